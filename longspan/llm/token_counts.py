"""Token counts of documents: pieces are counted once per distinct pre-token, and no token ids are made.

A byte-level BPE cuts a text into pre-tokens by a pattern and merges each for itself, so a text's count is the sum over
its distinct pre-tokens of frequency times pieces. Tasks cut texts into chunks of ``CHUNK`` characters and number each
chunk's distinct pre-tokens; a document is then the numbers and frequencies of its own. The chunks' distinct pre-tokens
are shuffled by hash, and each is counted once there (its special strings are one token each); what comes back to a chunk
is one small number for each of its pre-tokens, and a product of the chunk's sparse matrix of frequencies with them is
the result. A pre-token that nearly all texts hold is one row a chunk, so no task gets more than its share. The number of
hash buckets follows the characters of the corpus, so a bucket holds a bounded number of pre-tokens; a chunk holds
``CHUNK`` characters or, if that is longer, one text.

Defined results: null text = empty, with 0 tokens; rows that repeat and rows without an id are counted each for
itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
LIMIT = 512
CHUNK = 32_000_000
#: Characters of the corpus for each hash bucket, and the least number of buckets.
BUCKET_CHARS, LEAST_BUCKETS = 4_000_000, 256
#: Rows of documents that are packed together.
BLOCK_DOCS = 1024
PACKED = "chunk long, bucket int, words binary, at binary, docs binary, sizes binary, numbers binary, frequencies binary"


class Pieces:
    """The pre-tokens of the vocabulary in ``name`` and their pieces."""

    held: dict[str, Pieces] = {}

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(public_tokenizers.path(name.replace(".tiktoken", ".json")), encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"] if x["special"]}
        ranks = {token: rank for token, rank in ranks.items() if rank not in special.values()}
        self.special = special
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.between = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(special, key=len, reverse=True)))
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, name: str) -> Pieces:
        if name not in cls.held:
            cls.held[name] = cls(name)
        return cls.held[name]

    def frequencies(self, text: str) -> Counter:
        """Pre-tokens of a text, special strings among them, with their frequencies."""
        if not any(x in text for x in self.special):
            return Counter(self.pattern.findall(text))
        found: Counter = Counter()
        for part in self.between.split(text):
            if part in self.special:
                found[part] += 1
            elif part:
                found.update(self.pattern.findall(part))
        return found

    def count(self, word: str) -> int:
        """Pieces of a pre-token. One that is a special string was met as such: no pattern yields it."""
        return 1 if word in self.special else len(self.encoding.encode_ordinary(word))


def _pack(values, kind) -> bytes:
    """An array, split into planes of bytes so that they compress, as zstd."""
    planes = np.asarray(values).astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Chunk:
    """Documents of one chunk, numbered from 0, and the distinct pre-tokens that they hold."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.word: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.sizes: list[int] = []
        self.numbers: list[int] = []
        self.frequencies: list[int] = []

    def add(self, row: tuple, found: Counter) -> None:
        word = self.word
        self.rows.append(row)
        self.sizes.append(len(found))
        self.numbers.extend([word.setdefault(x, len(word)) for x in found])
        self.frequencies.extend(found.values())

    def packed(self, buckets: int) -> Iterator[tuple]:
        """Rows of PACKED: for each bucket the words that fall there with their numbers, and the documents in blocks."""
        words = [x.encode("utf-8", "surrogatepass") for x in self.word]
        bucket = np.fromiter((zlib.crc32(x) % buckets for x in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        kinds, begins = np.unique(bucket[order], return_index=True)
        for b, at in zip(kinds.tolist(), np.split(order, begins[1:])):
            own = [words[i] for i in at.tolist()]
            text = zstandard.compress(b"".join(own), 1)
            yield self.number, b, text, _pack(at, "<u4"), None, _pack([len(x) for x in own], "<u4"), None, None
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        # Words are numbered as they come, so frequent ones have small numbers, which compress well.
        numbers, frequencies = np.array(self.numbers, np.int64), np.array(self.frequencies, np.int64)
        for a in range(0, len(self.rows), BLOCK_DOCS):
            z = min(a + BLOCK_DOCS, len(self.rows))
            part = slice(ends[a], ends[z])
            docs = pa.RecordBatch.from_pylist([dict(zip(("i", "b"), r)) for r in self.rows[a:z]], DOCS)
            yield self.number, -1, None, None, _stream(docs), _pack(self.sizes[a:z], "<u4"), _pack(numbers[part], "<u4"), _pack(frequencies[part], "<u4")


DOCS = pa.schema([("i", pa.int64()), ("b", pa.int64())])


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 1)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _cut(name: str, buckets: int, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(name)
        task = TaskContext.get().partitionId() << 32
        chunk, made = _Chunk(task), 0
        for b in batches:
            for i, size, text in zip(*(b.column(x).to_pylist() for x in range(3))):
                if chunk.chars and chunk.chars + len(text) > chunk_chars:
                    for row in chunk.packed(buckets):
                        yield _batch([row], PACKED)
                    made += 1
                    chunk = _Chunk(task + made)
                chunk.chars += len(text)
                chunk.add((i, size), pieces.frequencies(text))
        rows = list(chunk.packed(buckets))
        if rows:
            yield _batch(rows, PACKED)

    return run


COUNTED = "chunk long, at binary, pieces binary"


def _count(name: str):
    """Of a bucket's words of all chunks: each distinct one counted once, and its pieces for each chunk that holds it."""

    def run(rows: pa.Table) -> pa.Table:
        pieces, known, out = Pieces.of(name), {}, []
        for chunk, text, sizes, at in zip(*(rows.column(x).to_pylist() for x in ("chunk", "words", "sizes", "at"))):
            text, ends = zstandard.decompress(text), np.cumsum(_unpack(sizes, "<u4")).tolist()
            own = []
            for a, z in zip([0, *ends], ends):
                word = text[a:z]
                if word not in known:
                    known[word] = pieces.count(word.decode("utf-8", "surrogatepass"))
                own.append(known[word])
            out.append((chunk, at, _pack(own, "<u4")))
        return pa.Table.from_batches([_batch(out, COUNTED)])

    return run


def _sum(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """doc_id, n_bytes, n_tokens of a chunk's documents."""
    at = [_unpack(x, "<u4") for x in counted.column("at").to_pylist()]
    pieces = np.zeros(sum(map(len, at)), np.int64)
    for where, n in zip(at, counted.column("pieces").to_pylist()):
        pieces[where] = _unpack(n, "<u4")
    out = []
    for packed, sizes, numbers, frequencies in zip(*(docs.column(x).to_pylist() for x in ("docs", "sizes", "numbers", "frequencies"))):
        rows = pa.ipc.open_stream(zstandard.decompress(packed)).read_all()
        ends = np.concatenate([[0], np.cumsum(_unpack(sizes, "<u4"), dtype=np.int64)])
        total = np.concatenate([[0], np.cumsum(pieces[_unpack(numbers, "<u4")] * _unpack(frequencies, "<u4"))])
        out.append(pa.table([rows.column("i"), rows.column("b"), pa.array(total[ends[1:]] - total[ends[:-1]])], ["doc_id", "n_bytes", "n_tokens"]))
    return pa.concat_tables(out) if out else pa.table({x: pa.array([], pa.int64()) for x in ("doc_id", "n_bytes", "n_tokens")})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(chars // bucket_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.octet_length(text).cast("long").alias("b"), text.alias("text"))
    packed = written(rows.mapInArrow(_cut(vocabulary, buckets, chunk_chars), PACKED))
    words = packed.where("bucket >= 0").select("chunk", "bucket", "words", "sizes", "at")
    counted = words.groupBy("bucket").applyInArrow(_count(vocabulary), COUNTED)
    chunks = packed.where("bucket < 0").select("chunk", "docs", "sizes", "numbers", "frequencies")
    return chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op12_token_counts": op12_token_counts}
ORACLE_SQL: dict[str, str] = {}
