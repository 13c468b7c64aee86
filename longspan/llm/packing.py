"""Lexical retrieval packing of documents into token sequences.

Documents are put in order of a MinHash of their ids (then of another, and doc_id), so that texts with ids in common
stand near one another, by ranges that Spark balances; each task cuts its range into shards of ``shard_docs``
rows or ``SHARD_TOKENS`` tokens. In each shard a BM25 inverted index over token ids returns, for the document that
opens a window (the seed), all of its neighbours that no window has used yet, best first; they fill the window greedily:
first those that fit whole, then the best of the rest is cut at the window's end and its remainder opens the next
window. If no neighbour is left the next document in order goes on. So every sequence is full but a shard's last, which
is divided into powers of two down to ``smallest``; at 1, nothing needs padding. A task holds one shard, and rows that
repeat are dealt over ranges by a number of their own. Neighbours are looked for within the shard: a bounded part of the
corpus that holds the texts nearest by the order, not all of it.

Defined results: null text = empty; an empty document is its end id alone; rows that repeat are packed each for
itself; null ids stay null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import lean, sliced, table, written

WINDOW = 2048
SHARD_DOCS = 1000
END_ID = 1
K1, B = 1.2, 0.75
SHARD_TOKENS = 4_000_000
SMALLEST = 1


class Tokenizer:
    """The byte-level BPE in ``name``, with its special strings.

    tiktoken holds the vocabulary of the tokenizers file and gives the same ids (tests/llm compares the two) in a
    quarter of the time.
    """

    held: dict[str, Tokenizer] = {}

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(public_tokenizers.path(name.replace(".tiktoken", ".json")), encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"] if x["special"]}
        ranks = {token: rank for token, rank in ranks.items() if rank not in special.values()}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, name: str) -> Tokenizer:
        if name not in cls.held:
            cls.held[name] = cls(name)
        return cls.held[name]

    def ids(self, text: str, end: int) -> np.ndarray:
        ids = self.encoding.encode_to_numpy(text, allowed_special="all")
        return np.concatenate([ids, np.array([end], np.uint32)])


class Index:
    """BM25 postings of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], k1: float, b: float):
        self.n = len(docs)
        counts = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in counts])
        term = np.concatenate([t for t, _ in counts]).astype(np.int64)
        tf = np.concatenate([c for _, c in counts]).astype(np.float64)
        doc = np.repeat(np.arange(self.n), sizes)
        length = np.array([len(d) for d in docs], np.float64)
        df = np.bincount(term)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length / length.mean())[doc]))
        self.term, self.begin = term, np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(term, kind="stable")
        self.by_term_doc, self.by_term_weight = doc[order], self.weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a term with the seed, best score first, ties to the earlier one."""
        spans = [(self.at[t], self.at[t + 1]) for t in self.term[self.begin[seed] : self.begin[seed + 1]].tolist()]
        docs = np.concatenate([self.by_term_doc[x:y] for x, y in spans])
        score = np.bincount(docs, np.concatenate([self.by_term_weight[x:y] for x, y in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill(docs: list[np.ndarray], window: int = WINDOW, k1: float = K1, b: float = B, smallest: int = SMALLEST) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard's documents."""
    index, unused = Index(docs, k1, b), np.ones(len(docs), bool)
    size = np.array([len(d) for d in docs])
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, offset, next_doc = 0, 0, 0

    def put(doc: int, start: int) -> int:
        """Puts what fits of a document into the window; where the next piece starts."""
        nonlocal sequence, offset
        n = min(int(size[doc]) - start, window - offset)
        pieces.append((doc, start, n, sequence, offset))
        offset += n
        if offset == window:
            sequence, offset = sequence + 1, 0
        return start + n

    seed, start = -1, 0
    while True:
        if seed < 0:
            while next_doc < len(docs) and not unused[next_doc]:
                next_doc += 1
            if next_doc == len(docs):
                break
            seed, start = next_doc, 0
            unused[seed] = False
        opener = seed
        while start < size[seed]:
            start = put(seed, start)
        seed, start = -1, 0
        if not offset:
            continue
        found = index.neighbours(opener, unused)
        room = size[found]
        at = 0
        while offset and at < len(found):
            fits = np.flatnonzero(room[at:] <= window - offset)
            if not len(fits):
                break
            at += int(fits[0])
            unused[found[at]] = False
            put(int(found[at]), 0)
            at += 1
        if offset:
            found = found[unused[found]]
            if len(found):
                seed = int(found[0])
                unused[seed] = False
                start = put(seed, 0)
    return _divided(pieces, sequence, window, smallest)


def _divided(pieces: list[tuple[int, int, int, int, int]], last: int, window: int, smallest: int) -> list[tuple[int, int, int, int, int]]:
    """The pieces, those of the unfilled last sequence divided into sequences of powers of two."""
    tail = [p for p in pieces if p[3] == last]
    out = pieces[: len(pieces) - len(tail)]
    left = sum(p[2] for p in tail)
    power = window // 2
    room, offset = 0, 0
    for doc, start, n, _, _ in tail:
        while n:
            if not room:
                while power >= smallest and power > left:
                    power //= 2
                room, offset = (power if power >= smallest else left), 0
            take = min(n, room)
            out.append((doc, start, take, last, offset))
            start, n, room, offset, left = start + take, n - take, room - take, offset + take, left - take
            if not room:
                last += 1
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


TOKENS = "doc_id long, ids binary, wide boolean, first long, second long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    return (_mixed(ids.astype(np.uint64) + np.uint64(k + 1 << 32)) >> np.uint64(1)).astype(np.int64)


def tokens(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """A row per document: its ids in two bytes each, or four if wide, and two MinHashes of them (without the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, of_short = Tokenizer.of(vocabulary), [_hashes(np.arange(1 << 16), k) for k in (0, 1)]
        for b in sliced(batches):
            ids, wide, hashes = [], [], []
            for t in b.column(1):
                x = tokenizer.ids(t.as_py(), end_id)
                wide.append(bool(x.max() >> 16))
                ids.append(x.astype("<u4" if wide[-1] else "<u2").tobytes())
                hashes.append([int((h[x[:-1]] if not wide[-1] else _hashes(x[:-1], k)).min()) if len(x) > 1 else -1 for k, h in enumerate(of_short)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(wide), *(pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1))], [x.split()[0] for x in TOKENS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(lean(run), TOKENS)


def pack(docs: DataFrame, window: int = WINDOW, shard_docs: int = SHARD_DOCS, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    keys = ["first", "second", "doc_id", "own"]
    rows = written(tokens(docs, vocabulary, end_id)).withColumn("own", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        ids, docs_held, size = [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal base
            doc, start, n, sequence, offset = (list(x) for x in zip(*fill(ids, window)))
            part = [np.ascontiguousarray(ids[d][s : s + k], "<u4").tobytes() for d, s, k in zip(doc, start, n)]
            columns = [[docs_held[d] for d in doc], start, n, part, [len(ids[d]) for d in doc], [base + s for s in sequence], offset]
            base += sequence[-1] + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in batches:
            for d, x, wide in zip(*(b.column(k) for k in range(3))):
                ids.append(np.frombuffer(x.as_buffer(), "<u4" if wide.as_py() else "<u2").astype(np.uint32))
                docs_held.append(d.as_py())
                size += len(ids[-1])
                if len(ids) >= shard_docs or size >= SHARD_TOKENS:
                    yield shard()
                    ids, docs_held, size = [], [], 0
        if ids:
            yield shard()

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids", "wide").mapInArrow(lean(run), SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op1_packing": op1_packing}
ORACLE_SQL: dict[str, str] = {}
