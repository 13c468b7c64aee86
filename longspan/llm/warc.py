"""WARC archives written and read as a table of chunks.

A record's payload is cut into chunks of at most ``chunk_bytes``. Each chunk is one WARC segment: the first is a
``response`` (or ``revisit``) record, later ones are ``continuation`` records that name the first and their number.
Every segment carries the SHA-256 of the payload up to its own end, so a reader checks a record chunk by chunk and
never holds more than one. Spark's text writer puts the segments into gzip files; ``maxRecordsPerFile`` times
``chunk_bytes`` bounds a file, and a lost executor only repeats its own files. The reader takes other WARC files too,
gzip (a member per record) or plain, records without segments: their blocks are cut into chunks as they stream by, the
block of a record is its payload, and a SHA-256 is checked if one is stated. Header lines may be folded and need not be
UTF-8 (they are Latin-1 then), and zeros may pad a file's end. Spark hands the reader a file as one value, so a file may
have 2 GB at most, as it lies.

Defined results: null payload = empty; null url = empty; null ids are written and read as null; repeated rows each
give a record of their own, and all rows that hold the smallest id of their payload are responses; an empty table
gives an archive without records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import broadcast_if_small, scratch, table, written

CHUNK_BYTES = 1 << 16
RECORDS_PER_FILE = 4096
MIN_REVISIT_BYTES = 100
#: Digests of 32 bytes, so a broadcast is of some 20 MB at most.
BROADCAST_ROWS = 200_000
WARC_DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"

CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, stated_digest string, chunk_no int, last boolean, chunk_bytes long, running_digest string, from_start boolean, chunk binary"


def records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A row per page: page_id, url, payload (binary), digest, refers_to (smallest page_id with this payload, if another row's).

    Only ids and digests are shuffled to find copies, summed before. Digests that occur more than once are then sent to
    the payloads; beyond BROADCAST_ROWS of them payloads are shuffled, once, in a join that Spark may split.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy(F.unhex("digest").alias("copied"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    first = written(first)
    refers = F.when(F.col("first_id") != F.coalesce("page_id", F.col("first_id") - 1), F.col("first_id"))
    joined = rows.join(broadcast_if_small(first, first.count(), BROADCAST_ROWS), F.unhex("digest") == F.col("copied"), "left")
    return joined.withColumn("refers_to", refers).drop("first_id", "copied")


def _segments(chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        out, held = [], 0
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                page, refers = col["page_id"][i].as_py(), col["refers_to"][i].as_py()
                digest, url = col["digest"][i].as_py(), col["url"][i].as_py()
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                body = memoryview(col["payload"][i].as_buffer())
                key = f"{'' if page is None else page}"
                origin, n = f"<urn:record:{key}:{part}-{n}>", n + 1
                head = f"WARC-Date: {WARC_DATE}\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha256:{digest}\r\nPayload-Length: {len(body)}\r\nPage-Key: {key}\r\n"
                if refers is not None:
                    head += f"WARC-Refers-To-Key: {refers}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                    body = body[:0]
                total = max(1, -(-len(body) // chunk_bytes))
                running = hashlib.sha256()
                for k in range(total):
                    piece = body[k * chunk_bytes : (k + 1) * chunk_bytes]
                    running.update(piece)
                    kind = "continuation" if k else "response" if refers is None else "revisit"
                    own = origin if not k else f"{origin[:-1]}/{k}>"
                    lines = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {own}\r\n{head}WARC-Segment-Number: {k + 1}\r\nWARC-Segment-Origin-ID: {origin}\r\nSegment-Last: {int(k == total - 1)}\r\nRunning-Digest: sha256:{running.hexdigest()}\r\nContent-Length: {len(piece)}\r\n\r\n"
                    out.append(lines.encode() + bytes(piece))
                    held += len(out[-1])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return write


def write_archive(rows: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes records() as gzip WARC files under path."""
    segments = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_segments(chunk_bytes), "value binary")
    text = segments.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream:
    """Reads a buffer piece by piece: plain, or gzip, one member after the other, as WARC files have one per record."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.have, self.fresh = data, 0, bytearray(), True
        self.inflate = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.inflate is None:
            piece = bytes(self.data[self.at : self.at + (1 << 16)])
            self.at += len(piece)
            self.have += piece
            return bool(piece)
        while self.at < len(self.data):
            if self.fresh and self.data[self.at] == 0:  # zeros between members, or after the last one
                self.at += 1
                continue
            self.fresh = False
            piece = self.data[self.at : self.at + (1 << 16)]
            self.at += len(piece)
            got = self.inflate.decompress(piece)
            if self.inflate.eof:  # the rest belongs to the next member
                self.at -= len(self.inflate.unused_data)
                self.inflate, self.fresh = zlib.decompressobj(31), True
            elif self.at == len(self.data):
                raise ValueError("a gzip member ends before its time")
            if got:
                self.have += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.have.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.have)
            if not self.more():
                return b""
        out = bytes(self.have[:found])
        del self.have[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def _header(head: bytes) -> dict[str, str]:
    """Fields of a record's header in lower case; folded lines go on, lines without a colon say nothing, of several of a name the last counts."""
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    lines: list[str] = []
    for x in text.split("\r\n")[1:]:
        if x[:1] in (" ", "\t") and lines:
            lines[-1] += " " + x.strip()
        else:
            lines.append(x)
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def _parse(keep_bytes: bool):
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                stream, state = _Stream(memoryview(batch.column(0)[i].as_buffer())), (None, None)
                while head := stream.until(END).lstrip(b"\x00\r\n"):
                    h = _header(head)
                    number = lambda k, other=None: int(h[k]) if h.get(k) else other
                    size, own = number("content-length"), h["warc-record-id"]
                    origin, no, last = h.get("warc-segment-origin-id", own), number("warc-segment-number", 1), h.get("segment-last", "1") == "1"
                    stated = h.get("warc-payload-digest", "")
                    stated = stated[7:] if stated.startswith("sha256:") else None
                    # A record that isn't cut into segments is cut here.
                    cut = CHUNK_BYTES if "warc-segment-number" not in h else max(1, size)
                    for part in range(max(1, -(-size // cut))):
                        n = min(cut, size - part * cut)
                        body, final = stream.take(n), (part + 1) * cut >= size
                        if len(body) != n or final and stream.take(4) != END:
                            raise ValueError(f"truncated segment {own}")
                        digest = hashlib.sha256() if no + part == 1 else state[1] if state[0] == origin else None
                        state = (origin, digest)
                        if digest:
                            digest.update(body)
                        whole = digest is not None
                        ends = last and final
                        # A record that goes on in another file keeps its chunks, to be digested where they meet.
                        keep = body if keep_bytes or not whole or not last else None
                        rows.append((origin, number("page-key"), h.get("warc-target-uri"), h["warc-type"], number("warc-refers-to-key"), number("payload-length", size if last and no == 1 else None), stated, no + part, ends, n, digest.hexdigest() if whole else None, whole, keep))
                        held += len(keep or b"") + 400
                        if held > 1 << 22:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    return read


def read_chunks(spark: SparkSession, path: str, keep_bytes: bool = True) -> DataFrame:
    """The chunk table of the archives under path: a row per segment (see CHUNKS), its SHA-256 counted anew from the bytes read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInArrow(_parse(keep_bytes), CHUNKS)


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of record and number to a row per record."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "n_chunks"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32()]
    state, size, due = None, 0, 1
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["chunk_no"] == 1:
                state, size, due = hashlib.sha256(), 0, 1
                first = r
            if r["chunk_no"] != due:
                raise ValueError(f"chunk {due} of {r['record_id']} is missing")
            due, size = due + 1, size + r["chunk_bytes"]
            if r["chunk"] is not None:
                state.update(r["chunk"])
            if not r["last"]:
                continue
            digest = r["running_digest"] if r["chunk"] is None else state.hexdigest()
            if first["record_type"] == "response" and (digest != (r["stated_digest"] or digest) or size != (r["payload_bytes"] or size)):
                raise ValueError(f"payload of {r['record_id']} is damaged")
            out.append((first["page_id"], size if r["payload_bytes"] is None else r["payload_bytes"], r["stated_digest"] or digest, first["record_type"], first["refers_to"], first["url"], r["chunk_no"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record read back and checked against its digest: page_id, payload_bytes, payload_digest, record_type, refers_to, url, n_chunks."""
    chunks = read_chunks(spark, path, keep_bytes=False)
    dealt = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return dealt.mapInArrow(_join_chunks, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, n_chunks int")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_archive(records(table(spark, sf_dir, "pages")), path)
    return read_records(spark, path)


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to, url,
  CAST(CASE WHEN first_id <> page_id THEN 1 ELSE greatest(1, (n + 65535) // 65536) END AS INTEGER) AS n_chunks
FROM p LEFT JOIN f USING (d)"""
}
