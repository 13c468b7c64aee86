"""Collocations: frequent phrases by hashed bucket counts and Apriori pruning, scored by their weakest cut.

Pass 1 counts words, and bucket-counts the pairs that follow one another. Pass n counts exactly the n-word phrases that
may be frequent, those of which both (n-1)-word parts are frequent and whose bucket was met often enough, and
bucket-counts phrases of n + 1 words of which both n-word parts passed. Buckets met often enough, and the phrases that
proved frequent, go to the next pass as two broadcast bitmaps of the same size (a phrase that is not frequent may share
a bit; it is then counted, and dropped by its count). The number of buckets follows the characters of the corpus, from
``LEAST_BITS`` to ``MOST_BITS`` (2^28 bits, 32 MB a bitmap): a corpus beyond some 10^10 characters fills the buckets,
and then only the parts' bits prune; counts stay exact.

Tasks cut texts into chunks of ``CHUNK`` characters (or one text, if longer) and sum a chunk's words, phrases and buckets
before they are shuffled, so one that a third of all rows hold is a row per chunk. Buckets are shuffled in ranges, as
offsets and counts of up to two bytes and one, and summed as they stream by. The phrases' parts are found by joins that
Spark may split; each lang's best are ranked within parts first.

Defined results: null text = empty, with no words; a null lang is ``und``; ids don't count, and rows that repeat
count each; an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longspan.llm.common import table, written

MIN_COUNT = 10
MOST_WORDS = 3
#: Percent of a phrase's occurrences in one longer phrase from which on it is dropped.
INSIDE = 50
TOP = 2000
CHUNK = 16_000_000
LEAST_BITS, MOST_BITS = 20, 28
#: Characters for each bucket: some two pairs of words.
BUCKET_CHARS = 12
#: Buckets of one range, as a power of two.
RANGE_BITS = 16
FOUND = "lang string, phrase string, n long, part int, offsets binary, counts binary"
#: By byte: A-Z to lower case, all separators to BREAK, which no word holds.
BREAK = b";"
STEP = bytes(BREAK[0] if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Words numbered from 1 as they come; 0 stands between pieces."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _follow(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The code of a phrase and a word after it, from their codes."""
    return _mix(code * SEED + word)


def _code(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")))


def bucket(code: np.ndarray, bits: int) -> np.ndarray:
    return (code >> np.uint64(64 - bits)).astype(np.int64)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Bitmaps:
    """What a pass knows of phrases one word shorter (parts) and of buckets of its own."""

    def __init__(self, bits: int, parts: np.ndarray, buckets: np.ndarray):
        self.bits, self.parts, self.buckets = bits, parts, buckets


def _passed(ids: np.ndarray, words: np.ndarray, n: int, held: _Bitmaps | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in ids at which an n-word phrase begins that may be frequent, and the codes of those phrases."""
    at = np.flatnonzero(ids)
    code, part = words[ids[at]], None
    for k in range(1, n):
        # part: the code of the phrase without its first word, which is kept beside it.
        on = (at + k < len(ids)) & (ids[np.minimum(at + k, len(ids) - 1)] > 0)
        at, code, part = at[on], code[on], None if part is None else part[on]
        last = words[ids[at + k]]
        if k == n - 1 and held is not None:
            on = _has(held.parts, bucket(code, held.bits))
            at, code, part, last = at[on], code[on], None if part is None else part[on], last[on]
            tail = last if part is None else _follow(part, last)
            on = _has(held.parts, bucket(tail, held.bits))
            at, code, last = at[on], code[on], last[on]
            code = _follow(code, last)
            on = _has(held.buckets, bucket(code, held.bits))
            return at[on], code[on]
        part = last if part is None else _follow(part, last)
        code = _follow(code, last)
    return at, code


def _counted(lang: str, texts: list[bytes], n: int, last: bool, bits: int, least: int, held: _Bitmaps | None) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND from the texts of one lang: phrases of n words with their counts, and buckets of those of n + 1."""
    number = _Numbers({BREAK: 0})
    joined = b"\n".join(texts).translate(STEP).replace(BREAK, b" " + BREAK + b" ")
    tokens = joined.split()
    del joined
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    names = list(number)
    words = np.fromiter((_code(lang, w) for w in names), np.uint64, len(names))
    at, code = _passed(ids, words, n, held)
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.array([], np.int64)
    times = np.diff(np.concatenate([first, [len(code)]]))
    # Different phrases of one code stand apart only by their words: those of a code are compared with its first.
    columns = [ids[at + k] for k in range(n)]
    begin = np.repeat(first, times)
    apart = reduce(np.logical_or, [c != c[begin] for c in columns]) if len(code) else np.array([], bool)
    if apart.any():
        rows = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        columns, times = list(rows[0].T), rows[1]
    else:
        columns = [c[first] for c in columns]
    phrases = [b" ".join(x) for x in zip(*([names[i] for i in c.tolist()] for c in columns))]
    if phrases:
        nothing = pa.nulls(len(phrases), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()), pa.nulls(len(phrases), pa.int32()), nothing, nothing], FIELDS)
    if last:
        return
    if n == 1:
        longer, codes = _passed(ids, words, 2, None)
    else:
        here = np.zeros(len(ids) + 1, bool)
        here[at] = True
        codes_at = np.zeros(len(ids), np.uint64)
        codes_at[at] = code
        longer = np.flatnonzero(here[:-1] & here[1:])
        codes = _follow(codes_at[longer], words[ids[longer + n]])
    yield from _ranges(bucket(codes, bits), least)


FIELDS = [x.split()[0] for x in FOUND.split(", ")]


def _ranges(buckets: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Buckets in ranges: sorted offsets in two bytes, and counts, of which ``least`` is enough, in one or more."""
    met, times = np.unique(buckets, return_counts=True)
    if not len(met):
        return
    kind = "<u1" if least < 256 else "<u4"
    part = met >> RANGE_BITS
    parts, begins = np.unique(part, return_index=True)
    offsets = (met & ((1 << RANGE_BITS) - 1)).astype("<u2")
    counts = np.minimum(times, least).astype(kind)
    ends = [*begins[1:].tolist(), len(met)]
    cut = [(offsets[a:z].tobytes(), counts[a:z].tobytes()) for a, z in zip(begins.tolist(), ends)]
    none = pa.nulls(len(parts), pa.string())
    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(parts), pa.int64()), pa.array(parts, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*cut))], FIELDS)


def _pass(n: int, last: bool, bits: int, least: int, chunk: int, held: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, texts, size = held.value if held else None, {}, 0

        def ready() -> Iterator[pa.RecordBatch]:
            for lang, own in texts.items():
                yield from _counted(lang, own, n, last, bits, least, maps)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text.encode("utf-8", "surrogatepass")
                if size and size + len(text) > chunk:
                    yield from ready()
                    texts, size = {}, 0
                texts.setdefault(lang, []).append(text)
                size += len(text)
        yield from ready()

    return run


def _often(least: int):
    """Of ranges in order of part: the bits of buckets met at least ``least`` times. One range's counts are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = None, np.zeros(1 << RANGE_BITS, np.int64)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([held], pa.int32()), "bits": pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())})

        for b in batches:
            for part, offsets, times in zip(*(b.column(x).to_pylist() for x in ("part", "offsets", "counts"))):
                if part != held:
                    if held is not None:
                        yield bits()
                    held = part
                    counts[:] = 0
                # Offsets of one row are distinct. Sums stop at least, so they hold at any number of rows.
                at = np.frombuffer(offsets, "<u2")
                counts[at] = np.minimum(counts[at] + np.frombuffer(times, "<u1" if least < 256 else "<u4"), least)
        if held is not None:
            yield bits()

    return run


def _bits_of(bits: int):
    """Ranges of the buckets of phrases, each met once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                code, *more = (np.array([_code(lang, w)], np.uint64) for w in phrase.encode("utf-8", "surrogatepass").split(b" "))
                codes.append(reduce(_follow, more, code))
            if codes:
                for found in _ranges(bucket(np.concatenate(codes), bits), 1):
                    yield found.select(["part", "offsets", "counts"])

    return run


def bitmap(ranges: DataFrame, bits: int, least: int) -> np.ndarray:
    """The bits of the buckets that ranges (part, offsets, counts) meet at least ``least`` times: 2^bits bits, whatever the rows."""
    merged = ranges.repartition("part").sortWithinPartitions("part").mapInArrow(_often(least), "part int, bits binary")
    out, size = np.zeros(max(1 << bits, 1 << RANGE_BITS) >> 3, np.uint8), (1 << RANGE_BITS) >> 3
    for r in merged.collect():  # 2^MOST_BITS bits at most
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, lang_col: str = "lang", text_col: str = "text", chunk: int = CHUNK, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, a of all phrases of up to most_words words met at least min_count times, and lang, n of all langs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text"))
    if bits is None:
        chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, int(chars // BUCKET_CHARS).bit_length()))
    held, all_words, out = None, None, []
    for n in range(1, most_words + 1):
        found = written(rows.mapInArrow(_pass(n, n == most_words, bits, min_count, chunk, held), FOUND))
        if held is not None:
            held.destroy()
        sums = found.where("part IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        if n == 1:
            sums = written(sums)
            all_words = sums.groupBy("lang").agg(F.sum("a").alias("n"))
        known = written(sums.where(F.col("a") >= min_count).select("lang", "phrase", F.lit(n).alias("words"), "a"))
        out.append(known)
        if n < most_words:
            often = bitmap(found.where("part IS NOT NULL").select("part", "offsets", "counts"), bits, min_count)
            own = bitmap(known.select("lang", "phrase").mapInArrow(_bits_of(bits), "part int, offsets binary, counts binary"), bits, 1)
            held = spark.sparkContext.broadcast(_Bitmaps(bits, own, often))
    return reduce(DataFrame.unionByName, out), all_words


def _words(first: Column, size: Column) -> Column:
    """The phrase of size words from the first-th (from 1) of column w."""
    return F.array_join(F.slice("w", first, size), " ")


def scored(phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, words, a, l, r, score of phrases of two words or more, without those that mostly stand in one longer phrase.

    Scores are exact up to counts of 10^16: products are decimals of 38 digits.
    """
    many = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    one = F.lit(1)
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _words(one, F.col("k")).alias("left"), _words(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.withColumnsRenamed({"part": side, "f": f}), ["lang", side])
    score = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(1000000 AS DECIMAL(7, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    longer = many.where("words > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("whole"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("whole") < inside * F.col("a"), F.lit(True)))
    return kept.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def ranked(phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``top``: best within parts of a lang, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = phrases.withColumn("own", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "own").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases, totals = frequent(table(spark, sf_dir, "documents").select("lang", "text"))
    return ranked(scored(phrases), totals)


QUERIES = {"op11_phrases": op11_phrases}
ORACLE_SQL = {
    "op11_phrases": r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT *, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)
), scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.c, x.a AS l, y.a AS r, CAST((CAST(cuts.a AS HUGEINT) * cuts.a * 1000000) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.lp JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rp
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS whole FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM cand WHERE k = 3) GROUP BY ALL
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) LEFT JOIN longer USING (lang, phrase) WHERE whole IS NULL OR 100 * whole < 50 * a QUALIFY rank <= 2000"""
}
