"""Benchmark decontamination with SimHash of item-sized windows, in DataFrame operations only.

Items and documents are lower-cased words of letters and digits, in shingles of ``width`` words (a shorter item is one
shingle). A window has an item's length and lies where one of the item's shingles in the document puts it; a window
without one has similarity 0. (Document, item) pairs whose shared shingles can't reach the similarity even all together
go first. Each window and each item is a 64-bit SimHash of its shingles, weighted by their numbers of occurrences.
Fingerprints are cut into blocks, so few that two that differ in at most ``radius`` bits differ in at most ``FLIPS`` bits
of some block (for 19 bits five blocks of 13); items publish each block with up to so many bits turned, so the join on
(length, block, bits) finds all such pairs, and about a fifth of unrelated ones. Weighted Jaccard similarity (sum of least over sum of greatest counts)
then verifies each pair exactly. At similarity 0.8 the expected distance is 10 bits with a deviation of 3; 19 leaves a
margin of three deviations.

Windows of equal content are compared once. The items' shingles and the ids of documents that share some are broadcast
only below a counted number of rows, and are joined by a shuffle beyond it.

Defined results: null and empty texts and items match nothing; rows that repeat give the same pairs once; null ids are
returned as null; of several best windows the first counts; empty tables give no pairs; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import broadcast_if_small, table, text_key, written

WIDTH = 5
PERCENT = 80
RADIUS = 19
BROADCAST_ROWS = 500_000
BITS = 64
FLIPS = 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle(at: Column, width: int) -> Column:
    """The hash of width words from position at of the array w."""
    return F.xxhash64(*(F.get("w", at + k) for k in range(width)))


def fingerprints(windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, size (shingles in all), content (g and tf of each, sorted) and fp of windows, a row per key and shingle g."""
    tf = windows.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("tf"))
    votes = [F.sum(F.when(F.getbit("g", F.lit(k)) == 1, F.col("tf")).otherwise(-F.col("tf"))).alias(f"v{k}") for k in range(BITS)]
    sums = tf.groupBy(*keys).agg(F.sum("tf").alias("size"), F.sort_array(F.collect_list(F.struct("g", "tf"))).alias("content"), *votes)
    bits = [F.when(F.col(f"v{k}") > 0, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)) for k in range(BITS)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return sums.select(*keys, "size", "content", fp.alias("fp"))


def _edges(radius: int) -> list[tuple[int, int]]:
    """First and past the last bit of the blocks: four or so many that two fingerprints within radius differ in FLIPS bits of some block at most."""
    n = max(4, -(-(radius + 1) // (FLIPS + 1)))
    ends = [round(k * BITS / n) for k in range(n + 1)]
    return list(zip(ends, ends[1:]))


def _bits(lo: int, hi: int) -> Column:
    return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def blocks(radius: int) -> Column:
    """Block number and bits of fp, as an array of structs."""
    return F.array(*(F.struct(F.lit(k).alias("block"), _bits(lo, hi).alias("bits")) for k, (lo, hi) in enumerate(_edges(radius))))


def neighbours(radius: int) -> Column:
    """Block number and bits of fp with up to FLIPS bits of the block turned, as an array of structs."""

    flips = radius // len(_edges(radius))

    def of(k: int, lo: int, hi: int) -> Column:
        turned = [sum(1 << b for b in some) for f in range(flips + 1) for some in combinations(range(hi - lo), f)]
        return F.transform(F.array(*map(F.lit, turned)), lambda t: F.struct(F.lit(k).alias("block"), _bits(lo, hi).bitwiseXOR(t.cast("long")).alias("bits")))

    return F.concat(*(of(k, lo, hi) for k, (lo, hi) in enumerate(_edges(radius))))


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """doc_id, k (the text_key), item_id, start (word), shared, union (shingles) of each window at percent / 100 or more."""
    texts = docs.select("doc_id", text_key(F.col("text")).alias("k"), words(F.col("text")).alias("w"))
    asked = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    asked = asked.withColumns({"n": F.size("w"), "item": F.monotonically_increasing_id()})
    asked = written(asked.withColumn("width", F.least(F.lit(width), F.col("n"))))
    hits, own = None, None
    for r in asked.select("width").distinct().orderBy("width").collect():  # at most width values
        u = r["width"]
        some = asked.where(F.col("width") == u).select("item", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - u)).alias("q"))
        grams = written(some.select("item", "n", "q", shingle(F.col("q"), u).alias("g")))
        own = grams if own is None else own.unionByName(grams)
        there = texts.where(F.size("w") >= u).select("doc_id", "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - u)).alias("p"))
        found = there.select("doc_id", "k", "p", shingle(F.col("p"), u).alias("g")).join(broadcast_if_small(grams, grams.count(), BROADCAST_ROWS), "g")
        found = found.groupBy("doc_id", "k", "item", "n").agg(F.count_distinct("q").alias("met"), F.collect_set(F.col("p") - F.col("q")).alias("starts"))
        found = found.where(F.col("met") * 100 >= (F.col("n") - u + 1) * percent).withColumn("width", F.lit(u))
        hits = found if hits is None else hits.unionByName(found)
    schema = "doc_id long, k binary, item_id long, start int, shared long, union long"
    if hits is None:
        return docs.sparkSession.createDataFrame([], schema)
    hits = written(hits)
    starts = hits.select("doc_id", "k", "width", "n", F.explode("starts").alias("start")).distinct()
    windows = starts.groupBy("doc_id", "k").agg(F.collect_list(F.struct("width", "n", "start")).alias("windows"))
    windows = written(windows)
    placed = texts.join(broadcast_if_small(windows.withColumnRenamed("doc_id", "d"), windows.count(), BROADCAST_ROWS), (F.col("doc_id").eqNullSafe(F.col("d"))) & (texts["k"] == windows["k"]))
    placed = placed.select("doc_id", texts["k"], "w", F.explode("windows").alias("v")).select("doc_id", "k", "w", "v.*")
    first, last = F.greatest("start", F.lit(0)), F.least(F.size("w"), F.col("start") + F.col("n")) - F.col("width")
    spread = placed.where(last >= first).select("doc_id", "k", "w", "width", "n", "start", F.explode(F.sequence(first, last)).alias("p"))
    g = F.coalesce(*(F.when(F.col("width") == u, shingle(F.col("p"), u)) for u in range(1, width + 1)))
    prints = fingerprints(spread.select("doc_id", "k", "n", "start", "p", g.alias("g")).distinct(), ["doc_id", "k", "n", "start"])
    prints = written(prints.withColumn("c", F.xxhash64("content")))
    classes = prints.groupBy("n", "fp", "c").agg(F.first("content").alias("content"), F.first("size").alias("size"))
    of_items = fingerprints(own, ["item", "n"]).withColumnsRenamed({"fp": "item_fp", "content": "item_content", "size": "item_size"})
    left = classes.select("n", "fp", "c", F.inline(blocks(radius)))
    right = of_items.withColumn("fp", F.col("item_fp")).select("n", "item", "item_fp", F.inline(neighbours(radius)))
    near = left.join(right.hint("merge"), ["n", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("n", "fp", "c", "item").distinct()
    near = near.join(classes, ["n", "fp", "c"]).select("n", "fp", "c", "item", "size", F.inline("content"))
    shared = near.join(of_items.select("item", "item_size", F.inline("item_content").alias("g", "item_tf")), ["item", "g"])
    shared = shared.groupBy("n", "fp", "c", "item", "size", "item_size").agg(F.sum(F.least("tf", "item_tf")).alias("shared"))
    union = F.col("size") + F.col("item_size") - F.col("shared")
    good = written(shared.withColumn("union", union).where(F.col("shared") * 100 >= F.col("union") * percent).select("n", "fp", "c", "item", "shared", "union"))
    matched = prints.select("doc_id", "k", "n", "start", "fp", "c").join(good, ["n", "fp", "c"]).join(asked.select("item", "item_id"), "item")
    return matched.select("doc_id", "k", "item_id", "start", "shared", "union")


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (word), shared, size (shingles of the union), similarity of each pair at percent / 100 or more."""
    matched = matches(docs, items, width, percent, radius)
    similarity = F.col("shared") / F.col("union")
    best = F.min(F.struct((-similarity).alias("s"), "start", "shared", "union")).alias("b")
    return matched.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.start").cast("int").alias("start"), "b.shared", F.col("b.union").alias("size"), (-F.col("b.s")).alias("similarity"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE_SQL = {
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
de AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS p, w FROM d WHERE len(w) >= 5),
dg AS (SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] || ' ' || w[p + 5] AS g FROM de),
ie AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS q, w FROM i WHERE len(w) >= 5),
ig AS (SELECT item_id, n, q, w[q + 1] || ' ' || w[q + 2] || ' ' || w[q + 3] || ' ' || w[q + 4] || ' ' || w[q + 5] AS g FROM ie),
a AS (SELECT DISTINCT doc_id, item_id, n, p - q AS start FROM dg JOIN ig USING (g)),
wt AS (SELECT a.doc_id, item_id, n, start, g, count(*) AS tf FROM a JOIN dg ON a.doc_id = dg.doc_id AND p BETWEEN start AND start + n - 5 GROUP BY ALL),
it AS (SELECT item_id, g, count(*) AS tf FROM ig GROUP BY ALL),
m AS (SELECT doc_id, item_id, n, start, sum(wt.tf) AS size, sum(least(wt.tf, coalesce(it.tf, 0))) AS shared FROM wt LEFT JOIN it USING (item_id, g) GROUP BY ALL),
r AS (SELECT *, size + n - 4 - shared AS u FROM m WHERE 100 * shared >= 80 * (size + n - 4 - shared)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(shared AS DOUBLE) / CAST(u AS DOUBLE) DESC, start) AS k FROM r)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(shared AS BIGINT) AS shared, CAST(u AS BIGINT) AS size, CAST(shared AS DOUBLE) / CAST(u AS DOUBLE) AS similarity FROM b WHERE k = 1"""
}
