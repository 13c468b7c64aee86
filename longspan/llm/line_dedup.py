"""Deletion of repeated runs of lines by a suffix array over line ids.

Each document is the sequence of its lines that hold a word. Distributed prefix doubling sorts suffixes by their first
1, 2, 4, ... lines: a rank of 2^(k+1) lines is the order of the pair of ranks of 2^k lines at i and i + 2^k, and
positions whose prefix occurs once leave. Positions of equal rank at depth 2^k are an interval of the suffix array whose
longest common prefix is 2^k lines or more; two overlapping ranks give the interval of any other depth. A window repeats
if its interval holds an earlier position. Windows are the shortest of at least ``min_words`` words from each line
forwards and backwards, at most min_words lines, which bounds the number of rounds; those that overlap or touch and
repeat the same earlier copy line by line are one maximal repeated run, however long (``repeated_runs``). All lines of
later copies are deleted; the first copy, in order of doc_id and line, stays.

Pairs and windows are counted in the tasks before they are shuffled, and joins back on them are Spark's own, which
splits a line or run that much of the corpus shares.

Defined results: null text = empty, returned as it is; documents without words never change; rows that repeat (same id
and text) are one document, each returned alike; rows of one id with different texts are ordered by a hash of the text;
null ids come first; an empty table stays empty; further columns are returned as they are, but for one that has the name
given to the result's own (``lines_col``, ``removed_col``), which those replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from longspan.llm.common import lean, sliced, table, unused, written

MIN_WORDS = 50
LINES = "d long, k long, i int, line_no int, line binary, ahead int, back int"


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            for d, k, text in zip(*(b.column(x).to_pylist() for x in range(3))):
                lines = [(n, x) for n, x in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")) if x.strip()]
                if not lines:
                    continue
                total = np.cumsum([0] + [len(x.split()) for _, x in lines])
                n = len(lines)
                ahead = np.searchsorted(total, total[:-1] + min_words)  # the window from i ends before this line
                back = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # the window to i begins here
                at = np.arange(n)
                out[0].extend([d] * n)
                out[1].extend([k] * n)
                out[2].extend(range(n))
                out[3].extend(x for x, _ in lines)
                out[4].extend(hashlib.blake2b(x, digest_size=16).digest() for _, x in lines)
                out[5].extend(np.where(ahead <= n, ahead - at, 0).tolist())
                out[6].extend(np.where(back >= 0, at - back + 1, 0).tolist())
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [x.split()[0] for x in LINES.split(", ")])

    return run


def _identity(id_col: str, text_col: str):
    """Columns d (the id) and k (a hash of the text)."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _named(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows whose values in by occur more than once, with their rank in the order of by."""
    many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(written(many.orderBy(*by).withColumn(name, F.monotonically_increasing_id())), by)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Maximal repeated runs but their first copies, and the lines they name.

    Runs: d, k, i, size (lines) and first_d, first_k, first_i of the earlier copy. Lines: d, k, i, line_no of lines that
    occur more than once; i counts a document's lines with words, line_no all.
    """
    d, k = _identity(id_col, text_col)
    texts = docs.select(d.alias("d"), k.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = written(texts.mapInArrow(lean(_lines(min_words)), LINES)).dropDuplicates(["d", "k", "i"])
    base = written(_named(lines, ["line"], "r").drop("line"))
    ranks = [base.select("d", "k", "i", "r")]
    for level in range((max(1, min_words)).bit_length() - 1):
        p = ranks[-1]
        ahead = p.select("d", "k", (F.col("i") - F.lit(1 << level)).alias("i"), F.col("r").alias("s"))
        longer = written(_named(p.join(ahead, ["d", "k", "i"]), ["r", "s"], "t").select("d", "k", "i", F.col("t").alias("r")))
        if longer.isEmpty():
            break
        ranks.append(longer)
    all_ranks = ranks[0].withColumn("level", F.lit(0))
    for level, p in enumerate(ranks[1:], 1):
        all_ranks = all_ranks.unionByName(p.withColumn("level", F.lit(level)))
    both = F.array(
        F.struct(F.col("i").alias("i"), F.col("ahead").alias("size")),
        F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("size")),
    )
    windows = base.select("d", "k", F.explode(both).alias("w")).select("d", "k", "w.i", "w.size").where("size > 0").distinct()
    windows = windows.withColumn("level", F.floor(F.log2("size")).cast("int")).withColumn("j", (F.col("i") + F.col("size") - F.expr("shiftleft(1, level)")).cast("int"))
    head = all_ranks.withColumnRenamed("r", "a")
    tail = all_ranks.withColumnsRenamed({"i": "j", "r": "b"})
    named = written(windows.join(head, ["d", "k", "i", "level"]).join(tail, ["d", "k", "j", "level"]).select("d", "k", "i", "size", "a", "b"))
    # An interval's first position; written, so that Spark can split the join of an interval that holds much of the corpus.
    first = written(named.groupBy("size", "a", "b").agg(F.min(F.struct("d", "k", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = named.join(first, ["size", "a", "b"]).where(F.struct("d", "k", "i") != F.col("first"))
    later = later.select("d", "k", "i", (F.col("i") + F.col("size")).alias("end"), F.col("first.d").alias("first_d"), F.col("first.k").alias("first_k"), (F.col("i") - F.col("first.i")).alias("apart"))
    copy = ["d", "k", "first_d", "first_k", "apart"]
    w = Window.partitionBy(*copy).orderBy("i")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = later.withColumn("begins", F.when(F.col("i") <= reached, 0).otherwise(1)).withColumn("run", F.sum("begins").over(w))
    runs = begins.groupBy(*copy, "run").agg(F.min("i").alias("i"), F.max("end").alias("end"))
    return runs.select("d", "k", "i", (F.col("end") - F.col("i")).alias("size"), "first_d", "first_k", (F.col("i") - F.col("apart")).alias("first_i")), base


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, k, line_no of all lines to delete, each once."""
    runs, base = repeated_runs(docs, min_words, id_col, text_col)
    gone = runs.select("d", "k", F.explode(F.sequence("i", F.col("i") + F.col("size") - 1)).alias("i")).distinct()
    return gone.join(base.select("d", "k", "i", "line_no"), ["d", "k", "i"]).select("d", "k", "line_no")


@F.pandas_udf(StringType())
def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    """The lines of each text but those of the removed numbers; null where either is."""

    def left(t, gone):
        if t is None or gone is None:
            return None
        gone = set(gone.tolist())
        return "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)

    return pd.Series([left(t, g) for t, g in zip(text, removed)], dtype=object)


def delete_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", removed_col: str = "removed_lines") -> DataFrame:
    """docs with the text that stays, and lines_col, removed_col (numbers from 0, in order)."""
    gone = repeated_lines(docs, min_words, id_col, text_col).groupBy("d", "k").agg(F.sort_array(F.collect_list("line_no")).alias("lines"))
    d, k, lines = (unused(docs, x) for x in ("d", "k", "lines_of"))
    keep = [c for c in docs.columns if c not in (lines_col, removed_col)]
    keyed = docs.select(*keep, *(x.alias(n) for x, n in zip(_identity(id_col, text_col), (d, k))))
    joined = keyed.join(gone.withColumnsRenamed({"d": d, "k": k, "lines": lines}), [d, k], "left")
    left = _without(F.when(F.col(lines).isNotNull(), F.col(text_col)), F.col(lines))
    return joined.select(
        *(F.when(F.col(lines).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in keep),
        F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias(lines_col),
        F.coalesce(F.col(lines), F.array().cast("array<int>")).alias(removed_col),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return delete_repeats(docs).select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), "text")


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL = {
    "op10_line_dedup": r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents
), l AS (
  SELECT doc_id, line, line_no, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw
), c AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY line_no) AS cum FROM l WHERE w > 0
), spans AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.cum - a.cum + a.w >= 50 GROUP BY a.doc_id, a.i
  UNION
  SELECT a.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.cum - a.cum + a.w >= 50 GROUP BY a.doc_id, b.i
), runs AS (
  SELECT p.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS run FROM spans p JOIN c ON p.doc_id = c.doc_id AND c.i BETWEEN s AND e GROUP BY p.doc_id, s, e
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT DISTINCT c.doc_id, c.line_no FROM later p JOIN c ON p.doc_id = c.doc_id AND c.i BETWEEN s AND e
)
SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(gone.line_no) AS INTEGER) AS n_removed,
  coalesce(string_agg(CAST(l.line_no AS VARCHAR), ',' ORDER BY l.line_no) FILTER (gone.line_no IS NOT NULL), '') AS removed_lines,
  CASE WHEN count(gone.line_no) = 0 THEN any_value(text) ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (gone.line_no IS NULL), '') END AS text
FROM (SELECT l.*, text FROM l JOIN documents USING (doc_id)) l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line_no = gone.line_no GROUP BY l.doc_id"""
}
