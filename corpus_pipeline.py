"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Toxic texts go; repeated runs of lines are deleted, and documents of which nothing is left go; one document of each
group of near copies stays (that of smallest doc_id, without an id only if none has one); documents that hold a
benchmark item go; the rest is packed into token sequences. All stages but the last return the columns of documents,
further ones as they are, whatever their names.
A row is its id and its text: what befalls one leaves others of its id, or without one, alone.

Defined results, in every stage: a null text is as empty and stays null; null and empty texts are never toxic, copies or
contaminated, so only equal rows of them become one; very long texts are read whole; an empty table stays empty. Rows
that repeat (same id and text) share a fate, and near_copies leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from longspan.llm.common import discard, table, text_key, tidied, unused, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from all labelled rows, does not reject.

    Without labelled texts of both classes nothing is learned, and all stay.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; n_chars is counted anew, and emptied documents go.

    Documents that no deletion touches keep their text and n_chars as they are, null or not.
    """
    lines, removed = unused(docs, "lines"), unused(docs, "removed")
    left = line_dedup.delete_repeats(docs, lines_col=lines, removed_col=removed)
    touched = F.size(removed) > 0
    counted = F.when(touched, F.length("text")).otherwise(F.col("n_chars"))
    return left.where(~(touched & (F.trim("text") == ""))).withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """docs without those whose doc_id and text_key are doc_id and key of one of rows."""
    rows = rows.select(F.col("doc_id").alias("__gone"), F.col(key).alias("__key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(rows["__gone"]) & (text_key(docs["text"]) == rows["__key"])
    return docs.join(rows, same, "left_anti")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similarity 0.8 or more on five-word shingles, of rows that repeat one too."""
    own = unused(docs, "key")
    kept = without(docs, jaccard_join.later_copies(docs, percent=80, width=5), "text_key")
    return kept.withColumn(own, text_key(F.col("text"))).dropDuplicates(["doc_id", own]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window is similar to a benchmark item; null and empty items match nothing."""
    return without(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")), "k")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; an empty text is its end alone."""
    return packing.digests(packing.pack(docs))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; each stage's scratch tables go when its result is written, and that when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with tidied(spark) as kept:
            docs = written(stage(spark, docs, sf_dir))
            kept.append(docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
