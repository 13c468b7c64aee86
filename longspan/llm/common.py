"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class for Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
#: Texts of a batch that an Arrow function takes at once.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Unset, it is a local one in local mode (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            root = f"file://{tempfile.mkdtemp(prefix='longspan-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/longspan-{uuid.uuid4().hex}"


#: Paths of the tables written so far and not discarded, by the driver that wrote them.
_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df, cut from its lineage: written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._longspan_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)
    _tables.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables of which nothing that is still to be computed reads."""
    for t in tables:
        _delete(t.sparkSession, t._longspan_path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """At its end deletes what was written within, but for the written tables that were put into the list it gives."""
    before, kept = set(_tables), []
    yield kept
    for path in [x for x in _tables if x not in before and x not in {t._longspan_path for t in kept}]:
        _delete(spark, path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, so that what is made of them is small whatever the batches are."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is executed within, and not later, gives Python at most SLICE rows at once: a batch of whole texts is held in the JVM too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= SLICE:
        spark.conf.set(key, str(SLICE))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Gives memory that was freed back to the system; allocators would keep it, in workers that wait for a task too."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if give_back is not None:
        give_back(0)


def lean(run: Callable) -> Callable:
    """run, a function for mapInArrow, that gives freed memory back after each batch and at its end."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                trim()

        yield from run(each())
        trim()

    return trimmed


def lower_ascii(c):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text):
    """128 bits that stand for a text, as a column; with its id they are a row's identity. Null is as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if rows, its counted size, is at most limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    return next(x for k in range(len(df.columns) + 1) if (x := f"__{name}{k}") not in df.columns)
