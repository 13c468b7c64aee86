"""Tables written to the folder that driver and executors share, so that a lost executor repeats one step and not a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. If that is unset, a local one in local mode (as in tests), and an error on a cluster."""
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


def written(df: DataFrame) -> DataFrame:
    """df as it was when written: Parquet in the shared folder, read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._longspan_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables from which nothing is to be computed any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._longspan_path)
        at.getFileSystem(t.sparkSession._jsc.sc().hadoopConfiguration()).delete(at, True)
