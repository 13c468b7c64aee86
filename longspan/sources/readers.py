"""Readers of panel inputs."""

from __future__ import annotations

import csv
import json
import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READABLE = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


def read_csv_union(spark: SparkSession, paths: str | list[str], file_column: str = "__source_file__") -> DataFrame:
    """CSV files as one frame by column name, with blanks around headers gone and each row's file; raises if none match.

    One job reads all files' first lines; files of one header are read in one scan, so jobs follow the headers and not the files.
    """
    found = sorted(f for p in ([paths] if isinstance(paths, str) else paths) for f in _matching(spark, p))
    if not found:
        raise FileNotFoundError(f"no file matches {paths}")
    # The part of a file that begins it lies in one task, in order, so its first line is that task's first.
    lines = spark.read.text(found).select("value", "_metadata.file_path", "_metadata.file_block_start").where("file_block_start = 0")
    heads = lines.groupBy("file_path").agg(F.first("value").alias("head"))
    frames = []
    for r in heads.groupBy("head").agg(F.sort_array(F.collect_list("file_path")).alias("files")).orderBy("head").collect():  # names of files
        df = spark.read.option("header", True).csv(r["files"])
        header = [c.strip() for c in df.columns]
        origin = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        frames.append(df.select(*(F.col(f"`{a}`").alias(b) for a, b in zip(df.columns, header)), F.url_decode(origin).alias(file_column)))
    return union_by_name(frames)


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in found or []]


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Tasks read a file each; only the first one's schema comes to the driver."""
    import pyarrow as pa
    from pyarrow import feather
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def tables(batches):
        return (feather.read_table(pa.BufferReader(x.as_buffer())) for b in batches for x in b.column(0))

    def schema(batches):
        yield from (pa.record_batch([pa.array([t.schema.serialize().to_pybytes()])], ["schema"]) for t in tables(batches))

    def rows(batches):
        yield from (b for t in tables(batches) for b in t.to_batches())

    head = files.limit(1).mapInArrow(schema, "schema binary").first()[0]
    return files.mapInArrow(rows, from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(head))))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension; Feather files, which Spark has no source for, as Arrow files that tasks read, one each."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".feather":
        return _read_feather(spark, path)
    if kind not in READABLE:
        raise ValueError(f"can't read {path}")
    return spark.read.format(READABLE[kind]).options(header=True, inferSchema=True).load(path) if kind == ".csv" else spark.read.format(READABLE[kind]).load(path)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only these columns of a Parquet table; raises if one is missing."""
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def read_existing(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The tables among paths that exist, as one."""
    frames = [read_any(spark, p) for p in paths if _matching(spark, p)]
    return union_by_name(frames) if frames else None


def feature_list(path: str, column: str = "feature") -> list[str]:
    """The column of a feature-list CSV, without repeats, in order."""
    with open(path, newline="", encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    if rows and column not in rows[0]:
        raise ValueError(f"{path} has no column {column}")
    return list(dict.fromkeys(r[column].strip() for r in rows if r[column].strip()))


def feature_sets(path: str) -> dict[str, list[str]]:
    """F0, F1, F2 from the text that sinks.write_yaml writes, or from JSON; raises unless they are nested."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    sets = json.loads(text) if text.lstrip().startswith("{") else parse_yaml_lists(text)
    if missing := [k for k in ("F0", "F1", "F2") if k not in sets]:
        raise ValueError(f"missing sets: {missing}")
    if not set(sets["F0"]) <= set(sets["F1"]) <= set(sets["F2"]):
        raise ValueError("sets must be nested")
    return sets


def parse_yaml_lists(text: str) -> dict[str, list[str]]:
    """Names with lists of plain values, in block or flow style; any other YAML (nested, anchors, several documents) is an error that names its line."""
    out: dict[str, list[str]] = {}
    name, plain = "", lambda x: x.split(" #")[0].strip().strip("\"'")
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.split(" #")[0].rstrip()
        if bare.lstrip().startswith("#") or not bare.strip() or bare == "---" and not out:
            continue
        key, colon, rest = bare.partition(":")
        if not bare.startswith((" ", "-")) and colon and not rest:
            name = plain(key)
            out[name] = []
        elif not bare.startswith((" ", "-")) and colon and rest.strip().startswith("[") and rest.strip().endswith("]") and "[" not in rest.strip()[1:]:
            name = ""
            out[plain(key)] = [plain(x) for x in rest.strip()[1:-1].split(",") if x.strip()]
        elif bare.strip().startswith("- ") and name and not re.search(r":(\s|$)|^\s*- [-&*{\[|>]", bare):
            out[name].append(plain(bare.strip()[2:]))
        else:
            raise ValueError(f"line {number} is not a name with a list of plain values: {line.strip()!r}")
    return out


def parse_blacklist(text: str) -> dict[str, list[str]]:
    """Names by section of a blacklist: exact, prefix, regex. A ## line names a section before # lines count as remarks."""
    out: dict[str, list[str]] = {"exact": [], "prefix": [], "regex": []}
    section = ""
    for line in map(str.strip, text.splitlines()):
        if line.startswith("##"):
            section = next((k for k in out if k in line.lower()), "")
        elif line and not line.startswith("#") and section:
            out[section].append(line.removeprefix("-").strip())
    return out
