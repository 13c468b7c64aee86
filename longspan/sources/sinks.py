"""Sinks, hashes and reports."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, existing: str = "error") -> str | None:
    """Writes df beside path and renames it there at the end, so readers see all or nothing. existing: error, overwrite or backup; returns the backup's path."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and existing == "error":
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    writer = df.write.option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    backup = old = None
    if fs.exists(target):
        if existing == "backup":
            backup = f"{path.rstrip('/')}.{time.strftime('%Y%m%d_%H%M%S')}.bak"
            fs.rename(target, _fs(spark, backup)[1])
        else:  # the old table stays beside until the new one stands
            old = _fs(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")[1]
            fs.rename(target, old)
    if not fs.rename(_fs(spark, staged)[1], target):
        raise OSError(f"can't move {staged} to {path}")
    if old is not None:
        fs.delete(old, True)
    return backup


def write_csv(df: DataFrame, path: str, digits: int = 6, mode: str = "errorifexists") -> None:
    """A small table as one CSV file, doubles rounded."""
    rounded = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_sheets(spark: SparkSession, sheets: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """A workbook as a folder: a table for each sheet, CSV or Parquet, and workbook.json with their order, names and columns."""
    if kind not in ("csv", "parquet"):
        raise ValueError(kind)
    folders = {name: "".join(c if c.isalnum() or c in "-_" else "_" for c in name) for name in sheets}
    if len(set(folders.values())) < len(folders):
        raise ValueError(f"sheets of one file name: {sorted(folders)}")
    for name, df in sheets.items():
        write_csv(df, f"{path}/{folders[name]}.csv") if kind == "csv" else write_parquet(df, f"{path}/{folders[name]}.parquet")
    manifest(spark, f"{path}/workbook.json", {"sheets": [{"name": n, "table": f"{folders[n]}.{kind}", "columns": df.columns} for n, df in sheets.items()]})


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report, manifest or list as one file in any store that Spark writes."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def manifest(spark: SparkSession, path: str, content: dict) -> None:
    write_text(spark, json.dumps(content, indent=2, sort_keys=True, default=str), path)


def markdown(title: str, sections: dict[str, DataFrame | str | list[str]], rows: int = 50) -> str:
    """A report; of tables the first rows."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", ""]
        if isinstance(body, DataFrame):
            out += ["| " + " | ".join(body.columns) + " |", "|" + "---|" * len(body.columns)]
            out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in body.limit(rows).collect()]
        else:
            out += [f"- {x}" for x in body] if isinstance(body, list) else [body]
        out.append("")
    return "\n".join(out)


def yaml_text(value, indent: int = 0) -> str:
    """Dicts, lists and scalars as YAML."""
    pad = "  " * indent
    if isinstance(value, dict):
        parts = []
        for k, v in value.items():
            nested = isinstance(v, (dict, list)) and v
            parts.append(f"{pad}{k}:\n{yaml_text(v, indent + (1 if isinstance(v, dict) else 0))}" if nested else f"{pad}{k}: {_scalar(v)}")
        return "\n".join(parts)
    return "\n".join(f"{pad}- {_scalar(v)}" for v in value)


def _scalar(v) -> str:
    if isinstance(v, (dict, list)):
        return "{}" if isinstance(v, dict) else "[]"
    return "null" if v is None else json.dumps(v) if isinstance(v, (bool, str)) else str(v)


def blacklist_text(exact: list[str], prefix: list[str] = (), regex: list[str] = ()) -> str:
    named = {"Forbidden exact columns": exact, "Forbidden prefix columns": prefix, "Forbidden regex columns": regex}
    return "\n".join(line for name, items in named.items() for line in (f"## {name}", *(f"- {x}" for x in items), "")) + "\n"


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_hash(df: DataFrame) -> DataFrame:
    """n_rows and an order-free content hash of all rows, one row."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"))
