"""Running sums and row numbers over orders of any length, by ranges with offsets carried between them.

A window over a long order puts all of it into one task. Here rows are cut into ranges of about ``RANGE_ROWS`` in order
(Spark samples the bounds), each range is summed in its own task, and the sums of the ranges before it, a row for each
range and group, are added. Up to ``RANGE_ROWS`` rows in all one window does, which holds no more than a range would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longspan.sources.scratch import written

RANGE_ROWS = 1 << 20


def ranged(df: DataFrame, by: list[str], order: list[Column], parts: int, part: str = "__part") -> DataFrame:
    """df in about ``parts`` ranges of by and order, numbered in column part; written, so that numbers stay with rows."""
    return written(df.repartitionByRange(parts, *(F.col(b) for b in by), *order).withColumn(part, F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], whole: dict[str, Column] | None = None, range_rows: int = RANGE_ROWS, *, most: int | None = None) -> DataFrame:
    """df with running sums (of every row up to its own in order, by group) and with sums over the whole group.

    Order must be total within by. Null groups are a group. A caller that knows that df has at most ``most`` rows saves
    writing and counting a small one.
    """
    whole = whole or {}
    small = most is not None and most <= range_rows
    rows = df if small or hasattr(df, "_longspan_path") else written(df)
    n = most if small else rows.count()
    if n <= range_rows:
        up, all_rows = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
        return rows.withColumns({k: F.sum(c).over(up) for k, c in sums.items()} | {k: F.sum(c).over(all_rows) for k, c in whole.items()})
    parts = ranged(rows, by, order, -(-n // range_rows))
    totals = parts.groupBy(*by, "__part").agg(*(F.sum(c).alias(f"__s_{k}") for k, c in sums.items()), *(F.sum(c).alias(f"__w_{k}") for k, c in whole.items()))
    w = Window.partitionBy(*by)
    before = w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that the group has
    keys = [F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]
    offsets = written(totals.select(*keys, F.col("__part").alias("__at"), *(F.sum(f"__s_{k}").over(before).alias(f"__b_{k}") for k in sums), *(F.sum(f"__w_{k}").over(w).alias(k) for k in whole)))
    on = reduce(lambda a, b: a & b, [parts[b].eqNullSafe(offsets[f"__by{i}"]) for i, b in enumerate(by)], parts["__part"] == offsets["__at"])
    up = Window.partitionBy(*by, "__part").orderBy(*order)
    own = parts.join(offsets, on).withColumns({k: F.sum(c).over(up) + F.coalesce(F.col(f"__b_{k}"), F.lit(0)) for k, c in sums.items()})
    return own.select(*df.columns, *sums, *whole)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with each row's number from 1 in its group; order must be total."""
    return running(df, by, order, {name: F.lit(1).cast("long")}, range_rows=range_rows)
