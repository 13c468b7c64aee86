"""Features of a cell's past. All windows of a call share one partitioning and order, so they cost one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longspan.functions import order_key, safe_numeric, year_month_index

AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def by_cell(cell: str = "cell_id", date: str = "date"):
    return Window.partitionBy(cell).orderBy(date)


def label_lags(y: Column, lags: tuple[int, ...], w) -> dict[str, Column]:
    return {f"y_lag{k}": F.coalesce(F.lag(y, k).over(w), F.lit(0)).cast("int") for k in lags}


def count_in_last(flag: Column, months: int, w) -> Column:
    return F.sum(flag).over(w.rowsBetween(-(months - 1), 0)).cast("long")


def _last_row(flag: Column, w) -> Column:
    """The number of the latest row up to this one on which flag was 1, as a running count of rows less those since."""
    return F.last(F.when(flag == 1, F.col("__row")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def ever_before(y: Column, w) -> Column:
    return F.coalesce(F.max(y).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")


def ever_at_all(y: Column, cell: str) -> Column:
    """Over the whole series: looks ahead, so a diagnostic and never a predictor."""
    return F.max(y).over(Window.partitionBy(cell)).cast("int")


def rolling(column: str, months: int, aggregate: str, w) -> tuple[str, Column]:
    return f"{column}_roll{months}m_{aggregate}", AGGREGATES[aggregate](safe_numeric(F.col(column))).over(w.rowsBetween(-(months - 1), 0))


def memory_features(panel: DataFrame, cap: int, cell: str = "cell_id", date: str = "date", y: str = "y", months: int = 12, rolls: list[tuple[str, int, str]] = (), history: DataFrame | None = None) -> DataFrame:
    """panel with y_lag1, y_lag12, event_count, months_since_event, ever_before and rolling columns.

    Lags before a cell's first row are 0. history (cell, date, y) gives earlier labels for them, if there are any.
    """
    from longspan.operators.catalog import check_roll_columns

    check_roll_columns([c for c, _, _ in rolls])
    w = by_cell(cell, date)
    rows = panel
    if history is not None:
        earlier = history.join(panel.select(cell, date), [cell, date], "left_anti").select(cell, date, y).withColumn("__own", F.lit(False))
        rows = panel.withColumn("__own", F.lit(True)).unionByName(earlier, allowMissingColumns=True)
    out = rows.withColumns({**label_lags(F.col(y), (1, 12), w), "__row": F.row_number().over(w), "ever_before": ever_before(F.col(y), w), **dict(rolling(*r, w) for r in rolls)})
    since = F.least(F.coalesce(F.col("__row") - _last_row(F.col("y_lag1"), w), F.lit(cap)), F.lit(cap)).cast("int")
    out = out.withColumns({f"event_count_{months}m": count_in_last(F.col("y_lag1"), months, w), "months_since_event": since}).drop("__row")
    return out.where("__own").drop("__own") if history is not None else out


def months_since(panel: DataFrame, flag: str, cap: int, name: str = "months_since_event", cell: str = "cell_id", date: str = "date") -> DataFrame:
    w = by_cell(cell, date)
    rows = panel.withColumn("__row", F.row_number().over(w))
    return rows.withColumn(name, F.least(F.coalesce(F.col("__row") - _last_row(F.col(flag), w), F.lit(cap)), F.lit(cap)).cast("int")).drop("__row")


def backward_steps(panel: DataFrame, cell: str = "cell_id", date: str = "date", order: str | None = None) -> DataFrame:
    """Rows whose date is not after the one before it in order of the column order; without it, in order of date, only repeats."""
    previous = F.lag(date).over(by_cell(cell, order or date))
    return panel.withColumn("previous", previous).where(F.col(date) <= F.col("previous"))


def month_gaps(panel: DataFrame, cell: str = "cell_id", date: str = "date") -> DataFrame:
    """Rows that are not one month after the row before, with the step."""
    index = year_month_index(F.col(date))
    step = (index - F.lag(index).over(by_cell(cell, date))).cast("int")
    return panel.select(cell, date, step.alias("step")).where(F.col("step") != 1)


def last_rows(panel: DataFrame, k: int, cell: str = "cell_id", date: str = "date") -> DataFrame:
    w = Window.partitionBy(cell).orderBy(F.desc(date))
    return panel.withColumn("__row", F.row_number().over(w)).where(F.col("__row") <= k).drop("__row")


def sample_fixed(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows, the same at each run."""
    return df.orderBy(order_key(seed, *(F.col(c) for c in keys)), *keys).limit(n)


def sample_per_stratum(df: DataFrame, stratum: str, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(order_key(seed, *(F.col(c) for c in keys)), *keys)
    return df.withColumn("__row", F.row_number().over(w)).where(F.col("__row") <= n).drop("__row")


def first_cells(df: DataFrame, n: int, cell: str = "cell_id") -> DataFrame:
    return df.select(cell).distinct().orderBy(F.col(cell).cast("string")).limit(n)
