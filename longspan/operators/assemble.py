"""Assembly of panels: joins with contracts, densification, lagged panels, attrition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longspan.functions import is_month_start, to_month
from longspan.operators.quality import Check, ContractError, duplicate_keys, enforce, label_faults, required

REDUCER_LEFTOVERS = ("sum", "pix_mean", "pix")


def drop_redundant_reducers(df: DataFrame) -> DataFrame:
    """Without *_mean and *_count columns whose base is there, and without leftovers of spatial reducers."""
    have = set(df.columns)
    gone = [c for c in df.columns for s in ("_mean", "_count") if c.endswith(s) and c.removesuffix(s) in have]
    return df.drop(*gone, *REDUCER_LEFTOVERS)


def assert_unique(df: DataFrame, keys: list[str], name: str = "table") -> None:
    n = duplicate_keys(df, keys).agg(F.coalesce(F.sum("n_extra"), F.lit(0))).first()[0]
    if n:
        raise ContractError(f"{name}: {n} rows repeat a key of {keys}")


def join_static(panel: DataFrame, static: DataFrame, keys: list[str], prefer: str = "right", check: bool = True) -> DataFrame:
    """Every panel row with its static row, if any; columns on both sides come from prefer (right or left). Raises if static repeats a key."""
    if check:
        assert_unique(static, keys, "static")
    both = [c for c in static.columns if c in panel.columns and c not in keys]
    return (panel.drop(*both) if prefer == "right" else panel).join(static if prefer == "right" else static.drop(*both), keys, "left")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join of tables that both must have unique keys, so the number of rows stays."""
    assert_unique(left, keys, "left")
    return join_static(left, right, keys, prefer="left")


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_feat", drop: tuple[str, ...] = ()) -> DataFrame:
    """A left join; right columns that left has too get the suffix, those in drop go first."""
    right = right.drop(*drop)
    return left.join(right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in keys}), keys, "left")


def join_metadata(panel: DataFrame, meta: DataFrame, key: str, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """panel with the wanted columns it lacks, from one row per key of meta, and the names that neither has."""
    take = [c for c in wanted if c in meta.columns and c not in panel.columns]
    missing = [c for c in wanted if c not in meta.columns and c not in panel.columns]
    return (panel.join(first_rows(meta.select(key, *take), [key], take), key, "left") if take else panel), missing


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order; summed in the tasks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order or keys))).alias("r")) if rest else df.distinct()
    return one.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)) if rest else one


def first_per_cell(df: DataFrame, cell: str, date: str, columns: list[str]) -> DataFrame:
    """The first value of each column that is not null, in order of date."""
    return df.groupBy(cell).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns))


def absent(sample: DataFrame, panel: DataFrame, keys: list[str], reason: str | None = None) -> DataFrame:
    """Sampled rows that the panel lost; with a reason, in a column attrition_reason."""
    if reason is not None:
        return absent(sample, panel, keys).withColumn("attrition_reason", F.lit(reason))
    return sample.join(panel.select(*keys).distinct(), keys, "left_anti")


def present(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(chosen.select(*keys).distinct(), keys, "left_semi")


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both tables have."""
    return a.select(*keys).intersect(b.select(*keys))


GROUP_CELLS = 1024
MERGE_CELLS = 1 << 14


def densify(df: DataFrame, cells: DataFrame, cell: str, date: str, first, last, group_cells: int = GROUP_CELLS, merge_cells: int = MERGE_CELLS) -> DataFrame:
    """A row per cell and month from first to last; months without a row have nulls.

    The cells alone are few bytes, which Spark would put into one task; they are dealt into groups of about group_cells,
    so a task makes as many rows however many cells there are. Months of more than
    merge_cells cells are joined by merging: once shuffled they are few bytes too, and Spark might broadcast them all.
    """
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    own = cells.select(cell).distinct()
    n = own.count()
    rows = own.repartition(max(1, -(-n // group_cells)), cell).withColumn(date, months)
    return (rows.hint("merge") if n > merge_cells else rows).join(df, [cell, date], "left")


def lagged_panel(panel: DataFrame, cell: str, date: str, columns: list[str], keep: list[str]) -> DataFrame:
    """keep of each month with columns of the month before as *_lag1; each cell's first month goes. One window for all columns."""
    w = Window.partitionBy(cell).orderBy(date)
    out = panel.select(*keep, *(F.lag(c).over(w).alias(f"{c}_lag1") for c in columns), F.row_number().over(w).alias("__row"))
    return out.where("__row > 1").drop("__row")


def labelled(panel: DataFrame, source: str = "burned_flag", y: str = "y") -> DataFrame:
    """panel with its label column under the name y, as 0 or 1; raises if a label is null, no number, or another number."""
    required(panel, [source], "panel")
    if faults := {r["fault"]: r["n"] for r in label_faults(panel, source).collect()}:
        raise ContractError(f"{source} is no label of 0 or 1 in some rows: {faults}")
    return panel.withColumn(y, F.col(source).cast("double").cast("int")).drop(*([source] if source != y else []))


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """df with date as a date and year and month derived from it; raises if a date can't be read or is not the first of a month."""
    out = df.withColumn(date, to_month(F.col(date)))
    enforce(out, [Check("date_not_month_start", F.col(date).isNull() | ~is_month_start(F.col(date)))])
    return out.withColumns({"year": F.year(date), "month": F.month(date)})


def drop_nulls(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """df without rows that lack one of the columns (null or NaN), and how many rows each column costs alone: column, n."""
    required(df, columns, "table")
    kinds = dict(df.dtypes)
    lacks = {c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in columns}
    if not columns:
        return df, df.sparkSession.createDataFrame([], "column string, n long")
    counts = df.agg(*(F.count_if(x).alias(c) for c, x in lacks.items())).unpivot([], list(columns), "column", "n")
    return df.where(~reduce(lambda a, b: a | b, lacks.values())), counts


def shifted(panel: DataFrame, date: str, months: int = 1) -> DataFrame:
    return panel.withColumn(date, F.add_months(date, months))


def repair_core(df: DataFrame, column: str, base: DataFrame | None, key: str) -> DataFrame:
    """column as *_pass if it is binary or constant, else as *_inpanel_raw with base's values as *_raw beside it."""
    n, lo, hi = df.agg(F.count_distinct(column), F.min(column), F.max(column)).first()
    binary = n <= 1 or n == 2 and {float(lo), float(hi)} == {0.0, 1.0}
    out = df.withColumnRenamed(column, f"{column}_pass" if binary else f"{column}_inpanel_raw")
    if binary or base is None:
        return out
    raw = first_rows(base.select(key, F.col(column).alias(f"{column}_raw")), [key], [f"{column}_raw"])
    return out.join(raw, key, "left")


def spatial_block(df: DataFrame, meta: DataFrame | None, cell: str, size_km: float = 10.0, policy: str = "auto") -> tuple[DataFrame, str]:
    """df with a block column and its source: a block column in df, one in meta, lon and lat in meta, STRATUM, or none. policy: off, auto or require."""
    from longspan.functions import grid_index, grid_name, mercator

    names = ("spatial_block_id", "tile_id", f"grid{size_km:g}km_id")
    if policy == "off":
        return df, "off"
    for c in names:
        if c in df.columns:
            return df.withColumn("block", F.col(c)), f"panel:{c}"
    if meta is not None:
        for c in names:
            if c in meta.columns:
                return join_static(df, first_rows(meta.select(cell, F.col(c).alias("block")), [cell], ["block"]), [cell]), f"meta:{c}"
        if {"lon", "lat"} <= set(meta.columns):
            x, y = mercator(F.col("lon"), F.col("lat"))
            grid = meta.select(cell, grid_name(grid_index(x, size_km), grid_index(y, size_km)).alias("block"))
            return join_static(df, first_rows(grid, [cell], ["block"]), [cell]), "meta:lonlat"
    if "STRATUM" in df.columns:
        return df.withColumn("block", F.col("STRATUM").cast("string")), "panel:STRATUM"
    if policy == "require":
        raise ContractError("no source for a spatial block")
    return df, "none"


def tagged(df: DataFrame, **values) -> DataFrame:
    """df with constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def with_replicates(df: DataFrame, k: int, name: str = "fold_id") -> DataFrame:
    """Each row k times, numbered from 0, without a join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def between_dates(date: Column, first: str, last: str) -> Column:
    return date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
