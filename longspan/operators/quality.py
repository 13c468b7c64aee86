"""Contracts on panels. Row checks are conditions that one pass counts together; each can fail, warn or be off."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longspan.functions import is_close, is_month_start


class ContractError(ValueError):
    """A table breaks its contract."""


@dataclass
class Check:
    """Rows for which bad holds break the contract."""

    name: str
    bad: Column
    mode: str = "fail"


def count_bad(df: DataFrame, checks: list[Check]) -> dict[str, int]:
    """Bad rows by check, in one pass."""
    live = [c for c in checks if c.mode != "off"]
    if not live:
        return {}
    row = df.agg(*(F.count_if(F.coalesce(c.bad, F.lit(False))).alias(c.name) for c in live)).first()
    return row.asDict()


def enforce(df: DataFrame, checks: list[Check], examples: int = 10) -> dict[str, int]:
    """Counts; raises on bad rows of a failing check, with examples, and warns of others."""
    counts = count_bad(df, checks)
    for c in checks:
        if n := counts.get(c.name):
            text = f"{c.name}: {n} rows, such as {[r.asDict() for r in df.where(c.bad).limit(examples).collect()]}"
            if c.mode == "fail":
                raise ContractError(text)
            warnings.warn(text, stacklevel=2)
    return counts


def panel_checks(date: str = "date", y: str = "y") -> list[Check]:
    return [
        Check("label_not_binary", F.col(y).isNull() | ~F.col(y).isin(0, 1)),
        Check("date_not_month_start", F.col(date).isNull() | ~is_month_start(F.col(date))),
    ]


def in_range(column: str, low, high, mode: str = "fail") -> Check:
    c = F.col(column)
    return Check(f"{column}_out_of_range", c.isNull() | (c < low) | (c > high), mode)


def memory_checks(cap: int, months: int = 12) -> list[Check]:
    return [in_range(f"event_count_{months}m", 0, months), in_range("months_since_event", 0, cap), in_range("y_lag1", 0, 1), in_range("y_lag12", 0, 1)]


def prediction_checks(columns: list[str]) -> list[Check]:
    return [Check(f"{c}_not_probability", F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)) for c in columns]


def required(df: DataFrame, columns: list[str], name: str = "table") -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"{name}: missing columns {missing}")


def label_faults(df: DataFrame, source: str) -> DataFrame:
    """fault, n of labels that are null, not_a_number or not_binary, from one pass."""
    x = F.expr(f"try_cast(`{source}` AS double)")
    kind = F.when(F.col(source).isNull(), "null").when(x.isNull() | F.isnan(x), "not_a_number").when(~x.isin(0, 1), "not_binary")
    return df.select(kind.alias("fault")).where("fault IS NOT NULL").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def panel_row(df: DataFrame, columns: list[str], cell: str = "cell_id", date: str = "date", y: str = "y") -> DataFrame:
    """One row on a panel: rows, cells, first and last date, label rate, counts of broken contracts, and each column's mean, least, most and missing rate; NaN counts as missing."""
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    per = [f(x[c]).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    per += [F.avg(x[c].isNull().cast("int")).alias(f"{c}_missing") for c in columns]
    bad = [F.count_if(F.coalesce(c.bad, F.lit(False))).alias(c.name) for c in panel_checks(date, y)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(cell).alias("n_cells"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.avg(y).alias("y_rate"), *bad, *per)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and n_extra, the rows beyond the first."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n_extra")).where("n_extra > 0")


def label_consistency(df: DataFrame, area: str, flag: str) -> DataFrame:
    """One row: n_checked, n_mismatch, mismatch_rate, n_area_pos, n_y_pos of area > 0 against flag = 1."""
    a, y = F.col(area) > 0, F.col(flag) == 1
    both = df.where(F.col(area).isNotNull() & F.col(flag).isNotNull())
    n, m = F.count(F.lit(1)), F.count_if(a != y)
    return both.agg(n.alias("n_checked"), m.alias("n_mismatch"), F.try_divide(m, n).alias("mismatch_rate"), F.count_if(a).alias("n_area_pos"), F.count_if(y).alias("n_y_pos"))


def panel_index(df: DataFrame, expected_months: int, cell: str = "cell_id", date: str = "date") -> DataFrame:
    """One row: n_rows, n_cells, n_duplicates, and cells whose number of months is not as expected."""
    per = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(date).alias("m"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"), F.sum(F.col("n") - F.col("m")).alias("n_duplicates"), F.count_if(F.col("m") != expected_months).alias("n_cells_off"))


def alignment(lead: DataFrame, nowcast: DataFrame, columns: list[str], cell: str = "cell_id", date: str = "date", rtol: float = 1e-6, atol: float = 1e-8, integers: tuple[str, ...] = (), shift: int = 1) -> DataFrame:
    """A row per column: compared, matched, match_rate, max_abs_diff of lead's *_lag1 against nowcast of shift months before."""
    pair = lambda df, name, suffix: F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}{suffix}").cast("double").alias(name)) for c in columns))
    a = lead.select(cell, date, F.inline(pair(lead, "lag", "_lag1")))
    b = nowcast.select(cell, F.add_months(date, shift).cast("date").alias(date), F.inline(pair(nowcast, "now", "")))
    both = a.join(b, [cell, date, "column"]).where(F.col("lag").isNotNull() | F.col("now").isNotNull())
    near = F.when(F.col("column").isin(*integers), F.col("lag") == F.col("now")).otherwise(is_close(F.col("lag"), F.col("now"), rtol, atol))
    ok = F.coalesce(near, F.lit(False))
    stats = both.groupBy("column").agg(F.count(F.lit(1)).alias("compared"), F.count_if(ok).alias("matched"), F.coalesce(F.max(F.abs(F.col("lag") - F.col("now"))), F.lit(0.0)).alias("max_abs_diff"))
    return stats.withColumn("match_rate", F.col("matched") / F.col("compared"))


def enforce_alignment(stats: DataFrame, least: float = 0.999) -> None:
    if bad := stats.where(F.col("match_rate") < least).orderBy("match_rate", "column").limit(20).collect():
        raise ContractError(f"lagged columns don't match the month before: {[r.asDict() for r in bad]}")


def label_shift(lead: DataFrame, nowcast: DataFrame, shifts: tuple[int, ...] = (1, 0, -1), cell: str = "cell_id", date: str = "date", y: str = "y") -> DataFrame:
    """A row per shift of months: compared and match_rate of y against the other table's y, the best first."""
    moved = nowcast.select(cell, F.explode(F.array(*(F.struct(F.lit(s).alias("shift"), F.add_months(date, s).cast("date").alias(date)) for s in shifts))).alias("s"), F.col(y).alias("other"))
    both = moved.select(cell, "s.shift", F.col(f"s.{date}").alias(date), "other").join(lead.select(cell, date, y), [cell, date])
    rate = both.groupBy("shift").agg(F.count(F.lit(1)).alias("compared"), F.avg((F.col(y) == F.col("other")).cast("int")).alias("match_rate"))
    return rate.orderBy(F.desc("match_rate"), "shift")


def rolling_recheck(df: DataFrame, source: str, rolled: str, months: int, cells: DataFrame, cell: str = "cell_id", date: str = "date", atol: float = 1e-9) -> DataFrame:
    """Rows of the chosen cells whose rolled mean isn't the mean over a self join on row numbers."""
    w = Window.partitionBy(cell).orderBy(date)
    some = df.join(cells.select(cell), cell, "left_semi").select(cell, date, source, rolled, F.row_number().over(w).alias("i"))
    back = some.select(cell, F.col("i").alias("j"), F.col(source).alias("x"))
    steps = some.withColumn("j", F.explode(F.sequence(F.col("i") - months + 1, F.col("i"))))
    again = steps.join(back, [cell, "j"], "left").groupBy(cell, date, rolled).agg(F.avg("x").alias("again"))
    return again.where(~(F.col(rolled).eqNullSafe(F.col("again")) | F.coalesce(is_close(F.col(rolled), F.col("again"), 1e-9, atol), F.lit(False))))


def multi_role_rows(splits: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one role of a fold."""
    return splits.groupBy(*keys).agg(F.count_distinct("split_role").alias("n_roles")).where("n_roles > 1")


def shared_blocks(splits: DataFrame, block: str, roles: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Blocks that a fold has in both roles; of block protocols there must be none."""
    has = lambda r: F.max((F.col("split_role") == r).cast("int"))
    return splits.groupBy("protocol", "fold_id", block).agg(has(roles[0]).alias("a"), has(roles[1]).alias("b")).where("a = 1 and b = 1").select("protocol", "fold_id", block)


def coverage(splits: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key in both tables, also of keys that only one has; null keys match null keys."""
    a = splits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_split"))
    b = predictions.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count(F.lit(1)).alias("n_pred"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = a.join(b, on, "full_outer").select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), F.coalesce("n_split", F.lit(0)).alias("n_split"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))
    return joined.withColumn("covered", F.col("n_split") == F.col("n_pred"))


def metadata_quality(meta: DataFrame, cell: str = "cell_id") -> DataFrame:
    """One row: n_rows, n_duplicate_cells, n_lon_bad, n_lat_bad and null rates."""
    n = F.count(F.lit(1))
    rates = [F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null_rate") for c in meta.columns if c != cell]
    return meta.agg(n.alias("n_rows"), (n - F.count_distinct(cell)).alias("n_duplicate_cells"), F.count_if(~F.col("lon").between(-180, 180)).alias("n_lon_bad"), F.count_if(~F.col("lat").between(-90, 90)).alias("n_lat_bad"), *rates)


def null_rate_warnings(df: DataFrame, columns: list[str], most: float = 0.5) -> list[str]:
    row = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns)).first() if columns else None
    return [c for c in columns if row[c] is not None and row[c] > most]


def same_rows(before: DataFrame, after: DataFrame) -> None:
    a, b = before.count(), after.count()
    if a != b:
        raise ContractError(f"{a} rows became {b}")


def same_values(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> dict[str, int]:
    """Rows on which two tables differ in a column that both have."""
    r = right.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return left.join(r, keys).agg(*(F.count_if(~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in columns)).first().asDict()
