"""Summaries of panels; each is one pass or one small shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.operators.ranges import numbered
from longspan.operators.ranks import percentiles, wide
from longspan.sources.scratch import written

CHUNK = 100


def months_per_cell(df: DataFrame, cell: str = "cell_id", date: str = "date") -> DataFrame:
    """Least, median and most months of a cell, and the cells. Cells are counted by their months first, so the median is of a few rows."""
    per = df.groupBy(cell).agg(F.count_distinct(date).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.min("m").alias("min_months"), F.percentile("m", 0.5, F.col("n")).cast("double").alias("median_months"), F.max("m").alias("max_months"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_cells"))


def joined_cells(df: DataFrame, columns: list[str], cell: str = "cell_id") -> DataFrame:
    """Cells with any of these columns."""
    return df.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()).agg(F.count_distinct(cell).alias("n_cells"))


def missing_rates(df: DataFrame, columns: list[str] | None = None, top: int | None = None) -> DataFrame:
    """column, missing_rate; wide tables are counted CHUNK columns at a time, so that code generation holds."""
    columns = columns or df.columns
    frames = []
    for k in range(0, len(columns), CHUNK):
        some = columns[k : k + CHUNK]
        one = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in some))
        frames.append(one.unpivot([], some, "column", "missing_rate"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(F.desc("missing_rate"), "column").limit(top) if top else out


def share_audit(df: DataFrame, p: str) -> DataFrame:
    """Counts and rates of inclusion probabilities above 1 and not above 0; nulls count as neither."""
    above, below = F.coalesce(F.col(p) > 1, F.lit(False)), F.coalesce(F.col(p) <= 0, F.lit(False))
    return df.agg(F.count_if(above).alias("n_above_one"), F.count_if(below).alias("n_not_positive"), F.avg(above.cast("int")).alias("rate_above_one"), F.avg(below.cast("int")).alias("rate_not_positive"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, min, p01, median, p99, max of finite values, and rates of missing, infinite and negative ones of all rows."""
    x = {c: F.col(c).cast("double") for c in columns}
    finite = {c: F.when(~F.isnan(x[c]) & (F.abs(x[c]) != float("inf")), x[c]) for c in columns}
    exact = wide(percentiles(df.select(*(finite[c].alias(c) for c in columns)), columns, [0.01, 0.5, 0.99]), [], {0.01: "p01", 0.5: "median", 0.99: "p99"})
    frames = []
    for k in range(0, len(columns), CHUNK):
        parts = []
        for c in columns[k : k + CHUNK]:
            infinite = F.coalesce(F.abs(x[c]) == float("inf"), F.lit(False))
            missing = x[c].isNull() | F.coalesce(F.isnan(x[c]), F.lit(False))
            negative = F.coalesce((x[c] < 0) & ~F.isnan(x[c]), F.lit(False))
            rates = {"missing_rate": missing, "infinite_rate": infinite, "negative_rate": negative}
            if_finite = {"min": F.min(finite[c]), "max": F.max(finite[c])}
            parts.append(F.struct(F.lit(c).alias("column"), *(v.alias(n) for n, v in if_finite.items()), *(F.avg(v.cast("int")).alias(n) for n, v in rates.items())))
        frames.append(df.agg(F.array(*parts).alias("a")).select(F.inline("a")))
    out = reduce(DataFrame.unionByName, frames).join(exact, "column", "left")
    return out.select("column", "min", "p01", "median", "p99", "max", "missing_rate", "infinite_rate", "negative_rate")


def label_rates(df: DataFrame, y: str = "y", date: str = "date") -> DataFrame:
    """level (overall, year, month), value, n, n_positive, rate; one pass over grouping sets."""
    rows = df.select(F.year(date).alias("year"), F.month(date).alias("month"), F.col(y).alias("y"))
    out = rows.groupingSets([[], ["year"], ["month"]], "year", "month").agg(F.grouping_id().alias("g"), F.count("y").alias("n"), F.sum("y").cast("long").alias("n_positive"), F.avg("y").alias("rate"))
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "year").otherwise("month")
    return out.select(level.alias("level"), F.coalesce("year", "month").alias("value"), "n", "n_positive", "rate")


def constant_columns(df: DataFrame, columns: list[str], null_is_value: bool) -> list[str]:
    """Columns of one value. A null is a value of its own, or else is left aside with infinities, and all-null columns count as constant."""
    out = []
    for k in range(0, len(columns), CHUNK):
        some = columns[k : k + CHUNK]
        kinds = dict(df.dtypes)
        clean = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) if kinds[c] in ("double", "float") and not null_is_value else F.col(c) for c in some}
        row = df.agg(*(F.min(clean[c]).eqNullSafe(F.max(clean[c])).alias(f"{c}__same") for c in some), *(F.max(F.col(c).isNull()).alias(f"{c}__null") for c in some), *(F.count(c).alias(f"{c}__n") for c in some)).first()
        out += [c for c in some if row[f"{c}__same"] and not (null_is_value and row[f"{c}__null"] and row[f"{c}__n"])]
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_bits(number: str = "__number") -> tuple[Column, Column]:
    """Bucket and bits of dense numbers from 1: bitmaps of 4 KB for each bucket of 32,768 numbers, exact and merged by ``bitmap_or_agg``."""
    return F.bitmap_bucket_number(F.col(number)), F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number)))


def split_summary(splits: DataFrame, stratum: str, cell: str = "cell_id") -> DataFrame:
    """Rows, cells, label rate and dates by fold and role, and by stratum too.

    Cells are numbered once; a fold's cells are the bits of its strata's bitmaps, merged, so no row is expanded by level
    or by distinct column.
    """
    fold, bucket = ["protocol", "fold_id", "split_role"], "__bucket"
    numbers = numbered(splits.select(F.col(cell).alias("__cell")).where("__cell IS NOT NULL").distinct(), [], [F.col("__cell")], "__number")
    rows = splits.join(numbers, splits[cell] == numbers["__cell"], "left")
    which, bits = distinct_bits()
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_y", "sum_y")] + [F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")]
    base = rows.groupBy(*fold, stratum, which.alias(bucket)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("y").alias("n_y"), F.sum("y").alias("sum_y"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), bits.alias("bits")
    )
    base = written(base)  # a row for each stratum of a fold and 32,768 cells
    fine = base.groupBy(*fold, stratum).agg(*sums, F.sum(F.bitmap_count("bits")).alias("n_cells")).withColumn("qc_level", F.lit(stratum))
    coarse = base.groupBy(*fold, bucket).agg(*sums, F.bitmap_or_agg("bits").alias("bits"))
    coarse = coarse.groupBy(*fold).agg(*sums, F.sum(F.bitmap_count("bits")).alias("n_cells")).withColumns({"qc_level": F.lit("fold"), stratum: F.lit(None).cast(splits.schema[stratum].dataType)})
    out = fine.unionByName(coarse)
    return out.select(*fold, stratum, "n_rows", "n_cells", F.try_divide("sum_y", "n_y").alias("y_rate"), "first_date", "last_date", "qc_level")


def protocol_windows(splits: DataFrame) -> DataFrame:
    """Per protocol and role: folds, rows and the dates that occur."""
    return splits.groupBy("protocol", "split_role").agg(F.count_distinct("fold_id").alias("n_folds"), F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
