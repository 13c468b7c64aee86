"""Exact percentiles of many columns and groups at once, by narrowing value ranges.

A percentile is the value at a rank, or lies between the values at two. Each is looked for in a range of values that
holds it, at first all of them. A round takes, of the values in every range still larger than ``FEW``, a sketch of
bounded size; its two values around the rank bound the next range, and a count says where in it the rank lies. A range
shrinks some ``ACCURACY`` / 4 times a round, so three rounds do for 10^12 values; one of equal ends is found. Only the
few values of the last ranges are gathered, so no aggregate holds more than ``FEW`` values of a group.

Nulls are left out, as is NaN; a group or column without a value has null percentiles. Groups may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.operators.ranges import running
from longspan.sources.scratch import discard, written

FEW = 100_000
ACCURACY = 10_000


def _long(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, column, x: a row for each value."""
    values = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(*by, F.inline(values)).where("x IS NOT NULL AND NOT isnan(x)")


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank, x and the range's columns for all values in each range."""
    r = ranges.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(r[f"__{k}"]) for k in keys))
    return rows.join(r, on & rows["x"].between(r["lo"], r["hi"])).drop(*(f"__{k}" for k in keys))


def narrowed(rows: DataFrame, ranges: DataFrame, keys: list[str], few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """ranges (keys, rank, lo, hi, below, inside) shrunk until they hold at most few values or are one value."""
    done = ranges.where(F.col("inside") <= few).unionByName(ranges.where((F.col("inside") > few) & (F.col("lo") == F.col("hi"))))
    todo = written(ranges.where((F.col("inside") > few) & (F.col("lo") < F.col("hi"))))
    finished = [written(done)]
    group = [*keys, "rank"]
    while not todo.isEmpty():
        values = _within(rows, todo.select(*keys, "rank", "lo", "hi"), keys)
        sketch = values.groupBy(*group).agg(F.percentile_approx("x", [k / (accuracy // 4) for k in range(accuracy // 4 + 1)], accuracy).alias("q"))
        both = todo.alias("t").join(sketch.alias("s"), reduce(lambda x, y: x & y, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in group))).select("t.*", "s.q")
        place = (F.col("rank") - F.col("below")) / F.col("inside") * (accuracy // 4)
        a = F.get("q", F.greatest(F.lit(0), F.floor(place) - 1).cast("int"))
        b = F.get("q", F.least(F.lit(accuracy // 4), F.floor(place) + 2).cast("int"))
        cut = written(both.select(*group, "lo", "hi", "below", "inside", a.alias("a"), b.alias("b")))
        values = _within(rows, cut, keys)
        x, a, b = F.col("x"), F.col("a"), F.col("b")
        amid = (x > a) & (x < b)
        counts = values.groupBy(*group, "lo", "hi", "below", "a", "b").agg(
            *(F.count_if(c).alias(n) for n, c in (("under", x < a), ("first", x == a), ("amid", amid), ("last", (x == b) & (a < b)), ("over", x > b))),
            *(f(F.when(c, x)).alias(n) for n, f, c in (("under_hi", F.max, x < a), ("amid_lo", F.min, amid), ("amid_hi", F.max, amid), ("over_lo", F.min, x > b))),
        )
        # Where the rank lies: at an end, which is the value then, or amid; beyond an end only if the sketch broke its bound.
        at, parts = F.col("below"), []
        for n, lo, hi in (("under", F.col("lo"), F.col("under_hi")), ("first", a, a), ("amid", F.col("amid_lo"), F.col("amid_hi")), ("last", b, b), ("over", F.col("over_lo"), F.col("hi"))):
            parts.append(F.struct(lo.alias("lo"), hi.alias("hi"), at.alias("below"), F.col(n).alias("inside")))
            at = at + F.col(n)
        new = counts.select(*group, F.inline(F.array(*parts))).where("rank >= below AND rank < below + inside")
        new = written(new)
        finished.append(new.where(f"inside <= {few} OR lo = hi"))
        discard(todo, cut)
        todo = written(new.where(f"inside > {few} AND lo < hi"))
    return reduce(DataFrame.unionByName, finished)


def percentiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = (), interpolate: bool = True, few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """by, column, p, value: exact percentiles as ``percentile`` gives them (without interpolation the lower of two values, as ``percentile_disc`` from below).

    Reads df once, to write these columns; they are read for the counts, for the values of the last ranges, and twice for
    each round of large groups.
    """
    keys = [*by, "column"]
    rows = _long(written(df.select(*by, *columns)), columns, list(by))
    counts = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    asked = F.explode(F.array(*(F.lit(float(p)) for p in probs)))
    place = F.col("p") * (F.col("inside") - 1) if interpolate else F.greatest(F.lit(0.0), F.ceil(F.round(F.col("p") * F.col("inside"), 9)) - 1)
    # Places that a float's error puts beside a whole rank are that rank.
    near = F.when(F.abs(place - F.round(place)) < 1e-9, F.round(place)).otherwise(place)
    sides = [F.floor("place").cast("long").alias("r0"), F.ceil("place").cast("long").alias("r1")]
    value = F.when(F.col("r0") == F.col("r1"), F.col("__r0")).otherwise((F.col("r1") - F.col("place")) * F.col("__r0") + (F.col("place") - F.col("r0")) * F.col("__r1"))
    if (counts.agg(F.max("inside")).first()[0] or 0) <= few:
        whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("v")).withColumn("inside", F.size("v"))
        placed = whole.withColumn("p", asked).withColumn("place", near).select("*", *sides)
        return placed.select(*keys, "p", F.get("v", F.col("r0").cast("int")).alias("__r0"), F.get("v", F.col("r1").cast("int")).alias("__r1"), "place", "r0", "r1").select(*keys, "p", value.alias("value"))
    targets = written(counts.withColumn("p", asked).withColumn("place", near).select("*", *sides))
    ranks = targets.select(*keys, F.explode(F.array("r0", "r1")).alias("rank"), "lo", "hi", "inside").distinct().withColumn("below", F.lit(0).cast("long"))
    found = narrowed(rows, written(ranks.select(*keys, "rank", "lo", "hi", "below", "inside")), keys, few, accuracy)
    one = found.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
    last = _within(rows, found.where("lo < hi"), keys).groupBy(*keys, "rank", "below").agg(F.sort_array(F.collect_list("x")).alias("v"))
    at = F.get("v", (F.col("rank") - F.col("below")).cast("int"))
    values = written(one.unionByName(last.select(*keys, "rank", at.alias("value"))))
    out = targets
    for side in ("r0", "r1"):
        v = values.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("rank").alias("__rank"), F.col("value").alias(f"__{side}"))
        on = reduce(lambda x, y: x & y, (out[k].eqNullSafe(v[f"__{k}"]) for k in keys))
        out = out.join(v, on & (out[side] == v["__rank"]), "left").drop("__rank", *(f"__{k}" for k in keys))
    return out.select(*keys, "p", value.alias("value"))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column, null where it has no value: one row a column comes to the driver."""
    got = {r["column"]: r["value"] for r in percentiles(df, columns, [0.5]).collect()} if columns else {}
    return {c: got.get(c) for c in columns}


def wide(long: DataFrame, by: list[str], names: dict[float, str]) -> DataFrame:
    """by, column and a column for each percentile, from percentiles()."""
    return long.groupBy(*by, "column").agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()))


def cut_points(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Up to bins - 1 distinct values of each column that divide its values into equal shares, in order; columns * bins rows come to the driver.

    With so many ranks values are counted and the counts summed in order: a value covers the ranks from below to upto, so
    no row meets every rank. Reads df once.
    """
    counts = written(_long(df, columns, []).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n")))
    summed = running(counts, ["column"], [F.col("x")], {"upto": F.col("n")}, {"inside": F.col("n")}).withColumn("below", F.col("upto") - F.col("n"))
    # The first k whose rank, ceil(k * inside / bins) - 1, is not below the value's.
    first = summed.withColumn("k", F.expr(f"below * {bins} div inside + 1"))
    found: dict[str, set[float]] = {c: set() for c in columns}
    for r in first.where(f"k < {bins} AND (k * inside + {bins - 1}) div {bins} <= upto").select("column", "x").collect():
        found[r["column"]].add(r["x"])
    discard(counts)
    return {c: sorted(v) for c, v in found.items()}
