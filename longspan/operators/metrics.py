"""Metrics of rare-event predictions by group.

Rankings are first summed by group and score, in the tasks; scores tie as one threshold. What runs over the scores in
order does so by ranges with offsets (``ranges``), so continuous scores of one group are spread over tasks, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longspan.operators.ranges import numbered, running
from longspan.operators.ranks import percentiles, wide
from longspan.sources.scratch import written

LOWER_IS_BETTER = ("Brier",)


def by_score(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """group, score, n and pos: rows and positives of each score."""
    return df.groupBy(*group, F.col(p).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))


def cumulative(df: DataFrame, group: list[str], y: str, p: str, most: int | None = None) -> DataFrame:
    """group, score, n and pos at the score, and tp, seen, fp at scores from it up; positives and n_group in all."""
    n, pos = F.col("n"), F.col("pos")
    return running(by_score(df, group, y, p), group, [F.desc("score")], {"tp": pos, "seen": n}, {"positives": pos, "n_group": n}, most=most).withColumn("fp", F.col("seen") - F.col("tp"))


def _auprc() -> Column:
    """Average precision from the rows of cumulative()."""
    return F.sum(F.try_divide(F.col("pos"), F.col("positives")) * F.col("tp") / F.col("seen"))


def _roc_auc() -> Column:
    won = F.col("pos") * (F.col("n_group") - F.col("positives") - F.col("fp") + (F.col("n") - F.col("pos")) / 2)
    return F.try_divide(F.sum(won), F.max(F.col("positives")) * F.max(F.col("n_group") - F.col("positives")))


def _sizes() -> list[Column]:
    return [F.max("n_group").alias("n"), F.max("positives").alias("n_positive")]


def average_precision(df: DataFrame, group: list[str], y: str = "y", p: str = "p", most: int | None = None) -> DataFrame:
    """Average precision over distinct scores; null without positives. most: a bound on df's rows, if the caller knows one."""
    return cumulative(df, group, y, p, most).groupBy(*group).agg(*_sizes(), _auprc().alias("auprc"))


def average_precision_by_row(df: DataFrame, group: list[str], order: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Average precision with each row as a threshold of its own, in a total order; 0 without positives.

    One running sum over all rows in order, by ranges.
    """
    some = df.select(*group, *(c for c in order if c not in (*group, y, p)), F.col(p).alias(p), F.col(y).alias(y))
    rows = running(some, group, [F.desc(p), *map(F.asc, order)], {"__tp": F.col(y).cast("long"), "__k": F.lit(1).cast("long")})
    hits = F.sum(F.when(F.col(y) == 1, F.col("__tp") / F.col("__k")))
    return rows.groupBy(*group).agg(F.coalesce(F.try_divide(hits, F.sum(y)), F.lit(0.0)).alias("auprc_row"))


def roc_auc(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Probability that a positive outranks a negative, ties half; null if a class is missing."""
    return cumulative(df, group, y, p).groupBy(*group).agg(*_sizes(), _roc_auc().alias("roc_auc"))


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def at_threshold(df: DataFrame, group: list[str], threshold, y: str = "y", p: str = "p") -> DataFrame:
    """brier, precision, recall, f1 at p >= threshold (a number or column); 0 where undefined."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    sums = df.groupBy(*group).agg(brier(y, p).alias("brier"), F.count_if(hit & pos).alias("tp"), F.count_if(hit).alias("called"), F.count_if(pos).alias("pos"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(*group, "brier", rate(F.col("tp"), F.col("called")).alias("precision"), rate(F.col("tp"), F.col("pos")).alias("recall"), rate(2 * F.col("tp"), F.col("called") + F.col("pos")).alias("f1"))


def top_fraction(df: DataFrame, group: list[str], fractions: tuple[float, ...], keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Per fraction: k = max(1, ceil(n * fraction)) rows of highest p (ties by keys), hits, precision, recall (null without positives)."""
    df = written(df.select(*group, *(c for c in keys if c not in (*group, y, p)), F.col(y).alias(y), F.col(p).alias(p)))  # read twice, computed once
    c = cumulative(df, group, y, p).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    c = c.withColumn("k", F.greatest(F.lit(1), F.ceil(F.round(F.col("n_group") * F.col("fraction"), 9))).cast("long"))
    # Scores above the cut count whole; the score at the cut, one for each group and fraction, is cut among its rows by keys.
    cut = F.when((F.col("seen") > F.col("k")) & (F.col("seen") - F.col("n") < F.col("k")), F.struct(F.col("score"), (F.col("k") - F.col("seen") + F.col("n")).alias("room")))
    whole = written(c.groupBy(*group, "fraction", "k").agg(F.sum(F.when(F.col("seen") <= F.col("k"), F.col("pos")).otherwise(0)).alias("above"), F.max("positives").alias("pos"), F.max(cut).alias("cut")))
    names = {g: f"__{g}" for g in group}
    at = whole.where("cut IS NOT NULL").select(*(F.col(g).alias(names[g]) for g in group), F.col("cut.score").alias("__score")).distinct()
    same = reduce(lambda a, b: a & b, [df[g].eqNullSafe(at[names[g]]) for g in group], df[p].eqNullSafe(at["__score"]))
    tied = df.join(at, same, "left_semi")  # a row for each group and fraction: Spark broadcasts it if it is small
    ranked = numbered(tied, [*group, p], [F.asc(k) for k in keys], "__rank").select(*(F.col(g).alias(names[g]) for g in group), F.col(p).alias("__score"), F.col(y).alias("__y"), "__rank")
    to = reduce(lambda a, b: a & b, [whole[g].eqNullSafe(ranked[names[g]]) for g in group], F.col("cut.score").eqNullSafe(F.col("__score")))
    hits = F.first("above") + F.count_if((F.col("__rank") <= F.col("cut.room")) & (F.col("__y") == 1))
    out = whole.join(ranked, to & (F.col("__rank") <= F.col("cut.room")), "left").groupBy(*group, "fraction", "k", "pos").agg(hits.alias("hits"))
    return out.select(*group, "fraction", "k", "hits", (F.col("hits") / F.col("k")).alias("precision"), F.try_divide("hits", "pos").alias("recall"))


def best_threshold(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """The score with the highest F1 as a threshold, the higher of equals."""
    c = cumulative(df, group, y, p)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("seen") + F.col("positives")), F.lit(0.0))
    best = F.max(F.struct(F.round(f1, 12).alias("f1"), F.col("score").alias("threshold"))).alias("b")
    return c.groupBy(*group).agg(best).select(*group, "b.threshold", "b.f1")


def frozen_threshold(df: DataFrame, group: list[str], role: str = "split_role", choose: str = "val", apply: str = "test", y: str = "y", p: str = "p") -> DataFrame:
    """The best threshold on rows of one role, and what it gives on those of another: threshold, brier, precision, recall, f1."""
    chosen = best_threshold(df.where(F.col(role) == choose), group, y, p).select(*group, "threshold")
    other = df.where(F.col(role) == apply)
    other = other.join(F.broadcast(chosen), group) if group else other.join(F.broadcast(chosen))  # a row per group
    return at_threshold(other, [*group, "threshold"], F.col("threshold"), y, p)


def blind_spots(df: DataFrame, y: str = "y", p: str = "p", below: float = 0.1, valid: str | None = None) -> DataFrame:
    """Events that the model gave little chance, where the data are valid."""
    ok = F.col(valid) == 1 if valid else F.lit(True)
    return df.where((F.col(y) == 1) & (F.col(p) < below) & ok)


def metric_table(df: DataFrame, group: list[str], y: str = "y", p: str = "p", threshold=0.5) -> DataFrame:
    """n, n_positive, auprc, roc_auc, brier, precision, recall, f1 by group, all from one sum by group and score: df is read once.

    threshold is a number or a column of group; y is 0 or 1.
    """
    c = cumulative(df, group, y, p)
    score, pos, n = F.col("score"), F.col("pos"), F.col("n")
    error = F.sum(pos * (score - 1) * (score - 1) + (n - pos) * score * score)
    hit = score >= threshold
    tp, called = F.coalesce(F.sum(F.when(hit, pos)), F.lit(0)), F.coalesce(F.sum(F.when(hit, n)), F.lit(0))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.groupBy(*group).agg(
        *_sizes(), _auprc().alias("auprc"), _roc_auc().alias("roc_auc"), F.try_divide(error, F.sum(F.when(score.isNotNull(), n))).alias("brier"),
        rate(tp, called).alias("precision"), rate(tp, F.sum(pos)).alias("recall"), rate(2 * tp, called + F.sum(pos)).alias("f1"),
    )


def deltas(df: DataFrame, name: str, reference: str, metrics: list[str]) -> DataFrame:
    """Each row's metrics less those of the row named reference; *_change, and *_drop with the sign turned."""
    base = df.where(F.col(name) == reference).agg(*(F.first(m).alias(f"__{m}") for m in metrics))  # one row
    out = df.join(F.broadcast(base))
    for m in metrics:
        out = out.withColumns({f"{m}_change": F.col(m) - F.col(f"__{m}"), f"{m}_drop": F.col(f"__{m}") - F.col(m)})
    return out.drop(*(f"__{m}" for m in metrics))


def gap_table(df: DataFrame, name: str, reference: str, metrics: list[str], lower_is_better: tuple[str, ...] = LOWER_IS_BETTER) -> DataFrame:
    """Long form: name, metric, value, reference_value, difference, and performance_gap, positive where the reference does better."""
    base = df.where(F.col(name) == reference).unpivot([], metrics, "metric", "reference_value").groupBy("metric").agg(F.first("reference_value").alias("reference_value"))
    long = df.where(F.col(name) != reference).unpivot([name], metrics, "metric", "value")
    difference = F.col("value") - F.col("reference_value")
    gap = F.when(F.col("metric").isin(*lower_is_better), difference).otherwise(-difference)
    return long.join(F.broadcast(base), "metric").select(name, "metric", "value", "reference_value", difference.alias("difference"), gap.alias("performance_gap"))


def mean_abs(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """by, feature, mean_abs of contribution columns; one wide pass, then unpivoted."""
    one = df.groupBy(*by).agg(*(F.avg(F.abs(c)).alias(c) for c in columns))
    return one.unpivot(list(by), columns, "feature", "mean_abs")


def top_features(importance: DataFrame, k: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("mean_abs"), "feature").limit(k)


def group_shares(importance: DataFrame, groups: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sums of mean_abs by feature group, and each one's share of all groups' sum."""
    sums = importance.join(groups, "feature").groupBy(*by, "feature_group").agg(F.sum("mean_abs").alias("mean_abs_sum"))
    return sums.withColumn("share", F.try_divide(F.col("mean_abs_sum"), F.sum("mean_abs_sum").over(Window.partitionBy(*by))))


def group_pivot(shares: DataFrame, by: str, order: list[str]) -> DataFrame:
    return shares.groupBy(by).pivot("feature_group", order).agg(F.first("share"))


def tail_means(df: DataFrame, x: str, effect: str, by: list[str] = (), low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Quantiles of x, mean effect at or beyond each, and high less low."""
    q = wide(percentiles(df, [x], [low, high], list(by)), list(by), {low: "q_low", high: "q_high"}).drop("column")
    rows = df.join(q, list(by)) if by else df.join(F.broadcast(q))  # one row
    out = rows.groupBy(*by, "q_low", "q_high").agg(F.avg(F.when(F.col(x) <= F.col("q_low"), F.col(effect))).alias("mean_low"), F.avg(F.when(F.col(x) >= F.col("q_high"), F.col(effect))).alias("mean_high"))
    return out.withColumn("difference", F.col("mean_high") - F.col("mean_low"))
