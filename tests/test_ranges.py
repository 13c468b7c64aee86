import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import metrics, ranges, resample, splits
from longspan.operators.metrics import cumulative


def scores(spark, n=900):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, int(rng.random() < 0.3), rng.choice([round(rng.random(), 2), rng.random()])) for k in range(n)]
    return spark.createDataFrame(rows, "g string, k int, y int, p double"), rows


def table(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


@pytest.mark.parametrize("size", [37, 100_000])
def test_running_sums_equal_one_window(spark, size):
    df, rows = scores(spark)
    order = [F.desc("p"), F.asc("k")]
    got = {r["k"]: (r["s"], r["n"], r["all"]) for r in ranges.running(df, ["g"], order, {"s": F.col("y").cast("long"), "n": F.lit(1).cast("long")}, {"all": F.col("y").cast("long")}, size).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))
        total, seen = sum(r[2] for r in own), 0
        for i, r in enumerate(own, 1):
            seen += r[2]
            assert got[r[1]] == (seen, i, total)
    numbers = {r["k"]: r["i"] for r in ranges.numbered(df, [], order, "i", size).collect()}
    assert [k for k, _ in sorted(numbers.items(), key=lambda x: x[1])] == [r[1] for r in sorted(rows, key=lambda r: (-r[3], r[1]))]
    assert ranges.running(df.where("k < 0"), ["g"], order, {"s": F.col("y")}).collect() == []


def test_no_task_holds_more_than_a_range(spark):
    """One group of continuous scores is spread over ranges of about equal size, and each window is over a range."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("score"), F.lit(1).alias("one"))
    parts = ranges.ranged(df, [], [F.desc("score")], 20)
    sizes = [r["count"] for r in parts.groupBy("__part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 20_000 / 20 * 2
    plan = ranges.running(df, [], [F.desc("score")], {"s": F.col("one")}, range_rows=1000)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert len(windows) == 1 and "__part" in windows[0]


def test_metrics_do_not_depend_on_range_size(spark, monkeypatch):
    df, _ = scores(spark)
    once = {}
    for size in (1 << 20, 50):
        monkeypatch.setattr(ranges.running, "__defaults__", (None, size))
        monkeypatch.setattr(ranges.numbered, "__defaults__", (size,))
        got = [table(f) for f in (metrics.average_precision_by_row(df, ["g"], ["k"]), metrics.top_fraction(df, ["g"], (0.01, 0.3), ["k"]), metrics.best_threshold(df, ["g"]), cumulative(df, ["g"], "y", "p"))]
        for f in (metrics.metric_table(df, ["g"]),):
            got.append(sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in f.collect()))
        assert got == once.setdefault("got", got)


def test_metric_table_reads_once(spark):
    df, rows = scores(spark, 300)
    got = {r["g"]: r for r in metrics.metric_table(df, ["g"], threshold=0.4).collect()}
    plain = {r["g"]: r for r in metrics.at_threshold(df, ["g"], 0.4).collect()}
    roc = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, ["g"]).collect()}
    for g, r in got.items():
        assert r["roc_auc"] == pytest.approx(roc[g]) and all(r[c] == pytest.approx(plain[g][c]) for c in ("brier", "precision", "recall", "f1"))
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    metrics.metric_table(df.mapInArrow(count, df.schema), ["g"]).collect()
    assert counted.value == 300


def test_folds_by_ranges(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"))
    a = {r["key"]: r["fold"] for r in splits.fold_map(df, "key", 5, 3).collect()}
    b = {r["key"]: r["fold"] for r in splits.fold_map(df, "key", 5, 3, range_rows=40).collect()}
    assert a == b and sorted(map(list(a.values()).count, range(5))) == [100] * 5


@pytest.mark.parametrize("cells, metric", [(1 << 22, "auprc"), (100, "auprc"), (100, "roc_auc")])
def test_bootstrap_equals_repeated_rows(spark, cells, metric):
    """The metric of each replicate is that of rows repeated by their weights, over any number of ranges."""
    df, rows = scores(spark, 200)
    base = np.array([int(hashlib.md5(f"0|{r[1]}".encode()).hexdigest()[:8], 16) for r in rows])
    w = resample.weights(base, 4)
    assert w[:, 0].tolist() != w[:, 1].tolist()
    values = []
    for rep in range(4):
        again = spark.createDataFrame([(*r[:2], r[2], r[3]) for r, n in zip(rows, w[:, rep]) for _ in range(n)], "g string, k int, y int, p double")
        of = {"auprc": metrics.average_precision, "roc_auc": metrics.roc_auc}[metric]
        values.append({r["g"]: r[metric] for r in of(again, ["g"]).collect()})
    got = {r["g"]: (r[f"{metric}_mean"], r[f"{metric}_std"]) for r in resample.bootstrap(df, ["g"], metric, 4, keys=["k"], range_cells=cells).collect()}
    for g, (mean, std) in got.items():
        own = [v[g] for v in values]
        assert mean == pytest.approx(np.mean(own)) and std == pytest.approx(np.std(own, ddof=1))
    assert resample.bootstrap(df.where("k < 0"), ["g"], metric, 4, keys=["k"]).collect() == []


def test_bootstrap_weights_are_poisson():
    w = resample.weights(np.random.default_rng(1).integers(0, 2**32, 20_000), 10)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w.T)[np.triu_indices(10, 1)]).max() < 0.04
    assert abs((w == 0).mean() - math.exp(-1)) < 0.01
