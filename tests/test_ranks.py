import random

import pytest
from pyspark.sql import functions as F

from longspan.operators import ranks

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def table(spark, n=4000, seed=1):
    rng = random.Random(seed)

    def x(k):
        return rng.choice([None, float("nan"), rng.gauss(0, 1), 10 ** rng.uniform(-200, 200), -(10 ** rng.uniform(-5, 5)), 7.0, 7.0, 7.0])

    rows = [(rng.choice(["a", "a", "a", "b", None]), x(k), float(rng.randint(0, 3)), None, rng.random()) for k in range(n)]
    return spark.createDataFrame(rows, "g string, wild double, tied double, empty double, flat double")


def want(df, columns, by):
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    got = df.groupBy(*by).agg(*(F.percentile(clean[c], PROBS).alias(c) for c in columns)).collect()
    return {(*(r[k] for k in by), c, p): r[c][k] for r in got for c in columns if r[c] is not None for k, p in enumerate(PROBS)}


@pytest.mark.parametrize("few, accuracy", [(10_000, 10_000), (20, 40)])
def test_equal_to_percentile(spark, few, accuracy):
    """Ranges that must be narrowed over several rounds, with ties, wide values, null groups and empty columns."""
    df = table(spark)
    columns = ["wild", "tied", "empty", "flat"]
    got = {(r["g"], r["column"], r["p"]): r["value"] for r in ranks.percentiles(df, columns, PROBS, ["g"], few=few, accuracy=accuracy).collect()}
    expected = want(df, columns, ["g"])
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-300), k


def test_without_groups_and_interpolation(spark):
    df = spark.createDataFrame([(float(k % 10),) for k in range(100)], "x double")
    got = {r["p"]: r["value"] for r in ranks.percentiles(df, ["x"], [0.1, 0.11, 0.5, 1.0], interpolate=False).collect()}
    assert got == {0.1: 0.0, 0.11: 1.0, 0.5: 4.0, 1.0: 9.0}
    assert ranks.medians(df, ["x"]) == {"x": 4.5} and ranks.medians(df.where("x > 99"), ["x"]) == {"x": None}
    assert ranks.cut_points(df, ["x"], 4) == {"x": [2.0, 4.0, 7.0]}


def test_no_aggregate_holds_a_group(spark, monkeypatch):
    """The only values gathered are those of the last ranges, at most few of each."""
    seen = []
    real = ranks.F.collect_list

    def gathered(c):
        seen.append(c)
        return real(c)

    monkeypatch.setattr(ranks.F, "collect_list", gathered)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("x"))
    rows = ranks._long(df, ["x"], [])
    start = spark.createDataFrame([("x", 12_345, 0.0, 49_999.0, 0, 50_000)], "column string, rank long, lo double, hi double, below long, inside long")
    (r,) = ranks.narrowed(rows, start, ["column"], few=100, accuracy=1000).collect()
    assert r["inside"] <= 1000 and r["below"] <= 12_345 < r["below"] + r["inside"] and r["lo"] <= 12_345 <= r["hi"] and not seen
    (r,) = ranks.percentiles(df, ["x"], [0.3], few=100, accuracy=1000).collect()
    assert r["value"] == pytest.approx(0.3 * 49_999) and len(seen) == 1


def test_cut_points_meet_no_row_with_every_rank(spark, monkeypatch):
    """Many ranks over more values than are gathered at once: rows are counted by value, and no range is narrowed for each rank."""
    rng = random.Random(4)
    rows = [(rng.choice([None, float("nan"), 5.0, rng.gauss(0, 1)]), float(k % 3), None) for k in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    monkeypatch.setattr(ranks, "FEW", 10)
    monkeypatch.setattr(ranks, "narrowed", lambda *a, **k: pytest.fail("ranges narrowed by rank"))
    for bins in (2, 7, 255):
        got = ranks.cut_points(df, ["a", "b", "c"], bins)
        for k, c in enumerate(("a", "b", "c")):
            values = sorted(r[k] for r in rows if r[k] is not None and r[k] == r[k])
            assert got[c] == sorted({values[-(-j * len(values) // bins) - 1] for j in range(1, bins)} if values else set())
