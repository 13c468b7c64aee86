import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.llm import topk


def brute(rows, k=10, every=10):
    v = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and np.isfinite(c) for c in x):
            v.setdefault(i, []).append(np.floor(np.array(x, np.float64) * 1024).astype(np.int64))
    out = {}
    for q in v:
        if q % every == 0:
            s = sorted((-int(y @ v[q][0]), i) for i, ys in v.items() if i != q for y in ys)[:k]
            out[q] = [(i, -s) for s, i in s]
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS part", "array(1) AS v")
    out = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["normal", "clusters", "ties"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 8))
    if kind == "clusters":
        v = v * 0.1 + rng.normal(size=(10, 8))[rng.integers(0, 10, 700)]
    if kind == "ties":
        v[:300] = v[0]
    rows = [(k, v[k].astype(np.float32).tolist()) for k in range(700)]
    assert got(spark, rows, shard=200, query_bytes=16 * 72) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (10, None), (20, []), (30, [float("nan"), 1.0]), (40, [None, 1.0]), (50, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (60, [0.0, 0.0])]
    assert got(spark, rows) == {0: [(1, 512 * 1024), (1, 512 * 1024), (2, 0), (60, 0)], 60: [(0, 0), (1, 0), (1, 0), (2, 0)]}
    assert got(spark, []) == {}


def test_lengths_are_not_mixed(spark):
    """Vectors of different lengths are searched among their own."""
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=3 + k // 10 % 2 * 4).astype(np.float32).tolist()) for k in range(200)]
    want = {}
    for n in (3, 7):
        want |= brute([r for r in rows if len(r[1]) == n])
    have = got(spark, rows, shard=16)
    assert {q: [s for _, s in v] for q, v in have.items()} == {q: [s for _, s in v] for q, v in want.items()}


def test_bounds_stop_reading():
    """Where few components decide, most of the lists need not be read; where all weigh alike, most must."""
    rng = np.random.default_rng(10)
    flat = rng.normal(size=(4096, 64))
    steep = flat * 0.5 ** np.arange(64)
    share = {}
    for name, v in (("flat", flat), ("steep", steep)):
        v = np.floor(v * 1024).astype(np.int64)
        lists = topk.Lists(np.arange(len(v)), v)
        shares = []
        for q in range(0, 4096, 400):
            rows, score = lists.top(v[q], q, 10)
            exact = v @ v[q]
            exact[q] = -(2**62)
            assert sorted(score.tolist())[-10:] == sorted(exact.tolist())[-10:]
            shares.append(lists.share)
        share[name] = np.mean(shares)
    assert share["steep"] < 0.25 and share["flat"] < 1
