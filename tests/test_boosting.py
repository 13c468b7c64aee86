import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import attribution, boosting
from longspan.operators.boosting import Settings
from longspan.operators.quality import ContractError


def data(spark, n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 2] = rng.integers(0, 4, n)
    x[rng.random(n) < 0.15, 1] = np.nan
    margin = 2 * (x[:, 0] > 0.3) - 1.5 * (np.nan_to_num(x[:, 1], nan=2) > 0.5) * (x[:, 2] > 1) - 0.5
    y = (rng.random(n) < 1 / (1 + np.exp(-margin))).astype(int)
    w = rng.choice([0.5, 1.0, 2.0], n)
    rows = [(float(a), None if math.isnan(b) else float(b), float(c), int(v), float(u), k) for k, ((a, b, c), v, u) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, weight double, k int"), x, y, w


F3 = ["a", "b", "c"]
PLAIN = Settings(trees=3, rate=0.3, leaves=6, depth=4, bins=16, min_rows=5, rows=1.0, columns=1.0)


def search(bins, g, h, s):
    """The best split by trying every feature, bin and side of missing values."""
    best = None
    for f, cut, missing in itertools.product(range(bins.shape[1]), range(256), (True, False)):
        left = np.where(bins[:, f] == 0, missing, bins[:, f] <= cut)
        if not (bins[:, f] == cut).any() or min(left.sum(), (~left).sum()) < s.min_rows:
            continue
        gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
        if min(hl, hr) < s.min_hessian:
            continue
        gain = round(gl**2 / (hl + s.l2) + gr**2 / (hr + s.l2) - (gl + gr) ** 2 / (hl + hr + s.l2), 9)
        if gain > s.min_gain and (best is None or (gain, -f, -cut, missing) > best[0]):
            best = ((gain, -f, -cut, missing), left)
    return best


def grown(bins, y, w, margin, s):
    """One tree leaf by leaf: node -> (feature, bin, missing_left), and each row's value."""
    p = 1 / (1 + np.exp(-margin))
    g, h = w * (p - y), w * p * (1 - p)
    leaves = [(np.arange(len(y)), 0)]
    found = {0: search(bins, g, h, s)}
    splits = []
    while len(leaves) < s.leaves:
        options = [(found[k][0][0], -k) for k in found if found[k] is not None]
        if not options:
            break
        k = -max(options)[1]
        rows, depth = leaves[k]
        best, left = found.pop(k)
        splits.append((round(best[0], 6), -best[1], -best[2], best[3]))
        leaves[k] = (rows[left], depth + 1)
        leaves.append((rows[~left], depth + 1))
        for q in (k, len(leaves) - 1):
            r, d = leaves[q]
            found[q] = search(bins[r], g[r], h[r], s) if d < s.depth else None
    value = np.zeros(len(y))
    for r, _ in leaves:
        value[r] = -s.rate * g[r].sum() / (h[r].sum() + s.l2)
    return splits, value, len(leaves)


@pytest.mark.parametrize("s", [PLAIN, Settings(trees=2, rate=0.5, leaves=4, depth=9, bins=8, min_rows=20, l2=1.0, rows=1.0, columns=1.0)])
def test_trees_equal_a_search_of_every_split(spark, s):
    df, x, y, w = data(spark)
    model = boosting.fit(df, F3, settings=s)
    bins = model.bins(list(x.T))
    margin = np.full(len(y), math.log((w * y).sum() / (w * (1 - y)).sum()))
    assert model.base == pytest.approx(margin[0]) and len(model.trees) == s.trees
    for tree in model.trees:
        splits, value, leaves = grown(bins, y, w, margin, s)
        assert sum(f < 0 for f in tree.feature) == leaves <= s.leaves
        got = [(round(tree.gain[n], 6), tree.feature[n], tree.bin[n], tree.missing_left[n]) for n in range(len(tree.feature)) if tree.feature[n] >= 0]
        assert sorted(got) == sorted(splits)
        assert np.allclose(np.array(tree.value)[tree.nodes(bins)], value)
        margin = margin + value
    got = np.array([r["p_boosted"] for r in model.predict(df).orderBy("k").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


def test_patience_snapshots_and_samples(spark, tmp_path):
    """Validation of pure noise ends growth early; trees after the best are dropped; a second fit gives the same model."""
    df, _, _, _ = data(spark, 300)
    val = df.withColumn("y", F.pmod(F.xxhash64("k"), F.lit(2)).cast("int"))
    s = Settings(trees=60, rate=0.3, leaves=4, depth=3, bins=8, min_rows=5, patience=3, stop_on="loss", seed=5)
    model = boosting.fit(df, F3, val, s)
    best = int(np.argmax(np.round(model.history, 12)))
    assert len(model.trees) == best + 1 and len(model.history) == best + 1 + 3 < 60
    again = boosting.fit(df, F3, val, s)
    assert again.trees == model.trees
    boosting.save(model, spark, f"{tmp_path}/m.json")
    assert boosting.load(spark, f"{tmp_path}/m.json") == model
    by_auprc = boosting.fit(df, F3, df, Settings(trees=3, leaves=4, bins=8, min_rows=5))
    assert len(by_auprc.history) == 3 and by_auprc.history[-1] > 0.4
    assert boosting.sampled_columns(s, 10, 1) != boosting.sampled_columns(s, 10, 2) and len(boosting.sampled_columns(s, 10, 1)) == 8


def test_margins_carry_over_snapshots(spark, monkeypatch):
    df, x, _, _ = data(spark, 200)
    s = Settings(trees=4, rate=0.3, leaves=3, depth=3, bins=8, min_rows=5, rows=0.7, columns=0.6)
    plain = boosting.fit(df, F3, settings=s)
    monkeypatch.setattr(boosting, "SNAPSHOT", 1)
    often = boosting.fit(df, F3, settings=s)
    bins = plain.bins(list(x.T))
    assert np.allclose(plain.margins(bins), often.margins(bins))


def test_bad_labels_and_weights_raise(spark):
    df, _, _, _ = data(spark, 50)
    for bad in (df.withColumn("y", F.lit(None).cast("int")), df.withColumn("y", F.col("y") * 2), df.withColumn("weight", F.lit(0.0)), df.withColumn("y", F.lit(1)), df.where("k < 0")):
        with pytest.raises(ContractError):
            boosting.fit(bad, F3, settings=PLAIN)
    with pytest.raises(ValueError):
        boosting.fit(df, F3, settings=Settings(stop_on="other"))


def expected(tree, node, row, known):
    """The tree's mean with only the known features given, by cover."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    a, b = tree.left[node], tree.right[node]
    if f in known:
        left = tree.missing_left[node] if row[f] == 0 else row[f] <= tree.bin[node]
        return expected(tree, a if left else b, row, known)
    n = tree.cover[node]
    return sum(tree.cover[c] / n * expected(tree, c, row, known) for c in (a, b))


def test_contributions_equal_all_subsets(spark):
    """Shapley values over all subsets of four features, on trees of depth 4 that meet features again on a path."""
    rng = np.random.default_rng(8)
    n = 400
    x = rng.integers(0, 9, (n, 4)).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-((x[:, 0] > 4) * 2.0 - (x[:, 1] > 3) * (x[:, 2] > 5) * 2 + (x[:, 0] > 7) * (x[:, 3] > 2))))).astype(int)
    x[rng.random((n, 4)) < 0.1] = np.nan
    rows = [(k, *(None if math.isnan(v) else float(v) for v in r), int(t)) for k, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, y int")
    names = ["a", "b", "c", "d"]
    model = boosting.fit(df, names, settings=Settings(trees=3, rate=0.5, leaves=14, depth=4, bins=12, min_rows=3, rows=0.8, columns=1.0), weight=None)
    assert max(len(p.conditions[k]) for t in model.trees for p in attribution.paths(t) for k in range(len(p.features))) > 1
    got = {r["k"]: [r[c] for c in names] for r in attribution.tree_contributions(model, df, ["k"]).collect()}
    bins = model.bins(list(x.T))
    margins, mean = model.margins(bins), attribution.mean_margin(model)
    assert all(math.isclose(sum(got[k]) + mean, margins[k], abs_tol=1e-9) for k in range(n))
    for k in range(0, n, 23):
        for j in range(4):
            others = [f for f in range(4) if f != j]
            want = 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += weight * sum(expected(t, 0, bins[k], {*s, j}) - expected(t, 0, bins[k], set(s)) for t in model.trees)
            assert math.isclose(got[k][j], want, abs_tol=1e-9)


def test_deep_paths_stay_exact():
    """A path of ten features: the quadrature equals the sum over subsets by size."""
    rng = np.random.default_rng(1)
    d = 10
    z, o = rng.random(d), rng.integers(0, 2, d).astype(float)
    path = attribution.Path(2.0, list(range(d)), z.tolist(), [[(1, bool(v), True)] for v in o])
    got = attribution.contributions(np.ones((1, d), np.uint8), [[path]], d)[0]
    met = np.array([1.0 if v else 0.0 for v in o])
    for j in range(d):
        poly = np.array([1.0])
        for k in range(d):
            if k != j:
                poly = np.convolve(poly, [z[k], met[k]])
        want = 2.0 * (met[j] - z[j]) * sum(c * math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s, c in enumerate(poly))
        assert math.isclose(got[j], want, rel_tol=1e-9, abs_tol=1e-12)
