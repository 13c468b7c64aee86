import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import metrics, models, resample
from longspan.operators.quality import ContractError


def scores(spark, rows):
    return spark.createDataFrame([(g, k, y, p) for k, (g, y, p) in enumerate(rows)], "g string, k int, y int, p double")


TIED = [("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.8), ("a", 0, 0.1)]


def test_by_hand(spark):
    df = scores(spark, TIED)
    assert math.isclose(metrics.average_precision(df, ["g"]).first()["auprc"], 0.5 + 0.5 * 2 / 3)
    assert metrics.roc_auc(df, ["g"]).first()["roc_auc"] == 0.875
    assert metrics.average_precision_by_row(df, ["g"], ["k"]).first()["auprc_row"] == pytest.approx(0.8333333)
    assert metrics.average_precision_by_row(df.withColumn("k", -F.col("k")), ["g"], ["k"]).first()["auprc_row"] == 1
    assert scores(spark, [("a", 1, 0.8), ("a", 0, 0.4)]).agg(metrics.brier()).first()[0] == pytest.approx(0.1)
    top = metrics.top_fraction(scores(spark, [("a", int(k in (0, 10, 20)), 1 - k / 30) for k in range(30)]), ["g"], (0.05,), ["k"]).first()
    assert (top["k"], top["precision"], top["recall"]) == (2, 0.5, pytest.approx(1 / 3))


def test_without_positives(spark):
    df = scores(spark, [("a", 0, 0.3), ("a", 0, 0.2)])
    assert metrics.average_precision(df, ["g"]).first()["auprc"] is None
    assert metrics.roc_auc(df, ["g"]).first()["roc_auc"] is None
    assert metrics.average_precision_by_row(df, ["g"], ["k"]).first()["auprc_row"] == 0
    assert metrics.top_fraction(df, ["g"], (0.5,), ["k"]).first()["recall"] is None
    assert metrics.at_threshold(df, ["g"], 0.9).first()["f1"] == 0


def test_threshold_and_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [("a", int(y), float(np.clip(0.3 * y + rng.random() * 0.7, 0, 1))) for y in rng.random(400) < 0.2]
    df = scores(spark, rows)
    best = metrics.best_threshold(df, ["g"]).first()
    f1 = lambda t: metrics.at_threshold(df, ["g"], t).first()["f1"]
    assert f1(best["threshold"]) == pytest.approx(best["f1"]) and all(f1(t) <= best["f1"] + 1e-9 for t in (0.3, 0.5, 0.7))
    boot = resample.bootstrap(df, ["g"], "auprc", 30, keys=["k"]).first()
    assert boot["reps"] == 30 and abs(boot["auprc_mean"] - metrics.average_precision(df, ["g"]).first()["auprc"]) < 3 * boot["auprc_std"]


def test_gaps_turn_sign_where_lower_is_better(spark):
    df = spark.createDataFrame([("P1", 0.044672, 0.231193), ("P3", 0.043617, 0.222275)], "name string, Brier double, AUPRC double")
    got = {r["metric"]: r for r in metrics.gap_table(df, "name", "P3", ["Brier", "AUPRC"]).collect()}
    assert got["Brier"]["difference"] == pytest.approx(0.001055) and got["Brier"]["performance_gap"] == pytest.approx(0.001055)
    assert got["AUPRC"]["difference"] == pytest.approx(0.008918) and got["AUPRC"]["performance_gap"] == pytest.approx(-0.008918)


def test_climatology_by_hand(spark):
    train = spark.createDataFrame([("b1", 1, 1), ("b1", 1, 0), ("b1", 1, 0), ("b1", 2, 0)], "BIOME string, month int, y int")
    ask = spark.createDataFrame([("b1", 1), ("b1", 9), ("b9", 1), (None, 1)], "BIOME string, month int")
    out = models.predict_climatology(ask, models.climatology(train, ["BIOME"]), ["BIOME"])
    assert {(r["BIOME"], r["month"]): round(r["p_climatology"], 9) for r in out.collect()} == {("b1", 1): 0.4, ("b1", 9): round(2 / 6, 9), ("b9", 1): round(2 / 6, 9), (None, 1): round(2 / 6, 9)}


def data(spark, n=500):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    return spark.createDataFrame([(float(a), float(b) if k % 7 else None, 5.0, int(v)) for k, ((a, b), v) in enumerate(zip(x, y))], "a double, b double, c double, y int"), x, y


def test_logistic_reaches_the_optimum(spark, tmp_path):
    df, x, y = data(spark)
    fitted = models.fit_logistic(df, ["a", "b", "c"], c=0.1)
    rows = df.select(*fitted.scaling.columns(), "y").toPandas()
    w, b0 = fitted.model.coefficients.toArray(), fitted.model.intercept
    z = rows[["a", "b", "c"]].to_numpy()
    p = 1 / (1 + np.exp(-(z @ w + b0)))
    slope = 0.1 * (z.T @ (p - rows["y"].to_numpy())) + w  # of c * summed loss + |w|^2 / 2
    assert np.abs(slope).max() < 1e-3 and abs(w[2]) < 1e-9
    parts = models.linear_contributions(fitted, df, ["y"]).toPandas()
    assert np.allclose(parts[["a", "b", "c"]].sum(axis=1) + b0, z @ w + b0)
    models.save(fitted, spark, f"{tmp_path}/m")
    again = models.load(spark, f"{tmp_path}/m").predict(df).select("p_logistic").collect()
    assert again == fitted.predict(df).select("p_logistic").collect()
    assert fitted.predict(df).select("p_logistic").where("p_logistic not between 0 and 1").count() == 0


def test_trees_weights_and_folds(spark):
    df, _, _ = data(spark, 300)
    rows = df.withColumns({"protocol": F.lit("P"), "fold_id": F.lit(0), "split_role": F.when(F.rand(1) < 0.7, "train").otherwise("test")})
    out = models.run_folds(rows, lambda train, val: models.fit_trees(train, ["a", "b"], trees=5, depth=2))
    assert metrics.roc_auc(out, ["split_role"], p="p_trees").where("roc_auc < 0.6").count() == 0
    w = {r["y"]: r["s"] for r in models.weighted(df, "balanced").groupBy("y").agg(F.sum("weight").alias("s")).collect()}
    assert w[0] == pytest.approx(w[1])
    assert models.class_weight_option("none") is None and models.class_weight_option("balanced") == "balanced"
    with pytest.raises(ValueError):
        models.class_weight_option("odd")
    with pytest.raises(ContractError):
        models.weighted(df.where("y = 0"), "balanced")


def test_ablation(spark):
    df, _, _ = data(spark, 300)
    table = models.ablation(df, df, ["a", "b"], {"first": ["a"]}, lambda d, c: models.fit_logistic(d, c), lambda d: metrics.roc_auc(d.withColumn("g", F.lit(1)), ["g"], p="p_logistic"))
    got = {r["feature_set"]: r for r in metrics.deltas(table, "feature_set", "Full", ["roc_auc"]).collect()}
    assert got["No_first"]["roc_auc_drop"] > 0.1 and got["No_first"]["n_features"] == 1
    with pytest.raises(ContractError):
        models.ablation(df, df, ["a"], {"none": ["z"]}, None, None)


def test_a_threshold_is_frozen(spark):
    """Chosen on validation rows, applied to test rows as it is."""
    val = [("a", "val", 1, 0.9), ("a", "val", 0, 0.8), ("a", "val", 1, 0.7), ("a", "val", 0, 0.1)]
    test = [("a", "test", 1, 0.75), ("a", "test", 1, 0.6), ("a", "test", 0, 0.95), ("a", "test", 0, 0.2)]
    df = spark.createDataFrame(val + test, "g string, split_role string, y int, p double")
    for group in (["g"], []):
        r = metrics.frozen_threshold(df, group).first()
        assert (r["threshold"], r["precision"], r["recall"], r["f1"]) == (0.7, 0.5, 0.5, 0.5)


def test_top_fraction_and_rows_with_ties(spark):
    """Counted by score, they give what a ranking of all rows gives."""
    rng = np.random.default_rng(5)
    rows = [(int(g), k, int(rng.random() < 0.3), float(rng.integers(0, 6) / 5)) for k, g in enumerate(rng.integers(0, 3, 400))]
    df = spark.createDataFrame(rows, "g int, k int, y int, p double")
    got = {(r["g"], r["fraction"]): (r["k"], r["hits"]) for r in metrics.top_fraction(df, ["g"], (0.01, 0.1, 0.5, 1.0), ["k"]).collect()}
    by_row = {r["g"]: r["auprc_row"] for r in metrics.average_precision_by_row(df, ["g"], ["k"]).collect()}
    for g in range(3):
        ranked = [y for _, _, y, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))]
        for f in (0.01, 0.1, 0.5, 1.0):
            k = max(1, math.ceil(round(len(ranked) * f, 9)))
            assert got[(g, f)] == (k, sum(ranked[:k]))
        hits = np.cumsum(ranked)
        assert math.isclose(by_row[g], sum(h / (k + 1) for k, (h, y) in enumerate(zip(hits, ranked)) if y) / sum(ranked))
