import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import irls, models
from longspan.operators.quality import ContractError


def folds(spark, n=600, k=3):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(int)
    rows = [(i, float(a), float(b) if i % 7 else None, 5.0, None, int(v), i % k) for i, ((a, b), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, e double, y int, own int")
    df = df.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("protocol", F.lit("P"))
    role = F.when(F.col("own") == F.col("fold_id"), "test").when(F.col("i") % 5 == 0, "val").otherwise("train")
    return df.withColumn("split_role", role)


NAMES = ["a", "b", "c", "e"]


@pytest.mark.parametrize("weight, refit", [(None, ()), ("balanced", ("train", "val"))])
def test_every_fold_is_at_its_optimum(spark, weight, refit):
    df = folds(spark)
    fits = irls.fit_all(df, NAMES, c=0.5, weight=weight, refit_roles=refit).collect()
    assert len(fits) == (6 if refit else 3)
    rows = df.toPandas()
    for f in fits:
        roles = ("train", "val") if f["fit_stage"] == "final" else ("train",)
        own = rows[(rows["fold_id"] == f["fold_id"]) & rows["split_role"].isin(roles)]
        x = own[NAMES].to_numpy(float)
        med = np.nanmedian(x[:, :3], axis=0)
        filled = np.where(np.isnan(x[:, :3]), med, x[:, :3])
        assert np.allclose(f["median"][:3], med) and f["median"][3] is None
        scale = filled.std(0)
        z = np.column_stack([(filled - filled.mean(0)) / np.where(scale > 0, scale, 1), np.zeros(len(own))])
        y = own["y"].to_numpy()
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if weight else np.ones(len(y))
        beta = np.array(f["coefficients"])
        p = 1 / (1 + np.exp(-(z @ beta + f["intercept"])))
        assert np.abs(0.5 * z.T @ (w * (p - y)) + beta).max() < 1e-6 and abs((w * (p - y)).sum()) < 1e-6
        assert abs(beta[2]) < 1e-9 and abs(beta[3]) < 1e-9 and f["gradient"] < 1e-6


def test_same_as_a_single_fit_and_predictions(spark):
    df = folds(spark)
    fits = irls.fit_all(df, NAMES[:3], c=0.1)
    out = irls.predict_all(df, fits, NAMES[:3])
    assert out.count() == df.count()
    one = df.where("fold_id = 1")
    single = models.fit_logistic(one.where("split_role = 'train'"), NAMES[:3], c=0.1)
    a = {r["i"]: r["p_logistic"] for r in single.predict(one).collect()}
    b = {r["i"]: r["p_logistic"] for r in out.where("fold_id = 1").collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-4 for i in a)


def test_stages_predict_their_own_rows(spark):
    df = folds(spark, 200)
    fits = irls.fit_all(df, ["a"], refit_roles=("train", "val"))
    out = {(r["split_role"], r["fit_stage"]) for r in irls.predict_all(df, fits, ["a"]).select("split_role", "fit_stage").distinct().collect()}
    assert out == {("val", "inner"), ("train", "final"), ("test", "final")}


def test_jobs_do_not_grow_with_folds(spark):
    counts = {}
    for k in (2, 6):
        tag = f"irls-{k}"
        spark.sparkContext.setJobGroup(tag, tag)
        irls.fit_all(folds(spark, 300, k), ["a"], steps=3)
        counts[k] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(counts[6] - counts[2]) <= 3, counts


def test_labels_are_checked(spark):
    with pytest.raises(ContractError):
        irls.fit_all(folds(spark, 100).withColumn("y", F.col("y") + 1), ["a"])
