"""Logistic regressions of all folds at once, by iteratively reweighted least squares.

A step is one job for all fits: tasks sum gradients, cross products and losses of their rows by fit, one small matrix for
each, and the driver solves a system of the features' size for each fit. So the number of jobs is that of the slowest
fit's steps, whatever the number of folds. A step that raises a fit's loss is halved. Rows stay in one written table with
a fit's rows wherever they stand; a row that trains two stages of a fold is there twice.

Each fit minimises c times the weighted sum of log losses plus half the squared norm of the coefficients (not of the
intercept), on features filled with the medians of its own training rows and scaled by their mean and deviation; a
feature without a value in a fit's training rows has coefficient 0 there, a constant one scale 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from longspan.operators.quality import ContractError, required
from longspan.operators.ranks import percentiles
from longspan.sources.scratch import discard, written

KEYS = ["protocol", "fold_id", "fit_stage"]
TOLERANCE = 1e-7


def staged(splits: DataFrame, train_roles: tuple[str, ...], refit_roles: tuple[str, ...] = ()) -> DataFrame:
    """Training rows with fit_stage: outer; or with refit_roles inner for training roles and final for those."""
    role = F.col("split_role")
    stages = {"inner": train_roles, "final": refit_roles} if refit_roles else {"outer": train_roles}
    of = F.array_compact(F.array(*(F.when(role.isin(*roles), F.lit(name)) for name, roles in stages.items())))
    return splits.withColumn("fit_stage", F.explode(of))


def scalings(train: DataFrame, features: list[str]) -> DataFrame:
    """KEYS, median, mean, scale as arrays in order of features, by fit."""
    x = {f: F.col(f).cast("double") for f in features}
    long = percentiles(train.select(*KEYS, *(x[f].alias(f) for f in features)), features, [0.5], KEYS)
    med = long.groupBy(*KEYS).agg(*(F.max(F.when(F.col("column") == f, F.col("value"))).alias(f"__m{k}") for k, f in enumerate(features)))
    med = written(med)  # a row for each fit
    filled = {k: F.coalesce(F.when(~F.isnan(x[f]), x[f]), F.col(f"__m{k}")) for k, f in enumerate(features)}
    sums = train.join(med, KEYS).groupBy(*KEYS).agg(*(F.struct(F.first(f"__m{k}").alias("median"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("scale")).alias(f"s{k}") for k, c in filled.items()))
    arrays = {n: F.array(*(F.col(f"s{k}.{n}") for k in range(len(features)))) for n in ("median", "mean", "scale")}
    return sums.select(*KEYS, *(c.alias(n) for n, c in arrays.items()))


def _scaled(features: list[str]):
    """The filled, scaled features as an array, from the columns median, mean and scale beside them; 0 without a median."""
    out = []
    for k, f in enumerate(features):
        x = F.col(f).cast("double")
        value = F.coalesce(F.when(~F.isnan(x), x), F.get("median", F.lit(k))) - F.get("mean", F.lit(k))
        out.append(F.coalesce(F.try_divide(value, F.when(F.get("scale", F.lit(k)) > 0, F.get("scale", F.lit(k))).otherwise(1.0)), F.lit(0.0)))
    return F.array(*out)


def weights(train: DataFrame, strategy: str | None, y: str) -> DataFrame:
    """train with a column __w: 1, or n / (2 n_class) of its fit (balanced)."""
    if strategy is None:
        return train.withColumn("__w", F.lit(1.0))
    if strategy != "balanced":
        raise ValueError(strategy)
    counts = written(train.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("long")).alias("__pos")))  # a row for each fit
    own = F.when(F.col(y) == 1, F.col("__pos")).otherwise(F.col("__n") - F.col("__pos"))
    return train.join(counts, KEYS).withColumn("__w", F.col("__n") / (2 * own)).drop("__n", "__pos")


class _Fit:
    """One fit's coefficients (the intercept last) and the last that lowered its loss."""

    def __init__(self, size: int):
        self.beta = np.zeros(size)
        self.good, self.loss, self.step, self.done, self.gradient = self.beta, np.inf, None, False, np.inf

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, c: float) -> None:
        """The next coefficients from sums at the present ones."""
        ridge = np.append(np.ones(len(self.beta) - 1), 0.0)
        loss = c * loss + 0.5 * float((ridge * self.beta**2).sum())
        if loss > self.loss + 1e-12 * max(1.0, abs(self.loss)):
            self.step = self.step / 2
            self.beta = self.good + self.step
            self.done = bool(np.abs(self.step).max() < 1e-14)
            return
        slope = c * gradient + ridge * self.beta
        self.good, self.loss, self.gradient = self.beta, loss, float(np.abs(slope).max())
        self.done = self.gradient < TOLERANCE
        if not self.done:
            self.step = -np.linalg.lstsq(c * hessian + np.diag(ridge), slope, rcond=None)[0]
            self.beta = self.good + self.step


def _sums(state: dict[int, np.ndarray], size: int):
    """By fit: loss, gradient and cross products of a task's rows at the fit's coefficients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + size + size * size) for k in state}
        for b in batches:
            fit, labels, shares = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fit", "y", "w"))
            values = np.hstack([b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(fit), size - 1), np.ones((len(fit), 1))])
            for k, beta in state.items():
                own = fit == k
                if not own.any():
                    continue
                x, y, w = values[own], labels[own], shares[own]
                z = x @ beta
                p = 1 / (1 + np.exp(-z))
                t = total[k]
                t[0] += (w * (np.logaddexp(0, z) - y * z)).sum()
                t[1 : 1 + size] += x.T @ (w * (p - y))
                t[1 + size :] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["fit", "sums"])

    return run


def _added(x: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"fit": x["fit"].iloc[:1], "sums": [np.frombuffer(b"".join(x["sums"])).reshape(len(x), -1).sum(0).tobytes()]})


def _schema(df: DataFrame, **more) -> StructType:
    """KEYS as in df, and more fields."""
    return StructType([*(df.schema[k] for k in KEYS), *(StructField(n, t) for n, t in more.items())])


def fit_all(splits: DataFrame, features: list[str], c: float = 0.1, weight: str | None = None, y: str = "y", train_roles: tuple[str, ...] = ("train", "inner_train"), refit_roles: tuple[str, ...] = (), steps: int = 60) -> DataFrame:
    """KEYS, median, mean, scale, coefficients (arrays in order of features), intercept, gradient (the largest at the end): a row for each fit."""
    required(splits, [*features, y, "protocol", "fold_id", "split_role"], "splits")
    train = weights(staged(splits, train_roles, refit_roles), weight, y)
    scale = written(scalings(train, features))
    fits = scale.select(*KEYS).orderBy(*KEYS).collect()  # a row for each fold and stage
    spark = splits.sparkSession
    numbers = spark.createDataFrame([(*f, k) for k, f in enumerate(fits)], _schema(scale, fit=IntegerType()))
    joined = train.join(scale.join(numbers, KEYS), KEYS)
    rows = written(joined.select("fit", _scaled(features).alias("x"), F.col(y).cast("double").alias("y"), F.col("__w").alias("w")))
    if rows.where("y IS NULL OR NOT y IN (0, 1)").head(1):
        raise ContractError("labels must be 0 or 1")
    size = len(features) + 1
    state = {k: _Fit(size) for k in range(len(fits))}
    for _ in range(steps):
        live = {k: s.beta for k, s in state.items() if not s.done}
        if not live:
            break
        for r in rows.mapInArrow(_sums(live, size), "fit int, sums binary").groupBy("fit").applyInPandas(_added, "fit int, sums binary").collect():
            v = np.frombuffer(r["sums"])
            state[r["fit"]].take(v[0], v[1 : 1 + size], v[1 + size :].reshape(size, size), c)
    discard(rows)
    found = [(*f, [float(v) for v in state[k].good[:-1]], float(state[k].good[-1]), state[k].gradient) for k, f in enumerate(fits)]
    solved = spark.createDataFrame(found, _schema(scale, coefficients=ArrayType(DoubleType()), intercept=DoubleType(), gradient=DoubleType()))
    return scale.join(solved, KEYS)


def predict_all(splits: DataFrame, fits: DataFrame, features: list[str], name: str = "p_logistic", val_roles: tuple[str, ...] = ("val", "inner_val")) -> DataFrame:
    """splits with fit_stage and a column of probabilities: of the one fit of a fold, or of the inner one for validation rows and the final one for the rest.

    One join with a row for each fit, and expressions; no Python.
    """
    stage = F.col("fit_stage")
    mine = (stage == "outer") | F.when(F.col("split_role").isin(*val_roles), stage == "inner").otherwise(stage == "final")
    joined = splits.join(fits, ["protocol", "fold_id"]).where(mine)
    z = F.aggregate(F.zip_with(_scaled(features), F.col("coefficients"), lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b)
    return joined.withColumn("__p", 1 / (1 + F.exp(-z))).select(*splits.columns, "fit_stage", F.col("__p").alias(name))
