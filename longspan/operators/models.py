"""Models per fold: smoothed climatology, logistic regression, boosted trees, and what they share.

Statistics are fitted on training rows only, each in one pass; predictions are joins or MLlib transforms.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.operators.quality import ContractError, required
from longspan.operators.ranks import medians as exact_medians
from longspan.sources.sinks import write_text


def climatology(train: DataFrame, strata: list[str], month: str = "month", y: str = "y", alpha: float = 1.0, beta: float = 1.0, by: list[str] = ()) -> DataFrame:
    """Smoothed rates by (strata, month), by strata and overall, in by: level 0, 1, 2 and rate."""
    rows = train.select(*by, *strata, month, F.col(y).alias("__y"))
    full = [*by, *strata, month]
    sets = [full, [*by, *strata], list(by)]
    sums = rows.groupingSets([[F.col(c) for c in s] for s in sets], *full).agg(F.grouping_id().alias("g"), ((F.sum("__y") + alpha) / (F.count(F.lit(1)) + alpha + beta)).alias("rate"))
    level = F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2)
    return sums.select(*full, level.alias("level"), "rate")


def predict_climatology(df: DataFrame, rates: DataFrame, strata: list[str], month: str = "month", by: list[str] = (), name: str = "p_climatology") -> DataFrame:
    """df with the rate of its stratum and month, else its stratum's, else the overall one. Null strata match null ones."""
    out = df
    for level, keys in ((0, [*by, *strata, month]), (1, [*by, *strata]), (2, list(by))):
        one = rates.where(F.col("level") == level).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("rate").alias(f"__rate{level}"))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]) if keys else None
        out = (out.join(one, on, "left") if keys else out.join(F.broadcast(one))).drop(*(f"__{k}" for k in keys))
    return out.withColumn(name, F.coalesce("__rate0", "__rate1", "__rate2")).drop("__rate0", "__rate1", "__rate2")


@dataclass
class Scaling:
    """Training medians, means and population deviations by feature; features without a training value are left out."""

    features: list[str]
    median: dict[str, float]
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def columns(self) -> list[Column]:
        return [((F.coalesce(F.col(c).cast("double"), F.lit(self.median[c])) - self.mean[c]) / self.scale[c]).alias(c) for c in self.features]


def fit_scaling(train: DataFrame, features: list[str], chunk: int = 50) -> Scaling:
    """Exact medians first, then mean and deviation of filled columns; a constant column has scale 1."""
    medians = exact_medians(train, features)
    out = Scaling([c for c in features if medians[c] is not None], medians)
    for k in range(0, len(out.features), chunk):
        some = out.features[k : k + chunk]
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in some}
        row = train.agg(*(F.avg(filled[c]).alias(f"{c}__m") for c in some), *(F.stddev_pop(filled[c]).alias(f"{c}__s") for c in some)).first()
        out.mean |= {c: row[f"{c}__m"] or 0.0 for c in some}
        out.scale |= {c: row[f"{c}__s"] or 1.0 for c in some}
    return out


def class_weight_option(value: str | None) -> str | None:
    """none, null or nothing as None; balanced as itself; anything else is an error."""
    if value is None or value.lower() in ("none", "null", ""):
        return None
    if value.lower() == "balanced":
        return "balanced"
    raise ValueError(f"class weight {value!r}")


def weighted(train: DataFrame, strategy: str | None, y: str = "y", design: str = "d_weight") -> DataFrame:
    """train with a column weight: 1, n / (2 n_class), or the design weight (rows without one go)."""
    if strategy == "design":
        return train.withColumn("weight", F.col(design).cast("double")).where("weight > 0")
    if class_weight_option(strategy) is None:
        return train.withColumn("weight", F.lit(1.0))
    n, pos = train.agg(F.count(F.lit(1)), F.sum(F.col(y).cast("long"))).first()
    if not pos or pos == n:
        raise ContractError("balanced weights need both classes")
    return train.withColumn("weight", F.when(F.col(y) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))


@dataclass
class Fitted:
    """A fitted model over scaled features."""

    scaling: Scaling
    model: object
    name: str

    def predict(self, df: DataFrame) -> DataFrame:
        """df with a column of probabilities."""
        keep = df.columns
        scaled = df.select("*", F.struct(*self.scaling.columns()).alias("__s"))
        flat = scaled.select(*keep, *(F.col(f"__s.{c}").alias(f"__s_{k}") for k, c in enumerate(self.scaling.features)))
        vector = VectorAssembler(inputCols=[f"__s_{k}" for k in range(len(self.scaling.features))], outputCol="features").transform(flat)
        return self.model.transform(vector).select(*keep, vector_to_array("probability")[1].alias(self.name))


def save(fitted: Fitted, spark: SparkSession, path: str) -> None:
    """The model in MLlib's format, its features and scaling as JSON beside it."""
    fitted.model.write().overwrite().save(f"{path}/model")
    write_text(spark, json.dumps({"name": fitted.name, "kind": type(fitted.model).__name__, "scaling": asdict(fitted.scaling)}), f"{path}/features.json")


def load(spark: SparkSession, path: str) -> Fitted:
    held = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/features.json").collect()))
    kind = {m.__name__: m for m in (LogisticRegressionModel, GBTClassificationModel)}[held["kind"]]
    return Fitted(Scaling(**held["scaling"]), kind.load(f"{path}/model"), held["name"])


def _vectors(df: DataFrame, scaling: Scaling, more: list[str]) -> DataFrame:
    rows = df.select(*more, *scaling.columns())
    return VectorAssembler(inputCols=scaling.features, outputCol="features").transform(rows).select(*more, "features")


def fit_logistic(train: DataFrame, features: list[str], c: float = 0.1, weight: str | None = None, y: str = "y", name: str = "p_logistic", max_iter: int = 200) -> Fitted:
    """L2 logistic regression on filled, scaled features; c is the inverse strength against the summed loss, so the mean loss takes 1 / (c * sum of weights)."""
    required(train, [*features, y], "train")
    rows = weighted(train, weight, y)
    scaling = fit_scaling(train, features)
    data = _vectors(rows.withColumn("label", F.col(y).cast("double")), scaling, ["label", "weight"])
    total = rows.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, weightCol="weight", tol=1e-8).fit(data)
    return Fitted(scaling, model, name)


def fit_trees(train: DataFrame, features: list[str], val: DataFrame | None = None, weight: str | None = "balanced", y: str = "y", name: str = "p_trees", trees: int = 100, rate: float = 0.03, depth: int = 5, subsample: float = 0.8, seed: int = 0) -> Fitted:
    """Boosted trees; with val, boosting stops when the loss on it no longer falls, and val is not for reporting then."""
    rows = weighted(train, weight, y).withColumn("__val", F.lit(False))
    if val is not None:
        rows = rows.unionByName(val.withColumns({"weight": F.lit(1.0), "__val": F.lit(True)}), allowMissingColumns=True)
    scaling = fit_scaling(train, features)
    data = _vectors(rows.withColumn("label", F.col(y).cast("double")), scaling, ["label", "weight", "__val"])
    gbt = GBTClassifier(maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, weightCol="weight", seed=seed, featureSubsetStrategy="0.8")
    if val is not None:
        gbt = gbt.setValidationIndicatorCol("__val")
    return Fitted(scaling, gbt.fit(data), name)


def linear_contributions(fitted: Fitted, df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact contributions to the log odds of a logistic model: coefficient times distance from the training mean, a column per feature."""
    c = fitted.model.coefficients.toArray()
    return df.select(*keys, *((col * float(w)).alias(f) for col, w, f in zip(fitted.scaling.columns(), c, fitted.scaling.features)))


def run_folds(splits: DataFrame, fit: Callable[[DataFrame, DataFrame | None], Fitted], train_roles: tuple[str, ...] = ("train", "inner_train"), val_roles: tuple[str, ...] = ("val", "inner_val"), refit_roles: tuple[str, ...] = (), stop_on_val: bool = False) -> DataFrame:
    """Predictions of every fold's rows by a model fitted on that fold's training rows; fit_stage is outer.

    With refit_roles, a second model (stage final) is fitted on them too and predicts the rest of the fold's rows, while
    the first (stage inner) predicts validation rows. The loop is over (protocol, fold) pairs; rows stay distributed.
    """
    folds = splits.select("protocol", "fold_id").distinct().orderBy("protocol", "fold_id").collect()
    out = []
    for f in folds:
        rows = splits.where((F.col("protocol") == f["protocol"]) & (F.col("fold_id") == f["fold_id"]))
        role = F.col("split_role")
        train, val = rows.where(role.isin(*train_roles)), rows.where(role.isin(*val_roles))
        first = fit(train, val if stop_on_val else None)
        if not refit_roles:
            out.append(first.predict(rows).withColumn("fit_stage", F.lit("outer")))
            continue
        final = fit(rows.where(role.isin(*refit_roles)), None)
        out.append(first.predict(val).withColumn("fit_stage", F.lit("inner")))
        out.append(final.predict(rows.where(~role.isin(*val_roles))).withColumn("fit_stage", F.lit("final")))
    return reduce(lambda a, b: a.unionByName(b), out)


def ablation(train: DataFrame, test: DataFrame, features: list[str], groups: dict[str, list[str]], fit: Callable[[DataFrame, list[str]], Fitted], metrics: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Metrics of all features and without each group: feature_set, n_features and the metrics' columns, with changes from Full."""
    for g, names in groups.items():
        if not set(names) & set(features):
            raise ContractError(f"group {g} has no feature")
    sets = {"Full": features} | {f"No_{g}": [c for c in features if c not in set(names)] for g, names in groups.items()}
    tables = [metrics(fit(train, cols).predict(test)).withColumns({"feature_set": F.lit(name), "n_features": F.lit(len(cols))}) for name, cols in sets.items()]
    return reduce(lambda a, b: a.unionByName(b), tables)


# The names of the feature families, in their order. A monthly value stands here by its name without _lag1.
CLIMO = ["BIOME", "month"]
MEMORY = ["y_lag1", "fire_count_12m", "months_since_last_fire"]
CLIMATE = ["P_sum_mon", "PET_sum_mon", "TP_sum_mon", "Tmax_mon", "Tmean_mon", "RH_mean_mon", "RH_min_mon", "SM1_mean_mon", "SM2_mean_mon", "VPD_mean_mon", "VPD_max_mon", "WS_mean_mon", "WS_max_mon", "WS_strong_frac", "WD_u_mon", "WD_v_mon", "WD_R_mon"]
CLIMATE_ROLLED = ["P_sum_mon_lag1_roll3m_sum", "PET_sum_mon_lag1_roll3m_sum", "VPD_mean_mon_lag1_roll3m_mean"]
VEGETATION = ["NDVI_mean_mon", "EVI_mean_mon", "LST_day_mon", "LST_night_mon"]
VEGETATION_ROLLED = ["NDVI_mean_mon_lag1_roll3m_mean"]


def families(columns: list[str], vegetation_coverage: bool = False) -> dict[str, list[str]]:
    """The columns of each family that are there: climo (always whole), memory, climate with coverage and missing marks, and vegetation, with coverage only if asked for."""
    marks = [f"{c}_{kind}_lag1" for c in CLIMATE for kind in ("cov", "missing")]
    green = [f"{c}_lag1" for c in VEGETATION] + VEGETATION_ROLLED + ([f"{c}_cov_lag1" for c in VEGETATION] if vegetation_coverage else [])
    wanted = {"memory": MEMORY, "climate": [f"{c}_lag1" for c in CLIMATE] + CLIMATE_ROLLED + marks, "vegetation": green}
    have = set(columns)
    return {"climo": list(CLIMO)} | {k: [c for c in names if c in have] for k, names in wanted.items()}
