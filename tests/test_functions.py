import math

import pytest
from pyspark.sql import functions as F

from longspan import functions as C


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], kinds).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw,want", [("20150101_00ab_7", "00ab_7"), ("plain", "plain"), (None, "")])
def test_cell_id(spark, raw, want):
    assert one(spark, C.parse_cell_id(F.col("v")), v=("string", raw)) == want


@pytest.mark.parametrize("month,want", [(1, (0, 1)), (4, (1, 0)), (7, (0, -1))])
def test_season(spark, month, want):
    got = [one(spark, c, v=("int", month)) for c in C.season(F.col("v"))]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want))


@pytest.mark.parametrize("raw,want", [("1.5", 1.5), ("abc", None), ("Infinity", None), ("NaN", None), (None, None)])
def test_safe_numeric(spark, raw, want):
    assert one(spark, C.safe_numeric(F.col("v")), v=("string", raw)) == want


def test_coarser_floors_negative_indices(spark):
    assert one(spark, C.coarser(F.col("v"), 5), v=("long", -7)) == -2
    assert one(spark, C.coarser(F.col("v"), 10), v=("long", -7)) == -1
    assert one(spark, C.coarser(F.col("v"), 5), v=("long", 12)) == 2


@pytest.mark.parametrize("p,clip,weight", [(0.25, 0.25, 4), (1.4, 1, 1), (0.0, 0, None), (-1.0, 0, None), (None, None, None)])
def test_weights(spark, p, clip, weight):
    assert one(spark, C.clip_share(F.col("v")), v=("double", p)) == clip
    assert one(spark, C.design_weight(F.col("v")), v=("double", p)) == weight


def test_dates(spark):
    assert str(one(spark, C.month_start(F.lit(2015), F.col("v")), v=("int", 3))) == "2015-03-01"
    assert one(spark, C.month_start(F.lit(2015), F.col("v")), v=("int", 13)) is None
    assert one(spark, C.to_month(F.col("v")), v=("string", "no date")) is None
    assert str(one(spark, C.to_month(F.col("v")), v=("string", "2020-02-01"))) == "2020-02-01"


def test_rounding_and_names(spark):
    assert [one(spark, C.integer_count(F.col("v")), v=("double", x)) for x in (2.5, 3.5, float("nan"))] == [2, 4, None]
    assert one(spark, C.scale_of(F.col("v")), v=("string", "p3_50km")) == 50
    assert one(spark, C.scale_of(F.col("v")), v=("string", "P1")) is None
    assert one(spark, C.mapped(F.col("v"), {"a": "A"}), v=("string", "a")) == "A"
    assert one(spark, C.mapped(F.col("v"), {"a": "A"}), v=("string", "b")) == "b"
    assert one(spark, C.is_close(F.lit(2.0000001), F.col("v")), v=("double", 2.0)) is True
