import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from longspan.operators import assemble, catalog, models, quality, sequence, splits, summary
from longspan.operators.quality import ContractError
from longspan.plans import surrogate as S

SF = "/root/testdata/sf0.001"


def month(k, year=2015):
    return dt.date(year + k // 12, k % 12 + 1, 1)


def series(spark, values, name="y", kind="int", cell=1):
    return spark.createDataFrame([(cell, month(k), v) for k, v in enumerate(values)], f"cell_id long, date date, {name} {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("cell_id", "date").collect()]


def test_memory_features_by_hand(spark):
    out = sequence.memory_features(series(spark, [0, 0, 1, 0, 0, 0, 1, 0]), cap=3)
    assert column(out, "y_lag1") == [0, 0, 0, 1, 0, 0, 0, 1]
    assert column(out, "months_since_event") == [3, 3, 3, 0, 1, 2, 3, 0]
    assert column(out, "event_count_12m") == [0, 0, 0, 1, 1, 1, 1, 2]
    assert column(out, "ever_before") == [0, 0, 0, 1, 1, 1, 1, 1]


def test_history_replaces_the_zero_fill(spark):
    rows = series(spark, [0, 1, 0, 0])
    panel = rows.where(F.col("date") > F.lit(month(1)))
    assert column(sequence.memory_features(panel, 9), "y_lag1") == [0, 0]
    assert column(sequence.memory_features(panel, 9, history=rows), "y_lag1") == [1, 0]


def test_rolling_skips_what_is_not_a_number(spark):
    df = series(spark, [1.0, float("nan"), 3.0, None, float("inf"), 2.0], "x", "double")
    name, rolled = sequence.rolling("x", 3, "mean", sequence.by_cell())
    assert name == "x_roll3m_mean" and column(df.withColumn(name, rolled), name) == [1, 1, 2, 3, 3, 2]


def test_no_feature_looks_ahead(spark):
    rng = random.Random(1)
    y = [int(rng.random() < 0.3) for _ in range(40)]
    other = y[:20] + [1 - v for v in y[20:]]
    a, b = (sequence.memory_features(series(spark, v), 60).where(F.col("date") <= F.lit(month(20))).drop("y").orderBy("date").collect() for v in (y, other))
    assert a == b


def test_windows_share_one_shuffle(spark):
    rolls = [("x_lag1", 3, k) for k in ("mean", "sum", "max", "min")]
    df = series(spark, [0, 1, 0]).withColumn("x_lag1", F.lit(1.0)).repartition(4)
    plan = sequence.memory_features(df, 9, rolls=rolls)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lagged_panel_drops_first_month(spark):
    out = assemble.lagged_panel(series(spark, [5, 6, 7], "x"), "cell_id", "date", ["x"], ["cell_id", "date"])
    assert column(out, "x_lag1") == [5, 6] and column(out, "date")[0] == month(1)


def test_joins_keep_their_contract(spark):
    left = series(spark, [1, 2])
    right = spark.createDataFrame([(1, "a"), (1, "b")], "cell_id long, name string")
    with pytest.raises(ContractError):
        assemble.join_static(left, right, ["cell_id"])
    with pytest.raises(ContractError):
        assemble.join_one_to_one(left.union(left), right.limit(1), ["cell_id"])
    one = assemble.join_static(left.withColumn("name", F.lit("old")), right.limit(1), ["cell_id"])
    assert {r["name"] for r in one.collect()} == {"a"}
    kept = assemble.join_static(left.withColumn("name", F.lit("old")), right.limit(1), ["cell_id"], prefer="left")
    assert {r["name"] for r in kept.collect()} == {"old"}
    suffixed = assemble.join_suffixed(left, left.withColumn("z", F.lit(1)), ["cell_id", "date"])
    assert suffixed.columns == ["cell_id", "date", "y", "y_feat", "z"]


def test_reducer_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "a int, a_mean int, a_count int, b_mean int, sum int, pix_count int")
    assert assemble.drop_redundant_reducers(df).columns == ["a", "b_mean", "pix_count"]


def test_core_repair_and_blocks(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "cell_id long, valid_core double")
    assert "valid_core_pass" in assemble.repair_core(df, "valid_core", None, "cell_id").columns
    odd = assemble.repair_core(df.withColumn("valid_core", F.col("valid_core") + 0.5), "valid_core", df, "cell_id")
    assert {"valid_core_inpanel_raw", "valid_core_raw"} <= set(odd.columns)
    meta = spark.createDataFrame([(1, 73.0, 20.0), (2, 80.0, 90.0)], "cell_id long, lon double, lat double")
    out, source = assemble.spatial_block(df, meta, "cell_id")
    assert source == "meta:lonlat" and out.where("block is null").count() == 0
    assert assemble.spatial_block(df, None, "cell_id")[1] == "none"
    with pytest.raises(ContractError):
        assemble.spatial_block(df, None, "cell_id", policy="require")


def test_checks_fire(spark):
    good = series(spark, [0, 1, 0])
    assert quality.enforce(good, quality.panel_checks()) == {"label_not_binary": 0, "date_not_month_start": 0}
    with pytest.raises(ContractError, match="label"):
        quality.enforce(series(spark, [0, 2]), quality.panel_checks())
    with pytest.raises(ContractError, match="month_start"):
        quality.enforce(good.withColumn("date", F.date_add("date", 1)), quality.panel_checks())
    with pytest.warns(UserWarning):
        quality.enforce(series(spark, [0, 2]), [quality.in_range("y", 0, 1, "warn")])
    with pytest.raises(ContractError, match="probability"):
        quality.enforce(good.withColumn("p", F.lit(1.2)), quality.prediction_checks(["p"]))
    with pytest.raises(ContractError):
        quality.required(good, ["y", "nothing"])
    with pytest.raises(ContractError):
        quality.same_rows(good, good.limit(1))
    assert sequence.month_gaps(good.where(F.col("date") != F.lit(month(1)))).count() == 1
    assert sequence.backward_steps(good.union(good)).count() == 3
    assert quality.null_rate_warnings(good.withColumn("z", F.lit(None).cast("int")), ["y", "z"]) == ["z"]


def test_alignment(spark):
    now = series(spark, [1.0, 2.0, 3.0], "x", "double")
    lead = assemble.lagged_panel(now, "cell_id", "date", ["x"], ["cell_id", "date"])
    near = lead.withColumn("x_lag1", F.col("x_lag1") * 1.00000005)
    quality.enforce_alignment(quality.alignment(near, now, ["x"]))
    with pytest.raises(ContractError):
        quality.enforce_alignment(quality.alignment(lead.withColumn("x_lag1", F.col("x_lag1") + 1), now, ["x"]))


def test_constants_by_both_rules(spark):
    df = spark.createDataFrame([(5, 1.0, None), (5, float("inf"), None), (None, 1.0, None)], "a int, b double, c int")
    assert summary.constant_columns(df, ["a", "b", "c"], null_is_value=True) == ["c"]
    assert summary.constant_columns(df, ["a", "b", "c"], null_is_value=False) == ["a", "b", "c"]


def blocks(spark):
    rows = [(c, dt.date(y, 1, 1), b, 0) for c, b in ((1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E")) for y in (2018, 2022, 2023, 2025)]
    return spark.createDataFrame(rows, "cell_id long, date date, block string, y int")


def roles(df, fold, block):
    return {(r["block"] == block, r["date"].year): r["split_role"] for r in df.where(F.col("fold_id") == fold).collect()}


def test_protocols(spark):
    df = blocks(spark)
    assert {(r["date"].year, r["split_role"]) for r in splits.p1(df).collect()} == {(2018, "train"), (2022, "val"), (2023, "test")}
    fold = {r["block"]: r["fold"] for r in splits.fold_map(df, "block", 5, 0).collect()}
    assert sorted(fold.values()) == [0, 1, 2, 3, 4]
    held = next(b for b, k in fold.items() if k == 0)
    assert roles(splits.p3(df, "block"), 0, held) == {(True, 2023): "test", (False, 2018): "train", (False, 2022): "val"}
    assert roles(splits.p2(df, "block"), 0, held) == {(True, 2018): "val", (False, 2018): "train", (True, 2023): "test", (False, 2023): "test"}
    nested = roles(splits.p2_nested(df, "block"), 0, held)
    assert nested[(True, 2018)] == "inner_val" and nested[(False, 2018)] == "inner_train" and nested[(True, 2022)] == "val"
    splits.audit(splits.p3(df, "block"), ["fold_id", "cell_id", "date"], "block")
    with pytest.raises(ContractError):
        splits.audit(splits.p2(df, "block"), ["fold_id", "cell_id", "date"], "block")
    with pytest.raises(ContractError):
        splits.audit(splits.p1(df).unionByName(splits.p1(df).withColumn("split_role", F.lit("val"))), ["cell_id", "date"])
    assert splits.p3_scales(df, {"10km": "block"}).select("protocol").distinct().count() == 1
    sizes = [r["count"] for r in splits.p4_rows(df, ["cell_id", "date"], 3).where("split_role = 'test'").groupBy("fold_id").count().collect()]
    assert sum(sizes) == 20 and max(sizes) - min(sizes) <= 1


def test_admission_is_nested_and_strict(spark):
    panel = S.panel(spark, "/root/testdata/sf0.001").drop("lon", "lat", "area")
    keep = ["cell_id", "date", "year", "month", "y", "month_sin", "month_cos", "s_acctbal", "BIOME"]
    lead = assemble.lagged_panel(panel, "cell_id", "date", [*S.DYNAMIC, "obs_n", "obs_cov"], keep)
    got = catalog.admit(sequence.memory_features(lead, 60), "lead1", dynamic=S.DYNAMIC, static=["s_acctbal"])
    f0, f1, f2 = (set(got.predictors[k]) for k in ("F0", "F1", "F2"))
    assert f0 < f1 < f2 and "y_lag1" in f1 - f0 and "obs_n_lag1" in f2 - f1 and "cell_id" not in f2
    assert catalog.set_differences(got.predictors)["F1-F0"] == sorted(f1 - f0)
    for bad in ("burned_area_m2", "label_aux_x", "ever_burned", "lon", "has_fire_history"):
        with pytest.raises(ContractError):
            catalog.admit(lead.withColumn(bad, F.lit(1)), "lead1")
    with pytest.raises(ContractError):
        catalog.admit(lead.withColumn("VPD_mean_mon", F.lit(1)), "lead1")
    for bad in ("pix_count", "grid10km_id", "y"):
        with pytest.raises(ContractError):
            catalog.normalise([bad], [bad], "lead1")
    with pytest.raises(ContractError):
        catalog.enforce_temporal_audit(["x_lag0"], "lead1")
    with pytest.raises(ContractError):
        catalog.check_roll_columns(["x"])
    with pytest.raises(ContractError):
        catalog.group_map(["a"], {"g": ["b"]})
    table, record = catalog.build(lead, ["s_acctbal", "qty_sum_mon_lag1", "y", "obs_n_lag1"], "lead1", exclude={"regex": ["_n_"]})
    assert record["predictors"] == ["s_acctbal", "qty_sum_mon_lag1"] and "y" in table.columns
    assert catalog.adaptive_call(lambda a, b=2: a + b, a=1, c=9) == 3


def test_names_from_the_future():
    """Every barred name, also those that only begin with lead1_, and the light guard's words."""
    names = ["lead1_VPD", "VPD_lead1", "next_month_T", "xt+1", "t+2", "t+3", "burned_area_12m", "burned_area_48m", "y_lag1", "label_aux_x", "rain"]
    assert catalog.forbidden(names) == sorted(["lead1_VPD", "VPD_lead1", "next_month_T", "xt+1", "t+2", "burned_area_48m", "label_aux_x"])
    assert catalog.suspicious(["lead", "Lead2", "leading", "the next", "next_x", "t+9", "my future", "lag-1", "lag1"]) == ["lead", "Lead2", "the next", "t+9", "my future", "lag-1"]
    with pytest.raises(ContractError):
        catalog.assert_not_suspicious(["next"], "lead1")


def test_forbidden_columns_go_and_labels_are_made(spark):
    df = spark.createDataFrame([(1, "1", 2.0), (2, "0", None), (3, None, 1.0), (4, "x", 0.0)], "cell_id long, burned_flag string, lead1_VPD double")
    left, gone = catalog.without_forbidden(assemble.labelled(df.where("cell_id < 3")))
    assert gone == ["lead1_VPD"] and left.columns == ["cell_id", "y"]
    assert [r["y"] for r in left.orderBy("cell_id").collect()] == [1, 0]


@pytest.mark.parametrize("bad, fault", [(None, "null"), ("x", "not_a_number"), ("NaN", "not_a_number"), ("2", "not_binary"), ("0.5", "not_binary"), ("-1", "not_binary")])
def test_a_label_that_is_not_binary_stops(spark, bad, fault):
    good = spark.createDataFrame([(1, "1"), (2, "0"), (3, "1.0")], "cell_id long, burned_flag string")
    assert [r["y"] for r in assemble.labelled(good).orderBy("cell_id").collect()] == [1, 0, 1]
    with pytest.raises(ContractError, match=fault):
        assemble.labelled(good.union(spark.createDataFrame([(4, bad)], good.schema)))
    with pytest.raises(ContractError):
        assemble.labelled(good.drop("burned_flag"))


def test_calendar_and_null_rows(spark):
    df = spark.createDataFrame([("2020-03-01", 1.0, "a"), ("2021-12-01", float("nan"), None), ("2021-11-01", None, "b")], "date string, x double, s string")
    assert sorted((r["year"], r["month"]) for r in assemble.with_calendar(df).collect()) == [(2020, 3), (2021, 11), (2021, 12)]
    for bad in ("2020-03-02", "no date", None):
        with pytest.raises(ContractError):
            assemble.with_calendar(df.union(spark.createDataFrame([(bad, 1.0, "a")], df.schema)))
    kept, lost = assemble.drop_nulls(df, ["x", "s"])
    assert kept.count() == 1 and {r["column"]: r["n"] for r in lost.collect()} == {"x": 2, "s": 1}
    assert assemble.drop_nulls(df, [])[0].count() == 3


def test_dates_that_go_back(spark):
    rows = [(1, 0, month(0)), (1, 1, month(2)), (1, 2, month(1)), (1, 3, month(1))]
    df = spark.createDataFrame(rows, "cell_id long, k int, date date")
    assert sorted(r["k"] for r in sequence.backward_steps(df, order="k").collect()) == [2, 3]
    assert sequence.backward_steps(df).count() == 1


def test_attrition_reason(spark):
    a, b = spark.range(5).toDF("cell_id"), spark.range(3).toDF("cell_id")
    assert sorted(map(tuple, assemble.absent(a, b, ["cell_id"], "gone").collect())) == [(3, "gone"), (4, "gone")]


def test_split_summary_counts_by_bitmaps(spark):
    """Cells beyond one bitmap bucket, null strata and cells of several strata, against count_distinct; no row is expanded."""
    df = spark.range(120_000).select(
        (F.col("id") % 40_000 * 3).alias("cell_id"), F.lit("P").alias("protocol"), (F.col("id") % 2).cast("int").alias("fold_id"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split_role"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 5).cast("int").alias("B"), (F.col("id") % 7 == 0).cast("int").alias("y"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("date"),
    )
    out = summary.split_summary(df, "B")
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    keys = ["protocol", "fold_id", "split_role"]
    want = {}
    for level, by in (("fold", keys), ("B", [*keys, "B"])):
        for r in df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("c"), F.avg("y").alias("m"), F.min("date").alias("a"), F.max("date").alias("z")).collect():
            want[(level, r["fold_id"], r["split_role"], r["B"] if level == "B" else None)] = (r["n"], r["c"], round(r["m"], 9), r["a"], r["z"])
    got = {(r["qc_level"], r["fold_id"], r["split_role"], r["B"]): (r["n_rows"], r["n_cells"], round(r["y_rate"], 9), r["first_date"], r["last_date"]) for r in out.collect()}
    assert got == want


def test_feature_families():
    names = ["BIOME", "NDVI_mean_mon_lag1", "NDVI_mean_mon_cov_lag1", "NDVI_mean_mon_missing_lag1", "P_sum_mon_lag1", "P_sum_mon_cov_lag1", "P_sum_mon_missing_lag1", "y_lag1", "VPD_mean_mon_lag1_roll3m_mean", "fire_tslf", "LST_day_mon"]
    got = models.families(names)
    assert got == {"climo": ["BIOME", "month"], "memory": ["y_lag1"], "climate": ["P_sum_mon_lag1", "VPD_mean_mon_lag1_roll3m_mean", "P_sum_mon_cov_lag1", "P_sum_mon_missing_lag1"], "vegetation": ["NDVI_mean_mon_lag1"]}
    assert models.families(names, vegetation_coverage=True)["vegetation"] == ["NDVI_mean_mon_lag1", "NDVI_mean_mon_cov_lag1"]


def test_roles_are_inferred_and_patterns_read():
    got = catalog.inferred_roles(["x", "date", "cell_id", "pi", "weight", "n_qc", "tile_id", "grid7"], r"_qc$", "")
    assert got == {"id": ["cell_id", "date"], "weight": ["pi", "weight"], "qc": ["n_qc"], "split": ["tile_id"]}
    assert catalog.inferred_roles(["grid7", "tile_id"], "", "^grid")["split"] == ["grid7"]
    with pytest.raises(ValueError):
        catalog.option_pattern("(", "x")


def test_admission_invariants():
    good = catalog.Admission("lead1", {"F0": ["a"], "F1": ["a", "b"], "F2": ["a", "b", "c"]}, [], {}, {"F1": ["b"], "F2": ["c"]}, ["k"])
    catalog.check_admission(good)
    for sets, added, constants in (({"F0": ["a"], "F1": ["b"]}, {"F1": ["b"]}, []), ({"F0": ["a"], "F1": ["a", "b"]}, {"F1": ["c"]}, []), ({"F0": ["k"], "F1": ["k"]}, {"F1": []}, ["k"]), ({"F0": ["a", "a"]}, {}, [])):
        with pytest.raises(ContractError):
            catalog.check_admission(catalog.Admission("lead1", sets, [], {}, added, constants))


def test_densify_deals_cells_into_groups(spark):
    """No task makes the months of all cells; a cell's months stay in one."""
    cells = spark.range(5000).select(F.col("id").alias("cell_id"))
    some = spark.createDataFrame([(7, "2020-02-01", 1.5)], "cell_id long, date string, v double").withColumn("date", F.to_date("date"))
    out = assemble.densify(some, cells, "cell_id", "date", "2020-01-01", "2020-03-01")
    rows = out.withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert sum(sizes) == 15_000 and max(sizes) <= 2 * assemble.GROUP_CELLS * 3
    assert rows.groupBy("cell_id").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    assert [(r["cell_id"], str(r["date"]), r["v"]) for r in out.where("v IS NOT NULL").collect()] == [(7, "2020-02-01", 1.5)]


def test_months_of_many_cells_and_the_panel_are_not_broadcast(spark):
    """A filter makes the joins inner ones; the months, few bytes once shuffled, were broadcast then."""
    cells = spark.range(50).select(F.col("id").alias("cell_id"))
    some = spark.createDataFrame([(7, "2020-02-01", 1.5)], "cell_id long, date string, v double").withColumn("date", F.to_date("date"))
    out = assemble.densify(some, cells, "cell_id", "date", "2020-01-01", "2020-03-01", merge_cells=49).where("v IS NOT NULL")
    assert [(r["cell_id"], str(r["date"]), r["v"]) for r in out.collect()] == [(7, "2020-02-01", 1.5)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_order_lines_are_dealt_into_groups(spark):
    """The number of tasks that sum lines grows with the lines, whatever Spark makes of their bytes; results stay."""
    n = S.read(spark, SF, "lineitem").count()
    some, one = S.monthly(spark, SF, group_lines=500), S.monthly(spark, SF)
    assert some.rdd.getNumPartitions() == -(-n // 500) > 1
    key = lambda df: sorted((r["cell_id"], r["date"], r["n"], round(r["qty_sum_mon"], 6)) for r in df.collect())
    assert key(some) == key(one)
