import pytest
from pyspark.sql import functions as F

from longspan.sources import readers, sinks


def test_csv_union_by_name(spark, tmp_path):
    (tmp_path / "d_2015.csv").write_text("system:index, a ,b\nx_1,1,2\n")
    (tmp_path / "d_2016.csv").write_text("b,system:index\n3,y_2\n")
    df = readers.read_csv_union(spark, f"{tmp_path}/d_*.csv")
    got = {r["system:index"]: (r["a"], r["b"], r["__source_file__"]) for r in df.collect()}
    assert got == {"x_1": ("1", "2", "d_2015.csv"), "y_2": (None, "3", "d_2016.csv")}
    with pytest.raises(FileNotFoundError):
        readers.read_csv_union(spark, f"{tmp_path}/none*.csv")


def test_parquet_sink_is_atomic_and_backs_up(spark, tmp_path):
    path, df = f"{tmp_path}/t.parquet", spark.range(5)
    sinks.write_parquet(df, path)
    with pytest.raises(FileExistsError):
        sinks.write_parquet(df, path)
    backup = sinks.write_parquet(spark.range(2), path, existing="backup")
    assert readers.read_any(spark, path).count() == 2 and spark.read.parquet(backup).count() == 5
    bad = df.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        sinks.write_parquet(bad, path, existing="overwrite")
    assert spark.read.parquet(path).count() == 2
    assert readers.read_columns(spark, path, ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        readers.read_columns(spark, path, ["nothing"])
    assert readers.read_existing(spark, [path, f"{tmp_path}/absent.parquet"]).count() == 2


def test_texts_and_hashes(spark, tmp_path):
    assert readers.parse_blacklist("# remark\n## Forbidden exact columns\n- lon\n## Forbidden regex columns\nx_.*\n") == {"exact": ["lon"], "prefix": [], "regex": ["x_.*"]}
    assert readers.parse_blacklist(sinks.blacklist_text(["a"], ["b_"], ["c$"])) == {"exact": ["a"], "prefix": ["b_"], "regex": ["c$"]}
    sets = {"F0": ["a"], "F1": ["a", "b"], "F2": ["a", "b", "c"]}
    sinks.write_text(spark, sinks.yaml_text(sets), f"{tmp_path}/sets.yaml")
    assert readers.feature_sets(f"{tmp_path}/sets.yaml") == sets
    sinks.write_text(spark, sinks.yaml_text(sets | {"F0": ["z"]}), f"{tmp_path}/bad.yaml")
    with pytest.raises(ValueError):
        readers.feature_sets(f"{tmp_path}/bad.yaml")
    (tmp_path / "f.csv").write_text("feature\na\nb\na\n")
    assert readers.feature_list(f"{tmp_path}/f.csv") == ["a", "b"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.row_hash(df).first() == sinks.row_hash(df.orderBy(F.desc("k")).select("v", "k")).first()
    assert sinks.row_hash(df).first() != sinks.row_hash(df.withColumn("k", F.col("k") + 1)).first()
    assert sinks.file_hashes(spark, f"{tmp_path}/f.csv").first()["length"] == 14
    assert "| k | v |" in sinks.markdown("T", {"rows": df, "list": ["x"]})
    sinks.write_csv(df, f"{tmp_path}/out.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out.csv").count() == 2


def test_overwrite_leaves_nothing_beside(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    sinks.write_parquet(spark.range(3).toDF("x"), path)
    sinks.write_parquet(spark.range(5).toDF("x"), path, existing="overwrite")
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_feather_is_read_in_tasks(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    for k in range(2):
        feather.write_feather(pa.table({"a": [k, k + 1], "b": ["x", None]}), f"{tmp_path}/{k}.feather")
    got = readers.read_any(spark, f"{tmp_path}/1.feather")
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [(1, "x"), (2, None)]


def test_headers_are_read_in_one_job(spark, tmp_path):
    """Jobs follow the different headers, not the files."""
    jobs = {}
    for n in (4, 12):
        for k in range(n):
            (tmp_path / f"{n}_{k:02d}.csv").write_text(f'id, "name" ,v\n{k},n{k},{k * 2}\n' if k % 2 else f"v,id\n{k * 2},{k}\n")
        spark.sparkContext.setJobGroup(f"headers-{n}", "headers")
        df = readers.read_csv_union(spark, f"{tmp_path}/{n}_*.csv")
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers-{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sorted((int(r["id"]), r["v"], r["__source_file__"]) for r in df.collect()) == [(k, str(k * 2), f"{n}_{k:02d}.csv") for k in range(n)]
    assert jobs[4] == jobs[12]


def test_a_workbook_is_a_folder_of_tables(spark, tmp_path):
    sheets = {"Data dictionary": spark.range(3), "QC": spark.range(2).withColumn("x", F.lit(1 / 3))}
    for kind in ("csv", "parquet"):
        sinks.write_sheets(spark, sheets, f"{tmp_path}/{kind}", kind)
        held = __import__("json").loads((tmp_path / kind / "workbook.json").read_text())["sheets"]
        assert [(s["name"], s["columns"]) for s in held] == [("Data dictionary", ["id"]), ("QC", ["id", "x"])]
        assert [spark.read.format(kind).option("header", True).load(f"{tmp_path}/{kind}/{s['table']}").count() for s in held] == [3, 2]
    with pytest.raises(ValueError):
        sinks.write_sheets(spark, {"a b": spark.range(1), "a_b": spark.range(1)}, f"{tmp_path}/x")


def test_yaml_lists_and_what_is_refused():
    assert readers.parse_yaml_lists("---\n# sets\nF0: # first\n  - a\n  - 'b'\nF1: [a, \"b\", c]\nF2:\n- x\n") == {"F0": ["a", "b"], "F1": ["a", "b", "c"], "F2": ["x"]}
    for bad in ("F0:\n  in:\n    - a\n", "F0:\n  - a: 1\n", "F0: word\n", "- a\n", "F0: [a, [b]]\n", "F0:\n  - - a\n", "F0:\n  - *x\n"):
        with pytest.raises(ValueError):
            readers.parse_yaml_lists(bad)
