"""The registered queries: each operator family over the surrogate panel, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan import functions as C
from longspan.operators import assemble, attribution, boosting, catalog, irls, metrics, models, quality, resample, sequence, splits, summary
from longspan.plans import surrogate as S
from longspan.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = S.WINDOWS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6) -> Column:
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c, digits)


def day(c: str = "date") -> Column:
    return F.col(c).cast("string").alias(c)


def longs(*names: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in names]


def doubles(*names: str) -> list[Column]:
    return [r(c).alias(c) for c in names]


SQL_RN = "round(CAST({} AS DOUBLE), 6)"


def d(*names: str) -> str:
    """Rounded doubles in SQL."""
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def b(*names: str) -> str:
    """Longs in SQL."""
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


DATE = "CAST(date AS VARCHAR) AS date"


@query(f"{S.PREDICTED_SQL}, s AS (SELECT split_role, p, count(*) AS n, sum(y) AS pos FROM predicted GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY split_role) AS total FROM s WINDOW w AS (PARTITION BY split_role ORDER BY p DESC)), a AS (SELECT split_role, sum(n) AS n, max(total) AS n_positive, sum(pos / total * tp / seen) AS auprc FROM c GROUP BY 1), br AS (SELECT split_role, avg((p - y) * (p - y)) AS brier FROM predicted GROUP BY 1) SELECT split_role, {b('n', 'n_positive')}, {d('auprc', 'brier')} FROM a JOIN br USING (split_role)")
def slice_metrics(spark, sf):
    p = S.predicted(spark, sf)
    a = metrics.average_precision(p, ["split_role"]).join(p.groupBy("split_role").agg(metrics.brier().alias("brier")), "split_role")
    return a.select("split_role", *longs("n", "n_positive"), *doubles("auprc", "brier"))


@query(f"{S.PANEL_SQL} SELECT {b('cell_id')}, {DATE}, {b('y', 'obs_n', 'obs_missing')}, {d('qty_sum_mon', 'price_mean_mon', 'disc_mean_mon', 'tax_max_mon', 'obs_cov')} FROM panel")
def panel_monthly(spark, sf):
    return S.panel(spark, sf).select(*longs("cell_id"), day(), *longs("y", "obs_n", "obs_missing"), *doubles(*S.DYNAMIC, "obs_cov"))


@query(f"{S.PANEL_SQL} SELECT m.cell_id, CAST(m.date AS VARCHAR) AS date, {b('n')}, stratum, {b('biome')}, {d('s_acctbal')} FROM monthly m LEFT JOIN cells c ON m.cell_id = c.cell_id")
def left_join_static(spark, sf):
    out = assemble.join_static(S.monthly(spark, sf), S.cells(spark, sf), ["cell_id"])
    return out.select("cell_id", day(), *longs("n"), F.col("STRATUM").alias("stratum"), F.col("BIOME").cast("long").alias("biome"), *doubles("s_acctbal"))


@query(f"{S.PANEL_SQL} SELECT cell_id, CAST(date AS VARCHAR) AS date, 'no_month' AS attrition_reason FROM panel ANTI JOIN monthly USING (cell_id, date)")
def attrition_anti_join(spark, sf):
    return assemble.absent(S.panel(spark, sf).select("cell_id", "date"), S.monthly(spark, sf), ["cell_id", "date"], "no_month").select("cell_id", day(), "attrition_reason")


@query(f"{S.PANEL_SQL} SELECT m.cell_id, CAST(m.date AS VARCHAR) AS date, {b('n')}, {b('y')}, {d('obs_cov')} FROM monthly m JOIN panel p ON m.cell_id = p.cell_id AND m.date = p.date")
def one_to_one_join(spark, sf):
    both = assemble.join_one_to_one(S.monthly(spark, sf), S.panel(spark, sf), ["cell_id", "date"])
    return both.select("cell_id", day(), *longs("n", "y"), *doubles("obs_cov"))


@query(f"{S.PANEL_SQL} SELECT m.cell_id, CAST(m.date AS VARCHAR) AS date, round(m.qty_sum_mon, 6) AS qty_sum_mon, round(p.qty_sum_mon, 6) AS qty_sum_mon_feat, {b('obs_n')} FROM monthly m LEFT JOIN panel p ON m.cell_id = p.cell_id AND m.date = p.date")
def suffixed_join(spark, sf):
    both = assemble.join_suffixed(S.monthly(spark, sf), S.panel(spark, sf), ["cell_id", "date"], drop=("area",))
    return both.select("cell_id", day(), *doubles("qty_sum_mon", "qty_sum_mon_feat"), *longs("obs_n"))


@query(f"{S.PANEL_SQL} SELECT m.cell_id, CAST(m.date AS VARCHAR) AS date, stratum, round(s_acctbal, 6) AS s_acctbal FROM monthly m LEFT JOIN cells USING (cell_id)")
def metadata_join(spark, sf):
    both, missing = assemble.join_metadata(S.monthly(spark, sf), S.cells(spark, sf), "cell_id", ["STRATUM", "s_acctbal", "n", "absent"])
    if missing != ["absent"]:
        raise ValueError(missing)
    return both.select("cell_id", day(), F.col("STRATUM").alias("stratum"), *doubles("s_acctbal"))


@query(f"{S.PANEL_SQL}, chosen AS (SELECT cell_id FROM cells ORDER BY CAST(cell_id AS VARCHAR) LIMIT 10) SELECT cell_id, CAST(date AS VARCHAR) AS date, {b('y')} FROM panel SEMI JOIN chosen USING (cell_id)")
def semi_join_sample(spark, sf):
    return assemble.present(S.panel(spark, sf), sequence.first_cells(S.cells(spark, sf), 10), ["cell_id"]).select("cell_id", day(), *longs("y"))


@query("SELECT c_custkey, CASE WHEN strpos(t, '_') > 0 THEN substr(t, strpos(t, '_') + 1) ELSE t END AS cell_id FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || '_' || c_nationkey || '_' || c_custkey END AS t FROM customer)")
def parse_cell_id(spark, sf):
    c = S.read(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat_ws("_", "c_mktsegment", "c_nationkey", "c_custkey"))
    return c.select("c_custkey", C.parse_cell_id(raw).alias("cell_id"))


@query("SELECT o_orderkey, CAST(make_date(CAST(year(o_orderdate) AS BIGINT), CAST(month(o_orderdate) AS BIGINT), 1) AS VARCHAR) AS date FROM orders")
def month_start_date(spark, sf):
    return S.read(spark, sf, "orders").select("o_orderkey", C.month_start(F.year("o_orderdate"), F.month("o_orderdate")).cast("string").alias("date"))


@query("SELECT month, round(sin(2 * pi() * (month - 1) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * (month - 1) / 12), 6) + 0.0 AS month_cos FROM (SELECT DISTINCT CAST(month(o_orderdate) AS INTEGER) AS month FROM orders)")
def season_encoding(spark, sf):
    sin, cos = C.season(F.col("month"))
    months = S.read(spark, sf, "orders").select(F.month("o_orderdate").alias("month")).distinct()
    return months.select("month", (r(sin) + 0.0).alias("month_sin"), (r(cos) + 0.0).alias("month_cos"))


@query("SELECT event_id, round(CASE WHEN isfinite(x) THEN x END, 6) AS x FROM (SELECT event_id, TRY_CAST(CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE CAST(event_id / 8.0 AS VARCHAR) END AS DOUBLE) AS x FROM events)")
def safe_numeric(spark, sf):
    k = F.pmod("event_id", F.lit(5))
    text = F.when(k == 0, "abc").when(k == 1, "NaN").when(k == 2, "Infinity").otherwise((F.col("event_id") / 8.0).cast("string"))
    return S.read(spark, sf, "events").select("event_id", r(C.safe_numeric(text)).alias("x"))


@query(f"{S.PANEL_SQL} SELECT cell_id, round(least(greatest(pi, 0), 1), 6) AS pi_clip, round(1 / least(greatest(pi, 0), 1), 6) AS d_weight FROM cells")
def weight_clip(spark, sf):
    return S.cells(spark, sf).select("cell_id", r(C.clip_share(F.col("pi"))).alias("pi_clip"), r(C.design_weight(F.col("pi"))).alias("d_weight"))


GRID_SQL = S.PANEL_SQL + ", grid AS (SELECT cell_id, CAST(floor(6378137.0 * radians(lon) / 10000.0) AS BIGINT) AS ix, CAST(floor(6378137.0 * ln(tan(pi() / 4 + radians(least(greatest(lat, -85.05112878), 85.05112878)) / 2)) / 10000.0) AS BIGINT) AS iy FROM cells)"


def _grid(spark, sf) -> DataFrame:
    x, y = C.mercator(F.col("lon"), F.col("lat"))
    return S.cells(spark, sf).select("cell_id", C.grid_index(x, 10).alias("ix"), C.grid_index(y, 10).alias("iy"))


@query(f"{GRID_SQL} SELECT cell_id, ix, iy, ix || '_' || iy AS grid10km_id FROM grid")
def mercator_grid(spark, sf):
    return _grid(spark, sf).withColumn("grid10km_id", C.grid_name(F.col("ix"), F.col("iy")))


@query(f"{GRID_SQL} SELECT cell_id, CAST(floor((ix - 900) / 5.0) AS BIGINT) AS ix50, CAST(floor(iy / 5.0) AS BIGINT) AS iy50, CAST(floor((ix - 900) / 10.0) AS BIGINT) AS ix100, CAST(floor(iy / 10.0) AS BIGINT) AS iy100 FROM grid")
def grid_coarsen(spark, sf):
    g = _grid(spark, sf)
    ix, iy = F.col("ix") - 900, F.col("iy")  # west of the origin, so that negative indices occur
    return g.select("cell_id", C.coarser(ix, 5).alias("ix50"), C.coarser(iy, 5).alias("iy50"), C.coarser(ix, 10).alias("ix100"), C.coarser(iy, 10).alias("iy100"))


LAG_SQL = S.PANEL_SQL + ", lead1 AS (SELECT * FROM (SELECT cell_id, date, y, row_number() OVER w AS rn, lag(qty_sum_mon) OVER w AS qty_sum_mon_lag1, lag(price_mean_mon) OVER w AS price_mean_mon_lag1, lag(disc_mean_mon) OVER w AS disc_mean_mon_lag1, lag(tax_max_mon) OVER w AS tax_max_mon_lag1, lag(obs_n) OVER w AS obs_n_lag1, lag(obs_cov) OVER w AS obs_cov_lag1 FROM panel WINDOW w AS (PARTITION BY cell_id ORDER BY date)) WHERE rn > 1)"


def _lead1(spark, sf, panel: DataFrame | None = None, keep=("cell_id", "date", "y")) -> DataFrame:
    return assemble.lagged_panel(S.panel(spark, sf) if panel is None else panel, "cell_id", "date", [*S.DYNAMIC, "obs_n", "obs_cov"], list(keep))


@query(f"{LAG_SQL} SELECT cell_id, {DATE}, {b('y', 'obs_n_lag1')}, {d('qty_sum_mon_lag1', 'price_mean_mon_lag1', 'disc_mean_mon_lag1', 'tax_max_mon_lag1', 'obs_cov_lag1')} FROM lead1")
def lag1_panel(spark, sf):
    out = _lead1(spark, sf)
    return out.select("cell_id", day(), *longs("y"), C.integer_count(F.col("obs_n_lag1")).alias("obs_n_lag1"), *doubles(*(f"{c}_lag1" for c in S.DYNAMIC), "obs_cov_lag1"))


def _feature(name: str, *columns: str):
    @query(f"{S.FEATURES_SQL} SELECT cell_id, {DATE}, {b(*columns)} FROM features")
    def f(spark, sf):
        return S.features(spark, sf).select("cell_id", day(), *longs(*columns))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_feature("fire_lags", "y_lag1", "y_lag12")
_feature("event_count_12m", "event_count_12m")
_feature("months_since_event", "months_since_event")
_feature("ever_before", "ever_before")


@query(f"{LAG_SQL} SELECT cell_id, {DATE}, round(avg(qty_sum_mon_lag1) OVER w, 6) AS qty_roll, round(sum(disc_mean_mon_lag1) OVER w, 6) AS disc_roll, round(max(price_mean_mon_lag1) OVER w, 6) AS price_roll, round(min(tax_max_mon_lag1) OVER w, 6) AS tax_roll FROM lead1 WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_3m(spark, sf):
    w = sequence.by_cell()
    specs = {"qty_roll": ("qty_sum_mon_lag1", 3, "mean"), "disc_roll": ("disc_mean_mon_lag1", 3, "sum"), "price_roll": ("price_mean_mon_lag1", 3, "max"), "tax_roll": ("tax_max_mon_lag1", 3, "min")}
    return _lead1(spark, sf).select("cell_id", day(), *(r(sequence.rolling(*s, w)[1]).alias(n) for n, s in specs.items()))


@query(f"{S.PANEL_SQL}, g AS (SELECT cell_id, date, year(date) * 12 + month(date) AS k FROM monthly), s AS (SELECT *, k - lag(k) OVER (PARTITION BY cell_id ORDER BY date) AS step FROM g) SELECT cell_id, {DATE}, CAST(step AS INTEGER) AS step FROM s WHERE step <> 1")
def month_gap_check(spark, sf):
    return sequence.month_gaps(S.monthly(spark, sf)).select("cell_id", day(), "step")


@query(f"{S.PANEL_SQL} SELECT cell_id, {DATE}, {b('y')} FROM panel QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY date DESC) <= 3")
def last_k_rows(spark, sf):
    return sequence.last_rows(S.panel(spark, sf), 3).select("cell_id", day(), *longs("y"))


@query(f"{S.PANEL_SQL} SELECT k AS column, round(v, 6) AS missing_rate FROM (UNPIVOT (SELECT avg(CASE WHEN qty_sum_mon IS NULL THEN 1 ELSE 0 END) AS qty_sum_mon, avg(CASE WHEN price_mean_mon IS NULL THEN 1 ELSE 0 END) AS price_mean_mon, avg(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS y, avg(CASE WHEN obs_n IS NULL THEN 1 ELSE 0 END) AS obs_n FROM panel) ON COLUMNS(*) INTO NAME k VALUE v)")
def missing_rates(spark, sf):
    return summary.missing_rates(S.panel(spark, sf), ["qty_sum_mon", "price_mean_mon", "y", "obs_n"]).select("column", r("missing_rate").alias("missing_rate"))


@query(f"{S.PANEL_SQL} SELECT CAST(count(*) FILTER (pi > 1) AS BIGINT) AS n_above_one, CAST(count(*) FILTER (pi <= 0) AS BIGINT) AS n_not_positive, round(avg(CASE WHEN pi > 1 THEN 1 ELSE 0 END), 6) AS rate_above_one, round(avg(CASE WHEN pi <= 0 THEN 1 ELSE 0 END), 6) AS rate_not_positive FROM cells")
def pi_audit(spark, sf):
    return summary.share_audit(S.cells(spark, sf), "pi").select("n_above_one", "n_not_positive", *doubles("rate_above_one", "rate_not_positive"))


@query(f"{S.PANEL_SQL}, x AS (SELECT 'qty_sum_mon' AS k, CAST(qty_sum_mon AS DOUBLE) AS v FROM panel UNION ALL SELECT 'price_mean_mon', price_mean_mon FROM panel UNION ALL SELECT 's_acctbal', s_acctbal FROM panel) SELECT k AS column, round(min(v), 6) AS min, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS max, round(avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END), 6) AS missing_rate, 0.0::DOUBLE AS infinite_rate, round(avg(CASE WHEN v < 0 THEN 1 ELSE 0 END), 6) AS negative_rate FROM x GROUP BY 1")
def numeric_summary(spark, sf):
    out = summary.numeric_summary(S.panel(spark, sf), ["qty_sum_mon", "price_mean_mon", "s_acctbal"])
    return out.select("column", *doubles("min", "p01", "median", "p99", "max", "missing_rate", "infinite_rate", "negative_rate"))


@query(f"{S.PANEL_SQL} SELECT CASE WHEN grouping(year, month) = 3 THEN 'overall' WHEN grouping(year, month) = 1 THEN 'year' ELSE 'month' END AS level, CAST(coalesce(year, month) AS INTEGER) AS value, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, round(avg(y), 6) AS rate FROM panel GROUP BY GROUPING SETS ((), (year), (month))")
def label_rates(spark, sf):
    return summary.label_rates(S.panel(spark, sf)).select("level", "value", "n", "n_positive", r("rate").alias("rate"))


@query(f"{S.PANEL_SQL}, m AS (SELECT cell_id, count(DISTINCT date) AS m FROM monthly GROUP BY 1) SELECT min(m) AS min_months, CAST(median(m) AS DOUBLE) AS median_months, max(m) AS max_months, count(*) AS n_cells FROM m")
def months_per_cell(spark, sf):
    return summary.months_per_cell(S.monthly(spark, sf))


@query(f"{S.PANEL_SQL} SELECT cell_id, round(arg_min(qty_sum_mon, date), 6) AS qty_sum_mon, round(arg_min(tax_max_mon, date), 6) AS tax_max_mon FROM panel GROUP BY 1")
def first_value_per_cell(spark, sf):
    return assemble.first_per_cell(S.panel(spark, sf), "cell_id", "date", ["qty_sum_mon", "tax_max_mon"]).select("cell_id", *doubles("qty_sum_mon", "tax_max_mon"))


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS n_extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(S.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{S.PANEL_SQL} SELECT t.k AS column FROM (VALUES ('k_null'), ('k_one')) t(k), (SELECT count(*) AS n FROM panel) WHERE n > 0")
def constant_columns(spark, sf):
    rows = S.panel(spark, sf).withColumns({"k_one": F.lit(5), "k_null": F.when(F.col("month") == 1, 5)})
    names = summary.constant_columns(rows, [*S.DYNAMIC, "y", "k_one", "k_null"], null_is_value=False)
    return spark.createDataFrame([(c,) for c in names], "column string")


@query(f"{S.PANEL_SQL} SELECT count(*) AS n_checked, count(*) FILTER ((area > 0) <> (y = 1)) AS n_mismatch, round(count(*) FILTER ((area > 0) <> (y = 1)) / count(*), 6) AS mismatch_rate, count(*) FILTER (area > 0) AS n_area_pos, count(*) FILTER (y = 1) AS n_y_pos FROM panel")
def label_consistency(spark, sf):
    return quality.label_consistency(S.panel(spark, sf), "area", "y").select("n_checked", "n_mismatch", r("mismatch_rate").alias("mismatch_rate"), "n_area_pos", "n_y_pos")


@query(f"{LAG_SQL}, now AS (SELECT cell_id, CAST(date + INTERVAL 1 MONTH AS DATE) AS date, qty_sum_mon, obs_n FROM panel), j AS (SELECT 'qty_sum_mon' AS k, CAST(l.qty_sum_mon_lag1 AS DOUBLE) AS a, CAST(n.qty_sum_mon AS DOUBLE) AS c FROM lead1 l JOIN now n USING (cell_id, date) UNION ALL SELECT 'obs_n', l.obs_n_lag1, n.obs_n FROM lead1 l JOIN now n USING (cell_id, date)) SELECT k AS column, count(*) AS compared, count(*) FILTER (abs(a - c) <= 1e-8 + 1e-6 * abs(c)) AS matched, round(coalesce(max(abs(a - c)), 0), 6) AS max_abs_diff, round(count(*) FILTER (abs(a - c) <= 1e-8 + 1e-6 * abs(c)) / count(*), 6) AS match_rate FROM j WHERE a IS NOT NULL OR c IS NOT NULL GROUP BY 1")
def lead1_alignment(spark, sf):
    panel = S.panel(spark, sf)
    out = quality.alignment(_lead1(spark, sf, panel), panel, ["qty_sum_mon", "obs_n"], integers=("obs_n",))
    return out.select("column", "compared", "matched", *doubles("max_abs_diff", "match_rate"))


SPLIT_COLUMNS = ["protocol", "fold_id", "split_role", "cell_id"]
FOLD_SQL = """, folds AS (SELECT biome, CAST((row_number() OVER (ORDER BY md5('0:' || biome)) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT biome FROM panel)),
w AS (SELECT panel.*, fold, CASE WHEN year = 2001 THEN 'test' WHEN year = 2000 THEN 'val' ELSE 'train' END AS part FROM panel JOIN folds USING (biome)),
k AS (SELECT w.*, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS fold_id FROM w)"""


def _split_sql(protocol: str, role: str) -> str:
    return f"{S.PANEL_SQL}{FOLD_SQL}, s AS (SELECT '{protocol}' AS protocol, fold_id, {role} AS split_role, cell_id, date, y, biome FROM k) SELECT protocol, fold_id, split_role, cell_id, {DATE} FROM s WHERE split_role IS NOT NULL"


ROLE_P2 = "CASE WHEN part = 'test' THEN 'test' WHEN part = 'train' AND fold = fold_id THEN 'val' WHEN part = 'train' THEN 'train' END"
ROLE_P2N = "CASE WHEN part = 'test' THEN 'test' WHEN part = 'val' THEN 'val' WHEN fold = fold_id THEN 'inner_val' ELSE 'inner_train' END"
ROLE_P3 = "CASE WHEN part = 'test' AND fold = fold_id THEN 'test' WHEN part <> 'test' AND fold <> fold_id THEN part END"


@query(f"{S.PREDICTED_SQL} SELECT 'P1' AS protocol, CAST(0 AS INTEGER) AS fold_id, split_role, cell_id, {DATE} FROM roles")
def split_p1(spark, sf):
    return splits.p1(S.panel(spark, sf), W).select(*SPLIT_COLUMNS, day())


@query(_split_sql("P2", ROLE_P2))
def split_p2(spark, sf):
    return splits.p2(S.panel(spark, sf), "BIOME", windows=W).select(*SPLIT_COLUMNS, day())


@query(_split_sql("P2_nested", ROLE_P2N))
def split_p2_nested(spark, sf):
    return splits.p2_nested(S.panel(spark, sf), "BIOME", windows=W).select(*SPLIT_COLUMNS, day())


@query(_split_sql("P3", ROLE_P3))
def split_p3(spark, sf):
    return splits.p3(S.panel(spark, sf), "BIOME", windows=W).select(*SPLIT_COLUMNS, day())


@query(f"{S.PANEL_SQL}, f AS (SELECT cell_id, date, CAST((row_number() OVER (ORDER BY md5('0:' || cell_id || '|' || date)) - 1) % 5 AS INTEGER) AS fold FROM panel), k AS (SELECT *, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS fold_id FROM f) SELECT 'P4_row' AS protocol, fold_id, CASE WHEN fold = fold_id THEN 'test' ELSE 'train' END AS split_role, cell_id, {DATE} FROM k")
def split_p4_row(spark, sf):
    return splits.p4_rows(S.panel(spark, sf), ["cell_id", "date"]).select(*SPLIT_COLUMNS, day())


@query(f"{S.PANEL_SQL}, f AS (SELECT cell_id, CAST((row_number() OVER (ORDER BY md5('0:' || cell_id)) - 1) % 5 AS INTEGER) AS fold FROM cells), k AS (SELECT panel.*, fold, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS fold_id FROM panel JOIN f USING (cell_id)) SELECT 'P4_cell' AS protocol, fold_id, CASE WHEN fold = fold_id THEN 'test' ELSE 'train' END AS split_role, cell_id, {DATE} FROM k")
def split_p4_cell(spark, sf):
    return splits.p4_cells(S.panel(spark, sf)).select(*SPLIT_COLUMNS, day())


P3_SQL = f"{S.PANEL_SQL}{FOLD_SQL}, s AS (SELECT 'P3' AS protocol, fold_id, {ROLE_P3} AS split_role, cell_id, date, y, biome FROM k), p3 AS (SELECT * FROM s WHERE split_role IS NOT NULL)"


@query(f"{P3_SQL} SELECT protocol, fold_id, split_role, CASE WHEN grouping(biome) = 0 THEN 'BIOME' ELSE 'fold' END AS qc_level, {b('biome')}, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells, round(avg(y), 6) AS y_rate, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM p3 GROUP BY GROUPING SETS ((protocol, fold_id, split_role), (protocol, fold_id, split_role, biome))")
def split_qc(spark, sf):
    out = summary.split_summary(splits.p3(S.panel(spark, sf), "BIOME", windows=W), "BIOME")
    return out.select("protocol", "fold_id", "split_role", "qc_level", F.col("BIOME").cast("long").alias("biome"), "n_rows", "n_cells", r("y_rate").alias("y_rate"), day("first_date"), day("last_date"))


@query(f"{P3_SQL} SELECT protocol, split_role, count(DISTINCT fold_id) AS n_folds, count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM p3 GROUP BY 1, 2")
def protocol_windows(spark, sf):
    return summary.protocol_windows(splits.p3(S.panel(spark, sf), "BIOME", windows=W)).select("protocol", "split_role", "n_folds", "n_rows", day("first_date"), day("last_date"))


@query(f"{S.PANEL_SQL}{FOLD_SQL}, s AS (SELECT fold_id, {ROLE_P2} AS split_role, cell_id, date FROM k) SELECT cell_id, {DATE}, count(DISTINCT split_role) AS n_roles FROM s WHERE split_role IS NOT NULL GROUP BY cell_id, date HAVING count(DISTINCT split_role) > 1")
def split_overlap(spark, sf):
    return quality.multi_role_rows(splits.p2(S.panel(spark, sf), "BIOME", windows=W), ["cell_id", "date"]).select("cell_id", day(), "n_roles")


@query(f"{S.PANEL_SQL}{FOLD_SQL}, s AS (SELECT 'P2' AS protocol, fold_id, {ROLE_P2} AS split_role, biome FROM k) SELECT protocol, fold_id, {b('biome')} FROM s GROUP BY protocol, fold_id, biome HAVING bool_or(split_role = 'train') AND bool_or(split_role = 'test')")
def block_disjoint(spark, sf):
    return quality.shared_blocks(splits.p2(S.panel(spark, sf), "BIOME", windows=W), "BIOME").select("protocol", "fold_id", F.col("BIOME").cast("long").alias("biome"))


@query(f"{S.PREDICTED_SQL} SELECT cell_id, {DATE}, split_role, {d('p')} FROM predicted")
def climatology_predict(spark, sf):
    return S.predicted(spark, sf).select("cell_id", day(), "split_role", r("p").alias("p"))


@query(f"{S.PREDICTED_SQL}, a AS (SELECT split_role, biome, count(*) AS n_split FROM predicted GROUP BY 1, 2), c AS (SELECT split_role, biome, count(*) AS n_pred FROM predicted WHERE biome <> 2 GROUP BY 1, 2) SELECT split_role, {b('biome')}, n_split, coalesce(n_pred, 0) AS n_pred, n_split = coalesce(n_pred, 0) AS covered FROM a LEFT JOIN c USING (split_role, biome)")
def coverage_check(spark, sf):
    p = S.predicted(spark, sf)
    return quality.coverage(p, p.where("BIOME <> 2"), ["split_role", "BIOME"]).select("split_role", F.col("BIOME").cast("long").alias("biome"), "n_split", "n_pred", "covered")


CUMULATIVE_SQL = S.PREDICTED_SQL + ", s AS (SELECT biome, p, count(*) AS n, sum(y) AS pos FROM predicted WHERE split_role = 'test' GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER g AS total, sum(n) OVER g AS n_all FROM s WINDOW w AS (PARTITION BY biome ORDER BY p DESC), g AS (PARTITION BY biome))"


def _test(spark, sf) -> DataFrame:
    return S.predicted(spark, sf).where("split_role = 'test'").withColumn("biome", F.col("BIOME").cast("long"))


@query(f"{CUMULATIVE_SQL} SELECT {b('biome')}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_positive, round(CASE WHEN max(total) > 0 AND max(total) < max(n_all) THEN sum(pos * ((n_all - total) - (seen - tp) + (n - pos) / 2.0)) / (max(total) * (max(n_all) - max(total))) END, 6) AS roc_auc FROM c GROUP BY 1")
def roc_auc_by_group(spark, sf):
    return metrics.roc_auc(_test(spark, sf), ["biome"]).select("biome", "n", "n_positive", r("roc_auc").alias("roc_auc"))


@query(f"{CUMULATIVE_SQL} SELECT {b('biome')}, round(CASE WHEN max(total) > 0 THEN sum(pos / total * tp / seen) END, 6) AS auprc FROM c GROUP BY 1")
def auprc_by_group(spark, sf):
    return metrics.average_precision(_test(spark, sf), ["biome"]).select("biome", r("auprc").alias("auprc"))


@query(f"{S.PREDICTED_SQL}, o AS (SELECT split_role, y, row_number() OVER w AS k, sum(y) OVER (PARTITION BY split_role ORDER BY p DESC, cell_id, date ROWS UNBOUNDED PRECEDING) AS tp FROM predicted WINDOW w AS (PARTITION BY split_role ORDER BY p DESC, cell_id, date)) SELECT split_role, round(coalesce(sum(CASE WHEN y = 1 THEN tp / k END) / sum(y), 0), 6) AS auprc_row FROM o GROUP BY 1")
def auprc_by_row(spark, sf):
    return metrics.average_precision_by_row(S.predicted(spark, sf), ["split_role"], ["cell_id", "date"]).select("split_role", r("auprc_row").alias("auprc_row"))


@query(f"{S.PREDICTED_SQL}, s AS (SELECT split_role, avg((p - y) * (p - y)) AS brier, count(*) FILTER (p >= 0.06 AND y = 1) AS tp, count(*) FILTER (p >= 0.06) AS called, count(*) FILTER (y = 1) AS pos FROM predicted GROUP BY 1) SELECT split_role, {d('brier')}, round(coalesce(tp / nullif(called, 0), 0), 6) AS precision, round(coalesce(tp / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(called + pos, 0), 0), 6) AS f1 FROM s")
def brier_f1(spark, sf):
    return metrics.at_threshold(S.predicted(spark, sf), ["split_role"], 0.06).select("split_role", *doubles("brier", "precision", "recall", "f1"))


@query(f"{S.PREDICTED_SQL}, o AS (SELECT split_role, y, row_number() OVER (PARTITION BY split_role ORDER BY p DESC, cell_id, date) AS k, count(*) OVER (PARTITION BY split_role) AS n FROM predicted), f AS (SELECT *, unnest([0.01, 0.05, 0.1]) AS fraction FROM o), g AS (SELECT *, greatest(1, ceil(round(n * fraction, 9))) AS top FROM f) SELECT split_role, CAST(fraction AS DOUBLE) AS fraction, CAST(max(top) AS BIGINT) AS k, count(*) FILTER (k <= top AND y = 1) AS hits, round(count(*) FILTER (k <= top AND y = 1) / max(top), 6) AS precision, round(count(*) FILTER (k <= top AND y = 1) / sum(y), 6) AS recall FROM g GROUP BY split_role, fraction")
def topk_metrics(spark, sf):
    return metrics.top_fraction(S.predicted(spark, sf), ["split_role"], (0.01, 0.05, 0.1), ["cell_id", "date"]).select("split_role", "fraction", "k", "hits", *doubles("precision", "recall"))


@query(f"{S.PREDICTED_SQL}, s AS (SELECT p, count(*) AS n, sum(y) AS pos FROM predicted WHERE split_role = 'val' GROUP BY 1), c AS (SELECT p, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS total FROM s WINDOW w AS (ORDER BY p DESC)), f AS (SELECT p, round(2 * tp / (seen + total), 12) AS f1 FROM c) SELECT 'val' AS split_role, round(p, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, p DESC LIMIT 1")
def threshold_select(spark, sf):
    return metrics.best_threshold(S.predicted(spark, sf).where("split_role = 'val'"), ["split_role"]).select("split_role", *doubles("threshold", "f1"))


@query(f"{S.PREDICTED_SQL}, s AS (SELECT biome, p, count(*) AS n, sum(y) AS pos FROM predicted WHERE split_role = 'val' GROUP BY 1, 2), c AS (SELECT biome, p, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY biome) AS total FROM s WINDOW w AS (PARTITION BY biome ORDER BY p DESC)), f AS (SELECT biome, p, row_number() OVER (PARTITION BY biome ORDER BY coalesce(round(2 * tp / nullif(seen + total, 0), 12), 0) DESC, p DESC) AS k FROM c), t AS (SELECT f.biome, f.p AS threshold, avg((x.p - y) * (x.p - y)) AS brier, count(*) FILTER (x.p >= f.p AND y = 1) AS hit, count(*) FILTER (x.p >= f.p) AS called, count(*) FILTER (y = 1) AS pos FROM f JOIN predicted x ON f.biome = x.biome AND x.split_role = 'test' AND f.k = 1 GROUP BY 1, 2) SELECT {b('biome')}, {d('threshold', 'brier')}, round(coalesce(hit / nullif(called, 0), 0), 6) AS precision, round(coalesce(hit / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(called + pos, 0), 0), 6) AS f1 FROM t")
def frozen_threshold(spark, sf):
    p = S.predicted(spark, sf).withColumn("biome", F.col("BIOME").cast("long"))
    return metrics.frozen_threshold(p, ["biome"]).select("biome", *doubles("threshold", "brier", "precision", "recall", "f1"))


@query(f"{S.PREDICTED_SQL} SELECT {b('biome')}, count(*) AS n FROM predicted WHERE y = 1 AND p < 0.05 AND obs_missing = 0 GROUP BY 1")
def blind_spots(spark, sf):
    p = S.predicted(spark, sf).withColumn("valid", 1 - F.col("obs_missing"))
    return summary.value_counts(metrics.blind_spots(p, below=0.05, valid="valid"), "BIOME").select(F.col("BIOME").cast("long").alias("biome"), "n")


ROLE_METRICS_SQL = S.PREDICTED_SQL + ", m AS (SELECT split_role, avg((p - y) * (p - y)) AS brier, avg(y) AS rate, avg(p) AS mean_p FROM predicted GROUP BY 1)"


def _role_metrics(spark, sf) -> DataFrame:
    return S.predicted(spark, sf).groupBy("split_role").agg(metrics.brier().alias("Brier"), F.avg("y").alias("rate"), F.avg("p").alias("mean_p"))


@query(f"{ROLE_METRICS_SQL}, t AS (SELECT * FROM m WHERE split_role = 'train') SELECT m.split_role, round(m.brier, 6) AS brier, round(m.brier - t.brier, 6) AS brier_change, round(t.rate - m.rate, 6) AS rate_drop FROM m, t")
def ablation_delta(spark, sf):
    out = metrics.deltas(_role_metrics(spark, sf), "split_role", "train", ["Brier", "rate"])
    return out.select("split_role", r("Brier").alias("brier"), r("Brier_change").alias("brier_change"), r("rate_drop").alias("rate_drop"))


@query(f"{ROLE_METRICS_SQL}, l AS (UNPIVOT (SELECT split_role, CAST(brier AS DOUBLE) AS \"Brier\", CAST(rate AS DOUBLE) AS rate, CAST(mean_p AS DOUBLE) AS mean_p FROM m) ON \"Brier\", rate, mean_p INTO NAME metric VALUE v), t AS (SELECT metric, v AS rv FROM l WHERE split_role = 'train') SELECT split_role, metric, round(v, 6) AS value, round(rv, 6) AS reference_value, round(v - rv, 6) + 0.0 AS difference, round(CASE WHEN metric = 'Brier' THEN v - rv ELSE rv - v END, 6) + 0.0 AS performance_gap FROM l JOIN t USING (metric) WHERE split_role <> 'train'")
def gap_unpivot(spark, sf):
    out = metrics.gap_table(_role_metrics(spark, sf), "split_role", "train", ["Brier", "rate", "mean_p"])
    return out.select("split_role", "metric", *doubles("value", "reference_value"), *((r(c) + 0.0).alias(c) for c in ("difference", "performance_gap")))


@query(f"{S.PREDICTED_SQL}, q AS (SELECT biome, quantile_cont(price_mean_mon, 0.1) AS q_low, quantile_cont(price_mean_mon, 0.9) AS q_high FROM predicted GROUP BY 1) SELECT {b('biome')}, {d('q_low', 'q_high')}, round(avg(CASE WHEN price_mean_mon <= q_low THEN p END), 6) AS mean_low, round(avg(CASE WHEN price_mean_mon >= q_high THEN p END), 6) AS mean_high, round(avg(CASE WHEN price_mean_mon >= q_high THEN p END) - avg(CASE WHEN price_mean_mon <= q_low THEN p END), 6) AS difference FROM predicted JOIN q USING (biome) GROUP BY biome, q_low, q_high")
def quantile_tail_means(spark, sf):
    p = written(S.predicted(spark, sf).select(F.col("BIOME").cast("long").alias("biome"), "price_mean_mon", "p"))  # read for the quantiles and again for the means
    return metrics.tail_means(p, "price_mean_mon", "p", ["biome"]).select("biome", *doubles("q_low", "q_high", "mean_low", "mean_high", "difference"))


SHARE_SQL = S.PANEL_SQL + ", a AS (SELECT biome, avg(abs(qty_sum_mon)) / 1000 AS qty, avg(abs(price_mean_mon)) / 100000 AS price, avg(abs(disc_mean_mon)) AS disc, avg(abs(tax_max_mon)) AS tax FROM panel GROUP BY 1), l AS (SELECT biome, 'volume' AS feature_group, qty + price AS m FROM a UNION ALL SELECT biome, 'rates', disc + tax FROM a), s AS (SELECT *, m / sum(m) OVER (PARTITION BY biome) AS share FROM l)"


def _shares(spark, sf) -> DataFrame:
    p = S.panel(spark, sf).select(F.col("BIOME").cast("long").alias("biome"), (F.col("qty_sum_mon") / 1000).alias("qty"), (F.col("price_mean_mon") / 100000).alias("price"), F.col("disc_mean_mon").alias("disc"), F.col("tax_max_mon").alias("tax"))
    groups = spark.createDataFrame([("qty", "volume"), ("price", "volume"), ("disc", "rates"), ("tax", "rates")], "feature string, feature_group string")
    return metrics.group_shares(metrics.mean_abs(p, ["qty", "price", "disc", "tax"], ["biome"]), F.broadcast(groups), ["biome"])


@query(f"{SHARE_SQL} SELECT {b('biome')}, feature_group, round(m, 6) AS mean_abs_sum, {d('share')} FROM s")
def group_share(spark, sf):
    return _shares(spark, sf).select("biome", "feature_group", *doubles("mean_abs_sum", "share"))


@query(f"{SHARE_SQL} SELECT {b('biome')}, round(max(CASE WHEN feature_group = 'volume' THEN share END), 6) AS volume, round(max(CASE WHEN feature_group = 'rates' THEN share END), 6) AS rates FROM s GROUP BY 1")
def group_share_pivot(spark, sf):
    return metrics.group_pivot(_shares(spark, sf), "biome", ["volume", "rates"]).select("biome", *doubles("volume", "rates"))


@query(f"{S.PANEL_SQL} SELECT cell_id, {DATE}, {b('biome')} FROM panel QUALIFY row_number() OVER (PARTITION BY biome ORDER BY md5('7:' || cell_id || ':' || date)) <= 20")
def stratified_sample(spark, sf):
    return sequence.sample_per_stratum(S.panel(spark, sf), "BIOME", 20, ["cell_id", "date"], seed=7).select("cell_id", day(), F.col("BIOME").cast("long").alias("biome"))


@query(f"{S.PANEL_SQL} SELECT cell_id, {DATE} FROM panel ORDER BY md5('7:' || cell_id || ':' || date) LIMIT 100")
def fixed_sample(spark, sf):
    return sequence.sample_fixed(S.panel(spark, sf), 100, ["cell_id", "date"], seed=7).select("cell_id", day())


@query(f"{S.PANEL_SQL}, s AS (SELECT unnest([1, 0, -1]) AS shift), o AS (SELECT cell_id, shift, CAST(date + to_months(CAST(shift AS INTEGER)) AS DATE) AS date, y AS other FROM panel, s), l AS (SELECT cell_id, date, lag(y) OVER (PARTITION BY cell_id ORDER BY date) AS yl FROM panel) SELECT CAST(shift AS INTEGER) AS shift, count(*) AS compared, round(avg(CASE WHEN yl = other THEN 1 ELSE 0 END), 6) AS match_rate FROM l JOIN o USING (cell_id, date) WHERE yl IS NOT NULL GROUP BY 1")
def label_shift_search(spark, sf):
    panel = S.panel(spark, sf)
    lead = panel.select("cell_id", "date", F.lag("y").over(sequence.by_cell()).alias("y")).where("y is not null")
    return quality.label_shift(lead, panel).select("shift", "compared", r("match_rate").alias("match_rate"))


@query(f"{S.PANEL_SQL}, c AS (SELECT cell_id, count(*) AS n, count(DISTINCT date) AS m FROM monthly GROUP BY 1) SELECT {b('sum(n)').replace('AS sum(n)', 'AS n_rows')}, count(*) AS n_cells, CAST(sum(n - m) AS BIGINT) AS n_duplicates, count(*) FILTER (m <> 83) AS n_cells_off FROM c")
def panel_index(spark, sf):
    return quality.panel_index(S.monthly(spark, sf), 83)


@query(f"{S.PANEL_SQL} SELECT count(*) AS n_rows, count(*) - count(DISTINCT cell_id) AS n_duplicate_cells, count(*) FILTER (lon NOT BETWEEN -180 AND 180) AS n_lon_bad, count(*) FILTER (lat NOT BETWEEN -90 AND 90) AS n_lat_bad, round(avg(CASE WHEN pi IS NULL THEN 1 ELSE 0 END), 6) AS pi_null_rate FROM cells")
def metadata_quality(spark, sf):
    return quality.metadata_quality(S.cells(spark, sf)).select("n_rows", "n_duplicate_cells", "n_lon_bad", "n_lat_bad", r("pi_null_rate").alias("pi_null_rate"))


@query(f"{S.FEATURES_SQL} SELECT count(*) FILTER (event_count_12m NOT BETWEEN 0 AND 12) AS count_bad, count(*) FILTER (months_since_event NOT BETWEEN 0 AND 60) AS since_bad, count(*) FILTER (y NOT IN (0, 1)) AS y_bad, count(*) FILTER (day(date) <> 1) AS date_bad FROM features")
def range_checks(spark, sf):
    checks = {c.name: c.bad for c in quality.memory_checks(S.CAP) + quality.panel_checks()}
    named = {"count_bad": "event_count_12m_out_of_range", "since_bad": "months_since_event_out_of_range", "y_bad": "label_not_binary", "date_bad": "date_not_month_start"}
    return S.features(spark, sf).agg(*(F.count_if(checks[v]).alias(k) for k, v in named.items()))


@query(f"{LAG_SQL}, few AS (SELECT DISTINCT cell_id FROM lead1 ORDER BY CAST(cell_id AS VARCHAR) LIMIT 50), g AS (SELECT cell_id, date, avg(qty_sum_mon_lag1) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM lead1) SELECT cell_id, {DATE} FROM g SEMI JOIN few USING (cell_id) WHERE month(date) = 5 AND x IS NOT NULL")
def rolling_recheck(spark, sf):
    """Rolled means with an error planted in every May: the check finds those rows and no others."""
    lead = _lead1(spark, sf)
    name, rolled = sequence.rolling("qty_sum_mon_lag1", 3, "mean", sequence.by_cell())
    wrong = lead.withColumn(name, rolled).withColumn(name, F.col(name) + F.when(F.month("date") == 5, 1.0).otherwise(0.0))
    return quality.rolling_recheck(wrong, "qty_sum_mon_lag1", name, 3, sequence.first_cells(lead, 50), atol=1e-6).select("cell_id", day())


@query("SELECT n_name, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 6) AS building, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def joined_group_means(spark, sf):
    c = assemble.join_static(S.read(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), S.read(spark, sf, "nation"), ["n_nationkey"])
    return c.groupBy("n_name").agg(r(F.avg(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal")))).alias("building"), F.count(F.lit(1)).alias("n"))


@query(f"{S.PANEL_SQL} SELECT count(DISTINCT cell_id) AS n_cells FROM monthly")
def joined_cells(spark, sf):
    return summary.joined_cells(assemble.join_static(S.monthly(spark, sf), S.cells(spark, sf), ["cell_id"]), ["STRATUM", "BIOME"])


@query(f"{S.PANEL_SQL} SELECT 'P1_year' AS protocol, CAST(0 AS INTEGER) AS fold_id, CASE WHEN year >= 2000 THEN 'test' ELSE 'train' END AS split_role, cell_id, {DATE} FROM panel WHERE year BETWEEN 1996 AND 2001")
def split_by_year(spark, sf):
    return splits.by_year(S.panel(spark, sf), (1996, 1999), (2000, 2001)).select(*SPLIT_COLUMNS, day())


SCALES = {"10km": 1, "50km": 5, "100km": 10}


@query(
    f"{GRID_SQL}, s AS (SELECT '10km' AS scale, cell_id, ix || '_' || iy AS block FROM grid UNION ALL SELECT '50km', cell_id, CAST(floor(ix / 5.0) AS BIGINT) || '_' || CAST(floor(iy / 5.0) AS BIGINT) FROM grid UNION ALL SELECT '100km', cell_id, CAST(floor(ix / 10.0) AS BIGINT) || '_' || CAST(floor(iy / 10.0) AS BIGINT) FROM grid), "
    "f AS (SELECT scale, block, CAST((row_number() OVER (PARTITION BY scale ORDER BY md5('42:' || block)) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT scale, block FROM s)), "
    "k AS (SELECT s.scale, fold, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS fold_id, p.cell_id, p.year FROM s JOIN f USING (scale, block) JOIN panel p USING (cell_id)), "
    "r AS (SELECT 'p3_' || scale AS protocol, fold_id, CASE WHEN year = 2001 THEN CASE WHEN fold = fold_id THEN 'test' END WHEN fold <> fold_id THEN CASE WHEN year = 2000 THEN 'val' ELSE 'train' END END AS split_role, cell_id FROM k) "
    "SELECT CAST(regexp_extract(protocol, 'p3_([0-9]+)km', 1) AS INTEGER) AS scale, fold_id, split_role, count(*) AS n, count(DISTINCT cell_id) AS n_cells FROM r WHERE split_role IS NOT NULL GROUP BY ALL"
)
def split_p3_scales(spark, sf):
    g = _grid(spark, sf)
    blocks = g.select("cell_id", *(C.grid_name(C.coarser(F.col("ix"), k), C.coarser(F.col("iy"), k)).alias(f"grid{n}_id") for n, k in SCALES.items()))
    rows = assemble.join_static(S.panel(spark, sf), blocks, ["cell_id"])
    out = splits.p3_scales(rows, {n: f"grid{n}_id" for n in SCALES}, windows=W)
    return out.groupBy(C.scale_of(F.col("protocol")).alias("scale"), "fold_id", "split_role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("n_cells"))


@query(f"{S.PANEL_SQL} SELECT cell_id FROM cells INTERSECT SELECT cell_id FROM monthly")
def common_cells(spark, sf):
    return assemble.common(S.cells(spark, sf), S.monthly(spark, sf), ["cell_id"])


@query(f"{S.PANEL_SQL} SELECT cell_id, {DATE}, {b('m')} FROM (SELECT cell_id, date, max(y) OVER (PARTITION BY cell_id) AS m FROM panel)")
def ever_in_series(spark, sf):
    return S.panel(spark, sf).select("cell_id", day(), sequence.ever_at_all(F.col("y"), "cell_id").cast("long").alias("m"))


@query(f"{CUMULATIVE_SQL}, a AS (SELECT biome, sum(n) AS n, sum(pos) AS n_positive, CASE WHEN max(total) > 0 THEN sum(pos / total * tp / seen) END AS auprc, CASE WHEN max(total) > 0 AND max(total) < max(n_all) THEN sum(pos * ((n_all - total) - (seen - tp) + (n - pos) / 2.0)) / (max(total) * (max(n_all) - max(total))) END AS roc_auc FROM c GROUP BY 1), t AS (SELECT biome, avg((p - y) * (p - y)) AS brier, count(*) FILTER (p >= 0.06 AND y = 1) AS hit, count(*) FILTER (p >= 0.06) AS called, count(*) FILTER (y = 1) AS pos FROM predicted WHERE split_role = 'test' GROUP BY 1) SELECT {b('biome', 'n', 'n_positive')}, {d('auprc', 'roc_auc', 'brier')}, round(coalesce(hit / nullif(called, 0), 0), 6) AS precision, round(coalesce(hit / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(called + pos, 0), 0), 6) AS f1 FROM a JOIN t USING (biome)")
def group_performance(spark, sf):
    out = metrics.metric_table(_test(spark, sf), ["biome"], threshold=0.06)
    return out.select("biome", "n", "n_positive", *doubles("auprc", "roc_auc", "brier", "precision", "recall", "f1"))


@query(f"{S.PANEL_SQL}, m AS (SELECT avg(abs(qty_sum_mon)) AS qty_sum_mon, avg(abs(price_mean_mon)) AS price_mean_mon, avg(abs(tax_max_mon)) AS tax_max_mon FROM panel), l AS (UNPIVOT m ON COLUMNS(*) INTO NAME feature VALUE v) SELECT feature, round(v, 6) AS mean_abs FROM l ORDER BY v DESC LIMIT 2")
def top_features(spark, sf):
    return metrics.top_features(metrics.mean_abs(S.panel(spark, sf), ["qty_sum_mon", "price_mean_mon", "tax_max_mon"]), 2).select("feature", r("mean_abs").alias("mean_abs"))


DICTIONARY_SQL = S.FEATURES_SQL + """, c AS (SELECT unnest(['cell_id', 'date', 'year', 'month', 'y', 'month_sin', 'month_cos', 'qty_sum_mon', 'price_mean_mon', 'disc_mean_mon', 'tax_max_mon', 'obs_n', 'obs_missing', 'obs_cov', 'area',
  's_acctbal', 'BIOME', 'STRATUM', 'lon', 'lat', 'pi', 'pi_clip', 'd_weight', 'y_lag1', 'y_lag12', 'ever_before', 'event_count_12m', 'months_since_event']) AS "column"),
k AS (SELECT "column", CASE WHEN "column" IN ('cell_id', 'date', 'year', 'month') THEN 'key' WHEN "column" = 'y' THEN 'label' WHEN "column" IN ('pi', 'pi_clip', 'd_weight') THEN 'weight'
  WHEN "column" IN ('BIOME', 'STRATUM') THEN 'stratum' WHEN starts_with("column", 'month_') THEN 'derived' WHEN regexp_full_match("column", 'y_lag[0-9]+|event_count_[0-9]+m|months_since_event|ever_before') THEN 'memory'
  WHEN "column" IN ('lon', 'lat') THEN 'forbidden' WHEN starts_with("column", 'obs_') THEN 'quality' WHEN "column" = 's_acctbal' THEN 'static' WHEN contains("column", '_mon') THEN 'dynamic' ELSE 'other' END AS role FROM c),
w AS (SELECT *, CASE WHEN role = 'memory' THEN 'month before' WHEN role IN ('static', 'stratum', 'weight', 'key') THEN 'fixed' ELSE 'same month' END AS availability FROM k),
v AS (SELECT unnest(['cell_id', 'date', 'year', 'month', 'y', 'month_sin', 'month_cos', 'qty_sum_mon', 'price_mean_mon', 'disc_mean_mon', 'tax_max_mon', 'obs_n', 'obs_missing', 'obs_cov', 'area', 's_acctbal', 'BIOME', 'STRATUM', 'lon', 'lat', 'pi', 'pi_clip', 'd_weight', 'y_lag1', 'y_lag12', 'ever_before', 'event_count_12m', 'months_since_event']) AS "column",
  unnest([count(cell_id), count(date), count(year), count(month), count(y), count(month), count(month), count(qty_sum_mon), count(price_mean_mon), count(disc_mean_mon), count(tax_max_mon), count(obs_n), count(obs_missing), count(obs_cov), count(area), count(s_acctbal), count(biome), count(stratum), count(lon), count(lat), count(pi), count(pi), count(pi), count(y_lag1), count(y_lag12), count(ever_before), count(event_count_12m), count(months_since_event)]) AS n_values FROM features)
SELECT "column", role, CASE WHEN starts_with("column", 'qty') THEN 'items' WHEN starts_with("column", 'price') THEN 'currency' ELSE '' END AS unit,
  CASE WHEN starts_with("column", 'qty') OR starts_with("column", 'price') THEN 'orders' ELSE '' END AS source, availability,
  CASE WHEN role IN ('label', 'forbidden') THEN 'high' WHEN availability = 'same month' AND role IN ('dynamic', 'quality') THEN 'timing' ELSE 'none' END AS leakage_risk, n_values FROM w JOIN v USING ("column")"""


def _values(df: DataFrame) -> DataFrame:
    """column, n_values: the values of each column that are not null, in one pass."""
    return df.agg(*(F.count(c).alias(c) for c in df.columns)).unpivot([], df.columns, "column", "n_values")


@query(DICTIONARY_SQL)
def data_dictionary(spark, sf):
    """What the names of a table's columns say of them, beside how many values each really holds."""
    features = S.features(spark, sf)
    names = catalog.dictionary(spark, features.columns, [catalog.Source("qty", "items", "orders"), catalog.Source("price", "currency", "orders")], ["s_acctbal"])
    return names.join(_values(features), "column")


ADMISSION_SQL = """
WITH f AS (SELECT * FROM (VALUES (0, ['month_sin', 'month_cos'] || ['s_acctbal'] || list_transform(['qty_sum_mon', 'price_mean_mon', 'disc_mean_mon', 'tax_max_mon', 'obs_cov'], lambda x: x || '_lag1')),
  (1, ['y_lag1', 'y_lag12', 'ever_before', 'event_count_12m', 'months_since_event']), (2, ['obs_n_lag1'])) AS t(step, names)),
e AS (SELECT step, unnest(names) AS feature, unnest(range(len(names))) AS k FROM f), s AS (SELECT unnest([0, 1, 2]) AS up_to)
SELECT 'F' || up_to AS feature_set, CAST(row_number() OVER (PARTITION BY up_to ORDER BY step, k) - 1 AS INTEGER) AS position, feature FROM e JOIN s ON step <= up_to"""


@query(ADMISSION_SQL)
def feature_admission(spark, sf):
    panel = S.panel(spark, sf).drop("lon", "lat")
    lead = _lead1(spark, sf, panel, ("cell_id", "date", "year", "month", "y", "month_sin", "month_cos", "s_acctbal", "BIOME", "STRATUM", "pi", "pi_clip", "d_weight"))
    got = catalog.admit(sequence.memory_features(lead, S.CAP), "lead1", dynamic=S.DYNAMIC, static=["s_acctbal"])
    return spark.createDataFrame([(s, k, c) for s, names in got.predictors.items() for k, c in enumerate(names)], "feature_set string, position int, feature string")


def _by_time(spark, sf) -> DataFrame:
    """Features with roles by time, written: a fit reads its rows many times, and each time would begin at the order lines."""
    return written(splits.p1(S.features(spark, sf), W))


MODEL_FEATURES = ["month_sin", "month_cos", "s_acctbal", "y_lag1", "y_lag12", "event_count_12m", "months_since_event"]


@query()
def logistic_p1(spark, sf):
    rows = _by_time(spark, sf)
    out = models.run_folds(rows, lambda train, val: models.fit_logistic(train, MODEL_FEATURES, weight="balanced"))
    return metrics.metric_table(out, ["split_role"], p="p_logistic")


@query()
def trees_p1(spark, sf):
    rows = _by_time(spark, sf)
    out = models.run_folds(rows, lambda train, val: models.fit_trees(train, MODEL_FEATURES, val), stop_on_val=True)
    return metrics.metric_table(out.where("split_role <> 'val'"), ["split_role"], p="p_trees")


TREE_FEATURES = ["s_acctbal", "event_count_12m", "months_since_event", "y_lag12", "qty_sum_mon"]
ROOT = boosting.Settings(bins=16, min_rows=20, rows=1.0, columns=1.0)
_VALUES = " UNION ALL ".join(f"SELECT {k} AS k, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, y FROM roles WHERE split_role = 'train'" for k, f in enumerate(TREE_FEATURES))
ROOT_SQL = f"""{S.PREDICTED_SQL}, x AS ({_VALUES}), m AS (SELECT avg(y) AS m FROM roles WHERE split_role = 'train'),
cuts AS (SELECT feature, list_distinct(quantile_disc(v, {[k / 16 for k in range(1, 16)]})) AS cuts FROM x GROUP BY 1),
hist AS (SELECT k, feature, CASE WHEN v IS NULL THEN 0 ELSE 1 + len(list_filter(cuts, lambda c: c < v)) END AS bin, count(*) AS n, sum(m - y) AS g, sum(m * (1 - m)) AS h FROM x JOIN cuts USING (feature), m GROUP BY ALL)"""


def _root_sums(spark, sf) -> DataFrame:
    train = _by_time(spark, sf).where("split_role = 'train'")
    model, state = boosting.prepared(train, TREE_FEATURES, bins=ROOT.bins, weight=None)
    return boosting.histogram(state, model, ROOT, boosting.Grower(ROOT), [], list(range(len(TREE_FEATURES))), 0)


def _feature_name() -> Column:
    return F.get(F.array(*map(F.lit, TREE_FEATURES)), F.col("feature")).alias("feature")


@query(f"{ROOT_SQL} SELECT feature, CAST(bin AS INTEGER) AS bin, n, round(g, 4) AS g, round(h, 4) AS h FROM hist")
def tree_histogram(spark, sf):
    """Gradients of the first boosting round at the root, by feature and bin."""
    sums = _root_sums(spark, sf).where("node = 0").groupBy("feature", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "g", "h")))
    return sums.select(_feature_name(), "bin", *longs("n"), r("g", 4).alias("g"), r("h", 4).alias("h"))


@query(
    f"""{ROOT_SQL}, miss AS (SELECT feature, sum(CASE WHEN bin = 0 THEN n ELSE 0 END) AS nm, sum(CASE WHEN bin = 0 THEN g ELSE 0 END) AS gm, sum(CASE WHEN bin = 0 THEN h ELSE 0 END) AS hm, sum(n) AS na, sum(g) AS ga, sum(h) AS ha FROM hist GROUP BY 1),
up AS (SELECT k, feature, bin, sum(CASE WHEN bin > 0 THEN n ELSE 0 END) OVER w AS nu, sum(CASE WHEN bin > 0 THEN g ELSE 0 END) OVER w AS gu, sum(CASE WHEN bin > 0 THEN h ELSE 0 END) OVER w AS hu FROM hist WINDOW w AS (PARTITION BY feature ORDER BY bin)),
side AS (SELECT k, feature, bin, s AS missing_left, nu + CASE WHEN s THEN nm ELSE 0 END AS nl, gu + CASE WHEN s THEN gm ELSE 0 END AS gl, hu + CASE WHEN s THEN hm ELSE 0 END AS hl, na, ga, ha FROM up JOIN miss USING (feature), (VALUES (true), (false)) AS t(s)),
gains AS (SELECT *, round(gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha, 9) AS gain FROM side WHERE nl >= 20 AND na - nl >= 20 AND hl >= 0.001 AND ha - hl >= 0.001)
SELECT feature, CAST(bin AS INTEGER) AS bin, missing_left, round(gain, 6) AS gain FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gains.gain DESC, bin, missing_left DESC) = 1"""
)
def tree_root_splits(spark, sf):
    """Each feature's best first split."""
    best = boosting.best_splits(_root_sums(spark, sf), ROOT).where("node = 0 AND gain IS NOT NULL")
    return best.select(_feature_name(), "bin", "missing_left", *doubles("gain"))


LEAFWISE = boosting.Settings(rate=0.3, patience=3)
NOWCAST_FEATURES = [*MODEL_FEATURES, "qty_sum_mon", "obs_n"]  # of the same month, too


def _leafwise(spark, sf) -> tuple[DataFrame, boosting.Boosted]:
    rows = models.weighted(_by_time(spark, sf), "balanced")
    role = F.col("split_role")
    return rows, boosting.fit(rows.where(role == "train"), NOWCAST_FEATURES, rows.where(role == "val"), LEAFWISE)


@query()
def leafwise_p1(spark, sf):
    """Trees of up to 31 leaves and 500 rounds that end when average precision on the validation rows no longer rises."""
    rows, model = _leafwise(spark, sf)
    return metrics.metric_table(model.predict(rows.where("split_role <> 'val'")), ["split_role"], p=model.name)


@query()
def tree_attribution(spark, sf):
    """Mean absolute Shapley values of those trees on test rows."""
    rows, model = _leafwise(spark, sf)
    parts = attribution.tree_contributions(model, rows.where("split_role = 'test'"), ["cell_id", "date"])
    return metrics.top_features(metrics.mean_abs(parts, model.features), 15)


@query()
def two_stage_logistic(spark, sf):
    """A first model for validation rows, and one refitted on training and validation rows for the rest."""
    rows = _by_time(spark, sf)
    out = models.run_folds(rows, lambda train, val: models.fit_logistic(train, MODEL_FEATURES, weight="balanced"), refit_roles=("train", "val"))
    return metrics.metric_table(out, ["fit_stage", "split_role"], p="p_logistic")


@query()
def ablation_logistic(spark, sf):
    """Metrics on test rows without each family of features, and their changes from all."""
    rows = _by_time(spark, sf)
    groups = {"climo": ["month_sin", "month_cos", "s_acctbal"], "memory": ["y_lag1", "y_lag12", "event_count_12m", "months_since_event"]}
    table = models.ablation(
        rows.where("split_role = 'train'"), rows.where("split_role = 'test'"), MODEL_FEATURES, groups,
        lambda train, names: models.fit_logistic(train, names, weight="balanced"), lambda out: metrics.metric_table(out, ["split_role"], p="p_logistic"),
    )
    return metrics.deltas(table, "feature_set", "Full", ["auprc", "roc_auc", "brier"])


#: Columns of a wide table as inputs bring them, each from a column of the panel's features.
WIDE = {
    "cell_id": "cell_id", "y": "y", "y_lag1": "y_lag1", "burned_area_m2": "area", "burned_area_12m": "event_count_12m", "burned_mean": "obs_cov", "fire_count_12m": "event_count_12m", "months_since_last_fire": "months_since_event",
    "lead1_VPD": "qty_sum_mon", "VPD_lead1": "qty_sum_mon", "lead": "price_mean_mon", "leading": "price_mean_mon", "future_rain": "tax_max_mon", "rain forward": "tax_max_mon", "next_month_T": "disc_mean_mon", "xt+2": "disc_mean_mon", "target_a": "y",
    "valid_weight": "obs_cov", "lon": "lon", "BurnDate": "month", "the next": "y_lag12", "has_fire_history": "ever_before", "P_sum_mon_lag1": "qty_sum_mon",
}
AUDIT_SQL = f"""{S.FEATURES_SQL}, counts AS (SELECT [{', '.join(f"{{'name': '{n}', 'n': count({c})}}" for n, c in WIDE.items())}] AS l FROM features),
names AS (SELECT e.name AS name, e.n AS n_values FROM (SELECT unnest(l) AS e FROM counts)),
m AS (SELECT *, regexp_full_match(name, 'months_since_(last_fire|event)|fire_count_(12|24|36)m|event_count_[0-9]+m|burned_area_(12|24|36)m|y_lag[0-9]+|y_roll[0-9]+m_(sum|mean|max|min)|fire_tsl[fb]|ever_before') AS memory FROM names)"""
@query(AUDIT_SQL + " SELECT name, n_values, memory, name = 'has_fire_history' OR name IN ('burned_area_m2', 'burned_flag', 'burned_frac', 'ever_burned', 'system:index', '.geo', '__source_file__', 'lon', 'lat') OR NOT memory AND (starts_with(name, 'burned_') OR starts_with(name, 'valid_weight') OR regexp_matches(name, 'label_|target_|lead[+_]|lead1_|_lead1|future|forward|next_month|t[+][12]|[Bb]urn[Dd]ate|MCD64A1')) AS forbidden, regexp_matches(lower(name), '\\b(lead[0-9]*|future|next)\\b|\\blead[0-9]|\\bt[+]|\\blag-') AS suspicious FROM m")
def column_audit(spark, sf):
    """What the guards say of a wide table's columns, beside the values that stand in them."""
    wide = S.features(spark, sf).select(*(F.col(c).alias(n) for n, c in WIDE.items()))
    barred, odd = catalog.forbidden(wide.columns), catalog.suspicious(wide.columns)
    name = F.col("column")
    return _values(wide).select(name.alias("name"), "n_values", name.isin(*[n for n in WIDE if catalog.is_memory(n)]).alias("memory"), name.isin(*barred).alias("forbidden"), name.isin(*odd).alias("suspicious"))


@query(f"{S.PANEL_SQL} SELECT y, count(*) AS n FROM panel GROUP BY 1")
def labelled_panel(spark, sf):
    """Labels that came as text, read as 0 and 1."""
    raw = S.panel(spark, sf).select("cell_id", F.col("y").cast("string").alias("burned_flag"))
    return assemble.labelled(raw).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE l_linenumber WHEN 1 THEN 'null' WHEN 2 THEN 'not_a_number' ELSE 'not_binary' END AS fault, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1")
def label_faults(spark, sf):
    """Labels that stop a run, planted by line number."""
    k = F.col("l_linenumber")
    raw = F.when(k == 2, "yes").when(k == 3, "2").when(k > 3, F.pmod("l_orderkey", F.lit(2)).cast("string"))
    return quality.label_faults(S.read(spark, sf, "lineitem").select(raw.alias("burned_flag")), "burned_flag")


@query(f"{S.PANEL_SQL} SELECT cell_id, {DATE}, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM panel")
def calendar_columns(spark, sf):
    text = S.panel(spark, sf).select("cell_id", F.date_format("date", "yyyy-MM-dd").alias("date"))
    return assemble.with_calendar(text).select("cell_id", day(), "year", "month")


@query(
    f"{S.PANEL_SQL} SELECT count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, round(avg(y), 6) AS y_rate, CAST(0 AS BIGINT) AS label_not_binary, CAST(0 AS BIGINT) AS date_not_month_start, "
    + ", ".join(f"round({f}(CAST({c} AS DOUBLE)), 6) AS {c}_{n}" for c in ("qty_sum_mon", "obs_n") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
    + ", "
    + ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS {c}_missing" for c in ("qty_sum_mon", "obs_n"))
    + " FROM panel"
)
def panel_summary_row(spark, sf):
    row = quality.panel_row(S.panel(spark, sf), ["qty_sum_mon", "obs_n"])
    counts = ["n_rows", "n_cells", "label_not_binary", "date_not_month_start"]
    return row.select(*counts, day("first_date"), day("last_date"), *doubles(*(c for c in row.columns if c not in (*counts, "first_date", "last_date"))))


@query(f"{S.PANEL_SQL} SELECT count(*) AS n, round(sum(qty_sum_mon), 6) AS qty, count(CASE WHEN price_mean_mon IS NULL THEN 1 END) AS n_null FROM panel WHERE qty_sum_mon IS NOT NULL AND disc_mean_mon IS NOT NULL")
def rows_without_nulls(spark, sf):
    kept, _ = assemble.drop_nulls(S.panel(spark, sf), ["qty_sum_mon", "disc_mean_mon"])
    return kept.agg(F.count(F.lit(1)).alias("n"), r(F.sum("qty_sum_mon")).alias("qty"), F.count_if(F.col("price_mean_mon").isNull()).alias("n_null"))


@query(f"{S.PANEL_SQL} SELECT cell_id, {DATE}, {d('qty_sum_mon', 'other_mean')} FROM (SELECT *, disc_mean_mon AS other_mean FROM panel)")
def reducer_columns(spark, sf):
    """Means and counts beside their base go, as do leftovers of reducers; a mean without its base stays."""
    q = F.col("qty_sum_mon")
    raw = S.panel(spark, sf).select("cell_id", "date", "qty_sum_mon", q.alias("qty_sum_mon_mean"), q.alias("qty_sum_mon_count"), F.col("disc_mean_mon").alias("other_mean"), q.alias("sum"), q.alias("pix"), q.alias("pix_mean"))
    out = assemble.drop_redundant_reducers(raw)
    return out.select(*(day() if c == "date" else r(c).alias(c) if c not in ("cell_id",) else F.col(c) for c in out.columns))


@query(f"{GRID_SQL} SELECT p.cell_id, CAST(p.date AS VARCHAR) AS date, ix || '_' || iy AS block FROM panel p JOIN grid USING (cell_id)")
def spatial_block(spark, sf):
    """Blocks from the coordinates of the cells' metadata."""
    out, source = assemble.spatial_block(S.panel(spark, sf).drop("STRATUM"), S.cells(spark, sf), "cell_id")
    if source != "meta:lonlat":
        raise ValueError(source)
    return out.select("cell_id", day(), "block")


@query(f"{LAG_SQL} SELECT cell_id, {DATE}, {b('y')}, {d('qty_sum_mon_lag1', 'disc_mean_mon_lag1', 's_acctbal')} FROM lead1 JOIN cells USING (cell_id)")
def feature_build(spark, sf):
    """A versioned feature table: a constant column, a barred one and identifiers go, extras that are there come."""
    lead = _lead1(spark, sf, S.panel(spark, sf), ("cell_id", "date", "y", "s_acctbal", "lon")).withColumn("same_lag1", F.lit(3.0))
    names = ["qty_sum_mon_lag1", "disc_mean_mon_lag1", "same_lag1", "tax_max_mon_lag1"]
    out, record = catalog.build(lead, names, "lead1", extras=["s_acctbal", "absent"], exclude={"exact": ["tax_max_mon_lag1"]})
    if record["constant"] != ["same_lag1"] or record["blacklisted"] != ["tax_max_mon_lag1"]:
        raise ValueError(record)
    return out.select("cell_id", day(), *longs("y"), *doubles(*record["predictors"]))


@query()
def logistic_folds(spark, sf):
    """All folds of P3 fitted together: metrics by fold and role."""
    rows = splits.p3(written(S.features(spark, sf)), "BIOME", windows=W)
    out = irls.predict_all(rows, irls.fit_all(rows, MODEL_FEATURES, weight="balanced"), MODEL_FEATURES)
    return metrics.metric_table(out, ["fold_id", "split_role"], p="p_logistic")


REPS = 100
_MIX = "xor(x, x >> 16) * 73244475 % 4294967296"
BOOTSTRAP_SQL = f"""{S.PREDICTED_SQL}, b AS (SELECT split_role, p, y, CAST('0x' || substr(md5('0|' || cell_id || '|' || date), 1, 8) AS BIGINT) AS base FROM predicted),
r AS (SELECT split_role, p, y, rep, xor(base, (rep + 1) * 2654435761 % 4294967296) AS x FROM b, (SELECT range AS rep FROM range({REPS}))),
m1 AS (SELECT * REPLACE ({_MIX} AS x) FROM r), m2 AS (SELECT * REPLACE ({_MIX} AS x) FROM m1), m3 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM m2),
w AS (SELECT split_role, rep, p, y, {' + '.join(f'CASE WHEN x >= {t} THEN 1 ELSE 0 END' for t in resample.poisson_thresholds())} AS w FROM m3),
s AS (SELECT split_role, rep, p, sum(w) AS n, sum(w * y) AS pos FROM w GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS seen, sum(pos) OVER u AS tp, sum(pos) OVER (PARTITION BY split_role, rep) AS total FROM s WINDOW u AS (PARTITION BY split_role, rep ORDER BY p DESC)),
a AS (SELECT split_role, rep, sum(CASE WHEN seen > 0 THEN pos / nullif(total, 0) * tp / seen END) AS v FROM c GROUP BY 1, 2)
SELECT split_role, round(avg(v), 6) AS auprc_mean, round(stddev_samp(v), 6) AS auprc_std, count(v) AS reps FROM a GROUP BY 1"""


@query(BOOTSTRAP_SQL)
def bootstrap_auprc(spark, sf):
    return resample.bootstrap(S.predicted(spark, sf), ["split_role"], "auprc", REPS).select("split_role", *doubles("auprc_mean", "auprc_std"), "reps")


@query()
def linear_attribution(spark, sf):
    train = _by_time(spark, sf).where("split_role = 'train'")
    model = models.fit_logistic(train, MODEL_FEATURES)
    parts = models.linear_contributions(model, train, ["cell_id", "date", "BIOME"])
    return metrics.top_features(metrics.mean_abs(parts, model.scaling.features), 15)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_metrics(spark, sf_dir)
