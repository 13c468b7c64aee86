"""A monthly panel from the driver's order lines: cells are suppliers, months those of shipping.

The same panel is given in SQL, as common table expressions that the queries' SQL begins with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.functions import design_weight, clip_share, season
from longspan.operators.assemble import densify
from longspan.operators.models import climatology, predict_climatology
from longspan.operators.sequence import memory_features
from longspan.operators.splits import Windows, p1

DYNAMIC = ["qty_sum_mon", "price_mean_mon", "disc_mean_mon", "tax_max_mon"]
QUALITY = ["obs_n", "obs_missing", "obs_cov"]
WINDOWS = Windows(("1995-01-01", "1999-12-01"), ("2000-01-01", "2000-12-01"), ("2001-01-01", "2001-12-01"))
CAP = 60
GROUP_LINES = 1 << 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str, group_lines: int = GROUP_LINES) -> DataFrame:
    """Sums of order lines by supplier and month.

    Partial sums of all keys in a task, and those that Spark puts together by bytes, grow with the lines; so lines are
    dealt by key into groups of about group_lines, which are summed and joined to months as they stand.
    """
    month = F.trunc(F.to_date("l_shipdate"), "month")
    lines = read(spark, sf_dir, "lineitem").withColumns({"cell_id": F.col("l_suppkey"), "date": month})
    dealt = lines.repartition(max(1, -(-lines.count() // group_lines)), "cell_id", "date")
    return dealt.groupBy("cell_id", "date").agg(
        F.sum("l_quantity").alias("qty_sum_mon"),
        F.avg("l_extendedprice").alias("price_mean_mon"),
        F.avg("l_discount").alias("disc_mean_mon"),
        F.max("l_tax").alias("tax_max_mon"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("area"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell: what doesn't change by month."""
    k = F.col("s_suppkey")
    nation = read(spark, sf_dir, "nation")
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("cell_id"),
        "s_acctbal",
        F.col("n_regionkey").cast("int").alias("BIOME"),
        F.col("n_name").alias("STRATUM"),
        (F.lit(73.0) + F.pmod(k * 37, F.lit(620)) / 10.0).alias("lon"),
        (F.lit(18.0) + F.pmod(k * 53, F.lit(350)) / 10.0).alias("lat"),
        ((F.pmod(k, F.lit(12)) + 1) / 10.0).alias("pi"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel with its label and static columns. Joined from the left, so that Spark can't broadcast the panel."""
    first, last = read(spark, sf_dir, "lineitem").agg(*(F.trunc(F.to_date(f("l_shipdate")), "month") for f in (F.min, F.max))).first()
    static = cells(spark, sf_dir).where("cell_id is not null")
    rows = densify(monthly(spark, sf_dir), static, "cell_id", "date", first, last).join(static, "cell_id", "left")
    n, y = F.coalesce("n", F.lit(0)), (F.col("area") >= F.col("qty_sum_mon") * 0.7) & (F.col("n") >= 3)
    sin, cos = season(F.month("date"))
    return rows.select(
        "cell_id",
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.coalesce(y, F.lit(False)).cast("int").alias("y"),
        sin.alias("month_sin"),
        cos.alias("month_cos"),
        *DYNAMIC,
        n.alias("obs_n"),
        F.col("n").isNull().cast("int").alias("obs_missing"),
        F.least(F.lit(1.0), n / 10.0).alias("obs_cov"),
        F.coalesce("area", F.lit(0.0)).alias("area"),
        "s_acctbal",
        "BIOME",
        "STRATUM",
        "lon",
        "lat",
        "pi",
        clip_share(F.col("pi")).alias("pi_clip"),
        design_weight(F.col("pi")).alias("d_weight"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_features(panel(spark, sf_dir), CAP)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, roles by time, and the climatology of the training rows as p."""
    rows = p1(features(spark, sf_dir), WINDOWS)
    rates = climatology(rows.where("split_role = 'train'"), ["BIOME"])
    return predict_climatology(rows, rates, ["BIOME"], name="p")


PANEL_SQL = """
WITH months AS (
  SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS date FROM (SELECT date_trunc('month', l_shipdate) AS m FROM lineitem)
), monthly AS (
  SELECT l_suppkey AS cell_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS qty_sum_mon, avg(l_extendedprice) AS price_mean_mon,
    avg(l_discount) AS disc_mean_mon, max(l_tax) AS tax_max_mon, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS area
  FROM lineitem GROUP BY 1, 2
), cells AS (
  SELECT s_suppkey AS cell_id, s_acctbal, n_regionkey AS biome, n_name AS stratum, CAST(73.0 + (s_suppkey * 37 % 620) / 10.0 AS DOUBLE) AS lon,
    CAST(18.0 + (s_suppkey * 53 % 350) / 10.0 AS DOUBLE) AS lat, CAST((s_suppkey % 12 + 1) / 10.0 AS DOUBLE) AS pi
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), panel AS (
  SELECT c.cell_id, m.date, year(m.date) AS year, month(m.date) AS month, CASE WHEN area >= qty_sum_mon * 0.7 AND n >= 3 THEN 1 ELSE 0 END AS y,
    qty_sum_mon, price_mean_mon, disc_mean_mon, tax_max_mon, coalesce(n, 0) AS obs_n, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS obs_missing,
    least(1.0, coalesce(n, 0) / 10.0) AS obs_cov, coalesce(area, 0) AS area, s_acctbal, biome, stratum, lon, lat, pi
  FROM cells c CROSS JOIN months m LEFT JOIN monthly a ON a.cell_id = c.cell_id AND a.date = m.date
)"""
FEATURES_SQL = (
    PANEL_SQL
    + """, lagged AS (
  SELECT *, coalesce(lag(y) OVER w, 0) AS y_lag1, coalesce(lag(y, 12) OVER w, 0) AS y_lag12, row_number() OVER w AS rn,
    coalesce(max(y) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ever_before
  FROM panel WINDOW w AS (PARTITION BY cell_id ORDER BY date)
), features AS (
  SELECT *, sum(y_lag1) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS event_count_12m,
    least(60, coalesce(rn - max(CASE WHEN y_lag1 = 1 THEN rn END) OVER (PARTITION BY cell_id ORDER BY date ROWS UNBOUNDED PRECEDING), 60)) AS months_since_event
  FROM lagged
)"""
)
PREDICTED_SQL = (
    FEATURES_SQL
    + """, roles AS (
  SELECT *, CASE WHEN year = 2001 THEN 'test' WHEN year = 2000 THEN 'val' WHEN year <= 1999 THEN 'train' END AS split_role FROM features
), by_month AS (SELECT biome, month, (sum(y) + 1.0) / (count(*) + 2.0) AS r0 FROM roles WHERE split_role = 'train' GROUP BY 1, 2),
by_biome AS (SELECT biome, (sum(y) + 1.0) / (count(*) + 2.0) AS r1 FROM roles WHERE split_role = 'train' GROUP BY 1),
over_all AS (SELECT (sum(y) + 1.0) / (count(*) + 2.0) AS r2 FROM roles WHERE split_role = 'train'),
predicted AS (
  SELECT roles.*, CAST(coalesce(r0, r1, r2) AS DOUBLE) AS p FROM roles LEFT JOIN by_month USING (biome, month) LEFT JOIN by_biome USING (biome) CROSS JOIN over_all
)"""
)
