"""Views that stand for spatial tables on star-schema test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial

STEP = 10_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Molecules: a sample for each flag and status, brands as genes, price and quantity as places."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(F.concat("l_returnflag", "l_linestatus").alias("sample_id"), F.col("p_brand").alias("gene"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 2000).alias("y"), "l_orderkey", "l_linenumber")


def spots(spark: SparkSession, d: str) -> DataFrame:
    return spatial.pool_spots(points(spark, d), feature="gene", x="x", y="y", pixel_size_um=0.01, spot_size_um=100.0).withColumnRenamed("feature", "gene").withColumn("obs_id", F.concat_ws("x", "array_row", "array_col"))


def obs(spark: SparkSession, d: str) -> DataFrame:
    return spots(spark, d).select("sample_id", "obs_id", "array_row", "array_col", "x", "y").distinct()


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Slides of a fixed size with a forward matrix that turns and shifts."""
    ids = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("sample_id")).distinct()
    matrix = {"a11": 0.5, "a12": -0.25, "a13": 100.0, "a21": 0.25, "a22": 0.5, "a23": -50.0, "a31": 0.0, "a32": 0.0, "a33": 1.0}
    return ids.select("sample_id", F.lit(90_000).alias("width"), F.lit(80_000).alias("height"), F.lit(2.0).alias("pixel_size"), *[F.lit(v).alias(k) for k, v in matrix.items()])


def pairs(spark: SparkSession, d: str) -> DataFrame:
    items, parts = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    pred = F.col("l_quantity") + 20 * F.col("l_discount") - 10 * F.col("l_tax")
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(F.concat("l_returnflag", "l_linestatus").alias("sample_id"), F.col("p_brand").alias("gene"), F.col("l_linenumber").alias("fold"), F.col("l_quantity").alias("target"), pred.alias("pred"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Fold results: region as dataset, market segment as encoder, order year as fold, a ratio of balances and prices as corr."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    cell = joined.groupBy(F.col("r_name").alias("dataset"), F.col("c_mktsegment").alias("encoder"), F.year("o_orderdate").alias("fold"))
    return cell.agg((F.avg("c_acctbal") / F.avg("o_totalprice")).alias("raw")).select("dataset", "encoder", "fold", F.when((F.col("dataset") == "ASIA") & (F.col("fold") == 1995), F.lit(None)).otherwise(F.round("raw", 9)).alias("corr"))


def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import metrics

    return metrics.merge_folds(runs(spark, d), ("dataset", "encoder"), nan="skip").select("dataset", "encoder", F.col("mean").alias("pearson_mean"), F.col("std").alias("pearson_std"))


def panels(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return items.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("sample_id"), F.col("p_brand").alias("gene")).distinct()


def meta(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").alias("patient"), F.col("r_name").alias("dataset_title"), F.col("s_acctbal").alias("balance"))


#: The same views for SQL, as common table expressions.
SQL = {
    "points": "points AS (SELECT l_returnflag || l_linestatus AS sample_id, p_brand AS gene, l_extendedprice AS x, l_quantity * 2000 AS y, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "spots": "spots AS (SELECT sample_id, CAST(floor(y / 10000.0) AS INTEGER) AS array_row, CAST(floor(x / 10000.0) AS INTEGER) AS array_col, gene, count(*) AS value FROM points GROUP BY ALL)",
    "obs": "obs AS (SELECT DISTINCT sample_id, array_row, array_col, CAST((array_col + 0.5) * 10000.0 AS DOUBLE) AS x, CAST((array_row + 0.5) * 10000.0 AS DOUBLE) AS y FROM spots)",
    "pairs": "pairs AS (SELECT l_returnflag || l_linestatus AS sample_id, p_brand AS gene, l_linenumber AS fold, l_quantity AS target, l_quantity + 20 * l_discount - 10 * l_tax AS pred FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "runs": "runs AS (SELECT dataset, encoder, fold, CASE WHEN dataset = 'ASIA' AND fold = 1995 THEN NULL ELSE round(raw, 9) END AS corr FROM (SELECT r_name AS dataset, c_mktsegment AS encoder, CAST(year(o_orderdate) AS INTEGER) AS fold, avg(c_acctbal) / avg(o_totalprice) AS raw FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL))",
    "merged": "merged AS (SELECT dataset, encoder, avg(corr) AS pearson_mean, stddev_pop(corr) AS pearson_std FROM runs GROUP BY ALL)",
    "panels": "panels AS (SELECT DISTINCT s_nationkey AS sample_id, p_brand AS gene FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)",
    "meta": "meta AS (SELECT s_suppkey AS sample_id, s_nationkey AS patient, r_name AS dataset_title, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
}


def with_views(names: str, query: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + (query if query.startswith(",") else " " + query)
