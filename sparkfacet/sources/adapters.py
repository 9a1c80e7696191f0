"""Canonical catalogue frames from the given tables. Lazy: nothing is read until a query runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfacet.plans.store import stored

#: Fixed value: tiers from cheapest to best.
TIERS = ("economico", "diario", "desempeno", "oem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(frame: DataFrame) -> DataFrame:
    """The rows, dealt out anew if they lie in fewer parts than there are cores (a small file of one row group is read by one
    task); large tables have more parts and aren't moved."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def shares(frame: DataFrame, mb: float = 2) -> int:
    """How many tasks to deal a table's rows to, so that what one of them holds doesn't grow with the table: one for each so
    many MB that the columns have in files (2 MB are some 600 000 pairs of keys), and one for each core at least."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(frame.sparkSession.sparkContext.defaultParallelism, int(size / (mb * 2**20)))


def tier_of(size: Column) -> Column:
    return F.when(size <= 12, TIERS[0]).when(size <= 25, TIERS[1]).when(size <= 38, TIERS[2]).otherwise(TIERS[3])


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of a catalogue, made once for each state of the tables and session."""
    return stored(spark, sf_dir, "products", lambda: _products(spark, sf_dir))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, brand, part_type, category, variant, tier, price, stock (3 warehouses), stock_total, reviews, rating, on_sale, warranty (years).

    The lines are summed per part before the join, so the fact table shuffles as partial sums only.
    """
    part = table(spark, sf_dir, "part")
    cents = F.round(F.col("l_discount") * 100).cast("long")
    stock = [F.count_if(F.col("l_suppkey") % 3 == k).alias(f"s{k}") for k in range(3)]
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"), *stock)
    words = F.split("p_name", " ")
    joined = part.join(lines, "p_partkey", "left")
    levels = [F.coalesce(f"s{k}", F.lit(0)).cast("long") for k in range(3)]
    n = F.coalesce("n", F.lit(0)).cast("long")
    return joined.select(
        F.col("p_partkey").alias("i"), F.col("p_brand").alias("brand"), F.col("p_type").alias("part_type"), F.get(words, F.lit(1)).alias("category"), F.get(words, F.lit(0)).alias("variant"),
        tier_of(F.col("p_size")).alias("tier"), F.col("p_retailprice").alias("price"), F.array(*levels).alias("stock"), (levels[0] + levels[1] + levels[2]).alias("stock_total"),
        n.alias("reviews"), F.when(n > 0, F.lit(5.0) - F.col("cents") / (F.lit(5.0) * F.col("n"))).otherwise(0.0).alias("rating"), (F.col("p_partkey") % 7 == 0).alias("on_sale"), (0.5 + F.col("p_partkey") % 6 * 0.5).cast("double").alias("warranty"),
    )


#: The same frame in DuckDB's SQL, as a common table expression.
PRODUCTS_SQL = """p AS (SELECT p_partkey AS i, p_brand AS brand, p_type AS part_type, split_part(p_name, ' ', 2) AS category, split_part(p_name, ' ', 1) AS variant,
 CASE WHEN p_size <= 12 THEN 'economico' WHEN p_size <= 25 THEN 'diario' WHEN p_size <= 38 THEN 'desempeno' ELSE 'oem' END AS tier,
 CASE WHEN p_size <= 12 THEN 1 WHEN p_size <= 25 THEN 2 WHEN p_size <= 38 THEN 3 ELSE 4 END AS tier_rank,
 p_retailprice AS price, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(s0 + s1 + s2, 0) AS stock_total, coalesce(n, 0) AS reviews,
 CASE WHEN n > 0 THEN 5.0::DOUBLE - cents / (5.0::DOUBLE * n) ELSE 0.0::DOUBLE END AS rating, p_partkey % 7 = 0 AS on_sale, CAST(0.5 + p_partkey % 6 * 0.5 AS DOUBLE) AS warranty
 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) FILTER (l_suppkey % 3 = 0) AS s0, count(*) FILTER (l_suppkey % 3 = 1) AS s1, count(*) FILTER (l_suppkey % 3 = 2) AS s2 FROM lineitem GROUP BY ALL) ON l_partkey = p_partkey)"""
