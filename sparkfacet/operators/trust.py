"""Ratings, values and brand scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prior(products: DataFrame) -> DataFrame:
    """One row: the review-weighted mean rating, 4 without reviews."""
    return products.agg(F.coalesce(F.sum(F.col("rating") * F.col("reviews")) / F.nullif(F.sum("reviews"), F.lit(0)), F.lit(4.0)).alias("prior"))


def bayes(rating: Column, n: Column, mean: Column, m: int = 25) -> Column:
    return (n * rating + m * mean) / (n + m)


def wilson(share: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share; 0 without votes."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    z2 = z * z
    low = (p + z2 / (2 * n) - z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.when(n > 0, low).otherwise(0.0)


def with_bayes(products: DataFrame) -> DataFrame:
    return products.join(F.broadcast(prior(products))).withColumn("adjusted", bayes(F.col("rating"), F.col("reviews"), F.col("prior"))).drop("prior")  # one row is broadcast


def value(adjusted: Column, price: Column, warranty_years: Column, in_stock: Column) -> Column:
    return F.pow(adjusted / 5, F.lit(2.0)) * F.sqrt(warranty_years) * F.when(in_stock, 1.0).otherwise(0.8) / F.pow(price, F.lit(0.7))


def best_value(products: DataFrame, score: Column, group: list[str], least: int = 3) -> DataFrame:
    """The row with the highest score of each group of `least` or more; by aggregation, so that a hot group isn't gathered."""
    best = products.groupBy(*group).agg(F.count(F.lit(1)).alias("members"), F.max(F.struct(score.alias("score"), (-F.col("i")).alias("less"))).alias("top"))
    return best.filter(F.col("members") >= least).select(*group, (-F.col("top.less")).alias("i"), F.col("top.score").alias("score"), "members")


def brands(products: DataFrame) -> DataFrame:
    """(brand, refs, reviews, adjusted, in_stock_pct, oem, score: 0 to 100, grade) of products (brand, rating, reviews,
    warranty: years, stock_total, tier). A brand's rating is that of all its reviews, drawn to the mean of all; its score
    sums 45 points for the rating from 3.8 to 4.5, 20 for a mean warranty of two years, 20 for the share in stock, 10 for
    selling original parts and 5 for its size."""
    mean = prior(products)
    sums = products.groupBy("brand").agg(
        F.count(F.lit(1)).alias("refs"), F.sum("reviews").alias("reviews"), F.sum(F.col("rating") * F.col("reviews")).alias("rn"), F.avg("warranty").alias("warranty"),
        F.avg((F.col("stock_total") > 0).cast("double")).alias("stocked"), F.bool_or(F.col("tier") == "oem").alias("oem"),
    )
    one = sums.agg(F.max("refs").alias("most")).join(mean)
    raw = F.when(F.col("reviews") > 0, F.col("rn") / F.col("reviews")).otherwise(F.col("prior"))
    rated = sums.join(F.broadcast(one)).withColumn("adjusted", bayes(raw, F.col("reviews"), F.col("prior")))  # one row is broadcast
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("adjusted") - 3.8) / 0.7))
    points = 45 * clip + 20 * F.least(F.lit(1.0), F.col("warranty") / 2) + 20 * F.col("stocked") + 10 * F.col("oem").cast("int") + 5 * F.log1p("refs") / F.log1p("most")
    scored = rated.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(points, 9)))).cast("long"))
    grade = F.when(F.col("score") >= 85, "A+").when(F.col("score") >= 75, "A").when(F.col("score") >= 65, "B").when(F.col("score") >= 55, "C").otherwise("D")
    return scored.select("brand", "refs", "reviews", F.bround("adjusted", 2).alias("adjusted"), F.bround(100 * F.col("stocked")).cast("long").alias("in_stock_pct"), "oem", "score", grade.alias("grade"))
