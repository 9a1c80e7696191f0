"""Filters, facets, histograms, sorting and paging over product frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ("brand", "part_type", "category", "tier", "variant")


@dataclass(frozen=True)
class Request:
    """Selected values per dimension (empty: all), price bounds (inclusive) and flags."""

    selected: dict[str, tuple[str, ...]] = field(default_factory=dict)
    price_min: float | None = None
    price_max: float | None = None
    in_stock: bool = False
    on_sale: bool = False

    def conditions(self) -> dict[str, Column]:
        out = {d: F.col(d).isin(*v) for d, v in self.selected.items() if v}
        if self.price_min is not None:
            out["price_min"] = F.col("price") >= self.price_min
        if self.price_max is not None:
            out["price_max"] = F.col("price") <= self.price_max
        if self.in_stock:
            out["in_stock"] = F.col("stock_total") > 0
        if self.on_sale:
            out["on_sale"] = F.col("on_sale")
        return out

    def matches(self, without: tuple[str, ...] = ()) -> Column:
        result = F.lit(True)
        for name, c in self.conditions().items():
            if name not in without:
                result = result & c
        return result


def select(products: DataFrame, request: Request) -> DataFrame:
    return products.filter(request.matches())


def facets(products: DataFrame, request: Request) -> DataFrame:
    """(dim, value, n, selected): per dimension, counts under all filters but its own; selected values stay with 0. One pass."""
    tagged = products.select(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), request.matches((d,)).alias("ok")).alias(f"f_{d}") for d in DIMS))
    long = tagged.select(F.explode(F.array(*(f"f_{d}" for d in DIMS))).alias("f")).select("f.*").filter("value is not null")
    counts = long.groupBy("dim", "value").agg(F.count_if("ok").alias("n"))
    chosen = F.lit(False)
    for d, values in request.selected.items():
        chosen = chosen | ((F.col("dim") == d) & F.col("value").isin(*values))
    return counts.withColumn("selected", chosen).filter((F.col("n") > 0) | F.col("selected"))


def histogram(products: DataFrame, request: Request, bins: int = 16) -> DataFrame:
    """(bin, n, lo, hi) of prices under all filters but the price's own; empty bins included."""
    pool = products.filter(request.matches(("price_min", "price_max"))).select("price")
    ends = pool.agg(F.min("price").alias("a"), F.max("price").alias("b"))
    span = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1.0)
    place = F.least(F.lit(bins - 1), ((F.col("price") - F.col("a")) / span * bins).cast("int"))
    counts = pool.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row is broadcast
    all_bins = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.floor("a").alias("lo"), F.ceil("b").alias("hi"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "lo", "hi")


def page(frame: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in a total order; Spark keeps only the rows up to its end in each task."""
    return frame.orderBy(*order).offset(number * size).limit(size)


def rrf(frame: DataFrame, signals: dict[str, tuple[Column, float]], key: str, within: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: (key, within, score), the sum of weight / (k + rank) in each list; ties rank by key. Lists are
    those of the values of within (a query, a category), which are ranked apart from each other."""
    from pyspark.sql import Window

    score = sum((F.lit(w) / (k + F.row_number().over(Window.partitionBy(within).orderBy(c, key))) for c, w in signals.values()), F.lit(0.0))
    return frame.select(key, within, score.alias("score"))
