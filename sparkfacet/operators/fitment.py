"""Which (generation, year, engine) configurations an item covers: keys, compaction, islands of years, assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact(covered: DataFrame, universe: DataFrame) -> DataFrame:
    """The fewest keys for (item, gen, year, engine): g: whole generation, ge: an engine in all years, y: a year with all
    engines, ye: else. One shuffle gathers an item's configurations of a generation, of which there are as many as the
    generation has; how a configuration is covered is counted within them."""
    size = universe.groupBy("gen").agg(F.count_distinct("year").alias("years"), F.count_distinct("engine").alias("engines"))
    sets = covered.groupBy("item", "gen").agg(F.collect_set(F.struct("year", "engine")).alias("own")).join(size, "gen")
    g = F.col("gen").cast("string")

    def key(x: Column) -> Column:
        of_engine, of_year = F.size(F.filter("own", lambda y: y.engine == x.engine)), F.size(F.filter("own", lambda y: y.year == x.year))
        year = x.year.cast("string")
        return F.when(of_engine == F.col("years"), F.concat_ws(":", F.lit("ge"), g, x.engine)).when(of_year == F.col("engines"), F.concat_ws(":", F.lit("y"), g, year)).otherwise(F.concat_ws(":", F.lit("ye"), g, year, x.engine))

    whole = F.size("own") == F.col("years") * F.col("engines")
    keys = F.when(whole, F.array(F.concat(F.lit("g:"), g))).otherwise(F.array_distinct(F.transform("own", key)))
    return sets.select("item", F.explode(keys).alias("key"))


def islands(covered: DataFrame) -> DataFrame:
    """(item, gen, first, last) of each run of successive years."""
    years = covered.select("item", "gen", "year").distinct()
    run = F.col("year") - F.row_number().over(Window.partitionBy("item", "gen").orderBy("year"))
    return years.withColumn("run", run).groupBy("item", "gen", "run").agg(F.min("year").alias("first"), F.max("year").alias("last")).drop("run")


def runs(covered: DataFrame) -> DataFrame:
    """(item, gen, engines, first, last) of each run of successive years with the same engines."""
    sets = covered.groupBy("item", "gen", "year").agg(F.array_join(F.array_sort(F.collect_set("engine")), "+").alias("engines"))
    w = Window.partitionBy("item", "gen").orderBy("year")
    new = (F.lag("year").over(w).isNull() | (F.lag("year").over(w) != F.col("year") - 1) | (F.lag("engines").over(w) != F.col("engines"))).cast("int")
    return sets.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("item", "gen", "run", "engines").agg(F.min("year").alias("first"), F.max("year").alias("last")).drop("run")


def assess(covered: DataFrame, universe: DataFrame, gen: int) -> DataFrame:
    """(item, fitting, configs, verdict) for a vehicle known by its generation only."""
    asked = universe.filter(F.col("gen") == gen)
    total = asked.agg(F.count(F.lit(1)).alias("configs"))
    hits = covered.select("item", "gen", "year", "engine").distinct().join(asked, ["gen", "year", "engine"]).groupBy("item").agg(F.count(F.lit(1)).alias("fitting"))
    rows = covered.select("item").distinct().join(hits, "item", "left").fillna(0, ["fitting"]).join(F.broadcast(total))  # one row is broadcast
    verdict = F.when(F.col("fitting") == 0, "no").when(F.col("fitting") == F.col("configs"), "confirmed").otherwise("conditional")
    return rows.withColumn("verdict", verdict)
