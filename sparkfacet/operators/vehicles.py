"""Vehicles known in part, the keys that they and items have, and what fits what.

A configuration is (gen, year, engine). It has five keys: e:engine, g:gen, ge:gen:engine, y:gen:year, ye:gen:year:engine. An item
fits a vehicle if it has a key of one of the vehicle's configurations, or the key * (universal).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("gen", "year", "engine")
UNIVERSAL = "*"


def config_keys(gen: Column, year: Column, engine: Column) -> Column:
    """The five keys of a configuration."""
    g, y = gen.cast("string"), year.cast("string")
    return F.array(F.concat_ws(":", F.lit("e"), engine), F.concat_ws(":", F.lit("g"), g), F.concat_ws(":", F.lit("ge"), g, engine), F.concat_ws(":", F.lit("y"), g, y), F.concat_ws(":", F.lit("ye"), g, y, engine))


def known(vehicle: tuple[str, ...] = PARTS) -> Column:
    """How much is known: complete (all parts), empty (none), partial."""
    some = sum((F.col(c).isNotNull().cast("int") for c in vehicle), F.lit(0))
    return F.when(some == len(vehicle), "complete").when(some == 0, "empty").otherwise("partial")


def vehicle_configs(vehicles: DataFrame, universe: DataFrame) -> DataFrame:
    """(vehicle, gen, year, engine) of all configurations that agree with what is known; an empty vehicle has none.

    What is unknown agrees with anything: vehicles with the same known parts meet the universe on these, by equality."""
    out = None
    for n in range(1, len(PARTS) + 1):
        for have in combinations(PARTS, n):
            rest = [c for c in PARTS if c not in have]
            own = vehicles.filter(" and ".join([f"{c} is not null" for c in have] + [f"{c} is null" for c in rest])).select("vehicle", *have)
            met = own.join(universe, list(have)).select("vehicle", *PARTS)
            out = met if out is None else out.unionByName(met)
    return out


def vehicle_keys(vehicles: DataFrame, universe: DataFrame) -> DataFrame:
    """(vehicle, key), distinct."""
    return vehicle_configs(vehicles, universe).select("vehicle", F.explode(config_keys(*map(F.col, PARTS))).alias("key")).distinct()


def fitting(fits: DataFrame, keys: DataFrame) -> DataFrame:
    """(vehicle, item) of items (item, key) with a key of the vehicle; universal items aren't repeated for each vehicle."""
    return fits.join(keys, "key").select("vehicle", "item").distinct()


def configs_by_kind(keys: DataFrame, kinds: list[str], universe: DataFrame) -> DataFrame:
    """(gen, year, engine, *kinds, n): how many items of each kind fit each configuration. keys: item, key and the kinds'
    columns, the same in all rows of an item; * fits anything. Keys of one sort (the part before :) share no configuration, so
    items are counted by key first, and only those with keys of several sorts meet their configurations one by one."""
    every = F.concat(config_keys(F.col("gen"), F.col("year"), F.col("engine")), F.array(F.lit("*")))
    of = universe.select(*PARTS, F.explode(F.array_distinct(every)).alias("key"))
    held = keys.groupBy("item", *kinds).agg(F.collect_set("key").alias("keys"))
    free, sorts = F.array_contains("keys", "*"), F.size(F.array_distinct(F.transform("keys", lambda k: F.substring_index(k, ":", 1))))
    counted = F.when(free, F.array(F.lit("*"))).when(sorts == 1, F.col("keys")).otherwise(F.array().cast("array<string>"))
    simple = held.select(*kinds, F.explode(counted).alias("key")).groupBy("key", *kinds).agg(F.count(F.lit(1)).alias("n")).join(of, "key")
    mixed = held.filter(~free & (sorts > 1)).select("item", *kinds, F.explode("keys").alias("key")).join(of, "key").select("item", *PARTS, *kinds).distinct()
    each = simple.select(*PARTS, *kinds, "n").unionByName(mixed.select(*PARTS, *kinds, F.lit(1).cast("long").alias("n")))
    return each.groupBy(*PARTS, *kinds).agg(F.sum("n").alias("n"))


def key_configs(keys: DataFrame, universe: DataFrame) -> DataFrame:
    """keys (key) with the configurations (gen, year, engine) they stand for; keys of unknown kinds or values have none."""
    part = F.split("key", ":", 4)
    kind = part[0]
    parsed = keys.withColumn("kind", kind).withColumns({
        "g": F.when(kind != "e", F.get(part, F.lit(1))).try_cast("int"),
        "y": F.when(kind.isin("y", "ye"), F.get(part, F.lit(2))).try_cast("long"),
        "e": F.when(kind == "e", F.get(part, F.lit(1))).when(kind == "ge", F.get(part, F.lit(2))).when(kind == "ye", F.get(part, F.lit(3))),
    })
    out = None
    for name, on in (("e", {"e": "engine"}), ("g", {"g": "gen"}), ("ge", {"g": "gen", "e": "engine"}), ("y", {"g": "gen", "y": "year"}), ("ye", {"g": "gen", "y": "year", "e": "engine"})):
        own = parsed.filter(F.col("kind") == name).select("key", *(F.col(a).alias(b) for a, b in on.items()))
        met = own.join(universe, list(on.values())).select("key", *PARTS)
        out = met if out is None else out.unionByName(met)
    return out


def assess(fits: DataFrame, vehicles: DataFrame, universe: DataFrame) -> DataFrame:
    """(vehicle, item, fitting, configs, verdict, share, reason) of the pairs that fit at least in part; universal items once,
    with a null vehicle. Pairs that aren't there don't fit; an empty vehicle has no pairs (no vehicle to ask about)."""
    configs = vehicle_configs(vehicles, universe)
    total = configs.groupBy("vehicle").agg(F.count(F.lit(1)).alias("configs"))
    each = configs.select("vehicle", F.struct(*PARTS).alias("config"), F.explode(config_keys(*map(F.col, PARTS))).alias("key"))
    hits = each.join(fits.filter(F.col("key") != UNIVERSAL), "key").select("vehicle", "item", "config").distinct()
    counted = hits.groupBy("vehicle", "item").agg(F.count(F.lit(1)).alias("fitting")).join(total, "vehicle")
    share = F.bround(F.col("fitting") / F.col("configs"), 2)
    verdict = F.when(F.col("fitting") == F.col("configs"), "confirmed").otherwise("conditional")
    reason = F.when(F.col("fitting") == F.col("configs"), F.concat(F.lit("fits all "), F.col("configs"), F.lit(" configurations"))).otherwise(F.concat(F.lit("fits "), F.col("fitting"), F.lit(" of "), F.col("configs"), F.lit(" configurations")))
    pairs = counted.select("vehicle", "item", "fitting", "configs", verdict.alias("verdict"), F.when(verdict == "confirmed", 1.0).otherwise(share).alias("share"), reason.alias("reason"))
    free = fits.filter(F.col("key") == UNIVERSAL).select("item").distinct()
    return pairs.unionByName(free.select(F.lit(None).cast(pairs.schema["vehicle"].dataType).alias("vehicle"), "item", F.lit(0).cast("long").alias("fitting"), F.lit(0).cast("long").alias("configs"), F.lit("universal").alias("verdict"), F.lit(0.7).alias("share"), F.lit("fits any vehicle").alias("reason")))


def verdicts(pairs: DataFrame, fits: DataFrame, vehicles: DataFrame, universe: DataFrame) -> DataFrame:
    """(vehicle, item, verdict, share, reason) of each pair asked for (vehicle, item; unique): no-vehicle if nothing is known of
    it, universal, no, confirmed if all of its configurations fit, else conditional with the share that does. The reason of a
    conditional one says what would decide it: the years, if none is known; else the engines, if none is known and not all of
    those fit; else the generations."""
    known_ = vehicles.select("vehicle", "year", "engine", known().alias("known"))
    configs = vehicle_configs(pairs.select("vehicle").distinct().join(vehicles, "vehicle"), universe)
    total = configs.groupBy("vehicle").agg(F.count(F.lit(1)).alias("configs"), F.count_distinct("engine").alias("engines"))
    own = fits.join(pairs.select("item").distinct(), "item", "left_semi")
    keyed = configs.select("vehicle", F.struct(*PARTS).alias("config"), F.explode(config_keys(*map(F.col, PARTS))).alias("key"))
    hits = keyed.join(own.filter(F.col("key") != UNIVERSAL), "key").join(pairs, ["vehicle", "item"], "left_semi").groupBy("vehicle", "item").agg(F.collect_set("config").alias("fitting"))
    free = own.filter(F.col("key") == UNIVERSAL).select("item").distinct().withColumn("free", F.lit(True))
    rows = pairs.join(known_, "vehicle", "left").join(total, "vehicle", "left").join(hits, ["vehicle", "item"], "left").join(free, "item", "left")
    n = F.coalesce(F.size("fitting"), F.lit(0))
    verdict = F.when(F.coalesce("known", F.lit("empty")) == "empty", "no-vehicle").when(F.col("free"), "universal").when(n <= 0, "no").when(n == F.col("configs"), "confirmed").otherwise("conditional")
    share = F.when(verdict == "universal", 0.7).when(verdict.isin("no", "no-vehicle"), 0.0).otherwise(F.bround(n / F.col("configs"), 2))
    of = lambda what: F.array_join(F.array_sort(F.array_distinct(F.transform("fitting", lambda x: x[what]))).cast("array<string>"), "+")
    engines = F.size(F.array_distinct(F.transform("fitting", lambda x: x.engine)))
    reason = F.when(F.col("year").isNull(), F.concat(F.lit("years "), of("year"))).when(F.col("engine").isNull() & (engines < F.col("engines")), F.concat(F.lit("engines "), of("engine"))).otherwise(F.concat(F.lit("generations "), of("gen")))
    return rows.select("vehicle", "item", verdict.alias("verdict"), share.alias("share"), F.when(verdict == "conditional", reason).otherwise("").alias("reason"))


def summary(fits: DataFrame) -> DataFrame:
    """(item, summary, n: keys) by the kinds of all of the item's keys: universal if it has that key; by engine or by
    generation if it has keys of that kind only; else exact."""
    kinds = fits.groupBy("item").agg(F.array_sort(F.collect_set(F.split("key", ":")[0])).alias("kinds"), F.count(F.lit(1)).alias("n"))
    only = lambda k: F.col("kinds") == F.array(F.lit(k))
    return kinds.select("item", F.when(F.array_contains("kinds", UNIVERSAL), "universal").when(only("e"), "by engine").when(only("g"), "by generation").otherwise("exact").alias("summary"), "n")


def described(islands: DataFrame) -> DataFrame:
    """(item, text) of islands (item, gen, first, last): '1: 1992–1994 y 1996 + 2: 1995', generations and years in order."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("–", "first", "last"))
    years = islands.groupBy("item", "gen").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", one.alias("t")))), lambda x: x.t), " y ").alias("years"))
    return years.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gen", "years"))), lambda x: F.concat_ws(": ", x.gen.cast("string"), x.years)), " + ").alias("text"))


def label(gen: Column, year: Column, engine: Column) -> Column:
    """What is known, in words, without gaps."""
    return F.concat_ws(" ", F.concat(F.lit("gen "), gen.cast("string")), year.cast("string"), F.concat(F.lit("("), engine, F.lit(")")))


def spec(text: Column) -> Column:
    """struct<gen, year, engine> of gen:year[:engine]."""
    part = F.split(text, ":", 3)
    return F.struct(F.get(part, F.lit(0)).try_cast("int").alias("gen"), F.get(part, F.lit(1)).try_cast("long").alias("year"), F.get(part, F.lit(2)).alias("engine"))


def latest(generations: DataFrame, years: DataFrame) -> DataFrame:
    """(year, gen): the last generation (gen, start, end) that covers each year."""
    spread = generations.select("gen", F.explode(F.sequence("start", "end")).alias("year"))
    return years.join(spread, "year").groupBy("year").agg(F.max("gen").alias("gen"))
