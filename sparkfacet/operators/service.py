"""Plans of maintenance, shipments, orders and their codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfacet.functions.text import CROCKFORD, luhn32
from sparkfacet.operators.orders import back_ordered
from sparkfacet.sources.adapters import TIERS


def due(vehicles: DataFrame, tasks: DataFrame) -> DataFrame:
    """(vehicle, km, task) of vehicles (vehicle, km) and tasks (task, every): those whose interval divides the distance. The
    tasks are few; distances meet them once each, then vehicles meet their distance, where they are: a few distances are all that many vehicles have."""
    at = vehicles.select("km").distinct().join(F.broadcast(tasks)).filter(F.col("km") % F.col("every") == 0).select("km", "task")  # a maintenance table of tens of tasks
    return vehicles.join(F.broadcast(at), "km").select("vehicle", "km", "task")


def picks(products: DataFrame, better: tuple[str, ...]) -> DataFrame:
    """(task, cheapest, value, best) of products (task, i, tier, price, adjusted, score, in_stock): ids of the cheapest, of the
    best value, and of the best rated (adjusted rating, then the higher price) of the better tiers, or of all if there is none
    of these; in stock, or all if nothing is. Of equals the lowest id."""
    has = products.groupBy("task").agg(F.bool_or("in_stock").alias("any"), F.bool_or(F.col("in_stock") & F.col("tier").isin(*better)).alias("fine"), F.bool_or(F.col("tier").isin(*better)).alias("finer"))
    pool = products.join(has, "task").filter(F.col("in_stock") | ~F.col("any"))
    top = F.when(F.col("any"), F.col("fine")).otherwise(F.col("finer"))
    fine = F.when(F.col("tier").isin(*better) | ~top, F.struct("adjusted", "price", (-F.col("i")).alias("i")))
    return pool.groupBy("task").agg(F.min(F.struct("price", "i")).alias("c"), F.max(F.struct("score", (-F.col("i")).alias("i"))).alias("v"), F.max(fine).alias("b")).select("task", F.col("c.i").alias("cheapest"), (-F.col("v.i")).alias("value"), (-F.col("b.i")).alias("best"))


def allocate(lines: DataFrame) -> DataFrame:
    """lines with parts (array of struct<warehouse, units>) and short (units on back order). lines: qty, stock (array by
    warehouse), warehouses (digits of those that may serve). A line that all warehouses together can't serve is back ordered
    whole. Else the fullest of its warehouses serves it alone if it can, or it is split over them, the fullest first."""
    may = F.transform(F.filter(F.split(F.coalesce("warehouses", F.lit("")), ""), lambda c: c != ""), lambda c: c.cast("int"))
    by_size = F.array_sort(F.transform(may, lambda w: F.struct((-F.get("stock", w)).alias("less"), w.alias("warehouse"))))

    def take(state: Column, x: Column) -> Column:
        units = F.least(state.open, -x.less)
        return F.struct((state.open - units).alias("open"), F.when(units > 0, F.array_append(state.parts, F.struct(x.warehouse.alias("warehouse"), units.alias("units")))).otherwise(state.parts).alias("parts"))

    qty = F.col("qty").cast("long")
    start = F.struct(qty.alias("open"), F.array().cast("array<struct<warehouse: int, units: bigint>>").alias("parts"))
    served = F.when(back_ordered(F.col("stock"), qty), start).otherwise(F.aggregate(by_size, start, take))
    return lines.withColumn("__done", served).withColumn("parts", F.col("__done.parts")).withColumn("short", F.col("__done.open")).drop("__done")


def order_code(key: Column, prefix: str = "OC-") -> Column:
    """prefix, eight digits of CROCKFORD's from the key's hash, and their check digit: the same code for the same key."""
    bits = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 10), 16, 10).cast("long")  # 40 bits
    digit = lambda n: F.substring(F.lit(CROCKFORD), (n + 1).cast("int"), F.lit(1))
    code = F.concat(*(digit(F.shiftright(bits, 35 - 5 * k) % 32) for k in range(8)))
    return F.concat(F.lit(prefix), code, digit(luhn32(code)))


def normal_code(text: Column, prefix: str = "OC-") -> Column:
    """As people type codes: upper case, without blanks and prefix, O read as 0 and I, L as 1."""
    t = F.regexp_replace(F.upper(text), r"[\s-]", "")
    bare = prefix.replace("-", "")
    t = F.when(t.startswith(bare), F.substring(t, F.lit(len(bare) + 1), F.length(t))).otherwise(t)
    return F.translate(t, "OIL", "011")


def valid_code(code: Column) -> Column:
    """Whether a normal code has nine known digits, the last of which checks the others."""
    body, check = F.substring(code, 1, 8), F.substring(code, 9, 1)
    known = code.rlike(f"^[{CROCKFORD}]{{9}}$")
    return known & (F.instr(F.lit(CROCKFORD), check) - 1 == luhn32(F.when(known, body).otherwise("0")))


def accepted(name: Column, mail: Column) -> Column:
    """Whether a name has 2 to 80 characters (trimmed) and an address looks like one."""
    n = F.length(F.trim(name))
    return F.coalesce((n >= 2) & (n <= 80) & F.trim(mail).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))


def with_history(orders: DataFrame, events: DataFrame) -> DataFrame:
    """orders (code, ...) with history: the array of its events (code, seq, status) in order; empty without any."""
    of = events.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("history"))
    return orders.join(of, "code", "left").withColumn("history", F.coalesce("history", F.array().cast(of.schema["history"].dataType)))


def client_key(forwarded: Column, peer: Column) -> Column:
    """The last address of a forwarding header, else the peer's."""
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(F.when(last != "", last), peer)


def availability(stock: Column, etas: list[int]) -> Column:
    """struct<warehouse, low, text>: the soonest warehouse that has units (the first of equals); low: fewer than five in all."""
    total = F.aggregate(stock, F.lit(0).cast("long"), lambda a, x: a + x)
    soon = F.array_min(F.transform(F.filter(F.transform(stock, lambda s, k: F.struct(s.alias("s"), k.cast("int").alias("k"))), lambda x: x.s > 0), lambda x: F.struct(F.element_at(F.array(*map(F.lit, etas)), x.k + 1).alias("eta"), x.k.alias("warehouse"))))
    text = F.when(soon.isNull(), "out of stock").otherwise(F.concat(F.lit("in "), soon.eta, F.lit(" days")))
    return F.struct(soon.warehouse.alias("warehouse"), (total < 5).alias("low"), text.alias("text"))


def related_by_fit(products: DataFrame, types: DataFrame, keys: DataFrame, score: Column, each: int = 2, most: int = 4) -> DataFrame:
    """(vehicle, i, other, nth): what belongs to a product for a vehicle: the best each of every related type (part_type,
    related, nth: the order of a type's related ones) among what fits the vehicle, first most in all, type after type.
    keys: vehicle, item, the items that fit each vehicle. What is best for a vehicle and type is the same for all products
    that aim at it, so it is ranked once."""
    fitting = keys.select("vehicle", F.col("item").alias("i")).join(products.withColumn("__s", score).select("i", "part_type", "__s"), "i")
    per_type = F.row_number().over(Window.partitionBy("vehicle", "part_type").orderBy(F.desc("__s"), "i"))
    best = fitting.withColumn("n", per_type).filter(F.col("n") <= each)
    aims = types.join(best.select("vehicle", F.col("part_type").alias("related"), F.col("i").alias("other"), "n"), "related")
    lists = aims.groupBy("vehicle", "part_type").agg(F.slice(F.array_sort(F.collect_list(F.struct("nth", "n", "other"))), 1, most).alias("others"))  # each x related types
    met = fitting.select("vehicle", "i", "part_type").join(lists, ["vehicle", "part_type"])
    return met.select("vehicle", "i", F.posexplode(F.transform("others", lambda x: x.other)).alias("nth", "other")).withColumn("nth", F.col("nth") + 1)


def related(products: DataFrame, types: DataFrame, score: Column, each: int = 2, most: int = 4) -> DataFrame:
    """(i, other, nth): for products (i, part_type, price, ...) the best each of every related type (part_type, related), most in
    all. The best of a type are the same for all products that aim at it, so they are ranked once, and so is a type's list, of
    which a product may lose itself and one more of its own type: two more than most are enough."""
    per_type = F.row_number().over(Window.partitionBy("part_type").orderBy(F.desc("__s"), "i"))
    best = products.withColumn("__s", score).select("part_type", "i", "__s", per_type.alias("n")).filter(F.col("n") <= each + 1)
    aims = types.join(best.select(F.col("part_type").alias("related"), F.col("i").alias("other"), "__s", "n"), "related").filter((F.col("n") <= each) | (F.col("related") == F.col("part_type")))
    place = F.row_number().over(Window.partitionBy("part_type").orderBy(F.desc("__s"), "other"))
    aims = aims.withColumn("n", place).filter(F.col("n") <= most + 2).drop("n")
    met = products.select("i", "part_type").join(F.broadcast(aims), "part_type").filter("i <> other")  # a few rows for each type
    in_type = F.row_number().over(Window.partitionBy("i", "related").orderBy(F.desc("__s"), "other"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("__s"), "other"))
    return met.withColumn("k", in_type).filter(F.col("k") <= each).withColumn("nth", nth).filter(F.col("nth") <= most).select("i", "other", "nth")


def best_of_groups(products: DataFrame, group: list[str], most: int) -> DataFrame:
    """(group columns, members, first: ids) of products (i, tier, price, group columns): the first `most` of each group by tier, price
    and id. Windows are limited before they shuffle, so no group is gathered."""
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(place, "price", "i"))
    top = products.withColumn("__n", nth).filter(F.col("__n") <= most).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "i"))), lambda x: x.i).alias("first"))
    return products.groupBy(*group).agg(F.count(F.lit(1)).alias("members")).join(top, group)


def showcase(products: DataFrame, tiers: int = 4) -> DataFrame:
    """(group, tier, i, price): the cheapest of each tier of the first group that has all tiers, else of the one with the most."""
    sizes = products.groupBy("group").agg(F.count_distinct("tier").alias("n"))
    first = sizes.orderBy(F.desc(F.least("n", F.lit(tiers))), "group").limit(1).select("group")
    return products.join(F.broadcast(first), "group").groupBy("group", "tier").agg(F.min(F.struct("price", "i")).alias("x")).select("group", "tier", "x.i", "x.price")


def first_match(products: DataFrame, conditions: list[Column], order: list[Column]) -> DataFrame:
    """One row: the first product, in order, under the first condition that any meets (a chain of fallbacks)."""
    place = reduce(lambda rest, c: F.when(c[1], c[0]).otherwise(rest), reversed(list(enumerate(conditions))), F.lit(None).cast("int"))
    return products.withColumn("priority", place).filter("priority is not null").orderBy("priority", *order).limit(1)


def market(products: DataFrame) -> DataFrame:
    """(part_type, tier, price, below, n, percent, label) of each price of each market: products cheaper than it, and its place from
    0 to 100. From counts of equal prices, so that a market isn't gathered row by row."""
    prices = products.groupBy("part_type", "tier", "price").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("part_type", "tier")
    before = F.coalesce(F.sum("c").over(w.orderBy("price").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = prices.select("part_type", "tier", "price", before.alias("below"), F.sum("c").over(w).alias("n"))
    percent = F.least(F.lit(100), F.bround(F.col("below") * 100 / F.greatest(F.lit(1), F.col("n") - 1))).cast("long")
    return rows.withColumn("percent", percent).withColumn("label", F.when(percent <= 35, "low").when(percent <= 70, "fair").otherwise("high"))


def upper_median(products: DataFrame) -> DataFrame:
    """(part_type, tier, median): the price at place n // 2 of each market's sorted prices, from counts of equal prices."""
    rows = market(products).select("part_type", "tier", "price", "below", "n")
    return rows.filter(F.col("below") <= F.floor(F.col("n") / 2)).groupBy("part_type", "tier").agg(F.max("price").alias("median"))
