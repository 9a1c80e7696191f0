"""Carts, shipments, order events, diagnosis and maintenance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREE_FROM, FEE = 100_000.0, 99.0


def cart_totals(lines: DataFrame) -> DataFrame:
    """(cart, cents, fee, missing_for_free) of lines (cart, price_cents, qty); cents are whole numbers, so sums are exact."""
    sums = lines.groupBy("cart").agg(F.sum(F.col("price_cents") * F.col("qty")).alias("cents"))
    free = F.lit(int(FREE_FROM * 100))
    return sums.select("cart", "cents", F.when(F.col("cents") >= free, 0).otherwise(int(FEE * 100)).cast("long").alias("fee"), F.greatest(F.lit(0), free - F.col("cents")).alias("missing_for_free"))


def warehouse_sets(etas: list[int]) -> list[tuple[int, ...]]:
    """All sets of warehouses: the smallest first, of equals the one whose last parcel comes soonest, then by all their days."""
    sets = [c for n in range(1, len(etas) + 1) for c in combinations(range(len(etas)), n)]
    return sorted(sets, key=lambda c: (len(c), max(etas[k] for k in c), sum(etas[k] for k in c)))


def back_ordered(stock: Column, qty: Column) -> Column:
    """Whether all warehouses together hold less than a line asks for: it is left for later, whole."""
    return F.aggregate(stock, F.lit(0).cast("long"), lambda a, x: a + x) < qty


def ship_from(lines: DataFrame, etas: list[int]) -> DataFrame:
    """(cart, warehouses): the first of warehouse_sets() whose stock, summed, serves every line of the cart that isn't back
    ordered; null if all lines are.

    lines: cart, stock (array, one entry per warehouse), qty. The 2^W - 1 sets are columns of one aggregation.
    """
    sets = warehouse_sets(etas)
    back = back_ordered(F.col("stock"), F.col("qty"))

    def serves(c: tuple[int, ...]) -> Column:
        return F.bool_and(F.when(~back, sum((F.get("stock", F.lit(k)) for k in c), F.lit(0)) >= F.col("qty")))

    covers = lines.groupBy("cart").agg(*(serves(c).alias(f"c{j}") for j, c in enumerate(sets)))
    return covers.select("cart", F.coalesce(*(F.when(F.col(f"c{j}"), "".join(map(str, c))) for j, c in enumerate(sets))).alias("warehouses"))


def shipments(lines: DataFrame, soonest: list[int], latest: list[int]) -> DataFrame:
    """(cart, warehouses, units: array by warehouse, back_lines, eta_from, eta_to) of allocated lines (cart, warehouses, parts,
    short): what each warehouse sends, the lines left for later, and the days until the last parcel of those used."""

    def of(w: int) -> Column:
        return F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.when(x.warehouse == w, x.units).otherwise(0)))

    sent = [of(w) for w in range(len(latest))]
    each = lines.groupBy("cart").agg(F.first("warehouses").alias("warehouses"), F.array(*sent).alias("units"), F.count_if(F.col("short") > 0).alias("back_lines"))
    eta = lambda days: F.greatest(*(F.when(F.col("units")[w] > 0, d) for w, d in enumerate(days)), F.lit(None).cast("int"))
    return each.select("cart", "warehouses", "units", "back_lines", eta(soonest).alias("eta_from"), eta(latest).alias("eta_to"))


def transitions(events: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """(user_id, event_id, before, event_type, valid) in event order; the first event of a user is valid."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("event_type").over(w)
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("before") == a) & (F.col("event_type") == b))
    return events.withColumn("before", before).select("user_id", "event_id", "before", "event_type", (F.col("before").isNull() | ok).alias("valid"))


def add_business_days(day: Column, n: int) -> Column:
    """n days from Monday to Saturday on."""
    days = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 1)), lambda d: F.dayofweek(d) != 1)
    return F.element_at(days, n)


def best_bundles(costs: list[int], values: list[int], budget: int) -> list[bool]:
    """Which bundles give the highest total value within budget; a later one replaces earlier ones only if that is worth more."""
    best = np.zeros(budget + 1, np.int64 if sum(values) < 1 << 62 else object)
    keep = []
    for cost, value in zip(costs, values):
        taken = np.zeros(budget + 1, bool)
        if cost <= budget:
            with_it = best[: budget + 1 - cost] + value
            taken[cost:] = with_it > best[cost:]
            best[cost:] = np.where(taken[cost:], with_it, best[cost:])
        keep.append(taken)
    out, room = [], budget
    for cost, taken in zip(reversed(costs), reversed(keep)):
        out.append(bool(taken[room]))
        room -= cost * out[-1]
    return out[::-1]


def fit_budget(lines: DataFrame, budgets: DataFrame) -> DataFrame:
    """(plan, bundle, cost, priority, now) of each bundle of each plan: whether it is done within the plan's budget.

    lines: plan, bundle, nth (order in the plan), cents, priority; budgets: plan, budget (whole units). The lines of a bundle
    are done together or not at all; it costs their sum in whole units, half to even, one at least. With n lines in the plan a
    line of priority p is worth (n + 1) ** p, more than all lines of lower priorities, so these come strictly after. Values are
    whole numbers of any size. Sums per bundle are made before plans meet in a task; a plan has few bundles (tens)."""
    sums = lines.groupBy("plan", "bundle").agg(F.min("nth").alias("nth"), F.sum("cents").alias("cents"), F.sum("priority").alias("priority"), F.collect_list("priority").alias("priorities"))
    ready = sums.join(budgets, "plan").select("plan", "nth", "bundle", "cents", "priority", "priorities", "budget")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(plan: list) -> list[tuple]:
            n = sum(len(r[5]) for r in plan)
            costs, values = [max(1, round(r[3] / 100)) for r in plan], [sum((n + 1) ** int(p) for p in r[5]) for r in plan]
            now = best_bundles(costs, values, max(0, int(plan[0][6])))
            return [(r[0], r[2], cost, r[4], yes) for r, cost, yes in zip(plan, costs, now)]

        held: list = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch[c].tolist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += done(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["plan", "bundle", "cost", "priority", "now"])
        if held:
            yield pd.DataFrame(done(held), columns=["plan", "bundle", "cost", "priority", "now"])

    ordered = ready.repartition("plan").sortWithinPartitions("plan", "nth", "bundle")
    types = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    return ordered.mapInPandas(run, f"plan {types['plan']}, bundle {types['bundle']}, cost long, priority long, now boolean")


def knapsack(bundles: DataFrame, budget: int) -> DataFrame:
    """(plan, chosen: array of ids) with the highest total value within budget; of equals the one found first.

    bundles: plan, id, cost (whole, at least 1), value (long). A plan has few bundles (tens), whatever the number of plans.
    """

    def best(rows: list[tuple[int, int, int]]) -> tuple[list[int], int]:
        rooms: list[tuple[int, tuple]] = [(0, ())] * (budget + 1)
        for i, cost, value in rows:
            for room in range(budget, cost - 1, -1):
                with_it = rooms[room - cost][0] + value
                if with_it > rooms[room][0]:
                    rooms[room] = (with_it, (*rooms[room - cost][1], i))
        return list(rooms[budget][1]), rooms[budget][0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, rows = None, []
        for batch in batches:
            done = []
            for p, *row in zip(*(batch[c].tolist() for c in ("plan", "id", "cost", "value"))):
                if rows and p != plan:
                    done.append((plan, *best(rows)))
                    rows = []
                plan = p
                rows.append(row)
            yield pd.DataFrame(done, columns=["plan", "chosen", "value"])
        if rows:
            yield pd.DataFrame([(plan, *best(rows))], columns=["plan", "chosen", "value"])

    ordered = bundles.select("plan", "id", "cost", "value").repartition("plan").sortWithinPartitions("plan", "id")
    return ordered.mapInPandas(run, f"plan {bundles.schema['plan'].dataType.simpleString()}, chosen array<long>, value long")


def insert_once(existing: DataFrame, asked: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows of asked to add: of each key that existing lacks, the first in order. Repeated requests add nothing. Rows of
    one key are reduced before they shuffle."""
    columns = [c for c in asked.columns if c != key]
    first = asked.groupBy(key).agg(F.min(F.struct(*(c.alias(f"__{k}") for k, c in enumerate(order)), F.struct(*columns).alias("__row"))).alias("__first"))
    return first.join(existing.select(key), key, "left_anti").select(key, "__first.__row.*")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n) by Spark's session windows; the same call works on a stream with a watermark."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
