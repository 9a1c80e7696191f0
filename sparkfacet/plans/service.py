"""The registered queries on maintenance, shipments, orders, codes and product pages."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfacet.functions import text as X
from sparkfacet.operators import codes, orders, service, trust, vehicles, workshop
from sparkfacet.plans.catalog import _ADJ, _SETS, _VALUE, LATEST, SOONEST, _value, cart_lines, query, with_others
from sparkfacet.plans.fit import ALL as _ALL_FITS
from sparkfacet.plans.fit import fits, garage, universe
from sparkfacet.sources.adapters import TIERS, products, table, tier_rank

_TASKS = "t AS (SELECT p_type AS task, 10000 * row_number() OVER (ORDER BY p_type) AS every FROM (SELECT DISTINCT p_type FROM part))"
_KM = "k AS (SELECT o_orderkey AS vehicle, greatest(10000, CAST(round(greatest(5000, ((SELECT max(year(o_orderdate)) FROM orders) - year(o_orderdate) + 0.5) * 15000) / 10000.0) * 10000 AS BIGINT)) AS km FROM orders)"


def _tasks(spark, sf):
    types = table(spark, sf, "part").select(F.col("p_type").alias("task")).distinct()
    return types.select("task", (10000 * F.row_number().over(Window.orderBy("task"))).cast("long").alias("every"))  # a handful of types


def _due(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("vehicle"), F.year("o_orderdate").alias("year"))
    newest = o.agg(F.max("year").alias("newest"))
    km = o.join(F.broadcast(newest)).select("vehicle", workshop.milestones(workshop.km_estimate(F.col("year"), F.col("newest")), 1)[0].alias("km"))  # one row
    return service.due(km, _tasks(spark, sf))


@query(f"WITH {_TASKS}, {_KM} SELECT vehicle, km, task FROM k, t WHERE km % every = 0")
def due_tasks(spark, sf):
    return _due(spark, sf)


def _task_products(spark, sf):
    rated = trust.with_bayes(products(spark, sf))
    return rated.select(F.col("part_type").alias("task"), "i", "tier", "price", "adjusted", F.round(_value(), 8).alias("score"), (F.col("stock_total") > 20).alias("in_stock"))


_POOL = f"{_ADJ}, s AS (SELECT part_type AS task, i, tier, price, adjusted, round({_VALUE}, 8) AS score, stock_total > 20 AS in_stock FROM q), pool AS (SELECT * FROM s x WHERE in_stock OR NOT EXISTS (SELECT 1 FROM s y WHERE y.task = x.task AND y.in_stock)), fine AS (SELECT * FROM pool x WHERE tier IN ('desempeno', 'oem') OR NOT EXISTS (SELECT 1 FROM pool y WHERE y.task = x.task AND y.tier IN ('desempeno', 'oem'))), pk AS (SELECT task, arg_min(i, (price, i)) AS cheapest, arg_max(i, (score, -i)) AS value FROM pool GROUP BY task), pb AS (SELECT task, arg_max(i, (adjusted, price, -i)) AS best FROM fine GROUP BY task)"


@query(f", {_POOL} SELECT task, cheapest, value, best FROM pk JOIN pb USING (task) -- from p ")
def plan_picks(spark, sf):
    return service.picks(_task_products(spark, sf), ("desempeno", "oem"))


@query(f", {_POOL}, {_TASKS}, {_KM}, d AS (SELECT vehicle, task FROM k, t WHERE km % every = 0), c AS (SELECT i, CAST(round(price * 100) AS BIGINT) AS cents FROM p) SELECT vehicle, count(*) AS tasks, CAST(sum(a.cents * (1 + vehicle % 4)) AS BIGINT) AS cheapest_cents, CAST(sum(b.cents * (1 + vehicle % 4)) AS BIGINT) AS value_cents, CAST(sum(e.cents * (1 + vehicle % 4)) AS BIGINT) AS best_cents FROM d JOIN pk USING (task) JOIN pb USING (task) JOIN c a ON a.i = cheapest JOIN c b ON b.i = value JOIN c e ON e.i = best GROUP BY vehicle")
def plan_totals(spark, sf):
    """The due tasks of each vehicle at the three picks' prices; lines are rounded to cents before they are summed."""
    cents = table(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    priced = service.picks(_task_products(spark, sf), ("desempeno", "oem"))
    for name in ("cheapest", "value", "best"):
        priced = priced.join(cents.select(F.col("p_partkey").alias(name), F.col("cents").alias(f"{name}_cents")), name)
    qty = 1 + F.col("vehicle") % 4
    rows = _due(spark, sf).join(F.broadcast(priced), "task")  # one row for each task
    return rows.groupBy("vehicle").agg(F.count(F.lit(1)).alias("tasks"), *(F.sum(F.col(f"{n}_cents") * qty).alias(f"{n}_cents") for n in ("cheapest", "value", "best")))


_OF_VARIANT = _POOL.replace("part_type AS task", "part_type || ':' || (i % 2) AS task", 1)


@query(f", {_OF_VARIANT}, {_TASKS}, {_KM}, d AS (SELECT vehicle, task || ':' || (vehicle % 2) AS task, CASE WHEN length(task) % 2 = 1 THEN 4 + 2 * (vehicle % 3) ELSE 1 END AS qty FROM k, t WHERE km % every = 0), c AS (SELECT i, CAST(round(price * 100) AS BIGINT) AS cents FROM p) SELECT vehicle, count(*) AS tasks, CAST(sum(qty) AS BIGINT) AS units, CAST(sum(a.cents * qty) AS BIGINT) AS cheapest_cents, CAST(sum(b.cents * qty) AS BIGINT) AS value_cents, CAST(sum(e.cents * qty) AS BIGINT) AS best_cents FROM d JOIN pk USING (task) JOIN pb USING (task) JOIN c a ON a.i = cheapest JOIN c b ON b.i = value JOIN c e ON e.i = best GROUP BY vehicle")
def plan_variants(spark, sf):
    """Plans whose products are of the variant that the vehicle asks for (here, by its number), and whose parts of some types
    come one for each cylinder."""
    cents = table(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    of_variant = _task_products(spark, sf).withColumn("task", F.concat_ws(":", "task", (F.col("i") % 2).cast("string")))
    priced = service.picks(of_variant, ("desempeno", "oem"))
    for name in ("cheapest", "value", "best"):
        priced = priced.join(cents.select(F.col("p_partkey").alias(name), F.col("cents").alias(f"{name}_cents")), name)
    vehicle = F.col("vehicle")
    rows = _due(spark, sf).select("vehicle", F.when(F.length("task") % 2 == 1, 4 + 2 * (vehicle % 3)).otherwise(1).alias("qty"), F.concat_ws(":", "task", (vehicle % 2).cast("string")).alias("task")).join(F.broadcast(priced), "task")  # two rows for each task
    return rows.groupBy("vehicle").agg(F.count(F.lit(1)).alias("tasks"), F.sum("qty").alias("units"), *(F.sum(F.col(f"{n}_cents") * F.col("qty")).alias(f"{n}_cents") for n in ("cheapest", "value", "best")))


_SHIPPED = f"""l AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey AS cart, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS q, s0, s1, s2 FROM lineitem JOIN p ON i = l_partkey), c AS (SELECT cart, {_SETS} AS warehouses FROM l GROUP BY cart),
w AS (SELECT id, cart, line, q, coalesce(warehouses, '') AS warehouses, s0 + s1 + s2 < q AS back, unnest([{{'w': 0, 's': s0}}, {{'w': 1, 's': s1}}, {{'w': 2, 's': s2}}]) AS x FROM l JOIN c USING (cart)), r AS (SELECT id, cart, line, q, warehouses, back, x.w AS w, CASE WHEN back OR NOT contains(warehouses, CAST(x.w AS VARCHAR)) THEN 0 ELSE x.s END AS s FROM w),
u AS MATERIALIZED (SELECT *, CAST(greatest(0, least(s, q - coalesce(sum(s) OVER (PARTITION BY id ORDER BY s DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS units FROM r)"""


def _allocated(spark, sf):
    lines = cart_lines(spark, sf)
    return service.allocate(lines.join(orders.ship_from(lines, LATEST), "cart"))


@query(f", {_SHIPPED} SELECT cart, line, q AS qty, warehouses, coalesce(string_agg(w || 'x' || units, '+' ORDER BY s DESC, w) FILTER (units > 0), '') AS parts, CAST(q - sum(units) AS BIGINT) AS short FROM u GROUP BY id, cart, line, q, warehouses -- from p ")
def allocation(spark, sf):
    """What each warehouse of the cart's set sends of each line; lines that can't be served at all are left for later."""
    parts = F.array_join(F.transform("parts", lambda x: F.concat_ws("x", x.warehouse.cast("string"), x.units.cast("string"))), "+")
    return _allocated(spark, sf).select("cart", "line", "qty", F.coalesce("warehouses", F.lit("")).alias("warehouses"), parts.alias("parts"), "short")


@query(f", {_SHIPPED}, t AS (SELECT cart, warehouses, CAST(sum(units) FILTER (w = 0) AS BIGINT) AS n0, CAST(sum(units) FILTER (w = 1) AS BIGINT) AS n1, CAST(sum(units) FILTER (w = 2) AS BIGINT) AS n2, count(DISTINCT id) FILTER (back) AS back_lines FROM u GROUP BY cart, warehouses) SELECT cart, warehouses, n0 || '/' || n1 || '/' || n2 AS units, back_lines, greatest(CASE WHEN n0 > 0 THEN 1 END, CASE WHEN n1 > 0 THEN 3 END, CASE WHEN n2 > 0 THEN 1 END, -1) AS eta_from, greatest(CASE WHEN n0 > 0 THEN 1 END, CASE WHEN n1 > 0 THEN 4 END, CASE WHEN n2 > 0 THEN 2 END, -1) AS eta_to FROM t -- from p ")
def cart_shipments(spark, sf):
    """One row for each cart: its warehouses, what each sends, lines left for later, and when the last parcel comes."""
    done = orders.shipments(_allocated(spark, sf), SOONEST, LATEST)
    return done.select("cart", F.coalesce("warehouses", F.lit("")).alias("warehouses"), F.array_join(F.col("units").cast("array<string>"), "/").alias("units"), "back_lines", "eta_from", "eta_to").fillna(-1, ["eta_from", "eta_to"])  # -1: nothing is sent


_DIGITS = f"'{X.CROCKFORD}'"
_CODE = f"b AS (SELECT o_orderkey, CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 10) AS BIGINT) AS bits FROM orders), d AS (SELECT o_orderkey, list_transform(range(0, 8), lambda k: (bits >> CAST(35 - 5 * k AS INTEGER)) % 32) AS v FROM b), o AS (SELECT o_orderkey, 'OC-' || array_to_string(list_transform(v, lambda x: substr({_DIGITS}, x + 1, 1)), '') || substr({_DIGITS}, 1 + (32 - CAST(list_sum(list_transform(range(0, 8), lambda k: CASE WHEN k % 2 = 1 THEN v[k + 1] * 2 // 32 + v[k + 1] * 2 % 32 ELSE v[k + 1] END)) AS BIGINT) % 32) % 32, 1) AS code FROM d)"


@query(f"WITH {_CODE} SELECT o_orderkey, code FROM o")
def order_codes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", service.order_code(F.col("o_orderkey")).alias("code"))


@query(f"WITH {_CODE} SELECT o_orderkey, substr(code, 4) AS code, true AS whole, o_orderkey % 2 = 0 AS typed FROM o")
def code_checks(spark, sf):
    """Codes as people type them: lower case, blanks, O for 0; every other one with its last digit changed."""
    # exploding an array of one keeps long expressions from being written into each use
    once = lambda frame, **c: frame.select("*", *(F.explode(F.array(x)).alias(n) for n, x in c.items()))
    rows = once(table(spark, sf, "orders").select("o_orderkey"), made=service.order_code(F.col("o_orderkey")))
    rows = once(rows, code=service.normal_code(F.lower(F.concat(F.substring("made", 1, 7), F.lit(" "), F.translate(F.substring("made", 8, 5), "0", "O")))))
    wrong = F.concat(F.substring("code", 1, 8), F.when(F.substring("code", 9, 1) == "7", "8").otherwise("7"))
    rows = once(rows, said=F.when(F.col("o_orderkey") % 2 == 0, F.col("code")).otherwise(wrong))
    return rows.select("o_orderkey", "code", service.valid_code(F.col("code")).alias("whole"), service.valid_code(F.col("said")).alias("typed"))


SECRET = b"a secret that only tests and this query know"
_PADS = [bytes(b ^ x for b in SECRET.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
_BODY = """'{"brand":"' || p_brand || '","id":' || p_partkey || ',"type":"' || p_type || '"}'"""


@query(f"SELECT p_partkey, rtrim(translate(to_base64(encode(body)), '+/', '-_'), '=') || '.' || rtrim(translate(to_base64(unhex(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(body)))))), '+/', '-_'), '=') AS token, true AS valid, false AS forged FROM (SELECT p_partkey, {_BODY} AS body FROM part)")
def certificates(spark, sf):
    """Signed tokens of canonical JSON (keys in order), checked, and checked again after a change."""
    body = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_type").alias("type")))
    rows = table(spark, sf, "part").select("p_partkey", codes.issue(SECRET, body).alias("token"))
    return rows.select("p_partkey", "token", codes.verify(SECRET, F.col("token")).alias("valid"), codes.verify(SECRET, F.concat(F.lit("A"), "token")).alias("forged"))


_KEPT = "length(trim(name)) BETWEEN 2 AND 80 AND regexp_matches(trim(mail), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')"


@query(f"""WITH {_CODE}, s AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN ' x ' ELSE c_name END AS name, CASE WHEN o_custkey % 7 = 0 THEN 'none' ELSE 'c' || o_custkey || '@mail.example.com' END AS mail, o_orderdate, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey),
t AS (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS cents, count(*) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT code, '{{"cents":' || cents || ',"lines":' || lines || ',"name":"' || trim(name) || '"}}' AS payload, (SELECT d FROM (SELECT CAST(o_orderdate AS DATE) + CAST(k AS INTEGER) AS d FROM range(1, 12) r(k)) WHERE dayofweek(d) <> 0 ORDER BY d LIMIT 1 OFFSET 1) AS ships FROM s JOIN t USING (o_orderkey) JOIN o USING (o_orderkey) WHERE {_KEPT}""")
def placed_orders(spark, sf):
    """Orders whose customer is acceptable: totals, code, day of shipping and a JSON payload."""
    from sparkfacet.operators.orders import add_business_days

    k = F.col("o_custkey")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 10 == 0, " x ").otherwise(F.col("c_name")).alias("name"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customer, "o_custkey")
    rows = rows.withColumn("mail", F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit("c"), k, F.lit("@mail.example.com")))).filter(service.accepted(F.col("name"), F.col("mail")))
    price = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))
    totals = table(spark, sf, "lineitem").join(price, "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("price") * F.col("l_quantity").cast("long")).alias("cents"), F.count(F.lit(1)).alias("lines"))
    payload = F.to_json(F.struct("cents", "lines", F.trim("name").alias("name")))
    return rows.join(totals, "o_orderkey").select(service.order_code(F.col("o_orderkey")).alias("code"), payload.alias("payload"), add_business_days(F.to_date("o_orderdate"), 2).alias("ships"))


@query("SELECT u.user_id AS code, count(e.event_id) AS events, coalesce(string_agg(e.event_type, '>' ORDER BY e.ts, e.event_id), '') AS history FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM events WHERE event_type <> 'view') e USING (user_id) GROUP BY u.user_id")
def order_history(spark, sf):
    e = table(spark, sf, "events")
    seq = F.struct("ts", "event_id")
    logs = e.filter("event_type <> 'view'").select(F.col("user_id").alias("code"), seq.alias("seq"), F.col("event_type").alias("status"))
    done = service.with_history(e.select(F.col("user_id").alias("code")).distinct(), logs)
    return done.select("code", F.size("history").cast("long").alias("events"), F.array_join(F.transform("history", lambda h: h.status), ">").alias("history"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_orders(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", "o_totalprice")


@query(f"WITH {_CODE} SELECT o_orderkey, o_orderstatus AS status FROM o JOIN orders USING (o_orderkey) WHERE o_custkey % 10 < 5")
def order_lookup(spark, sf):
    """An order is shown only to who knows both its code and its address (here, half of the askers)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", service.order_code(F.col("o_orderkey")).alias("code"))
    asked = table(spark, sf, "orders").select(service.order_code(F.col("o_orderkey")).alias("code"), (F.col("o_custkey") + F.when(F.col("o_custkey") % 10 < 5, 0).otherwise(1)).alias("o_custkey"))
    return asked.join(o, ["code", "o_custkey"]).select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id ELSE '192.168.1.' || user_id END AS client FROM events")
def client_keys(spark, sf):
    k, u = F.col("event_id") % 3, F.col("user_id")
    header = F.when(k == 0, F.concat(F.lit("1.2.3.4, 10.0.0."), u)).when(k == 1, " ")
    return table(spark, sf, "events").select("event_id", service.client_key(header, F.concat(F.lit("192.168.1."), u)).alias("client"))


@query("SELECT i, CASE WHEN s0 > 0 THEN 0 WHEN s2 > 0 THEN 2 WHEN s1 > 0 THEN 1 ELSE -1 END AS warehouse, stock_total < 5 AS low, CASE WHEN s0 > 0 THEN 'in 1 days' WHEN s2 > 0 THEN 'in 2 days' WHEN s1 > 0 THEN 'in 4 days' ELSE 'out of stock' END AS text FROM p ")
def availability(spark, sf):
    return products(spark, sf).select("i", service.availability(F.col("stock"), [1, 4, 2]).alias("a")).select("i", "a.*").fillna(-1, ["warehouse"])  # -1: none


_RELATED = "ty AS (SELECT x.p_type AS part_type, y.p_type AS related FROM (SELECT DISTINCT p_type FROM part) x JOIN (SELECT DISTINCT p_type FROM part) y ON x.p_type <> y.p_type AND (ascii(x.p_type) + ascii(y.p_type)) % 2 = 0)"


@query(f", {_RELATED}, b AS (SELECT part_type AS related, i AS other, rating, row_number() OVER (PARTITION BY part_type ORDER BY rating DESC, i) AS n FROM p ), m AS (SELECT p.i, other, related, b.rating AS rating FROM p JOIN ty USING (part_type) JOIN b USING (related) WHERE n <= 2) SELECT i, other, nth FROM (SELECT i, other, row_number() OVER (PARTITION BY i ORDER BY rating DESC, other) AS nth FROM m) WHERE nth <= 4 -- from p ")
def related_products(spark, sf):
    types = table(spark, sf, "part").select("p_type").distinct()
    x, y = types.select(F.col("p_type").alias("part_type")), types.select(F.col("p_type").alias("related"))
    pairs = x.join(F.broadcast(y), (F.col("part_type") != F.col("related")) & ((F.ascii("part_type") + F.ascii("related")) % 2 == 0))  # a handful of types
    out = service.related(products(spark, sf), pairs, F.col("rating"))
    return out.select("i", "other", F.col("nth").cast("long").alias("nth"))


@query("g AS (SELECT variant || ' ' || category AS grp, count(DISTINCT tier) AS n FROM p GROUP BY ALL), f AS (SELECT grp FROM g ORDER BY n DESC, grp LIMIT 1) SELECT grp AS \"group\", tier, arg_min(i, (price, i)) AS i, min(price) AS price FROM p JOIN f ON grp = variant || ' ' || category GROUP BY ALL".replace("g AS (", ", g AS (", 1))
def tier_showcase(spark, sf):
    return service.showcase(products(spark, sf).select(F.concat_ws(" ", "variant", "category").alias("group"), "tier", "price", "i"))


@query("SELECT CASE WHEN price < 0 THEN 0 WHEN on_sale AND stock_total > 25 AND tier = 'oem' THEN 1 ELSE 2 END AS priority, i, rating FROM p WHERE on_sale ORDER BY priority, rating DESC, i LIMIT 1")
def sample_product(spark, sf):
    """The first product under a chain of conditions, for a sample search."""
    conditions = [F.col("price") < 0, F.col("on_sale") & (F.col("stock_total") > 25) & (F.col("tier") == "oem"), F.col("on_sale")]
    return service.first_match(products(spark, sf), conditions, [F.desc("rating"), F.col("i")]).select("priority", "i", "rating")


_MARKET = "mk AS (SELECT i, part_type, tier, price, rank() OVER (PARTITION BY part_type, tier ORDER BY price) - 1 AS below, count(*) OVER (PARTITION BY part_type, tier) AS n FROM p ), mp AS (SELECT *, CAST(least(100, round_even(below * 100::DOUBLE / greatest(1, n - 1), 0)) AS BIGINT) AS percent FROM mk)"


@query(f", {_MARKET} SELECT i, percent, CASE WHEN percent <= 35 THEN 'low' WHEN percent <= 70 THEN 'fair' ELSE 'high' END AS label FROM mp -- from p ")
def market_place(spark, sf):
    p = products(spark, sf).select("i", "part_type", "tier", "price")
    return p.join(service.market(p), ["part_type", "tier", "price"]).select("i", "percent", "label")


@query("SELECT part_type, tier, list_sort(list(price))[1 + len(list(price)) // 2] AS median FROM p GROUP BY part_type, tier")
def market_median(spark, sf):
    return service.upper_median(products(spark, sf))


@query(""", e AS (SELECT x.i, string_agg(CAST(y.i AS VARCHAR), ',' ORDER BY y.tier_rank, y.price, y.i) AS alternatives FROM p x JOIN p y ON x.brand IS NOT DISTINCT FROM y.brand AND x.variant IS NOT DISTINCT FROM y.variant AND x.category IS NOT DISTINCT FROM y.category AND x.i <> y.i GROUP BY x.i)
SELECT i, min(i) OVER g AS first, row_number() OVER (PARTITION BY brand, variant, category ORDER BY tier_rank, price, i) AS nth, coalesce(alternatives, '') AS alternatives FROM p LEFT JOIN e USING (i) WINDOW g AS (PARTITION BY brand, variant, category)""")
def alternatives(spark, sf):
    """All other members of each product's group by tier and price, the group's first member, and the product's own place."""
    keys = ["brand", "variant", "category"]
    p = products(spark, sf).select("i", *keys, tier_rank(F.col("tier")).alias("r"), "price")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("r", F.asc_nulls_last("price"), "i"))
    placed = p.withColumn("nth", nth.cast("long"))  # before rows hold the others
    return with_others(placed, keys, [F.col("r"), F.col("price").isNull(), F.col("price")], "alternatives").select("i", "first", "nth", "alternatives")


@query("SELECT category, coalesce(NULL, variant, 'Todas') AS shelf, count(*) AS n, arg_min(i, i) AS first, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS rows FROM p GROUP BY ALL")
def listing_groups(spark, sf):
    g = products(spark, sf).groupBy("category", F.coalesce("variant", F.lit("Todas")).alias("shelf"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.array_join(F.array_sort(F.collect_list("i")).cast("array<string>"), ",").alias("rows"))


@query("SELECT category, part_type, brand, tier, count(*) AS n, count(*) FILTER (stock_total > 0) AS stocked, CASE WHEN grouping(tier) = 0 THEN 4 WHEN grouping(brand) = 0 THEN 3 WHEN grouping(part_type) = 0 THEN 2 ELSE 1 END AS level FROM p GROUP BY ROLLUP (category, part_type, brand, tier) HAVING category IS NOT NULL")
def catalogue_tree(spark, sf):
    """Counts at each level of the tree, from one rollup."""
    r = products(spark, sf).rollup("category", "part_type", "brand", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stock_total") > 0).alias("stocked"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, 4).when(F.col("g") == 1, 3).when(F.col("g") == 3, 2).otherwise(1)
    return r.filter("category is not null").select("category", "part_type", "brand", "tier", "n", "stocked", level.alias("level"))


@query("SELECT i, CAST(round_even((1 - price / (price + 5 * s1)) * 100, 0) AS BIGINT) AS discount, CAST(round_even(reviews * (rating / 5) + CASE WHEN stock_total > 0 THEN 40 ELSE 0 END + CASE WHEN tier = 'diario' THEN 25 ELSE 0 END, 0) AS BIGINT) AS popularity, brand || ' / ' || tier_rank || ' / ' || category AS card, count(*) OVER (PARTITION BY brand) AS of_brand, count(*) OVER (PARTITION BY part_type) AS of_type, count(*) OVER (PARTITION BY category) AS of_category FROM p ")
def product_cards(spark, sf):
    """The wide projection: brand, type, category and tier looked up, a discount in whole percent, popularity, a label."""
    p = products(spark, sf)
    for c, name in (("brand", "of_brand"), ("part_type", "of_type"), ("category", "of_category")):
        p = p.join(products(spark, sf).groupBy(c).agg(F.count(F.lit(1)).alias(name)), c)
    tiers = spark.range(len(TIERS)).select((F.col("id") + 1).alias("rank"), F.element_at(F.array(*map(F.lit, TIERS)), (F.col("id") + 1).cast("int")).alias("tier"))
    discount = F.bround((1 - F.col("price") / (F.col("price") + 5 * F.col("stock")[1])) * 100).cast("long")
    popularity = F.bround(F.col("reviews") * (F.col("rating") / 5) + F.when(F.col("stock_total") > 0, 40).otherwise(0) + F.when(F.col("tier") == "diario", 25).otherwise(0)).cast("long")
    return p.join(F.broadcast(tiers), "tier").select("i", discount.alias("discount"), popularity.alias("popularity"), F.concat_ws(" / ", "brand", F.col("rank").cast("string"), "category").alias("card"), "of_brand", "of_type", "of_category")  # four tiers


_BITS = "SELECT tier, count(*) AS n, count(*) FILTER (brand < 'Brand#2') AS both FROM p GROUP BY tier"


@query(_BITS)
def bitmap_counts(spark, sf):
    """Members of each tier's bitmap, and of its intersection with another set's, by Spark's bitmap functions."""
    p = products(spark, sf).select("i", "tier", (F.col("brand") < "Brand#2").alias("other"))
    piece, place = F.expr("bitmap_bucket_number(i + 1)"), F.expr("bitmap_bit_position(i + 1)")
    maps = p.groupBy("tier", piece.alias("piece")).agg(F.bitmap_construct_agg(place).alias("all"))
    both = p.filter("other").groupBy("tier", piece.alias("piece")).agg(F.bitmap_construct_agg(place).alias("some"))
    return maps.join(both, ["tier", "piece"], "left").groupBy("tier").agg(F.sum(F.bitmap_count("all")).alias("n"), F.coalesce(F.sum(F.bitmap_count("some")), F.lit(0)).alias("both"))


_WMI = "w AS (SELECT n_nationkey AS place, upper(substr(md5(n_name), 1, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END)) AS prefix, n_name AS maker FROM nation)"
_VIN = "v AS (SELECT c_custkey, upper(substr(md5('vin' || c_custkey), 1, 17)) AS vin FROM customer)"
_SUM = " + ".join(f"{w} * instr('0123456789', CASE WHEN substr(vin, {k + 1}, 1) BETWEEN 'A' AND 'F' THEN CAST(instr('ABCDEF', substr(vin, {k + 1}, 1)) AS VARCHAR) ELSE substr(vin, {k + 1}, 1) END) - {w}" for k, w in enumerate(codes.VIN_WEIGHTS) if w)


_REGION = "CASE WHEN contains('12345', f) THEN 'Norteamérica' WHEN contains('67', f) THEN 'Oceanía' WHEN contains('89', f) THEN 'Sudamérica' WHEN contains('ABCDEFGH', f) THEN 'África' ELSE '' END"


@query(f"""WITH {_VIN}, {_WMI}, y AS (SELECT *, {_SUM} AS s, substr(vin, 1, 1) AS f, CASE WHEN substr(vin, 10, 1) BETWEEN '1' AND '9' THEN 2000 + CAST(substr(vin, 10, 1) AS INTEGER) WHEN substr(vin, 10, 1) BETWEEN 'A' AND 'F' THEN 2009 + instr('ABCDEF', substr(vin, 10, 1)) ELSE 0 END AS year FROM v)
SELECT c_custkey, substr(vin, 9, 1) = CASE WHEN s % 11 = 10 THEN 'X' ELSE CAST(s % 11 AS VARCHAR) END AS valid, (SELECT arg_min(maker, place) FROM w WHERE starts_with(vin, prefix)) AS maker, {_REGION} AS region, CAST(CASE WHEN year > 2012 THEN year - 30 ELSE year END AS INTEGER) AS year, CASE WHEN c_custkey % 13 = 0 THEN 'length' WHEN c_custkey % 17 = 0 THEN 'letters' ELSE '' END AS error FROM y""")
def vin_decode(spark, sf):
    """Check digits of numbers made from the customers, the first maker whose prefix they begin with, region and model year as
    of 2011; and what is wrong with some that were typed too short or with an O."""
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    makers = table(spark, sf, "nation").select(k.alias("place"), F.upper(F.substring(F.md5(F.col("n_name").cast("binary")), F.lit(1), F.when(k % 2 == 0, 1).otherwise(2))).alias("prefix"), F.col("n_name").alias("maker"))
    vins = table(spark, sf, "customer").select("c_custkey", F.upper(F.substring(F.md5(F.concat(F.lit("vin"), "c_custkey").cast("binary")), 1, 17)).alias("vin"))
    begins = vins.select("c_custkey", "vin", F.explode(F.array(F.substring("vin", 1, 1), F.substring("vin", 1, 2))).alias("prefix")).join(makers, "prefix")
    first = begins.groupBy("c_custkey").agg(F.min_by("maker", "place").alias("maker"))
    typed = codes.vin_clean(F.lower(F.when(c % 13 == 0, F.substring("vin", 1, 16)).when(c % 17 == 0, F.concat(F.substring("vin", 1, 16), F.lit("o"))).otherwise(F.concat_ws("-", F.substring("vin", 1, 3), F.substring("vin", 4, 14)))))
    vin = F.col("vin")
    return vins.join(first, "c_custkey", "left").select("c_custkey", codes.vin_valid(vin).alias("valid"), "maker", F.coalesce(codes.vin_region(vin), F.lit("")).alias("region"), F.coalesce(codes.vin_year(vin, F.lit(2011)), F.lit(0)).cast("int").alias("year"), F.coalesce(codes.vin_error(typed), F.lit("")).alias("error"))


@query("SELECT p_partkey, p_brand AS brand, p_type AS type, valid, CASE WHEN valid THEN p_brand || ' / ' || p_type || ' / ' || p_name ELSE '' END AS label FROM (SELECT *, p_partkey % 3 <> 0 AS valid FROM part)")
def token_payloads(spark, sf):
    """Tokens read back: what they say, whether they are genuine (every third is forged), and the label made of it."""
    k = F.col("p_partkey")
    body = F.to_json(F.struct(F.col("p_brand").alias("brand"), k.alias("id"), F.col("p_type").alias("type")))
    rows = table(spark, sf, "part").select("p_partkey", codes.issue(SECRET, body).alias("token"))
    rows = rows.withColumn("token", F.when(k % 3 == 0, F.concat(F.col("token"), F.lit("x"))).otherwise(F.col("token")))
    read = rows.select("p_partkey", codes.verify(SECRET, F.col("token")).alias("valid"), codes.payload_of(F.col("token"), "brand string, id long, type string").alias("p"), codes.short_code(F.col("token")).alias("code"))
    names = table(spark, sf, "part").select(k.alias("id"), "p_name")
    read = read.withColumn("id", F.col("p.id")).join(names, "id", "left")  # the product may be gone
    return read.select("p_partkey", "p.brand", "p.type", "valid", F.when(F.col("valid") & (F.length("code") == 9), F.concat_ws(" / ", "p.brand", "p.type", "p_name")).otherwise("").alias("label"))


@query(f""", {_ALL_FITS[5:]}, ty AS (SELECT DISTINCT p_type AS part_type FROM part), rl AS (SELECT x.part_type, y.part_type AS related, row_number() OVER (PARTITION BY x.part_type ORDER BY y.part_type) AS nth FROM ty x JOIN ty y ON x.part_type <> y.part_type), {_ADJ}, s AS (SELECT i, part_type, round({_VALUE}, 8) AS value FROM q),
fi AS MATERIALIZED (SELECT DISTINCT vehicle, item AS i FROM f JOIN vk USING (key)), b AS (SELECT vehicle, part_type AS related, i AS other, row_number() OVER (PARTITION BY vehicle, part_type ORDER BY value DESC, i) AS n FROM fi JOIN s USING (i)), a AS (SELECT fi.vehicle, fi.i, other, row_number() OVER (PARTITION BY fi.vehicle, fi.i ORDER BY rl.nth, b.n) AS nth FROM fi JOIN s USING (i) JOIN rl USING (part_type) JOIN b ON b.vehicle = fi.vehicle AND b.related = rl.related AND b.n <= 2) SELECT vehicle, i, other, nth FROM a WHERE nth <= 4 -- from p """)
def related_for_vehicles(spark, sf):
    """What belongs to each product that fits a vehicle, among what fits it too."""
    types = table(spark, sf, "part").select("p_type").distinct()
    names = types.agg(F.array_sort(F.collect_list("p_type")).alias("all"))  # a handful of types
    pairs = types.join(F.broadcast(names)).select(F.col("p_type").alias("part_type"), F.posexplode(F.filter("all", lambda x: x != F.col("p_type"))).alias("nth", "related"))  # one row
    keys = vehicles.fitting(fits(spark, sf), vehicles.vehicle_keys(garage(spark, sf), universe(spark, sf)))
    rated = trust.with_bayes(products(spark, sf)).withColumn("value", F.round(_value(), 8))
    out = service.related_by_fit(rated, pairs, keys, F.col("value"))
    return out.select("vehicle", "i", "other", F.col("nth").cast("long").alias("nth"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 3 <> 0")
def inserted_orders(spark, sf):
    """Orders asked for twice, some of which are there already, inserted once each; their JSON is read back to equal rows."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    asked = o.withColumn("nth", F.lit(1)).unionByName(o.select("o_orderkey", "o_custkey", F.lit("again").alias("status"), "cents").withColumn("nth", F.lit(2)))
    new = orders.insert_once(o.filter("o_orderkey % 3 = 0"), asked, "o_orderkey", [F.col("nth")])
    payload = F.to_json(F.struct("o_custkey", "status", "cents"))
    read = new.select("o_orderkey", F.from_json(payload, "o_custkey long, status string, cents long").alias("p"))
    return read.select("o_orderkey", "p.o_custkey", "p.status", "p.cents")
