"""The registered queries of the catalogue operators, each with the same result in DuckDB's SQL where that is possible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfacet.functions import text as X
from sparkfacet.operators import fitment, orders, search, service, trust
from sparkfacet.plans.store import shared_folder, stored
from sparkfacet.sources.adapters import PRODUCTS_SQL, dealt, products, shares, table, tier_rank
from sparkfacet.streaming import keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {PRODUCTS_SQL} {sql}" if " p " in sql or " p\n" in sql else sql
        return f

    return add


REQUEST = search.Request({"brand": ("Brand#11", "Brand#12", "Brand#13", "Brand#23"), "tier": ("diario", "oem")}, price_min=905.0, price_max=990.0, in_stock=True)
BRAND, TIER, PRICE, STOCK = "brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#23')", "tier IN ('diario', 'oem')", "price >= 905 AND price <= 990", "stock_total > 0"


@query(f"SELECT i, brand, tier, price, stock_total FROM p WHERE {BRAND} AND {TIER} AND {PRICE} AND {STOCK}")
def filter_multi_select(spark, sf):
    return search.select(products(spark, sf), REQUEST).select("i", "brand", "tier", "price", "stock_total")


@query("SELECT i, price FROM p WHERE price >= 920 AND price <= 960 AND on_sale")
def filter_price_flags(spark, sf):
    return search.select(products(spark, sf), search.Request(price_min=920.0, price_max=960.0, on_sale=True)).select("i", "price")


_REST = {"brand": f"{TIER} AND {PRICE} AND {STOCK}", "tier": f"{BRAND} AND {PRICE} AND {STOCK}"}
_ALL = f"{BRAND} AND {TIER} AND {PRICE} AND {STOCK}"


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS value, count(*) FILTER ({_REST.get(d, _ALL)}) AS n, {BRAND if d == 'brand' else TIER if d == 'tier' else 'false'} AS selected FROM p GROUP BY {d}" for d in search.DIMS) + ") WHERE n > 0 OR selected")
def facets_disjunctive(spark, sf):
    return search.facets(products(spark, sf), REQUEST)


@query(f"SELECT count(*) FILTER ({BRAND} AND {TIER} AND {PRICE} AND {STOCK}) AS in_stock, count(*) FILTER ({_ALL} AND on_sale) AS on_sale FROM p ")
def flag_counts(spark, sf):
    return products(spark, sf).agg(F.count_if(REQUEST.matches(("in_stock",)) & (F.col("stock_total") > 0)).alias("in_stock"), F.count_if(REQUEST.matches(("on_sale",)) & F.col("on_sale")).alias("on_sale"))


@query(f"""SELECT CAST(b.bin AS INTEGER) AS bin, count(x.price) AS n, CAST(floor(any_value(e.a)) AS BIGINT) AS lo, CAST(ceil(any_value(e.b)) AS BIGINT) AS hi
FROM range(16) b(bin) CROSS JOIN (SELECT min(price) AS a, max(price) AS b FROM p WHERE {BRAND} AND {TIER} AND {STOCK}) e LEFT JOIN (SELECT price, least(15, CAST(floor((price - a) / CASE WHEN z > a THEN z - a ELSE 1 END * 16) AS INTEGER)) AS bin FROM p , (SELECT min(price) AS a, max(price) AS z FROM p WHERE {BRAND} AND {TIER} AND {STOCK}) WHERE {BRAND} AND {TIER} AND {STOCK}) x ON x.bin = b.bin GROUP BY b.bin""")
def price_histogram(spark, sf):
    return search.histogram(products(spark, sf), REQUEST)


@query("SELECT brand AS word, count(*) AS weight, 'brand' AS kind FROM p GROUP BY brand UNION ALL SELECT part_type, count(*), 'part_type' FROM p GROUP BY part_type UNION ALL SELECT category, count(*), 'category' FROM p GROUP BY category")
def completion_weights(spark, sf):
    p = products(spark, sf).select(F.explode(F.array(*(F.struct(F.col(d).alias("word"), F.lit(d).alias("kind")) for d in ("brand", "part_type", "category")))).alias("w"))
    return p.groupBy("w.word", "w.kind").agg(F.count(F.lit(1)).alias("weight"))


@query("SELECT i, price FROM p ORDER BY price, i LIMIT 24 OFFSET 48")
def sort_price_page(spark, sf):
    return search.page(products(spark, sf).select("i", "price"), [F.col("price"), F.col("i")], 2, 24)


@query("SELECT i, tier, price FROM p ORDER BY tier_rank, price, i LIMIT 24")
def sort_tier_page(spark, sf):
    return search.page(products(spark, sf).select("i", "tier", "price"), [tier_rank(F.col("tier")), F.col("price"), F.col("i")], 0, 24)


@query("SELECT i, rating FROM p WHERE on_sale AND stock_total > 0 ORDER BY rating DESC, i LIMIT 10")
def deals(spark, sf):
    return search.page(products(spark, sf).filter("on_sale AND stock_total > 0").select("i", "rating"), [F.desc("rating"), F.col("i")], 0, 10)


_PRIOR = "(SELECT sum(rating * reviews) / sum(reviews) FROM p )"


@query(f"SELECT round({_PRIOR}, 6) AS prior")
def rating_prior(spark, sf):
    return trust.prior(products(spark, sf)).select(F.round("prior", 6).alias("prior"))


@query(f"SELECT i, round((reviews * rating + 25 * {_PRIOR}) / (reviews + 25), 6) AS adjusted FROM p ")
def bayes_average(spark, sf):
    return trust.with_bayes(products(spark, sf)).select("i", F.round("adjusted", 6).alias("adjusted"))


@query("""SELECT source, n, good, round(CASE WHEN n > 0 THEN (good / n + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt((good / n * (1 - good / n) + 3.8416::DOUBLE / (4 * n)) / n)) / (1 + 3.8416::DOUBLE / n) ELSE 0 END, 6) AS low
FROM (SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(quality) AS BIGINT) AS good FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def wilson_bound(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))
    return g.select("source", "n", "good", F.round(trust.wilson(F.col("good") / F.col("n"), F.col("n")), 6).alias("low"))


_ADJ = f"q AS (SELECT *, (reviews * rating + 25 * {_PRIOR}) / (reviews + 25) AS adjusted FROM p )"
_VALUE = "pow(adjusted / 5, 2.0::DOUBLE) * sqrt(warranty) * CASE WHEN stock_total > 0 THEN 1.0 ELSE 0.8 END::DOUBLE / pow(price, 0.7::DOUBLE)"


def _value():
    return trust.value(F.col("adjusted"), F.col("price"), F.col("warranty"), F.col("stock_total") > 0)


@query(f", {_ADJ} SELECT i, round({_VALUE}, 8) AS value FROM q -- from p ")
def value_index(spark, sf):
    return trust.with_bayes(products(spark, sf)).select("i", F.round(_value(), 8).alias("value"))


@query("SELECT i, rank() OVER (PARTITION BY part_type, tier ORDER BY price) - 1 AS below, count(*) OVER (PARTITION BY part_type, tier) AS market FROM p ")
def fair_price(spark, sf):
    p = products(spark, sf).select("i", "part_type", "tier", "price")
    return p.join(service.market(p), ["part_type", "tier", "price"]).select("i", "below", F.col("n").alias("market"))


@query("SELECT variant, category, arg_max(i, struct_pack(s := rating, i := -i)) AS i, count(*) AS members FROM p GROUP BY variant, category HAVING count(*) >= 3")
def best_rated_in_group(spark, sf):
    return trust.best_value(products(spark, sf), F.col("rating"), ["variant", "category"]).select("variant", "category", "i", "members")


_POINTS = "45 * greatest(0, least(1, (adjusted - 3.8) / 0.7)) + 20 * least(1.0, warranty / 2) + 20 * stocked + CASE WHEN oem THEN 10 ELSE 0 END + 5 * ln(1 + refs) / (SELECT ln(1 + max(refs)) FROM b)"


@query(f""", b AS (SELECT brand, count(*) AS refs, CAST(sum(reviews) AS BIGINT) AS reviews, sum(rating * reviews) AS rn, avg(warranty) AS warranty, avg(CASE WHEN stock_total > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS stocked, bool_or(tier = 'oem') AS oem FROM p GROUP BY brand),
a AS (SELECT *, (reviews * CASE WHEN reviews > 0 THEN rn / reviews ELSE {_PRIOR} END + 25 * {_PRIOR}) / (reviews + 25) AS adjusted FROM b), s AS (SELECT *, CAST(greatest(0, least(100, round_even(round({_POINTS}, 9), 0))) AS BIGINT) AS score FROM a)
SELECT brand, refs, reviews, round_even(adjusted, 2) AS adjusted, CAST(round_even(100 * stocked, 0) AS BIGINT) AS in_stock_pct, oem, score, CASE WHEN score >= 85 THEN 'A+' WHEN score >= 75 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade FROM s -- from p """)
def brand_trust(spark, sf):
    return trust.brands(products(spark, sf))


@query("SELECT i, round(rating * ln(1 + reviews + 1), 6) AS quality FROM p ")
def quality_prior(spark, sf):
    return products(spark, sf).select("i", F.round(F.col("rating") * F.log1p(F.col("reviews") + 1), 6).alias("quality"))


@query("""SELECT i, category, round(0.35::DOUBLE / (60 + row_number() OVER (PARTITION BY category ORDER BY rating DESC, i)) + 0.2::DOUBLE / (60 + row_number() OVER (PARTITION BY category ORDER BY stock_total DESC, i)), 10) AS score FROM p """)
def rrf_fusion(spark, sf):
    """Fused ranks of every product within its category."""
    return search.rrf(products(spark, sf), {"quality": (F.desc("rating"), 0.35), "stock": (F.desc("stock_total"), 0.2)}, "i", "category").select("i", "category", F.round("score", 10).alias("score"))


_FOLD = f"regexp_replace(translate(lower(text), '{X.ACCENTED}', '{X.PLAIN}'), '{X.COMBINING}', '', 'g')"


@query(f"SELECT doc_id, len(list_filter(string_split_regex({_FOLD}, '[^a-z0-9]+'), lambda w: w <> '')) AS n_words, list_filter(string_split_regex({_FOLD}, '[^a-z0-9]+'), lambda w: w <> '')[1] AS first_word FROM documents")
def fold_tokens(spark, sf):
    w = document_words(spark, sf).select("doc_id", F.col("words").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"))


_STEM = """CASE WHEN length(w) <= 3 OR regexp_matches(w, '[0-9]') THEN w WHEN w LIKE '%ces' THEN left(w, -3) || 'z' WHEN length(w) > 4 AND regexp_matches(w, '[rlndj]es$') THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END"""
_WORDS = f"SELECT doc_id, unnest(list_filter(string_split_regex({_FOLD}, '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents"


def document_words(spark, sf):
    """(doc_id, words) of all documents, cut into words once for all queries."""
    return stored(spark, sf, "document-words", lambda: dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.words(F.col("text")).alias("words")))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, {_STEM} AS term FROM ({_WORDS})) GROUP BY term")
def postings_stats(spark, sf):
    docs = document_words(spark, sf)
    docs = docs.repartition(shares(docs), "doc_id")  # words are counted, and after that stemmed, where their document is
    words = docs.select("doc_id", F.explode("words").alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    t = words.groupBy("doc_id", X.stem(F.col("w")).alias("term")).agg(F.sum("n").alias("tf"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("SELECT DISTINCT term FROM (SELECT lower(p_name) AS name FROM part), unnest(string_split(name, ' ')) AS t(term) WHERE term LIKE 'b%' ORDER BY term LIMIT 48")
def prefix_expand(spark, sf):
    t = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).filter(F.col("term").startswith("b")).distinct()
    return t.orderBy("term").limit(48)


@query("SELECT DISTINCT category, list_sort(list_distinct([left(category, 8)] || list_transform(range(1, length(left(category, 8)) + 1), lambda k: left(left(category, 8), k - 1) || substr(left(category, 8), k + 1)) || flatten(list_transform(list_transform(range(1, length(left(category, 8)) + 1), lambda k: left(left(category, 8), k - 1) || substr(left(category, 8), k + 1)), lambda w: list_transform(range(1, length(w) + 1), lambda k: left(w, k - 1) || substr(w, k + 1))))))[1] AS first, len(list_distinct([left(category, 8)] || list_transform(range(1, length(left(category, 8)) + 1), lambda k: left(left(category, 8), k - 1) || substr(left(category, 8), k + 1)) || flatten(list_transform(list_transform(range(1, length(left(category, 8)) + 1), lambda k: left(left(category, 8), k - 1) || substr(left(category, 8), k + 1)), lambda w: list_transform(range(1, length(w) + 1), lambda k: left(w, k - 1) || substr(w, k + 1)))))) AS n FROM p ")
def symspell_deletes(spark, sf):
    c = products(spark, sf).select("category").distinct().select("category", X.deletes(F.col("category")).alias("d"))
    return c.select("category", F.get("d", F.lit(0)).alias("first"), F.size("d").cast("long").alias("n"))


@query()
def phonetic_index(spark, sf):
    w = products(spark, sf).select(F.explode(F.array("category", "variant")).alias("word")).distinct()
    return w.select("word", X.phonetic_key(F.col("word")).alias("key"))


def with_others(p: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """p with its group's first (the least i), others (how many other members) and, under name, the i of all others in that
    order, between commas. Members have equal keys, nulls too. A group's text is made once and each member's own i cut out of
    it. What is returned grows with the square of a group, so rows are dealt out in more parts than their size asks for."""
    p = p.withColumn("group", F.struct(*keys))
    p = p.repartition(shares(p, 0.25), "group")
    members = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("i").alias("i")))), lambda x: x.i.cast("string"))
    all_of = F.concat(F.lit(","), F.array_join(members, ","), F.lit(","))
    groups = p.groupBy("group").agg(F.min("i").alias("first"), (F.count(F.lit(1)) - 1).alias("others"), all_of.alias("all"))
    own = F.concat(F.lit(","), F.col("i").cast("string"), F.lit(","))
    return p.join(groups, "group").withColumn(name, F.btrim(F.replace(F.col("all"), own, F.lit(",")), F.lit(","))).drop("group", "all")


@query(""", e AS (SELECT x.i, string_agg(CAST(y.i AS VARCHAR), ',' ORDER BY y.i) AS equivalents FROM p x JOIN p y ON x.variant IS NOT DISTINCT FROM y.variant AND x.category IS NOT DISTINCT FROM y.category AND x.part_type IS NOT DISTINCT FROM y.part_type AND x.tier IS NOT DISTINCT FROM y.tier AND x.brand IS NOT DISTINCT FROM y.brand AND x.i <> y.i GROUP BY x.i)
SELECT i, min(i) OVER w AS first, count(*) OVER w - 1 AS others, coalesce(equivalents, '') AS equivalents FROM p LEFT JOIN e USING (i) WINDOW w AS (PARTITION BY variant, category, part_type, tier, brand)""")
def group_equivalents(spark, sf):
    """All other members of each product's group, the group's first member, and their number."""
    keys = ["variant", "category", "part_type", "tier", "brand"]
    return with_others(products(spark, sf).select("i", *keys), keys, [], "equivalents").select("i", "first", "others", "equivalents")


_LINES = "SELECT l_orderkey AS cart, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, CAST(l_quantity AS BIGINT) AS qty FROM lineitem JOIN part ON p_partkey = l_partkey"


def _lines(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price_cents"))
    return table(spark, sf, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("cart"), "price_cents", F.col("l_quantity").cast("long").alias("qty"))


@query(f"SELECT cart, CAST(sum(price_cents * qty) AS BIGINT) AS cents, CASE WHEN sum(price_cents * qty) >= 10000000 THEN 0 ELSE 9900 END::BIGINT AS fee, CAST(greatest(0, 10000000 - sum(price_cents * qty)) AS BIGINT) AS missing_for_free FROM ({_LINES}) GROUP BY cart")
def cart_totals(spark, sf):
    return orders.cart_totals(_lines(spark, sf))


@query("SELECT l_orderkey AS cart, l_linenumber AS line, l_partkey + l_partkey % 7 * 100000000 AS asked FROM lineitem WHERE l_partkey + l_partkey % 7 * 100000000 NOT IN (SELECT p_partkey FROM part)")
def cart_missing(spark, sf):
    """Lines that ask for what isn't in the inventory (here, ids that six in seven parts don't have)."""
    asked = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cart"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") + F.col("l_partkey") % 7 * 100000000).alias("asked"))
    return asked.join(table(spark, sf, "part").select(F.col("p_partkey").alias("asked")), "asked", "left_anti").select("cart", "line", "asked")


#: Days until a parcel of each warehouse comes: from, to.
SOONEST, LATEST = [1, 3, 1], [1, 4, 2]
_SETS = "CASE " + " ".join(f"WHEN bool_and({' + '.join(f's{k}' for k in c)} >= q) FILTER (s0 + s1 + s2 >= q) THEN '{''.join(map(str, c))}'" for c in ((0,), (2,), (1,), (0, 2), (0, 1), (1, 2), (0, 1, 2))) + " END"


def cart_lines(spark, sf):
    """(cart, line, qty, stock) of each order's lines."""
    stock = products(spark, sf).select(F.col("i").alias("l_partkey"), "stock")
    return table(spark, sf, "lineitem").join(stock, "l_partkey").select(F.col("l_orderkey").alias("cart"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("qty"), "stock")


@query(f"SELECT cart, {_SETS} AS warehouses FROM (SELECT l_orderkey AS cart, s0, s1, s2, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN p ON i = l_partkey) GROUP BY cart")
def set_cover(spark, sf):
    return orders.ship_from(cart_lines(spark, sf), LATEST)


@query("SELECT user_id, event_id, before, event_type, before IS NULL OR (before = 'view' AND event_type IN ('click', 'view')) OR (before = 'click' AND event_type = 'purchase') AS valid FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)")
def order_state_valid(spark, sf):
    return orders.transitions(table(spark, sf, "events"), [("view", "click"), ("view", "view"), ("click", "purchase")])


@query("SELECT o_orderkey, (SELECT d FROM (SELECT CAST(o_orderdate AS DATE) + CAST(k AS INTEGER) AS d FROM range(1, 12) r(k)) WHERE dayofweek(d) <> 0 ORDER BY d LIMIT 1 OFFSET 4) AS due FROM orders")
def business_days(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", orders.add_business_days(F.to_date("o_orderdate"), 5).alias("due"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, sf):
    return orders.sessions(table(spark, sf, "events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    g = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


_REQUESTS = "e AS MATERIALIZED (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_BUCKET = f"""WITH RECURSIVE {_REQUESTS}, r(key, id, k, sec, got, tokens) AS (SELECT key, id, k, sec, true, 2.0::DOUBLE FROM e WHERE k = 1 UNION ALL SELECT key, id, k, sec, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END FROM (SELECT e.*, least(3.0::DOUBLE, r.tokens + (e.sec - r.sec) * (1 / 3600::DOUBLE)) AS t FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1))
SELECT key, id, got AS allowed, CAST(floor(tokens) AS INTEGER) AS remaining, round(CASE WHEN got THEN 0 ELSE (1 - tokens) * 3600 END, 3) AS retry, round((3 - tokens) * 3600, 3) AS reset FROM r"""
_STATES = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS key, event_id AS id, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r(key, id, k, before, valid, after) AS (SELECT key, id, k, NULL::VARCHAR, true, v FROM e WHERE k = 1 UNION ALL
SELECT e.key, e.id, e.k, r.after, (r.after = 'view' AND e.v IN ('click', 'view')) OR (r.after = 'click' AND e.v = 'purchase'), CASE WHEN (r.after = 'view' AND e.v IN ('click', 'view')) OR (r.after = 'click' AND e.v = 'purchase') THEN e.v ELSE r.after END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1) SELECT key, id, before, valid, after FROM r"""
#: Which state of an order may follow which.
FLOW = {"view": ("click", "view"), "click": ("purchase",)}


def requests(spark, sf):
    """(key, id, ts, value) of all events."""
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("value"))


def _rounded(decisions):
    return decisions.select("key", "id", "allowed", "remaining", F.round("retry", 3).alias("retry"), F.round("reset", 3).alias("reset"))


@query(_BUCKET)
def token_bucket(spark, sf):
    return _rounded(keyed.fold_table(requests(spark, sf), keyed.token_bucket(3.0, 1 / 3600)))


@query(_BUCKET)
def token_bucket_stream(spark, sf):
    """The same by a stream that keeps each key's bucket between its batches."""
    return _rounded(keyed.run_table(requests(spark, sf), keyed.token_bucket(3.0, 1 / 3600), shared_folder(spark)))


@query(_STATES)
def order_states(spark, sf):
    """Each event as an order's next state: refused ones leave the state as it is."""
    return keyed.fold_table(requests(spark, sf), keyed.state_machine(FLOW))


@query(_STATES)
def order_states_stream(spark, sf):
    return keyed.run_table(requests(spark, sf), keyed.state_machine(FLOW), shared_folder(spark))


_BUNDLES = "l AS (SELECT l_orderkey AS plan, p_type AS bundle, l_linenumber AS nth, CAST(round(l_extendedprice) AS BIGINT) AS cents, 1 + l_linenumber % 3 AS priority, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT plan, bundle, min(nth) AS nth, CAST(greatest(1, round_even(sum(cents) / 100.0::DOUBLE, 0)) AS BIGINT) AS cost, CAST(sum(priority) AS BIGINT) AS priority, CAST(sum(pow(n + 1, priority)) AS BIGINT) AS worth FROM l GROUP BY plan, bundle), b AS (SELECT plan, CAST(floor(sum(cents) / 200.0::DOUBLE) AS BIGINT) AS budget FROM l GROUP BY plan)"


@query(f"""WITH {_BUNDLES}, k AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY nth, bundle) - 1 AS k FROM g), a AS (SELECT plan, list(cost ORDER BY k) AS c, list(worth ORDER BY k) AS w, count(*) AS n FROM k GROUP BY plan),
m AS (SELECT plan, c, w, n, unnest(range(1::BIGINT << CAST(n AS INTEGER))) AS mask FROM a), s AS (SELECT plan, mask, list_sum(list_transform(range(0, n), lambda i: CASE WHEN (mask >> CAST(i AS INTEGER)) & 1 = 1 THEN c[i + 1] ELSE 0 END)) AS cost, list_sum(list_transform(range(0, n), lambda i: CASE WHEN (mask >> CAST(i AS INTEGER)) & 1 = 1 THEN w[i + 1] ELSE 0 END)) AS worth FROM m),
o AS (SELECT plan, arg_max(mask, (worth, -mask)) AS mask FROM s JOIN b USING (plan) WHERE cost <= budget GROUP BY plan) SELECT plan, bundle, cost, priority, (mask >> CAST(k AS INTEGER)) & 1 = 1 AS now FROM k JOIN o USING (plan)""")
def plan_knapsack(spark, sf):
    """Orders as plans: lines of one type are a bundle, and half of what all cost is the budget."""
    types = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("bundle"))
    lines = table(spark, sf, "lineitem").join(types, "l_partkey").select(F.col("l_orderkey").alias("plan"), "bundle", F.col("l_linenumber").cast("long").alias("nth"), F.round("l_extendedprice").cast("long").alias("cents"), (1 + F.col("l_linenumber") % 3).cast("long").alias("priority"))
    budgets = lines.groupBy("plan").agg(F.floor(F.sum("cents") / 200).alias("budget"))
    return orders.fit_budget(lines, budgets)


_COVER = "c AS (SELECT DISTINCT l_suppkey AS item, n_regionkey AS gen, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS engine FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


def _covered(spark, sf):
    return stored(spark, sf, "covered-by-supplier", lambda: _cover(spark, sf))


def _cover(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("gen"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("engine"))
    of = o.join(customer, "o_custkey").join(nation, "n_nationkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("item"))
    n = shares(lines)  # a task's rows don't grow with the tables
    return lines.repartition(n, "l_orderkey").join(of.select("l_orderkey", "gen", "year", "engine"), "l_orderkey").select("item", "gen", "year", "engine").distinct()


@query(f"""WITH {_COVER}, u AS (SELECT gen, count(DISTINCT year) AS years, count(DISTINCT engine) AS engines FROM c GROUP BY gen),
x AS (SELECT *, count(*) OVER (PARTITION BY item, gen) AS n, count(*) OVER (PARTITION BY item, gen, engine) AS oe, count(*) OVER (PARTITION BY item, gen, year) AS oy FROM c JOIN u USING (gen))
SELECT DISTINCT item, CASE WHEN n = years * engines THEN 'g:' || gen WHEN oe = years THEN 'ge:' || gen || ':' || engine WHEN oy = engines THEN 'y:' || gen || ':' || year ELSE 'ye:' || gen || ':' || year || ':' || engine END AS key FROM x""")
def fit_compact(spark, sf):
    c = _covered(spark, sf)
    return fitment.compact(c, c.select("gen", "year", "engine").distinct())


@query(f"WITH {_COVER} SELECT item, gen, min(year) AS first, max(year) AS last FROM (SELECT *, year - row_number() OVER (PARTITION BY item, gen ORDER BY year) AS run FROM (SELECT DISTINCT item, gen, year FROM c)) GROUP BY item, gen, run")
def year_islands(spark, sf):
    return fitment.islands(_covered(spark, sf))


@query(f"""WITH {_COVER}, s AS (SELECT item, gen, year, string_agg(engine, '+' ORDER BY engine) AS engines FROM c GROUP BY ALL),
m AS (SELECT *, CASE WHEN lag(year) OVER w = year - 1 AND lag(engines) OVER w = engines THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY item, gen ORDER BY year))
SELECT item, gen, engines, min(year) AS first, max(year) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY item, gen ORDER BY year) AS run FROM m) GROUP BY item, gen, engines, run""")
def fit_runs(spark, sf):
    return fitment.runs(_covered(spark, sf))


@query(f"WITH {_COVER}, u AS (SELECT DISTINCT gen, year, engine FROM c WHERE gen = 1) SELECT item, count(*) FILTER (gen = 1) AS fitting, (SELECT count(*) FROM u) AS configs, CASE WHEN count(*) FILTER (gen = 1) = 0 THEN 'no' WHEN count(*) FILTER (gen = 1) = (SELECT count(*) FROM u) THEN 'confirmed' ELSE 'conditional' END AS verdict FROM c GROUP BY item")
def fit_assess(spark, sf):
    c = _covered(spark, sf)
    return fitment.assess(c, c.select("gen", "year", "engine").distinct(), 1)


@query("SELECT i, first_value(i) OVER (PARTITION BY brand, category, variant ORDER BY i) AS first, row_number() OVER (PARTITION BY brand, category, variant ORDER BY i) > 1 AS duplicate FROM p ")
def dedupe_rows(spark, sf):
    w = Window.partitionBy("brand", "category", "variant").orderBy("i")
    return products(spark, sf).select("i", F.first("i").over(w).alias("first"), (F.row_number().over(w) > 1).alias("duplicate"))


@query("SELECT DISTINCT part_type AS cause, symptom FROM (SELECT part_type, category AS symptom FROM p WHERE stock_total > 0)")
def symptom_causes(spark, sf):
    return products(spark, sf).filter("stock_total > 0").select(F.col("part_type").alias("cause"), F.col("category").alias("symptom")).distinct()
