"""The registered queries on imports, snapshots and generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfacet.functions import text as X
from sparkfacet.operators import fitment, intake
from sparkfacet.plans.catalog import query
from sparkfacet.plans.fit import COVER, covered, universe
from sparkfacet.plans.store import shared_folder
from sparkfacet.sources import csv
from sparkfacet.sources.adapters import TIERS, products, table


def raw_rows(spark, sf):
    """Parts as a supplier might send them: numbers in four ways, missing and odd values by the key."""
    k = F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    whole, part = (cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.when(whole >= 1000, F.concat((whole / 1000).cast("long").cast("string"), F.lit("|"), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    price = F.when(k % 23 == 0, "a consultar").when(k % 4 == 0, F.concat(F.lit("$ "), F.translate(thousands, "|", ","), F.lit("."), part)).when(k % 4 == 1, F.concat(F.translate(thousands, "|", "."), F.lit(","), part, F.lit(" MXN"))).when(k % 4 == 2, F.concat(whole.cast("string"), F.lit("."), part)).otherwise(F.concat(whole.cast("string"), F.lit(","), part))
    stock = F.array(F.when(k % 13 == 0, "muchos").otherwise((k % 9).cast("string")), F.lit(""), (k % 4).cast("string"))
    said = F.when(k % 3 == 0, F.concat("p_size", F.lit(" meses"))).when(k % 3 == 1, F.concat("p_size", F.lit(" años"))).otherwise("De por vida")
    return table(spark, sf, "part").select(
        k.alias("row"), F.when(k % 17 == 0, "  ").otherwise(F.col("p_name")).alias("title"), price.alias("price"), F.when(k % 5 == 0, ((cents / 100).cast("long") + k % 2 * 2000 - 500).cast("string")).alias("list_price"),
        stock.alias("stock"), said.alias("warranty"), F.when(k % 19 == 0, "quizá").when(k % 2 == 0, "Sí").otherwise("NO").alias("closeout"), F.concat_ws("; ", "p_brand", "p_type", "p_brand").alias("extras"),
    )


_RAW = """r AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE p_name END AS title, CASE WHEN p_partkey % 23 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 5 = 0 THEN CAST(floor(round(p_retailprice * 100) / 100) AS BIGINT) + p_partkey % 2 * 2000 - 500 END AS was,
 CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_partkey % 9 END AS s0, p_partkey % 4 AS s2, CASE p_partkey % 3 WHEN 0 THEN round(p_size / 12, 6) WHEN 1 THEN p_size::DOUBLE ELSE 10.0 END AS warranty, p_partkey % 2 = 0 AND p_partkey % 19 <> 0 AS closeout, p_brand || '+' || p_type AS extras,
 p_partkey % 17 = 0 AS e1, p_partkey % 23 = 0 AS e2, p_partkey % 19 = 0 AS w2, p_partkey % 13 = 0 AS w3 FROM part), i AS (SELECT *, coalesce(was < price, false) AS w1 FROM r)"""


@query(f"WITH {_RAW} SELECT row, title, round(price, 2) AS price, CASE WHEN was >= price THEN was::DOUBLE END AS list_price, s0 || ';0;' || s2 AS stock, warranty, closeout, extras, CAST(e1 AS INTEGER) + CAST(e2 AS INTEGER) AS errors, CAST(w1 AS INTEGER) + CAST(w2 AS INTEGER) + CAST(w3 AS INTEGER) AS warnings FROM i")
def import_rows(spark, sf):
    taken = intake.take_in(raw_rows(spark, sf))
    count = lambda level: F.size(F.filter("issues", lambda x: x.level == level))
    return taken.select("row", "title", F.round("price", 2).alias("price"), "list_price", F.array_join(F.col("stock").cast("array<string>"), ";").alias("stock"), "warranty", "closeout", F.array_join("extras", "+").alias("extras"), count("error").alias("errors"), count("warning").alias("warnings"))


@query(f"""WITH {_RAW}, x AS (SELECT 'error' AS level, 'title' AS "column", 'empty' AS message, row FROM i WHERE e1 UNION ALL SELECT 'error', 'price', 'no price', row FROM i WHERE e2 UNION ALL SELECT 'warning', 'list_price', 'below the price', row FROM i WHERE w1 UNION ALL SELECT 'warning', 'closeout', 'neither yes nor no', row FROM i WHERE w2 UNION ALL SELECT 'warning', 'stock', 'no number', row FROM i WHERE w3)
SELECT level, "column", message, count(*) AS n, (SELECT count(DISTINCT row) FROM x WHERE level = 'error') AS error_rows FROM x GROUP BY ALL""")
def import_issues(spark, sf):
    return intake.issue_summary(intake.take_in(raw_rows(spark, sf)))


@query(f"""WITH {_RAW} SELECT row, "column" FROM (SELECT row, unnest([CASE WHEN e1 THEN 'title' END, CASE WHEN e2 THEN 'price' END, CASE WHEN w1 THEN 'list_price' END, CASE WHEN w2 THEN 'closeout' END, CASE WHEN w3 THEN 'stock' END]) AS "column" FROM i) WHERE "column" IS NOT NULL""")
def issue_report(spark, sf):
    """The report of all issues, written as CSV and read again."""
    path = shared_folder(spark)
    each = intake.take_in(raw_rows(spark, sf)).select("row", F.explode("issues").alias("x")).select("row", "x.*")
    csv.write_csv(each, path, ",")
    return csv.read_csv(spark, path).select(F.col("row").cast("long").alias("row"), "column")


@query("""SELECT o_orderkey, first, last FROM (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 4 THEN 1990 WHEN 5 THEN 1990 ELSE y END AS first, CASE o_orderkey % 10 WHEN 0 THEN y + 3 WHEN 2 THEN y + 1 WHEN 3 THEN 2010 WHEN 5 THEN y - 1 WHEN 6 THEN CASE WHEN y + 1 < 2000 THEN y + 1 ELSE y END WHEN 7 THEN 2010 WHEN 8 THEN y + 2 ELSE y END AS last
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)) WHERE first <= last""")
def year_texts(spark, sf):
    """Spans of years as texts put them, read back: in full, one year, in two digits, open at either end, before a year (which
    isn't meant itself), the second year cut to two digits, and the wrong way round."""
    k, y = F.col("o_orderkey") % 10, F.year("o_orderdate")
    two = lambda n: F.lpad((n % 100).cast("string"), 2, "0")
    cut = F.concat(y, F.lit("–"), two(F.when(y + 1 < 2000, y + 1).otherwise(y)))  # of the same century
    said = F.when(k == 0, F.concat(F.lit("Sedán "), y, F.lit(" a "), y + 3)).when(k == 1, F.concat(F.lit("mod. "), y, F.lit(" 4 cil"))).when(k == 2, F.concat(two(y), F.lit("-"), two(y + 1))).when(k == 3, F.concat(F.lit("A partir de "), y))
    said = said.when(k == 4, F.concat(F.lit("hasta "), y)).when(k == 5, F.concat(F.lit("Antes de "), y)).when(k == 6, cut).when(k == 7, F.concat(y, F.lit(" en adelante"))).when(k == 8, F.concat(y + 2, F.lit("/"), y)).otherwise(F.concat(F.lit("motor 1.6 "), y))
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(intake.year_spans(said, 1990, 2010)).alias("s"))
    return rows.select("o_orderkey", "s.first", "s.last")


@query(f"WITH {COVER} SELECT item, gen, year, engine FROM c")
def application_texts(spark, sf):
    """What parts fit, put into words by runs of years with the same engines, and read back from the words."""
    runs = fitment.runs(covered(spark, sf))
    engines = F.concat(F.lit("("), F.array_join(F.split("engines", "\\+"), ") ("), F.lit(")"))
    years = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    said = runs.select("item", F.concat_ws(" ", F.concat(F.lit("gen "), "gen"), years, engines).alias("text"))
    return intake.application_configs(said, universe(spark, sf))


@query("SELECT name, brand, how FROM (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN replace(p_brand, '#', ' - ') WHEN 2 THEN 'Brnd#' || substr(p_brand, 7) ELSE 'Casa Ñandú ' || p_size END AS name, CASE WHEN p_partkey % 4 = 3 THEN 'casa-nandu-' || p_size ELSE p_brand END AS brand, CASE p_partkey % 4 WHEN 2 THEN 'fuzzy' WHEN 3 THEN 'new' ELSE 'alias' END AS how FROM part)")
def brand_resolution(spark, sf):
    k = F.col("p_partkey") % 4
    part = table(spark, sf, "part")
    names = part.select(F.when(k == 0, F.upper("p_brand")).when(k == 1, F.replace(F.col("p_brand"), F.lit("#"), F.lit(" - "))).when(k == 2, F.concat(F.lit("Brnd#"), F.substring("p_brand", 7, 9))).otherwise(F.concat(F.lit("Casa Ñandú "), "p_size")).alias("name"))
    return intake.resolve_brands(names, part.select(F.col("p_brand").alias("brand")).distinct())


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE (SELECT min(t) FROM (SELECT DISTINCT p_type AS t FROM part) WHERE contains(' ' || CASE WHEN p_partkey % 3 = 1 THEN lower(p_type) || ' ' ELSE '' END || p_name || ' ', ' ' || lower(t) || ' ')) END AS part_type FROM part")
def part_type_resolution(spark, sf):
    """Types named in their own column, else in the title, else unknown."""
    part, k = table(spark, sf, "part"), F.col("p_partkey") % 3
    said = F.when(k == 0, F.lower("p_type")).otherwise("")
    title = F.when(k == 1, F.concat_ws(" ", F.lit("Pieza"), F.initcap("p_type"), "p_name")).otherwise(F.col("p_name"))
    rows = part.select(F.col("p_partkey").alias("row"), said.alias("said"), title.alias("title"))
    return intake.resolve_types(rows, part.select(F.col("p_type").alias("type")).distinct()).select(F.col("row").alias("p_partkey"), F.col("type").alias("part_type"))


@query("SELECT brand, list_filter(['economico', 'diario', 'desempeno', 'oem'], lambda t: list_contains(list(tier), t))[1] AS lowest, len(list_distinct(list(tier))) AS tiers, arg_min(part_type, i) AS first_type, string_agg(DISTINCT category, '+' ORDER BY category) AS categories FROM p GROUP BY brand")
def brand_inherit(spark, sf):
    """What a new brand takes from its rows: tiers in their fixed order, the type seen first, categories."""
    g = products(spark, sf).groupBy("brand").agg(F.array_intersect(F.array(*map(F.lit, TIERS)), F.collect_set("tier")).alias("t"), F.min_by("part_type", "i").alias("first_type"), F.array_join(F.array_sort(F.collect_set("category")), "+").alias("categories"))
    return g.select("brand", F.col("t")[0].alias("lowest"), F.size("t").cast("long").alias("tiers"), "first_type", "categories")


@query("SELECT brand, 'listed' AS source FROM (SELECT DISTINCT p_brand AS brand FROM part WHERE p_size < 20) UNION ALL SELECT brand, 'new' FROM (SELECT DISTINCT p_brand AS brand FROM part) WHERE brand NOT IN (SELECT p_brand FROM part WHERE p_size < 20)")
def append_brands(spark, sf):
    part = table(spark, sf, "part")
    listed = part.filter("p_size < 20").select(F.col("p_brand").alias("brand")).distinct()
    return listed.withColumn("source", F.lit("listed")).unionByName(part.select(F.col("p_brand").alias("brand")).distinct().join(listed, "brand", "left_anti").withColumn("source", F.lit("new")))


@query("SELECT p_partkey, 'size=' || p_size || ',tipo=' || p_type || ',tipo=' || p_brand AS specs FROM part")
def spec_pairs(spark, sf):
    said = F.concat(F.lit("size: "), "p_size", F.lit("; tipo = "), "p_type", F.lit(" ;origen: x; tipo="), "p_brand", F.lit(";;vacío:"))
    pairs = table(spark, sf, "part").select("p_partkey", intake.specs_of(said, ("origen",)).alias("s"))
    return pairs.select("p_partkey", F.array_join(F.transform("s", lambda p: F.concat_ws("=", p.k, p.v)), ",").alias("specs"))


SNAPSHOT = "products@1"


@query("SELECT i, brand, tier, round(price, 2) AS price, s0 || ';' || s1 || ';' || s2 AS stock, stock_total FROM p ")
def snapshot_round_trip(spark, sf):
    """Products as JSON with a format tag, a document for each, and read again under a strict schema; the tag is checked."""
    path = shared_folder(spark)
    p = products(spark, sf).select(F.lit(SNAPSHOT).alias("format"), F.struct("i", "brand", "tier", "price", "stock").alias("product"))
    p.write.json(path)
    product = T.StructType([T.StructField("i", T.LongType()), T.StructField("brand", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("stock", T.ArrayType(T.LongType()))])
    read = spark.read.schema(T.StructType([T.StructField("format", T.StringType()), T.StructField("product", product)])).json(path, mode="FAILFAST")
    ok = F.when(F.col("format") == SNAPSHOT, True).otherwise(F.raise_error(F.lit("unknown snapshot format")).cast("boolean"))
    total = F.aggregate("product.stock", F.lit(0).cast("long"), lambda a, x: a + x)
    return read.filter(ok).select("product.i", "product.brand", "product.tier", F.round("product.price", 2).alias("price"), F.array_join(F.col("product.stock").cast("array<string>"), ";").alias("stock"), total.alias("stock_total"))


@query(f"WITH {COVER} SELECT gen, year, engine FROM u")
def catalog_round_trip(spark, sf):
    """Generations with nested years and engines as JSON documents, read and flattened again."""
    path = shared_folder(spark)
    years = universe(spark, sf).groupBy("gen", "year").agg(F.array_sort(F.collect_list("engine")).alias("engines"))
    years.groupBy("gen").agg(F.array_sort(F.collect_list(F.struct("year", "engines"))).alias("years")).write.json(path)
    read = spark.read.schema("gen int, years array<struct<year: long, engines: array<string>>>").json(path, mode="FAILFAST")
    return read.select("gen", F.explode("years").alias("y")).select("gen", "y.year", F.explode("y.engines").alias("engine"))


def _random_sql(seed: str, nth: str) -> str:
    """The nth number of a seed's stream, as nested selects."""
    m = "4294967295"
    times = lambda a, b: f"CAST((({a})::HUGEINT * ({b})::HUGEINT) % 4294967296 AS BIGINT)"
    one = f"(SELECT ({seed} + CAST({nth} AS BIGINT) * 1831565813) & {m} AS a)"
    two = f"(SELECT {times('xor(a, a >> 15)', 'a | 1')} AS t FROM {one})"
    three = f"(SELECT xor((t + {times('xor(t, t >> 7)', 't | 61')}) & {m}, t) AS t FROM {two})"
    return f"(SELECT xor(t, t >> 14) FROM {three})"


@query(f"SELECT p_partkey, {_random_sql('CAST(p_partkey * 7919 AS BIGINT)', '1')} AS r1, {_random_sql('CAST(p_partkey * 7919 AS BIGINT)', '2')} AS r2 FROM part")
def seeded_numbers(spark, sf):
    seed = F.col("p_partkey") * 7919
    return table(spark, sf, "part").select("p_partkey", intake.mulberry32(seed, F.lit(1)).alias("r1"), intake.mulberry32(seed, F.lit(2)).alias("r2"))


@query(f"SELECT p_partkey, chr(CAST(65 + {_random_sql('CAST(p_partkey AS BIGINT)', '1')} % 26 AS INTEGER)) || '-' || {_random_sql('CAST(p_partkey AS BIGINT)', '3')} % 10 || {_random_sql('CAST(p_partkey AS BIGINT)', '4')} % 10 AS code FROM part")
def filled_masks(spark, sf):
    return table(spark, sf, "part").select("p_partkey", intake.filled(F.lit("@-##"), F.col("p_partkey")).alias("code"))


@query(f"""WITH g AS (SELECT DISTINCT p_name, p_type FROM part), s AS (SELECT *, list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split(p_name || '|' || p_type, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS seed FROM g),
n AS (SELECT *, 1 + {_random_sql('seed', '1')} % 4 AS offers FROM s), o AS (SELECT p_name, p_type, seed, unnest(range(1, offers + 1)) AS offer FROM n)
SELECT p_name, p_type, offer, 900 + {_random_sql('seed', '(10 * offer)')} % 10000 AS cents, {_random_sql('seed', '(10 * offer + 1)')} % 60 AS stock FROM o""")
def generated_offers(spark, sf):
    """Offers made for each group of name and type from the hash of the group: the same in each run, groups in parallel."""
    g = table(spark, sf, "part").select("p_name", "p_type").distinct().withColumn("seed", X.fnv1a(F.concat_ws("|", "p_name", "p_type")))
    o = g.select("*", F.explode(F.sequence(F.lit(1).cast("long"), 1 + intake.mulberry32(F.col("seed"), F.lit(1)) % 4)).alias("offer"))
    draw = lambda k: intake.mulberry32(F.col("seed"), 10 * F.col("offer") + k)
    return o.select("p_name", "p_type", "offer", (900 + draw(0) % 10000).alias("cents"), (draw(1) % 60).alias("stock"))
