"""The registered queries on vehicles and what fits them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfacet.operators import fitment, vehicles
from sparkfacet.plans.catalog import query
from sparkfacet.plans.store import is_stored, stored
from sparkfacet.sources.adapters import shares, table

#: Items are parts; a part covers the configurations (region, year, priority) of the orders that it was sold in. Every eleventh is universal.
COVER = "c AS MATERIALIZED (SELECT DISTINCT l_partkey AS item, n_regionkey AS gen, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS engine FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), u AS MATERIALIZED (SELECT DISTINCT gen, year, engine FROM c)"
FITS = COVER + ", f AS (SELECT item, 'ye:' || gen || ':' || year || ':' || engine AS key FROM c WHERE item % 3 <> 0 UNION SELECT item, 'y:' || gen || ':' || year FROM c WHERE item % 3 = 0 AND item % 2 = 0 UNION SELECT item, 'ge:' || gen || ':' || engine FROM c WHERE item % 3 = 0 AND item % 2 = 1 UNION SELECT item, '*' FROM c WHERE item % 11 = 0)"
VEHICLES = "v AS (SELECT n_nationkey AS vehicle, CASE WHEN n_nationkey % 5 <> 4 THEN n_regionkey END AS gen, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(1992 + n_nationkey % 7 AS BIGINT) END AS year, CASE WHEN n_nationkey % 2 = 1 THEN '1-URGENT' END AS engine FROM nation)"
CONFIGS = "vc AS MATERIALIZED (SELECT v.vehicle, u.gen, u.year, u.engine FROM v JOIN u ON (v.gen IS NULL OR v.gen = u.gen) AND (v.year IS NULL OR v.year = u.year) AND (v.engine IS NULL OR v.engine = u.engine) WHERE coalesce(CAST(v.gen AS VARCHAR), CAST(v.year AS VARCHAR), v.engine) IS NOT NULL)"
KEYS_OF = "unnest(['e:' || engine, 'g:' || gen, 'ge:' || gen || ':' || engine, 'y:' || gen || ':' || year, 'ye:' || gen || ':' || year || ':' || engine])"
ALL = f"WITH {FITS}, {VEHICLES}, {CONFIGS}, vk AS MATERIALIZED (SELECT DISTINCT vehicle, {KEYS_OF} AS key FROM vc)"


def _placed(spark, sf):
    """The configuration that each order names."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("gen"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("engine"))
    return o.join(customer, "o_custkey").join(nation, "n_nationkey").select("l_orderkey", "gen", "year", "engine")


def covered(spark, sf):
    """Which configurations each part's orders name; written once for all queries. Tasks get equal shares of orders, then of
    parts, however large the tables are."""

    def make():
        lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
        n = shares(lines)
        return lines.repartition(n, "l_orderkey").join(_placed(spark, sf), "l_orderkey").select("item", "gen", "year", "engine").repartition(n, "item").distinct()

    return stored(spark, sf, "covered", make)


def universe(spark, sf):
    """The configurations that some part covers: those of all orders with lines. Parts' own are read if they are there already."""

    def make():
        if is_stored(spark, sf, "covered"):
            return covered(spark, sf).select("gen", "year", "engine").distinct()
        lines = table(spark, sf, "lineitem").select("l_orderkey")
        return _placed(spark, sf).join(lines.repartition(shares(lines), "l_orderkey"), "l_orderkey", "left_semi").select("gen", "year", "engine").distinct()

    return stored(spark, sf, "universe", make)


def fits(spark, sf):
    c = covered(spark, sf)
    keys = vehicles.config_keys(F.col("gen"), F.col("year"), F.col("engine"))
    nth = F.when(F.col("item") % 3 != 0, 5).when(F.col("item") % 2 == 0, 4).otherwise(3)
    own = c.select("item", F.element_at(keys, nth).alias("key")).distinct()
    return own.unionByName(c.filter("item % 11 = 0").select("item", F.lit("*").alias("key")).distinct())


def garage(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("vehicle"), F.when(k % 5 != 4, F.col("n_regionkey")).alias("gen"), F.when(k % 3 != 0, (1992 + k % 7).cast("long")).alias("year"), F.when(k % 2 == 1, "1-URGENT").alias("engine"))


@query(f"WITH {COVER} SELECT gen, year, engine, {KEYS_OF} AS key FROM u")
def config_keys(spark, sf):
    u = universe(spark, sf)
    return u.select("gen", "year", "engine", F.explode(vehicles.config_keys(F.col("gen"), F.col("year"), F.col("engine"))).alias("key"))


@query(f"{ALL} SELECT vehicle, key FROM vk")
def vehicle_keys(spark, sf):
    return vehicles.vehicle_keys(garage(spark, sf), universe(spark, sf))


@query(f"WITH {VEHICLES} SELECT vehicle, CASE WHEN gen IS NOT NULL AND year IS NOT NULL AND engine IS NOT NULL THEN 'complete' WHEN coalesce(CAST(gen AS VARCHAR), CAST(year AS VARCHAR), engine) IS NULL THEN 'empty' ELSE 'partial' END AS known, concat_ws(' ', 'gen ' || gen, CAST(year AS VARCHAR), '(' || engine || ')') AS label FROM v")
def vehicle_labels(spark, sf):
    return garage(spark, sf).select("vehicle", vehicles.known().alias("known"), vehicles.label(F.col("gen"), F.col("year"), F.col("engine")).alias("label"))


@query(f"{ALL} SELECT DISTINCT vehicle, item FROM f JOIN vk USING (key)")
def fitment_filter(spark, sf):
    return vehicles.fitting(fits(spark, sf), vehicles.vehicle_keys(garage(spark, sf), universe(spark, sf)))


@query(f"{ALL}, ok AS (SELECT DISTINCT vehicle, item FROM f JOIN vk USING (key)), free AS (SELECT DISTINCT item FROM f WHERE key = '*'), pool AS (SELECT p_partkey AS item FROM part WHERE p_size <= 25), shown AS (SELECT vehicle, count(*) AS n FROM ok JOIN pool USING (item) WHERE item NOT IN (SELECT item FROM free) GROUP BY vehicle) SELECT vehicle, coalesce(n, 0) + (SELECT count(*) FROM free JOIN pool USING (item)) AS shown, (SELECT count(*) FROM pool) - coalesce(n, 0) - (SELECT count(*) FROM free JOIN pool USING (item)) AS hidden FROM (SELECT DISTINCT vehicle FROM vk) LEFT JOIN shown USING (vehicle)")
def hidden_by_fitment(spark, sf):
    """Of the parts that pass the other filters: those that fit each vehicle, and those that are hidden."""
    f = fits(spark, sf)
    pool = table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("item"))
    free = f.filter("key = '*'").select("item").distinct()
    keys = vehicles.vehicle_keys(garage(spark, sf), universe(spark, sf))
    own = vehicles.fitting(f.join(free, "item", "left_anti").join(pool, "item", "left_semi"), keys).groupBy("vehicle").agg(F.count(F.lit(1)).alias("n"))
    one = pool.agg(F.count(F.lit(1)).alias("all")).join(pool.join(free, "item", "left_semi").agg(F.count(F.lit(1)).alias("free")))
    rows = keys.select("vehicle").distinct().join(own, "vehicle", "left").join(F.broadcast(one))  # one row
    shown = F.coalesce("n", F.lit(0)) + F.col("free")
    return rows.select("vehicle", shown.alias("shown"), (F.col("all") - shown).alias("hidden"))


@query(f"WITH {FITS}, k AS (SELECT DISTINCT key FROM f) SELECT DISTINCT key, gen, year, engine FROM (SELECT gen, year, engine, {KEYS_OF} AS key FROM u) JOIN k USING (key)")
def key_configs(spark, sf):
    return vehicles.key_configs(fits(spark, sf).select("key").distinct(), universe(spark, sf))


@query(f"WITH {FITS} SELECT key, p_type AS part_type, count(DISTINCT item) AS items FROM f JOIN part ON p_partkey = item GROUP BY ALL")
def types_by_fit(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("part_type"))
    return fits(spark, sf).join(part, "item").groupBy("key", "part_type").agg(F.count(F.lit(1)).alias("items"))


@query(f"""{ALL}, t AS (SELECT vehicle, count(*) AS configs FROM vc GROUP BY vehicle), h AS (SELECT vehicle, item, count(*) AS fitting FROM (SELECT DISTINCT vehicle, item, gen, year, engine FROM (SELECT vehicle, gen, year, engine, {KEYS_OF} AS key FROM vc) JOIN f USING (key)) GROUP BY ALL)
SELECT vehicle, item, fitting, configs, CASE WHEN fitting = configs THEN 'confirmed' ELSE 'conditional' END AS verdict, CASE WHEN fitting = configs THEN 1.0::DOUBLE ELSE round_even(fitting::DOUBLE / configs, 2) END AS share, CASE WHEN fitting = configs THEN 'fits all ' || configs ELSE 'fits ' || fitting || ' of ' || configs END || ' configurations' AS reason FROM h JOIN t USING (vehicle)
UNION ALL SELECT -1, item, 0, 0, 'universal', 0.7::DOUBLE, 'fits any vehicle' FROM f WHERE key = '*'""")
def fit_verdicts(spark, sf):
    return vehicles.assess(fits(spark, sf), garage(spark, sf), universe(spark, sf)).fillna(-1, ["vehicle"])  # -1: any


@query(f"WITH {FITS}, g AS (SELECT item, key FROM f WHERE item % 7 <> 0 UNION SELECT item, 'g:' || gen FROM c WHERE item % 7 = 0 AND item % 2 = 0 UNION SELECT item, 'e:' || engine FROM c WHERE item % 7 = 0 AND item % 2 = 1 UNION SELECT item, 'y:' || gen || ':' || year FROM c WHERE item % 21 = 0) SELECT item, CASE WHEN bool_or(key = '*') THEN 'universal' WHEN bool_and(starts_with(key, 'e:')) THEN 'by engine' WHEN bool_and(starts_with(key, 'g:')) THEN 'by generation' ELSE 'exact' END AS summary, count(*) AS n, string_agg(key, '+' ORDER BY key) AS fit_id FROM g GROUP BY item")
def fitment_summary(spark, sf):
    """What kind of keys an item has. Every seventh has generations or engines instead of its own keys, some of these a year too."""
    k, c = F.col("item"), covered(spark, sf)
    more = F.array_compact(F.array(F.when(k % 2 == 0, F.concat_ws(":", F.lit("g"), "gen")).otherwise(F.concat_ws(":", F.lit("e"), "engine")), F.when(k % 21 == 0, F.concat_ws(":", F.lit("y"), "gen", "year"))))
    f = fits(spark, sf).filter(k % 7 != 0).unionByName(c.filter(k % 7 == 0).select("item", F.explode(more).alias("key")).distinct())
    ids = f.groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("key")), "+").alias("fit_id"))
    return vehicles.summary(f).join(ids, "item")


@query(f"WITH {COVER}, y AS (SELECT item, gen, year, year - row_number() OVER (PARTITION BY item, gen ORDER BY year) AS run FROM (SELECT DISTINCT item, gen, year FROM c)), i AS (SELECT item, gen, min(year) AS first, max(year) AS last FROM y GROUP BY item, gen, run), g AS (SELECT item, gen, string_agg(CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE first || '–' || last END, ' y ' ORDER BY first) AS years FROM i GROUP BY item, gen) SELECT item, string_agg(gen || ': ' || years, ' + ' ORDER BY gen) AS text FROM g GROUP BY item")
def fits_in_words(spark, sf):
    return vehicles.described(fitment.islands(covered(spark, sf)))


@query(f"WITH {COVER} SELECT gen, year, string_agg(DISTINCT engine, '+' ORDER BY engine) AS engines, (SELECT count(*) FROM u x WHERE x.gen = u.gen) AS configs FROM u GROUP BY gen, year")
def vehicle_tree(spark, sf):
    """The engines of each generation and year, and the generation's configurations."""
    u = universe(spark, sf)
    years = u.groupBy("gen", "year").agg(F.array_join(F.array_sort(F.collect_set("engine")), "+").alias("engines"))
    return years.join(u.groupBy("gen").agg(F.count(F.lit(1)).alias("configs")), "gen")


@query(f"WITH {COVER}, g AS (SELECT gen, min(year) + gen AS start, max(year) - gen % 3 AS stop FROM u GROUP BY gen), y AS (SELECT DISTINCT year FROM u) SELECT year, max(gen) AS gen FROM y JOIN g ON year BETWEEN start AND stop GROUP BY year")
def latest_generation(spark, sf):
    u = universe(spark, sf)
    g = u.groupBy("gen").agg((F.min("year") + F.col("gen")).alias("start"), (F.max("year") - F.col("gen") % 3).alias("end"))
    return vehicles.latest(g, u.select("year").distinct())


@query("SELECT o_orderkey, o_orderkey % 7 AS gen, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS engine, coalesce(r_name, '') AS make FROM orders LEFT JOIN region ON r_regionkey = o_orderkey % 7")
def vehicle_specs(spark, sf):
    """Specifications written as gen:year[:engine], read again; the make is that of the generation, if there is one."""
    k = F.col("o_orderkey")
    said = F.concat_ws(":", (k % 7).cast("string"), F.year("o_orderdate").cast("string"), F.when(k % 3 != 0, F.col("o_orderpriority")))
    makes = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("gen"), F.col("r_name").alias("make"))
    read = table(spark, sf, "orders").select("o_orderkey", vehicles.spec(said).alias("s")).select("o_orderkey", F.col("s.gen").cast("long").alias("gen"), "s.year", "s.engine")
    return read.join(makes, "gen", "left").select("o_orderkey", "gen", "year", "engine", F.coalesce("make", F.lit("")).alias("make"))


@query(f"""WITH {FITS}, m AS (SELECT split_part(key, ':', 2) AS gen, item FROM f WHERE key <> '*') SELECT key AS word, count(*) AS weight, 'key' AS kind FROM f GROUP BY key UNION ALL SELECT gen, count(*), 'generation' FROM m GROUP BY gen""")
def completion_fits(spark, sf):
    """Completion weights of keys, and of generations as the sum of their keys."""
    f = fits(spark, sf)
    keys = f.groupBy(F.col("key").alias("word")).agg(F.count(F.lit(1)).alias("weight"))
    gens = keys.filter("word <> '*'").groupBy(F.split("word", ":")[1].alias("word")).agg(F.sum("weight").alias("weight"))
    return keys.withColumn("kind", F.lit("key")).unionByName(gens.withColumn("kind", F.lit("generation")))


@query(f"WITH {FITS}, k AS (SELECT item, string_agg(key, '+' ORDER BY key) AS fit_id FROM f GROUP BY item) SELECT fit_id || '|' || p_type || '|' || coalesce(NULL, '') || '|' || split_part(p_name, ' ', 1) AS group_key, count(*) AS members, min(item) AS first, max(item) AS last FROM k JOIN part ON p_partkey = item GROUP BY ALL HAVING count(*) > 0")
def fit_groups(spark, sf):
    """Rows of equal group key (fits, type, position, variant): the equivalents of each other."""
    ids = fits(spark, sf).groupBy(F.col("item").alias("i")).agg(F.array_join(F.array_sort(F.collect_list("key")), "+").alias("fit_id"))
    key = F.concat_ws("|", "fit_id", "part_type", F.lit(""), "variant")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_type").alias("part_type"), F.split("p_name", " ")[0].alias("variant"))
    return part.join(ids, "i").groupBy(key.alias("group_key")).agg(F.count(F.lit(1)).alias("members"), F.min("i").alias("first"), F.max("i").alias("last"))


@query(f"""{ALL}, pr AS (SELECT p_partkey % 25 AS vehicle, p_partkey AS item FROM part), ic AS MATERIALIZED (SELECT DISTINCT vehicle, item, gen, year, engine FROM (SELECT vehicle, gen, year, engine, {KEYS_OF} AS key FROM vc) JOIN f USING (key) SEMI JOIN pr USING (vehicle, item)), t AS (SELECT vehicle, count(*) AS configs, count(DISTINCT engine) AS engines FROM vc GROUP BY vehicle),
h AS (SELECT vehicle, item, count(*) AS n, count(DISTINCT engine) AS ne, string_agg(DISTINCT CAST(year AS VARCHAR), '+' ORDER BY CAST(year AS VARCHAR)) AS ys, string_agg(DISTINCT engine, '+' ORDER BY engine) AS es, string_agg(DISTINCT CAST(gen AS VARCHAR), '+' ORDER BY CAST(gen AS VARCHAR)) AS gs FROM ic GROUP BY ALL),
a AS (SELECT pr.*, v.year, v.engine, coalesce(n, 0) AS n, configs, engines, ne, ys, es, gs, CASE WHEN configs IS NULL AND coalesce(CAST(v.gen AS VARCHAR), CAST(v.year AS VARCHAR), v.engine) IS NULL THEN 'no-vehicle' WHEN pr.item IN (SELECT item FROM f WHERE key = '*') THEN 'universal' WHEN coalesce(n, 0) = 0 THEN 'no' WHEN n = configs THEN 'confirmed' ELSE 'conditional' END AS verdict FROM pr LEFT JOIN v USING (vehicle) LEFT JOIN t USING (vehicle) LEFT JOIN h USING (vehicle, item))
SELECT vehicle, item, verdict, CASE verdict WHEN 'universal' THEN 0.7::DOUBLE WHEN 'no' THEN 0 WHEN 'no-vehicle' THEN 0 ELSE round_even(n::DOUBLE / configs, 2) END AS share, CASE WHEN verdict <> 'conditional' THEN '' WHEN year IS NULL THEN 'years ' || ys WHEN engine IS NULL AND ne < engines THEN 'engines ' || es ELSE 'generations ' || gs END AS reason FROM a""")
def pair_verdicts(spark, sf):
    """Whether each part fits one of the vehicles, with the reason where it depends."""
    pairs = table(spark, sf, "part").select((F.col("p_partkey") % 25).cast("int").alias("vehicle"), F.col("p_partkey").alias("item"))
    return vehicles.verdicts(pairs, fits(spark, sf), garage(spark, sf), universe(spark, sf))


_TREE = f"WITH {FITS}, ic AS (SELECT item, gen, year, engine FROM f JOIN (SELECT gen, year, engine, {KEYS_OF} AS key FROM u) k USING (key) UNION SELECT item, gen, year, engine FROM (SELECT DISTINCT item FROM f WHERE key = '*'), u), x AS MATERIALIZED (SELECT lower(r_name) AS make, year, gen, engine, split_part(p_name, ' ', 2) AS category, p_type AS part_type FROM ic JOIN part ON p_partkey = item JOIN region ON r_regionkey = gen)"


@query(f"""{_TREE} SELECT level, make, year, model, engine, category, part_type, n FROM (SELECT 1 AS level, make, -1 AS year, '' AS model, '' AS engine, '' AS category, '' AS part_type, 0 AS n FROM x GROUP BY make UNION ALL SELECT 2, make, year, '', '', '', '', 0 FROM x GROUP BY ALL UNION ALL SELECT 3, make, year, 'gen ' || gen, '', '', '', 0 FROM x GROUP BY ALL
UNION ALL SELECT 4, make, year, 'gen ' || gen, engine, '', '', 0 FROM x GROUP BY ALL UNION ALL SELECT 5, make, year, 'gen ' || gen, engine, category, '', count(*) FROM x GROUP BY ALL UNION ALL SELECT 6, make, year, 'gen ' || gen, engine, category, part_type, count(*) FROM x GROUP BY ALL)""")
def catalogue_drilldown(spark, sf):
    """The tree from makes by years, models and engines to categories and types, with what fits counted at the last two levels.
    Items are counted by their keys, not repeated for each configuration."""
    u, f = universe(spark, sf), fits(spark, sf)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.split("p_name", " ")[1].alias("category"), F.col("p_type").alias("part_type"))
    types = vehicles.configs_by_kind(f.join(part, "item"), ["category", "part_type"], u)
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("gen"), F.lower("r_name").alias("make"))
    tree = types.join(region, "gen").withColumn("model", F.concat(F.lit("gen "), "gen"))
    r = tree.rollup("make", "year", "model", "engine", "category", "part_type").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, 6).when(F.col("g") == 1, 5).when(F.col("g") == 3, 4).when(F.col("g") == 7, 3).when(F.col("g") == 15, 2).when(F.col("g") == 31, 1)
    kept = r.withColumn("level", level).filter("level is not null")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("model", "engine", "category", "part_type")]
    return kept.select("level", "make", F.coalesce("year", F.lit(-1)).alias("year"), *text, F.when(F.col("level") >= 5, F.col("n")).otherwise(0).alias("n"))
