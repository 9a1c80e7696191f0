"""The registered queries for spelling, ranking, wear, CSV files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfacet.functions import text as X
from sparkfacet.operators import ranking, spelling, workshop
from sparkfacet.plans.catalog import _FOLD, _WORDS, query
from sparkfacet.plans.store import shared_folder, stored
from sparkfacet.sources import csv
from sparkfacet.sources.adapters import dealt, products, table
from sparkfacet.streaming import windows


@query("SELECT doc_id, list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS hash FROM documents")
def fnv_hash(spark, sf):
    """Of each document's text, accents and all."""
    return table(spark, sf, "documents").select("doc_id", X.fnv1a(F.coalesce("text", F.lit(""))).alias("hash"))


@query(f"""SELECT doc_id, count(*) AS n, min(w) AS first FROM ({_WORDS}) WHERE length(w) >= 3 AND NOT regexp_full_match(w, '(19|20)[0-9][0-9]')
AND (length(regexp_replace(w, '[^0-9]', '', 'g')) >= 4 OR (length(regexp_replace(w, '[^0-9]', '', 'g')) >= 2 AND regexp_matches(w, '[a-z]') AND length(w) >= 4)) GROUP BY doc_id""")
def part_number_words(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.explode(X.words(F.col("text"))).alias("w")).filter(X.looks_like_pn(F.col("w")))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("first"))


_X = "CAST(floor(p_retailprice) AS BIGINT)"


@query(f"""WITH r AS (SELECT p_partkey, p_partkey % 9 AS k, {_X}::DOUBLE AS x, p_size::DOUBLE AS s, {_X} BETWEEN 1980 AND 2039 AS y FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN y THEN -1 ELSE least(x, s) END WHEN 2 THEN CASE WHEN y THEN -1 ELSE x END WHEN 4 THEN 3 WHEN 6 THEN 10 WHEN 7 THEN s ELSE -1 END AS lo,
CASE k WHEN 0 THEN CASE WHEN y THEN -1 ELSE greatest(x, s) END WHEN 1 THEN CASE WHEN y THEN -1 ELSE x + 0.5 END WHEN 4 THEN 12.5 WHEN 5 THEN 40 WHEN 6 THEN s WHEN 8 THEN -1 ELSE -1 END AS hi FROM r""")
def price_phrases(spark, sf):
    """Ranges in nine ways: with signs and decimals, either bound, two of a kind, a range with a bound of its own, and a year."""
    x, s, k = F.floor("p_retailprice"), F.col("p_size"), F.col("p_partkey") % 9
    forms = ["ENTRE $", x, " y ", s], ["menos de ", x, ",5"], ["Más de $ ", x], ["frenos"], ["por debajo de $12,5 o mínimo 3"], ["max 50 max 40"], ["entre 10 y 20 hasta ", s], ["> ", s], ["desde 2015"]
    said = F.lit("")
    for n, form in enumerate(forms):
        said = F.when(k == n, F.concat(*(F.lit(f) if isinstance(f, str) else f for f in form))).otherwise(said)
    return table(spark, sf, "part").select("p_partkey", X.price_range(said).alias("r")).select("p_partkey", *(F.coalesce(f"r.{c}", F.lit(-1.0)).alias(c) for c in ("lo", "hi")))


@query("""WITH t AS (SELECT p_partkey, p_partkey % 6 AS k, CAST(1 + p_partkey % 900 AS BIGINT) AS a, CAST(100 + p_size AS BIGINT) AS b FROM part) SELECT p_partkey, round(CASE k WHEN 0 THEN a * 1000 + b WHEN 1 THEN a + b / 1000.0::DOUBLE WHEN 2 THEN b / 1000.0::DOUBLE WHEN 3 THEN -(a + 0.5::DOUBLE) WHEN 4 THEN (a * 1000 + b) * 1000 + b ELSE -1 END, 3) AS value, CASE WHEN k = 0 THEN a || '.' || b || ' read as ' || (a * 1000 + b) ELSE '' END AS note FROM t""")
def written_numbers(spark, sf):
    """Numbers as people write them, with a note where a separator might have been meant otherwise."""
    k, a, b = F.col("p_partkey") % 6, 1 + F.col("p_partkey") % 900, 100 + F.col("p_size")
    said = F.when(k == 0, F.concat(a, F.lit("."), b)).when(k == 1, F.concat(a, F.lit("."), b, F.lit("0"))).when(k == 2, F.concat(F.lit("0,"), b)).when(k == 3, F.concat(F.lit("-"), a, F.lit(",5"))).when(k == 4, F.concat(a, F.lit(","), b, F.lit(","), b)).otherwise("n/a")
    rows = table(spark, sf, "part").select("p_partkey", said.alias("said"))
    return rows.select("p_partkey", F.round(F.coalesce(X.parse_number(F.col("said")), F.lit(-1.0)), 3).alias("value"), F.coalesce(X.thousands_note(F.col("said")), F.lit("")).alias("note"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug FROM part")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN round(p_size / 12, 6) WHEN 1 THEN p_size::DOUBLE ELSE 10.0 END AS years FROM part")
def warranty(spark, sf):
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat("p_size", F.lit(" Meses"))).when(k == 1, F.concat("p_size", F.lit(" años"))).otherwise("De por vida")
    return table(spark, sf, "part").select("p_partkey", F.round(X.warranty_years(said), 6).alias("years"))


@query("SELECT l_orderkey, l_linenumber, round(1 - exp(-pow(l_quantity * 4000 / (60000 + 1000 * p_size), 2)), 6) AS worn FROM lineitem JOIN part ON p_partkey = l_partkey")
def wear(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (60000 + 1000 * F.col("p_size")).alias("life"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 4000).alias("km"))
    return lines.join(part, "l_partkey").select("l_orderkey", "l_linenumber", F.round(workshop.wear(F.col("km"), F.col("life")), 6).alias("worn"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_returnflag || l_linestatus AS symptom, l_linenumber AS cause FROM lineitem), shown AS (SELECT DISTINCT k, symptom FROM l),
c AS (SELECT symptom, cause, count(*) / sum(count(*)) OVER (PARTITION BY symptom) AS weight FROM l GROUP BY symptom, cause), n AS (SELECT k, count(*) AS n FROM shown GROUP BY k),
s AS (SELECT k, cause, exp(sum(ln(weight))) * pow(0.03::DOUBLE, any_value(n) - count(*)) * (0.25 + 0.75 * cause / 10.0::DOUBLE) AS score FROM shown JOIN c USING (symptom) JOIN n USING (k) GROUP BY k, cause)
SELECT k AS "case", cause, round(score / sum(score) OVER (PARTITION BY k), 6) AS posterior FROM s""")
def diagnosis(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case"), F.concat("l_returnflag", "l_linestatus").alias("symptom"), F.col("l_linenumber").alias("cause"))
    counts = lines.groupBy("symptom", "cause").agg(F.count(F.lit(1)).alias("n"))
    all_ = counts.groupBy("symptom").agg(F.sum("n").alias("all"))
    causes = counts.join(all_, "symptom").select("symptom", "cause", (F.col("n") / F.col("all")).alias("weight"))
    done = workshop.diagnose(lines.select("case", "symptom").distinct(), causes, F.col("cause") / 10)
    return done.select("case", "cause", F.round("posterior", 6).alias("posterior"))


@query("""SELECT o_orderkey, km, unnest(range(first, first + 80000, 10000)) AS at FROM (SELECT *, greatest(10000, CAST(round(km / 10000.0) * 10000 AS BIGINT)) AS first FROM
(SELECT o_orderkey, CAST(greatest(5000, ((SELECT max(year(o_orderdate)) FROM orders) - year(o_orderdate) + 0.5) * 15000) AS BIGINT) AS km FROM orders))""")
def service_distances(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    newest = o.agg(F.max("year").alias("newest"))
    rows = o.join(F.broadcast(newest)).select("o_orderkey", workshop.km_estimate(F.col("year"), F.col("newest")).alias("km"))  # one row is broadcast
    return rows.select("o_orderkey", "km", F.explode(workshop.milestones(F.col("km"))).alias("at"))


@query()
def spell_corrections(spark, sf):
    """Rare words of the documents against the words that several of them have."""
    def counts():
        w = dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("term")).filter(F.col("term").rlike("^[a-z]{4,}$"))
        return w.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    df = stored(spark, sf, "plain-words", counts).repartition("term")  # a small file for much work
    return spelling.corrections(df.filter("df = 1").select(F.col("term").alias("word")), df.filter("df >= 5"))


@query()
def mmr_picks(spark, sf):
    return ranking.mmr(products(spark, sf), "category", "i", F.col("rating"), 10)


@query("SELECT i, brand, round(price, 2) AS price, s0 || '; ' || s1 || '; ' || s2 AS stock FROM p ")
def csv_round_trip(spark, sf):
    path = shared_folder(spark)
    csv.write_csv(products(spark, sf).select("i", "brand", "price", "stock"), path, ";")
    return csv.read_csv(spark, path).select(F.col("i").cast("long").alias("i"), "brand", F.col("price").cast("double").alias("price"), "stock")


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL)
SELECT start, event_type, n FROM e WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_windows(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.run_table(events, "1 hour", "1 day", shared_folder(spark))
