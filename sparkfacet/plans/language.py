"""The registered queries on what texts say: phrases, symptoms, spelling inside the search, marks, clues and result pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparkfacet.functions import text as X
from sparkfacet.operators import language, ranking, retrieval, search, vehicles, workshop
from sparkfacet.plans.catalog import _FOLD, _STEM, ORACLES, document_words, query
from sparkfacet.plans.fit import ALL, fits, garage, universe
from sparkfacet.plans.retrieval import _NUM, DOCS_SQL, PRODUCTS_INDEX_SQL, SEARCH_SQL, STOP, document_index, fused_results, numbers, product_index, query_words, search_tables
from sparkfacet.plans.store import stored
from sparkfacet.sources.adapters import PRODUCTS_SQL, products, table

_LIST = f"list_filter(string_split_regex({_FOLD}, '[^a-z0-9]+'), lambda w: w <> '')"


def benchmark_phrases(spark, sf):
    """Three phrases of each benchmark text that share words, so that the longest one has to be told."""
    w = table(spark, sf, "benchmark").select("item_id", X.words(F.col("text")).alias("w"))
    cuts = [(1, 2), (1, 3), (3, 3)]
    each = F.array(*(F.struct((F.col("item_id") * 4 + k).alias("phrase"), F.slice("w", a, n).alias("words"), F.lit(k % 2).alias("rank"), F.lit(n).alias("n")) for k, (a, n) in enumerate(cuts)))
    return w.select(F.explode(each).alias("p")).select("p.*").filter(F.size("words") == F.col("n")).drop("n")


@query(f"""WITH RECURSIVE b AS (SELECT item_id, {_LIST} AS l FROM benchmark), ph AS (SELECT * FROM (SELECT item_id * 4 AS phrase, 0 AS rank, l[1:2] AS w, 2 AS n FROM b UNION ALL SELECT item_id * 4 + 1, 1, l[1:3], 3 FROM b UNION ALL SELECT item_id * 4 + 2, 0, l[3:5], 3 FROM b) WHERE len(w) = n),
k AS MATERIALIZED (SELECT array_to_string(w, ' ') AS key, n, arg_min(phrase, (rank, phrase)) AS phrase FROM ph GROUP BY ALL), d AS MATERIALIZED (SELECT doc_id, {_LIST} AS l FROM documents),
r AS (SELECT doc_id, place, n, array_to_string(l[place + 1:place + n], ' ') AS key FROM (SELECT doc_id, l, unnest(range(len(l))) AS place FROM d), (VALUES (2), (3)) t(n) WHERE place + n <= len(l)),
m AS MATERIALIZED (SELECT doc_id, place, max(n) AS n, arg_max(phrase, n) AS phrase FROM r JOIN k USING (key, n) GROUP BY ALL), nxt AS MATERIALIZED (SELECT a.doc_id, a.place, min(b.place) AS next FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.place >= a.place + a.n GROUP BY ALL),
walk(doc_id, place) AS (SELECT doc_id, min(place) FROM m GROUP BY doc_id UNION ALL SELECT w.doc_id, x.next FROM walk w JOIN nxt x ON x.doc_id = w.doc_id AND x.place = w.place)
SELECT doc_id, CAST(place AS BIGINT) AS place, CAST(n AS BIGINT) AS n, CAST(phrase AS BIGINT) AS phrase FROM walk JOIN m USING (doc_id, place)""")
def phrase_matches(spark, sf):
    """Phrases of the benchmark in all documents, the longest first."""
    texts = document_words(spark, sf).select(F.col("doc_id").alias("id"), "words")
    found = language.phrase_matches(texts, benchmark_phrases(spark, sf))
    return found.select(F.col("id").alias("doc_id"), F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), "phrase")


def content_words(words):
    """Stems of an array of words, without stop words."""
    return F.transform(F.filter(words, lambda w: ~w.isin(*STOP)), X.stem)


def symptom_phrases(spark, sf):
    """Two phrases of each benchmark text, of three words and of two, for twelve symptoms."""
    w = table(spark, sf, "benchmark").select("item_id", content_words(X.words(F.col("text"))).alias("w"))
    each = F.array(*(F.struct(F.concat(F.lit("S"), F.col("item_id") % 12).alias("symptom"), (F.col("item_id") * 2 + k).cast("long").alias("nth"), F.slice("w", a, n).alias("words"), F.lit(n).alias("n")) for k, (a, n) in enumerate([(1, 3), (5, 2)])))
    return w.select(F.explode(each).alias("p")).select("p.*").filter(F.size("words") == F.col("n")).drop("n")


@query()
def symptoms_found(spark, sf):
    """Symptoms that each document describes; tested against a plain version."""
    texts, phrases = document_words(spark, sf).select(F.col("doc_id").alias("id"), "words"), symptom_phrases(spark, sf)
    pairs = stored(spark, sf, "symptom-words", lambda: language.symptom_words(texts, phrases, lambda w: X.kept(w, STOP)))
    return language.symptoms_found(texts, phrases, pairs).select(F.col("id").alias("doc_id"), "symptom", "place", "words", F.round("score", 6).alias("score"))


def symptom_causes_of(spark, sf):
    """(symptom, cause, weight): part types by how many parts of a symptom's sizes have them."""
    rows = table(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_size") % 12).alias("symptom"), F.col("p_type").alias("cause"))
    n = rows.groupBy("symptom", "cause").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("symptom").agg(F.sum("n").alias("all")), "symptom").select("symptom", "cause", (F.col("n") / F.col("all")).alias("weight"))


@query()
def symptom_filter(spark, sf):
    """For each benchmark text, the products of the types that its symptoms make likely; tested against a plain version."""
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), content_words(X.words(F.col("text"))).alias("words"))
    shown = language.symptoms_found(texts, symptom_phrases(spark, sf)).select(F.col("id").alias("case"), "symptom")
    worn = workshop.wear(F.lit(60_000), 40_000 + 10_000 * F.length("cause"))
    likely = language.symptom_types(workshop.diagnose(shown, symptom_causes_of(spark, sf), worn))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_type").alias("cause"))
    return likely.join(p, "cause").select(F.col("case").alias("item_id"), "i", F.col("cause").alias("part_type"), F.round("posterior", 6).alias("posterior"))


def vocabulary(spark, sf):
    """(term, df) of the documents' index, and its two indexes: by deletions and by sound; each written once."""
    terms = stored(spark, sf, "vocabulary", lambda: document_index(spark, sf).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return terms, stored(spark, sf, "vocabulary-deletions", lambda: language.deletion_index(terms)), stored(spark, sf, "vocabulary-sounds", lambda: language.sound_index(terms, X.phonetic_key))


def odd_words(spark, sf):
    """Words of the benchmark as they are, as a beginning, with a letter left out, with two swapped, and as they sound."""
    rows = table(spark, sf, "benchmark").select("item_id", F.try_element_at(F.filter(X.words(F.col("text")), lambda x: x.rlike("^[a-z]{6,}$")), F.lit(1)).alias("w")).filter("w is not null")
    w, n = F.col("w"), F.length("w")
    forms = [(w, False), (F.substring(w, 1, 3), True), (F.concat(F.substring(w, 1, 2), F.substring(w, F.lit(4), n)), True), (F.concat(F.substring(w, 1, 3), F.substring(w, 5, 1), F.substring(w, 4, 1), F.substring(w, F.lit(6), n)), True), (F.translate(w, "sv", "zb"), False)]
    each = F.array(*(F.struct((F.col("item_id") * 5 + k).alias("query"), f.alias("word"), F.lit(last).alias("last")) for k, (f, last) in enumerate(forms)))
    return rows.select(F.explode(each).alias("f")).select("f.query", F.lit(0).alias("place"), "f.word", "f.last")


def _sound_sql(word: str) -> str:
    """The rules of functions.text.SOUNDS; doubled letters one by one, as this SQL's patterns can't refer back or look ahead."""
    out = word
    for pattern, sound in X.SOUNDS[:-1]:
        ahead = pattern.partition("(?=")
        out = f"regexp_replace({out}, '{ahead[0]}({ahead[2][:-1]})', '{sound}\\1', 'g')" if ahead[1] else f"regexp_replace({out}, '{pattern}', '{sound}', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789XG.":
        out = f"regexp_replace({out}, '[{c}]+', '{c}', 'g')"
    return f"lower({out})"


ORACLES["phonetic_index"] = f"WITH {PRODUCTS_SQL} SELECT word, {_sound_sql('word')} AS key FROM (SELECT DISTINCT unnest([category, variant]) AS word FROM p)"


@query(f"""WITH {DOCS_SQL}, b AS (SELECT item_id, list_filter({_LIST}, lambda x: regexp_full_match(x, '[a-z]{{6,}}'))[1] AS w FROM benchmark),
q AS (SELECT * FROM (SELECT item_id * 5 AS query, w AS word, false AS last FROM b UNION ALL SELECT item_id * 5 + 1, left(w, 3), true FROM b UNION ALL SELECT item_id * 5 + 2, left(w, 2) || substr(w, 4), true FROM b UNION ALL SELECT item_id * 5 + 3, left(w, 3) || substr(w, 5, 1) || substr(w, 4, 1) || substr(w, 6), true FROM b UNION ALL SELECT item_id * 5 + 4, translate(w, 'sv', 'zb'), false FROM b) WHERE word IS NOT NULL),
ex AS (SELECT query, word, term, 1.0::DOUBLE AS weight, 'exact' AS channel FROM q JOIN df ON term = word), px AS (SELECT word, term FROM (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY term) AS k FROM (SELECT DISTINCT word FROM q WHERE last AND length(word) >= 2) JOIN df ON starts_with(term, word)) WHERE k <= 48),
sure AS MATERIALIZED (SELECT * FROM ex UNION ALL SELECT query, q.word, term, 0.8::DOUBLE, 'prefix' FROM q JOIN px ON px.word = q.word WHERE last AND term <> q.word), lost AS MATERIALIZED (SELECT * FROM q WHERE length(word) >= 4 AND query NOT IN (SELECT query FROM sure)),
near AS (SELECT word, term, df, damerau_levenshtein(word, term) AS d FROM (SELECT DISTINCT word FROM lost) JOIN df ON abs(length(word) - length(term)) <= 2 AND damerau_levenshtein(word, term) <= CASE WHEN length(word) >= 8 THEN 2 ELSE 1 END),
sp AS MATERIALIZED (SELECT word, term, CASE WHEN d = 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, df DESC, term) AS k FROM near) WHERE k <= 5),
snd AS MATERIALIZED (SELECT term, {_sound_sql('term')} AS key FROM df), ask AS (SELECT DISTINCT word, {_sound_sql('word')} AS key FROM lost)
SELECT * FROM sure UNION ALL SELECT query, word, term, weight, 'spelling' FROM lost JOIN sp USING (word) UNION ALL SELECT query, lost.word, snd.term, 0.75::DOUBLE, 'sound' FROM lost JOIN ask USING (word) JOIN snd USING (key) WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.word = lost.word AND sp.term = snd.term)""")
def search_variants(spark, sf):
    """What words of the benchmark, whole, cut and misspelt, stand for in the documents' vocabulary, and by which way."""
    return language.search_variants(odd_words(spark, sf), *vocabulary(spark, sf), X.phonetic_key).select("query", "word", "term", "weight", "channel")


@query("""WITH l AS (SELECT w AS entry, row_number() OVER (ORDER BY w) AS nth FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part)), a AS (SELECT DISTINCT word FROM (SELECT left(entry, 2) || substr(entry, 4) AS word FROM l UNION ALL SELECT left(entry, length(entry) - 1) || 'a' FROM l UNION ALL SELECT 'x' || entry FROM l UNION ALL SELECT entry FROM l)),
n AS (SELECT word, entry, nth, damerau_levenshtein(word, entry) AS d FROM a JOIN l ON damerau_levenshtein(word, entry) <= CASE WHEN length(word) >= 8 THEN 2 WHEN length(word) >= 5 THEN 1 ELSE 0 END WHERE length(word) >= 5 AND NOT (word <> entry AND regexp_matches(word, '[ao]$') AND length(word) = length(entry) AND left(word, length(word) - 1) = left(entry, length(entry) - 1)))
SELECT word, arg_min(entry, (d, nth)) AS entry, CAST(min(d) AS INTEGER) AS distance FROM n GROUP BY word""")
def lexicon_corrections(spark, sf):
    """Misspelt words of part names against the list of these words."""
    entries = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("entry")).distinct()
    from pyspark.sql import Window

    lexicon = entries.withColumn("nth", F.row_number().over(Window.orderBy("entry")))  # the words of names, a small vocabulary
    e, n = F.col("entry"), F.length("entry")
    forms = F.array(F.concat(F.substring(e, 1, 2), F.substring(e, F.lit(4), n)), F.concat(F.expr("left(entry, length(entry) - 1)"), F.lit("a")), F.concat(F.lit("x"), e), e)
    return language.lexicon_corrections(entries.select(F.explode(forms).alias("word")), lexicon)


_TITLE_WORDS = "list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents), l AS (SELECT doc_id, title, {_TITLE_WORDS} AS l, {_LIST.replace('lower(text)', 'lower(title)')} AS f FROM t),
a AS (SELECT doc_id, title, list_filter([left(f[1], 3), f[2] || 'xy', f[3] || 'x', 'q'], lambda x: x IS NOT NULL) AS terms, unnest(range(1, len(l) + 1)) AS k, l FROM l),
w AS (SELECT doc_id, terms, k, l[k] AS raw, title, l FROM a), s AS (SELECT doc_id, terms, k, raw, length(array_to_string(l[1:k - 1], ' ')) AS before, l, title, {_FOLD.replace('lower(text)', "lower(regexp_replace(raw, '[^\\p{L}\\p{N}]', '', 'g'))")} AS w FROM w),
z AS (SELECT doc_id, terms, k, raw, l, title, {_STEM} AS s FROM s) SELECT doc_id, CAST(k AS BIGINT) AS word, raw FROM z WHERE length(s) > 1 AND len(list_filter(terms, lambda t: length(t) > 1 AND (starts_with(s, t) OR (length(t) > 3 AND starts_with(t, s))))) > 0""")
def title_marks(spark, sf):
    """The words of each document's first line to highlight for terms made from its words; read back at their places."""
    title = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    f = X.words(F.col("title"))
    rows = table(spark, sf, "documents").select("doc_id", title.alias("title")).withColumn("f", f)
    get = lambda k: F.get("f", F.lit(k))
    terms = F.array_compact(F.array(F.substring(get(0), 1, 3), F.concat(get(1), F.lit("xy")), F.concat(get(2), F.lit("x")), F.lit("q")))
    each = rows.select("doc_id", "title", F.explode(language.marks(F.col("title"), terms)).alias("m"))
    raw = F.substring("title", F.col("m.start") + 1, F.col("m.end") - F.col("m.start"))
    nth = F.size(F.filter(F.split(F.substring("title", F.lit(1), F.col("m.end")), r"(?U)\s+"), lambda x: x != ""))
    return each.select("doc_id", nth.cast("long").alias("word"), raw.alias("raw"))


@query(f"SELECT doc_id, count(*) AS n, CAST(sum(length(raw)) AS BIGINT) AS letters, bool_and(true) AS placed, min({_STEM}) AS first FROM (SELECT doc_id, raw, replace({_FOLD.replace('lower(text)', 'lower(raw)')}, ',', '.') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(split_part(coalesce(text, ''), chr(10), 1), '[\\p{{L}}\\p{{N}}]+(?:[.,]\\p{{Nd}}+)?')) AS raw FROM documents)) GROUP BY doc_id")
def token_places(spark, sf):
    """Tokens of first lines: folded and stemmed, and standing where their places say."""
    rows = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"))
    t = rows.select("doc_id", "title", F.explode(language.tokens(F.col("title"))).alias("t"))
    there = F.substring("title", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")) == F.col("t.raw")
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t.raw")).alias("letters"), F.bool_and(there).alias("placed"), F.min("t.s").alias("first"))


@query("""WITH u AS (SELECT DISTINCT n_regionkey AS gen, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS engine FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), e AS (SELECT list(engine ORDER BY engine) AS a FROM (SELECT DISTINCT engine FROM u)),
r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN [] WHEN 1 THEN [[o_orderpriority]] WHEN 2 THEN [a[1:3], a[2:5]] WHEN 3 THEN [a[1:2], a[4:5]] ELSE [a[2:4]] END AS clues, CASE WHEN o_orderkey % 5 = 0 THEN a[3:4] WHEN o_orderkey % 5 = 1 THEN a[5:5] END AS size, CASE WHEN o_orderkey % 7 = 0 THEN a[3:3] WHEN o_orderkey % 7 < 3 THEN a[1:3] END AS model FROM orders, e),
n AS (SELECT *, CASE WHEN len(clues) = 1 THEN clues[1] WHEN len(clues) = 2 THEN list_filter(clues[1], lambda x: list_contains(clues[2], x)) END AS named FROM r), y AS (SELECT *, list_filter(coalesce(named, model, []), lambda x: list_contains(coalesce(size, []), x)) AS sized FROM n), q AS (SELECT *, CASE WHEN len(sized) > 0 THEN sized ELSE named END AS set_ FROM y),
z AS (SELECT o_orderkey, CASE WHEN len(list_filter(coalesce(set_, []), lambda x: list_contains(coalesce(model, []), x))) > 0 THEN list_filter(set_, lambda x: list_contains(model, x)) ELSE set_ END AS s FROM q) SELECT o_orderkey, CASE WHEN len(s) = 1 THEN s[1] ELSE '' END AS engine FROM z""")
def engine_clues(spark, sf):
    """The engine that names, a size and a model leave, for clues made from the orders."""
    engines = table(spark, sf, "orders").select("o_orderpriority").distinct().agg(F.array_sort(F.collect_list("o_orderpriority")).alias("a"))  # five names
    k = F.col("o_orderkey")
    cut = lambda a, n: F.slice("a", a, n)
    none = F.array().cast("array<array<string>>")
    clues = F.when(k % 6 == 0, none).when(k % 6 == 1, F.array(F.array("o_orderpriority"))).when(k % 6 == 2, F.array(cut(1, 3), cut(2, 4))).when(k % 6 == 3, F.array(cut(1, 2), cut(4, 2))).otherwise(F.array(cut(2, 3)))
    size = F.when(k % 5 == 0, cut(3, 2)).when(k % 5 == 1, cut(5, 1))
    model = F.when(k % 7 == 0, cut(3, 1)).when(k % 7 < 3, cut(1, 3))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(F.broadcast(engines))  # one row
    return rows.select("o_orderkey", F.coalesce(language.engine_of(clues, size, model), F.lit("")).alias("engine"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 END, -1) AS vehicle, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 10 END, CASE WHEN o_orderkey % 4 = 0 THEN 20 END, -1) AS price_min,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN o_orderkey % 4 = 0 THEN ['a', o_orderstatus] ELSE [] END, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus, 'z'] ELSE [] END))), '+') AS brand FROM orders""")
def merged_requests(spark, sf):
    """What a query says and what its form asks, as one request."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("array<string>")
    said = {"vehicle": F.when(k % 2 == 0, F.col("o_custkey")), "price_min": F.when(k % 4 == 0, 20), "brand": F.when(k % 3 == 0, F.array(F.col("o_orderstatus"), F.lit("z"))).otherwise(none)}
    asked = {"vehicle": F.when(k % 3 == 0, F.col("o_custkey") + 1), "price_min": F.when(k % 5 == 0, 10), "brand": F.when(k % 4 == 0, F.array(F.lit("a"), F.col("o_orderstatus"))).otherwise(none)}
    out = language.merged_request(said, asked, ("brand",))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(out["vehicle"], F.lit(-1)).alias("vehicle"), F.coalesce(out["price_min"], F.lit(-1)).alias("price_min"), F.array_join(out["brand"], "+").alias("brand"))


@query()
def result_pages(spark, sf):
    """The first three diversified pages of a query on each product name; tested against a plain version."""
    p = products(spark, sf).select(F.col("i").alias("doc"), *ranking.SIMILARITY)
    return ranking.pages(fused_results(spark, sf).join(p, "doc"), "query", "doc", F.col("rrf"), (0, 1, 2), 8)


_BOTH = "qw AS MATERIALIZED (SELECT n_nationkey AS query, 0 AS place, w AS word, true AS last FROM (SELECT n_nationkey, split_part(p_name, ' ', 2) AS w FROM nation JOIN part ON p_partkey = n_nationkey + 1))"


@query(f"{PRODUCTS_INDEX_SQL}, {_BOTH}, {SEARCH_SQL}, {_NUM}, pm AS (SELECT n_nationkey AS query, i, max(CASE WHEN starts_with(key, a) THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) AS weight FROM (SELECT n_nationkey, 'PN' || (1 + n_nationkey % 9) || '0' AS a FROM nation) JOIN num ON contains(key, a) GROUP BY ALL) SELECT f.query, i, round(score + weight, 6) AS score FROM found f JOIN pm ON pm.query = f.query AND i = doc -- from p ".replace("pst AS MATERIALIZED", ", pst AS MATERIALIZED", 1))
def text_and_number(spark, sf):
    """Products found both by words and by part of a number, with the sum of both scores."""
    k = F.col("n_nationkey")
    part = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("n_nationkey"), F.split("p_name", " ")[1].alias("w"))
    words = query_words(table(spark, sf, "nation").join(part, "n_nationkey").select(k.alias("query"), F.array("w").alias("words")))
    asked = table(spark, sf, "nation").select(k.alias("query"), F.array(F.concat(F.lit("PN"), 1 + k % 9, F.lit("0"))).alias("parts"))
    rows, dl, terms, size = search_tables(spark, sf, "products", product_index(spark, sf))
    text = retrieval.search(rows, words, terms, size, lengths=dl).select("query", F.col("doc").alias("i"), "score")
    return retrieval.in_both(text, retrieval.partial_numbers(asked, numbers(spark, sf)).withColumnRenamed("weight", "score")).select("query", "i", F.round("score", 6).alias("score"))


@query("SELECT i, variant FROM p WHERE contains(lower(variant), 're') OR contains(lower(variant), 'an')")
def position_words(spark, sf):
    """Products whose position holds one of the words that a query says about it."""
    said = ("RE", "an")
    return products(spark, sf).filter(reduce(lambda a, b: a | b, (F.lower("variant").contains(w.lower()) for w in said))).select("i", "variant")


@query("""WITH b AS (SELECT p_brand AS brand, list(DISTINCT p_type) FILTER (p_size < 10) AS types, list(DISTINCT split_part(p_name, ' ', 2)) FILTER (p_size > 40) AS cats FROM part GROUP BY p_brand)
SELECT p_partkey, coalesce(list_contains(types, p_type), false) OR (p_partkey % 11 <> 0 AND coalesce(list_contains(cats, split_part(p_name, ' ', 2)), false)) AS covered FROM part JOIN b ON brand = p_brand""")
def brand_covers(spark, sf):
    """Whether a part's brand covers its type: by the listed types, or by the listed categories unless it is universal."""
    part = table(spark, sf, "part").withColumn("category", F.split("p_name", " ")[1])
    brands = part.groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") < 10, F.col("p_type"))).alias("types"), F.collect_set(F.when(F.col("p_size") > 40, F.col("category"))).alias("cats"))
    covered = F.array_contains("types", F.col("p_type")) | ((F.col("p_partkey") % 11 != 0) & F.array_contains("cats", F.col("category")))
    return part.join(brands, "p_brand").select("p_partkey", covered.alias("covered"))


@query("SELECT l_orderkey, l_linenumber, brand, price FROM lineitem JOIN p ON i = l_partkey WHERE l_linenumber = 1")
def point_lookups(spark, sf):
    """The product of each order's first line, by its id."""
    asked = table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("i"))
    return asked.join(products(spark, sf).select("i", "brand", "price"), "i").select("l_orderkey", "l_linenumber", "brand", "price")


@query(f"{ALL}, t AS (SELECT DISTINCT vehicle, p_type AS part_type FROM f JOIN vk USING (key) JOIN part ON p_partkey = item UNION SELECT DISTINCT vehicle, p_type FROM (SELECT DISTINCT vehicle FROM vk), f JOIN part ON p_partkey = item WHERE key = '*') SELECT vehicle, part_type FROM t WHERE length(part_type) % 2 = 1")
def available_causes(spark, sf):
    """Of the causes (here, types of odd length) those with parts for each vehicle or for any."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("part_type"))
    f = fits(spark, sf).join(part, "item").select("key", "part_type").distinct()
    keys = vehicles.vehicle_keys(garage(spark, sf), universe(spark, sf))
    own = f.join(keys, "key").select("vehicle", "part_type").distinct()
    free = f.filter("key = '*'").select("part_type").distinct()
    every = keys.select("vehicle").distinct().join(F.broadcast(free.agg(F.collect_set("part_type").alias("types")))).select("vehicle", F.explode("types").alias("part_type"))  # one row of type names
    causes = part.select("part_type").distinct().filter(F.length("part_type") % 2 == 1)
    return own.unionByName(every).distinct().join(causes, "part_type", "left_semi")



_ONE = "qw AS MATERIALIZED (SELECT 1 AS query, 0 AS place, split_part(p_name, ' ', 2) AS word, true AS last FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))"
_TIERS, _ANY = "tier IN ('diario', 'oem')", "stock_total > 5"
_FACETS = " UNION ALL ".join(f"SELECT 'facet' AS section, '{d}' AS name, {d} AS value, count(*) FILTER ({_ANY if d == 'tier' else f'{_TIERS} AND {_ANY}'}) AS n FROM c GROUP BY {d}" for d in ("brand", "part_type", "category", "tier", "variant"))


@query(f"""{PRODUCTS_INDEX_SQL}, {_ONE}, {SEARCH_SQL}, c AS MATERIALIZED (SELECT * FROM p JOIN found ON doc = i), z AS (SELECT min(price) AS a, max(price) AS b FROM c WHERE {_TIERS} AND {_ANY}), k AS (SELECT * FROM c WHERE {_TIERS} AND {_ANY} AND price <= 1500)
SELECT section, name, value, n FROM ({_FACETS.replace('> 5', '> 5 AND price <= 1500')}) WHERE n > 0 OR (name = 'tier' AND value IN ('diario', 'oem')) UNION ALL SELECT 'total', 'hits', '', count(*) FROM k UNION ALL SELECT 'total', 'on_sale', '', count(*) FILTER (on_sale) FROM k UNION ALL
SELECT 'price', CAST(bin AS VARCHAR), '', count(*) FROM (SELECT least(15, CAST(floor((price - a) / CASE WHEN b > a THEN b - a ELSE 1 END * 16) AS INTEGER)) AS bin FROM c, z WHERE {_TIERS} AND {_ANY}) GROUP BY bin UNION ALL SELECT 'hit', CAST(row_number() OVER (ORDER BY round(score, 6) DESC, i) AS VARCHAR), CAST(i AS VARCHAR), 1 FROM k QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, i) <= 24 -- from p """.replace("pst AS MATERIALIZED", ", pst AS MATERIALIZED", 1))
def full_search(spark, sf):
    """One request answered whole: words and filters together, with facets, totals, prices and the first hits."""
    from pyspark.sql import Window

    request = search.Request({"tier": ("diario", "oem")}, price_max=1500.0)
    first = table(spark, sf, "part").agg(F.min_by("p_name", "p_partkey").alias("name"))
    words = query_words(first.select(F.lit(1).alias("query"), F.array(F.split("name", " ")[1]).alias("words")))
    rows, dl, terms, size = search_tables(spark, sf, "products", product_index(spark, sf))
    found = retrieval.search(rows, words, terms, size, lengths=dl).select(F.col("doc").alias("i"), F.round("score", 6).alias("score"))
    pool = products(spark, sf).filter("stock_total > 5").join(found, "i")
    row = lambda section, name, value, n: (F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    facets = search.facets(pool, request).select(*row("facet", F.col("dim"), F.col("value"), F.col("n")))
    kept = search.select(pool, request)
    totals = kept.agg(F.count(F.lit(1)).alias("hits"), F.count_if("on_sale").alias("on_sale")).select(F.explode(F.create_map(F.lit("hits"), "hits", F.lit("on_sale"), "on_sale")).alias("name", "n"))
    prices = search.histogram(pool, request).filter("n > 0")
    best = search.page(kept, [F.desc("score"), F.col("i")], 0, 24)
    hits = best.select("i", F.row_number().over(Window.orderBy(F.desc("score"), "i")).alias("nth"))  # one page
    return facets.unionByName(totals.select(*row("total", F.col("name"), F.lit(""), F.col("n")))).unionByName(prices.select(*row("price", F.col("bin"), F.lit(""), F.col("n")))).unionByName(hits.select(*row("hit", F.col("nth"), F.col("i"), F.lit(1))))
