"""What the findings of the third round asked for."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from sparkfacet.functions import text as X
from sparkfacet.operators import language, spelling
from sparkfacet.operators import retrieval as retrieval_ops
from sparkfacet.plans import catalog, fit, retrieval, service  # noqa: F401
from sparkfacet.sources.adapters import PRODUCTS_SQL, shares

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_windows_of_texts_are_not_broadcast(spark):
    """rows that explode makes count as one each in Spark's sizes."""
    assert "Broadcast" not in plan(retrieval.number_windows(spark, SF))


def test_swaps_across_letters(spark):
    """letters that are swapped may have others between them, as in the SQL's distance."""
    assert spelling.damerau("enenitelich", "enietelich") == 2 < spelling.osa("enenitelich", "enietelich")
    rows = spark.createDataFrame([(1, 0, "enenitelich", True)], "query int, place int, word string, last boolean")
    terms = spark.createDataFrame([("enietelich", 3)], "term string, df long")
    found = language.search_variants(rows, terms, language.deletion_index(terms), language.sound_index(terms, X.phonetic_key), X.phonetic_key)
    assert [(r.term, r.weight, r.channel) for r in found.collect()] == [("enietelich", 0.5, "spelling")]


def test_a_last_word_stands_for_all_its_terms(spark):
    """of the terms that a batch's last words begin none is left out, in the query and in its SQL."""
    docs = spark.createDataFrame([(k, f"ab{k:03d}", 1.0) for k in range(120)], "doc long, term string, tf double")
    asked = spark.createDataFrame([(1, 0, "ab", True)], "query int, place int, word string, last boolean")
    assert retrieval_ops.search(docs, asked, prefixes=None).count() == 120
    assert retrieval_ops.search(docs, asked).count() == 48
    assert "<= 48" not in catalog.ORACLES["search_batch"] and "<= 48" in catalog.ORACLES["bm25f"]


def test_groups_hold_all_pairs(spark):
    """a row for each product with its class gives back every pair, and the order in it, as the older SQL wrote them out."""
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    for name in ("group_equivalents", "alternatives"):
        con.register(name, catalog.QUERIES[name](spark, SF01).toArrow())
    pairs = "SELECT x.i, y.i AS other FROM p x JOIN p y ON x.variant = y.variant AND x.category = y.category AND x.part_type = y.part_type AND x.tier = y.tier AND x.brand = y.brand AND x.i <> y.i"
    order = "SELECT i, other, row_number() OVER (PARTITION BY i ORDER BY r, price, other) AS nth FROM (SELECT x.i, y.i AS other, y.tier_rank AS r, y.price FROM p x JOIN p y ON x.brand = y.brand AND x.variant = y.variant AND x.category = y.category AND x.i <> y.i)"
    same = "SELECT a.i, b.i AS other FROM group_equivalents a JOIN group_equivalents b ON a.first = b.first AND a.i <> b.i"
    placed = "SELECT a.i, b.i AS other, b.nth - CASE WHEN b.nth > a.nth THEN 1 ELSE 0 END AS nth FROM alternatives a JOIN alternatives b ON a.first = b.first AND a.i <> b.i"
    for old, new in ((pairs, same), (order, placed)):
        old = con.execute(f"WITH {PRODUCTS_SQL} {old}").fetchall()
        assert len(old) > 0 and sorted(old) == sorted(con.execute(new).fetchall())
    assert con.execute("SELECT sum(others) FROM group_equivalents").fetchone()[0] == len(con.execute(f"WITH {PRODUCTS_SQL} {pairs}").fetchall())


def test_corrections_look_farther_only_where_nothing_is_near(spark):
    """the same as comparing all words with all terms."""
    rng = random.Random(4)
    made = lambda: "".join(rng.choices("abc", k=rng.randint(3, 11)))
    terms = {made(): rng.randint(1, 4) for _ in range(150)}
    words = {made() for _ in range(400)} | {t[:3] + t[4:5] + t[3:4] + t[5:] + rng.choice(["", "a"]) for t in terms} | set(list(terms)[:9]) | {"", "abcabcabcabcabcabcabc" * 9}
    terms["abcabcabcabcabcabcabc" * 9 + "xy"] = 1
    budget = lambda w: 2 if len(w) >= 8 else 1 if len(w) >= 5 else 0
    want = {}
    for w in words:
        d, _, t = min((spelling.osa(w, t), -df, t) for t, df in terms.items())
        if d <= budget(w):
            want[w] = (t, d)
    found = spelling.corrections(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(terms.items()), "term string, df long"))
    assert {r.word: (r.term, r.distance) for r in found.collect()} == want and {d for _, d in want.values()} == {0, 1, 2}


def test_tasks_dont_grow_with_the_tables(spark, tmp_path):
    """Tables are dealt out by their size."""
    lines = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_orderkey", "l_partkey")
    small, large = shares(lines, 0.01), shares(lines, 0.001)
    assert 8 <= small < large and abs(large / small - 10) < 1


def exchanges(frame) -> int:
    return sum(line.lstrip(" :+-").startswith("Exchange") for line in plan(frame).splitlines())


ODD = ["Bujía 2.5mm NGK-BKR/5E, 1.6.3 x-y-z a--b-c/-d -e- .7 a.b-c", "Das ist. 5.5.5a ...3.b/", "the 4.", None, "", "casas-luces 9.1s luces"]


def test_an_index_shuffles_texts_only(spark, tmp_path):
    """F8: a document's runs are counted where it is, and its terms are those of the SQL, decimals before letters too."""
    docs = [(k, t, "web-s 1.5l", "en", 0) for k, t in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("doc_id", "doc").withColumn("title", F.col("text"))
    assert exchanges(retrieval._index(frame, retrieval.BOOSTS, 4)) == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES["postings"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["postings"](spark, str(tmp_path)).collect())) == want
    assert {"2.5", "mm", "ngkbkr5e", "xyz", "luz"} <= {t for t, _, _ in want}


def test_few_keys_gather_no_vehicles(spark):
    """Distances and tasks are few, so vehicles meet them where they are."""
    from sparkfacet.operators import service as ops

    vehicles = spark.range(2_000_000).select(F.col("id").alias("vehicle"), (F.col("id") % 5 * 10_000 + 10_000).alias("km"))
    tasks = spark.createDataFrame([("a", 10_000), ("b", 20_000)], "task string, every long")
    assert exchanges(ops.due(vehicles.hint("merge"), tasks)) == 0 or "SortMergeJoin" not in plan(ops.due(vehicles, tasks))
    assert "SortMergeJoin" not in plan(ops.due(vehicles, tasks)) and ops.due(vehicles, tasks).count() == 2_000_000 + 800_000


def test_related_products_of_their_own_type(spark):
    """a type's list is cut before products meet it, with the same result, for types related to themselves too."""
    from sparkfacet.operators import service as ops

    rng = random.Random(4)
    rows = [(i, rng.choice("abcd"), float(rng.randrange(5))) for i in range(60)]
    pairs = [(x, y) for x in "abc" for y in "abcd" if rng.random() < 0.8] + [("a", "a")]
    pairs = sorted(set(pairs))
    got = {}
    for r in ops.related(spark.createDataFrame(rows, "i long, part_type string, rating double"), spark.createDataFrame(pairs, "part_type string, related string"), F.col("rating")).collect():
        got.setdefault(r.i, {})[r.nth] = r.other
    for i, t, _ in rows:
        best = [x for a, b in pairs if a == t for x in sorted((-s, j) for j, u, s in rows if u == b and j != i)[:2]]
        assert [got.get(i, {}).get(k + 1) for k in range(len(sorted(best)[:4]))] == [j for _, j in sorted(best)[:4]]


def test_terms_need_no_sorted_postings(spark):
    """statistics of terms write the index only, and a search's postings are neither written again nor sorted."""
    from sparkfacet.plans import store

    store.forget(spark)
    catalog.QUERIES["term_statistics"](spark, SF).collect()
    names = {k[2] for k in store._PATHS if k[0] == spark.sparkContext.applicationId}
    assert names == {"document-index", "documents-lengths", "documents-size", "documents-terms"}
    found = catalog.QUERIES["search_batch"](spark, SF)
    assert {k[2] for k in store._PATHS if k[0] == spark.sparkContext.applicationId} == names
    assert not any("SortMergeJoin" in line and ("term" in line or "doc" in line) for line in plan(found).splitlines())


def test_words_are_split_at_blanks(spark):
    """the same words as by the pattern that was slow, marks, signs and other scripts included."""
    texts = [*(t or "" for t in ODD), "Straße\tÜber—naïve e\u0301t\u00e9 \u0130x\x00y \u4e2d\u6587 z\U0001f600w 5€ A_b [c] \u017f", "".join(map(chr, range(1, 700)))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for new, pattern in ((X.words, "[^a-z0-9]+"), (X.term_runs, "[^a-z0-9./-]+")):
        got = rows.select(F.array_remove(new(F.col("t")), "").alias("new"), F.array_remove(F.split(X.fold(F.col("t")), pattern), "").alias("old"))
        assert "[^a-z0-9" not in plan(got.select("new")) and all(r.new == r.old for r in got.collect())


def test_parts_of_a_stream_follow_its_largest_keys(spark, tmp_path, monkeypatch):
    """many keys of few rows come in one part; keys of many rows in so many that none holds more than about chunk."""
    from sparkfacet.streaming import keyed

    runs, run = [], keyed.run_available
    monkeypatch.setattr(keyed, "run_available", lambda *a: runs.append(1) or run(*a))
    rng = random.Random(7)
    for name, n, parts in (("few", 4, 1), ("many", 120, 5)):
        rows = [(k, 1000 * k + j, rng.randrange(10**6), "x") for k in range(40) for j in range(4)] + [(99, j, rng.randrange(10**6), "x") for j in range(n)]
        frame = spark.createDataFrame(rows, "key long, id long, s long, value string").select("key", "id", F.timestamp_seconds("s").alias("ts"), "value")
        runs.clear()
        for fold in (keyed.token_bucket(3.0, 1 / 3600),):
            got = sorted(map(tuple, keyed.run_table(frame, fold, f"{tmp_path}/{name}", chunk=25).collect()))
            assert got == sorted(map(tuple, keyed.fold_table(frame, fold).collect())) and len(runs) == parts


def test_equal_applications_are_read_once(spark):
    """a text that many items share is read once, with the same rows."""
    from sparkfacet.operators import intake

    u = spark.createDataFrame([(g, y, e) for g in (1, 2) for y in (1992, 1993, 1994) for e in ("a", "b")], "gen int, year long, engine string")
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["gen 1 1992-1993 (a)", "gen 1 1992-1993 (a)", "gen 2 1994", "gen 9 1994", ""])] + [(1, "gen 2 1994")], "item int, text string")
    found = intake.application_configs(rows, u)
    lines = plan(found).splitlines()
    read = [k for k, line in enumerate(lines) if "Generate explode" in line]
    assert read and "Aggregate" in "".join(lines[read[0] + 1 :])  # what is read is distinct
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1992, "a"), (0, 1, 1993, "a"), (1, 1, 1992, "a"), (1, 1, 1993, "a"), (1, 2, 1994, "a"), (1, 2, 1994, "b"), (2, 2, 1994, "a"), (2, 2, 1994, "b")]


def test_items_are_counted_by_key(spark):
    """items with keys of several sorts count once for a configuration, those with * for all, and the rest by key."""
    from sparkfacet.operators import vehicles

    u = spark.createDataFrame([(g, y, e) for g in (1, 2) for y in (1992, 1993) for e in ("a", "b")], "gen int, year long, engine string")
    own = {1: ["g:1"], 2: ["y:1:1992", "ge:1:a", "ye:1:1992:b"], 3: ["*", "y:2:1992"], 4: ["ye:1:1992:a", "ye:2:1993:b"], 5: ["e:b", "g:1"], 6: ["ye:7:1992:a"]}
    frame = spark.createDataFrame([(i, k, "x" if i % 2 else "z") for i, ks in own.items() for k in ks], "item int, key string, kind string")
    met = {(r.item, r.gen, r.year, r.engine) for r in frame.join(vehicles.key_configs(frame.select("key").distinct(), u), "key").collect()} | {(3, *r) for r in u.collect()}
    want = {}
    for i, *c in met:
        want[(*c, "x" if i % 2 else "z")] = want.get((*c, "x" if i % 2 else "z"), 0) + 1
    assert {tuple(r)[:4]: r.n for r in vehicles.configs_by_kind(frame, ["kind"], u).collect()} == want


def test_words_of_texts_meet_few_pairs_where_they_are(spark):
    """the words of texts aren't dealt out by word; what phrases may take of them is a small table."""
    from sparkfacet.plans import language as plans

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in ("100k", "1k"):  # the second one is less than the table
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            assert "hashpartitioning(word" not in re.sub(r"nth#\d+L, word", "", plan(plans.symptoms_found(spark, SF)))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_words_are_those_of_the_distance(spark):
    """the same pairs as comparing all words, in one pass, other columns kept."""
    rng = random.Random(7)
    made = lambda: "".join(rng.choices("abc", k=rng.randint(0, 12)))
    known = {made() for _ in range(120)}
    words = {made() for _ in range(300)} | {k[:i] + k[i + 1 : i + 2] + k[i : i + 1] + k[i + 2 :] for k in known for i in (0, 3, 8)} | {k[:7] + "x" + k[7:] + "y" for k in known}
    budget = lambda w: 2 if len(w) >= 8 else 1 if len(w) >= 5 else 0
    rows = spark.createDataFrame([(w.upper(), w) for w in words], "raw string, word string")
    got = language.near_words(rows, spark.createDataFrame([(k,) for k in known], "known string"))
    want = {(w.upper(), w, k) for w in words for k in known if spelling.osa(w, k) <= budget(k)}
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(want) and {spelling.osa(w, k) for _, w, k in want} == {0, 1, 2}


def test_phrases_whose_words_may_take_the_same_word(spark):
    """only these keep lists of places; found as by a plain version."""
    from test_language import plain_symptoms

    phrases = [("twice", 1, ["motor", "motor"]), ("near", 2, ["puerta", "puertas", "golpe"]), ("plain", 3, ["golpe", "motor"]), ("thrice", 4, ["x", "x", "x"]), ("one", 5, ["puertaz"]), ("two", 6, ["motor", "nada", "golpe"])]
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["motor", "motro", "puerta", "puertas", "puertaz", "golpe", "golp", "x", "y", "nada"]) for _ in range(rng.randrange(9))) for _ in range(150)]
    frame = spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "id long, words array<string>")
    table = spark.createDataFrame(phrases, "symptom string, nth long, words array<string>")
    pairs = language.symptom_words(frame, table, lambda w: F.when(w != "y", w))
    for given in (None, pairs):
        got = {}
        for r in language.symptoms_found(frame, table, given).orderBy("id", "place").collect():
            got.setdefault(r.id, []).append((r.symptom, r.words, round(r.score, 6)))
        assert got == {k: w for k, t in enumerate(texts) if (w := plain_symptoms(t.split(), phrases))}


def test_an_import_is_read_once(spark):
    """the file is read and understood once for all of an import's results, and no part's configurations are made for it."""
    from sparkfacet.plans import store
    from sparkfacet.plans.imports import imported

    store.forget(spark)
    totals = catalog.QUERIES["import_totals"](spark, SF)
    names = {k[2] for k in store._PATHS if k[0] == spark.sparkContext.applicationId}
    assert "import" in names and "covered" not in names
    assert "csv" not in plan(totals).lower() and plan(imported(spark, SF)).count("FileScan") == 2
    assert {r.name: r.n for r in totals.filter("section = 'total'").collect()}["rows"] == imported(spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()
    quick = set(map(tuple, fit.universe(spark, SF).collect()))
    assert quick == set(map(tuple, fit.covered(spark, SF).select("gen", "year", "engine").distinct().collect()))
    assert store.is_stored(spark, SF, "covered") and not store.is_stored(spark, SF01, "covered")


def test_rows_meet_what_their_values_mean(spark):
    """rows of one title or type need no row of their own to be met, and an empty import has totals too."""
    from sparkfacet.operators import imports, intake

    types = spark.createDataFrame([("Filtro de aceite",), ("filtro de Aceite",), ("Filtro",), ("!",)], "type string")
    rows = [(1, "filtro", "x"), (2, "", "un filtro de aceite"), (2, "", "un filtro de aceite"), (3, "raro", "Filtro"), (4, None, None), (5, "FILTRO  de-aceite", "Filtro"), (6, "!", "nada")]
    got = sorted((r.row, r.said, r.type, r.sure) for r in intake.resolve_types(spark.createDataFrame(rows, "row long, said string, title string"), types).collect())
    assert [(x[0], *x[2:]) for x in got] == [(1, "Filtro", True), (2, "Filtro de aceite", False), (2, "Filtro de aceite", False), (3, "Filtro", False), (4, None, False), (5, "Filtro de aceite", True), (6, None, False)]
    none = spark.createDataFrame([], "row long, kept boolean, universal boolean, part_type string, issues array<struct<level: string, column: string, message: string, value: string>>")
    assert sorted((r.section, r.name, r.n) for r in imports.import_summary(none).collect()) == [("total", n, 0) for n in ("imported", "left_out", "rows", "universal")]
    some = spark.createDataFrame([(1, True, True, "a", []), (2, False, False, None, [("error", "price", "no price", "")]), (3, True, None, "a", [("warning", "tier", "missing", "")]), (4, False, True, "b", [("error", "price", "no price", "")])], none.schema)
    assert sorted(map(tuple, imports.import_summary(some).collect())) == [("issue", "price: no price", "error", 2), ("issue", "tier: missing", "warning", 1), ("level", "error", "error", 2), ("level", "warning", "warning", 1), ("part_type", "a", "", 2), ("total", "imported", "", 2), ("total", "left_out", "", 2), ("total", "rows", "", 4), ("total", "universal", "", 1)]
