"""What the findings of the fourth round asked for."""

import duckdb
from pyspark.sql import functions as F

from sparkfacet.plans import catalog, imports, service, store  # noqa: F401
from sparkfacet.sources.adapters import PRODUCTS_SQL

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_described_fits_in_small_plans(spark):
    """texts, what is read of them, and the rows each have a plan of their own; one plan of all filled the driver."""
    store.forget(spark)
    rows = catalog.QUERIES["described_fits"](spark, SF)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8
    assert {f"described-{n}" for n in ("said", "texts", "parts", "read", "met")} <= {k[2] for k in store._PATHS if k[0] == spark.sparkContext.applicationId}


def test_texts_by_another_name(spark):
    """texts that go by a number are read as those that go by themselves, the universal, missing and unknown ones too."""
    from sparkfacet.operators.imports import applications

    said = ["gen 1 2000-2001; gen 2 K10", "gen 1 2000-2001", "gen 2 1.2, algo", "algo raro | gen 9", "", " UNIVERSAL ", None, "gen 1 2000 | gen 1 2000"]
    universe = spark.createDataFrame([(g, y, e) for g in (1, 2) for y in (2000, 2001) for e in ("K10", "K12")], "gen int, year long, engine string")
    names = spark.createDataFrame([("gen 1", "gen", 1, None), ("gen 2", "gen", 2, None), ("k10", "engine", None, "K10"), ("k12", "engine", None, "K12")], "name string, kind string, gen int, engine string")
    sizes = spark.createDataFrame([("K10", 1.0), ("K12", 1.2)], "engine string, sized double")
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    configs, notes = applications(texts.select("text"), names, universe, sizes)
    by_id, noted = applications(texts, names, universe, sizes, "id")
    key = lambda row: tuple(map(str, row))
    want = sorted((tuple(r) for r in configs.collect()), key=key)
    assert len(want) > 8 and sorted(((said[r[0]], *r[1:]) for r in by_id.collect()), key=key) == want
    assert sorted(((said[r[0]], *r[1:]) for r in noted.collect()), key=key) == sorted((tuple(r) for r in notes.collect()), key=key)


def written_out(spark, name, column, pairs):
    """The pairs that the older SQL asks for, and those in the query's rows, each with its place in the row."""
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    con.register("told", catalog.QUERIES[name](spark, SF01).toArrow())
    listed = f"SELECT i, unnest(string_split({column}, ',')) AS other, generate_subscripts(string_split({column}, ','), 1) AS nth FROM told WHERE {column} <> ''"
    return con.execute(f"WITH {PRODUCTS_SQL} {pairs}").fetchall(), con.execute(f"SELECT i, CAST(other AS BIGINT), nth FROM ({listed})").fetchall()


def test_all_equivalents_are_written_out(spark):
    """the rows hold every pair of the older SQL, without a join of theirs."""
    pairs = "SELECT x.i, y.i AS other FROM p x JOIN p y ON x.variant = y.variant AND x.category = y.category AND x.part_type = y.part_type AND x.tier = y.tier AND x.brand = y.brand AND x.i <> y.i"
    want, got = written_out(spark, "group_equivalents", "equivalents", pairs)
    assert len(want) == 108 and sorted(x[:2] for x in got) == sorted(want)


def test_members_of_odd_groups(spark, tmp_path):
    """numbers that hold one another, null keys, and members alone."""
    rows = [(1, "a", 5), (11, "a", 4), (111, "a", None), (-1, "a", 4), (7, None, 1), (8, None, 2), (9, "b", 1)]
    spark.createDataFrame(rows, "i long, key string, price int").write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    got = catalog.with_others(p, ["key"], [F.col("price").isNull(), F.col("price")], "names").select("i", "first", "others", "names")
    want = {(1, -1, 3, "-1,11,111"), (11, -1, 3, "-1,1,111"), (111, -1, 3, "-1,11,1"), (-1, -1, 3, "11,1,111"), (7, 7, 1, "8"), (8, 7, 1, "7"), (9, 9, 0, "")}
    assert set(map(tuple, got.collect())) == want and got.count() == 7


def test_all_alternatives_are_written_out(spark):
    """the rows hold every pair of the older SQL, each at its place by tier and price."""
    pairs = "SELECT i, other, row_number() OVER (PARTITION BY i ORDER BY r, price, other) AS nth FROM (SELECT x.i, y.i AS other, y.tier_rank AS r, y.price FROM p x JOIN p y ON x.brand = y.brand AND x.variant = y.variant AND x.category = y.category AND x.i <> y.i)"
    want, got = written_out(spark, "alternatives", "alternatives", pairs)
    assert len(want) == 2478 and sorted(got) == sorted(want)
