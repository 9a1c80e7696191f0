"""The catalogue queries against DuckDB, and functions against literal definitions."""

import glob
import hmac
import os

import duckdb
import pytest

from sparkfacet.plans import assist, catalog, fit, imports, intake, language, retrieval, service  # noqa: F401  (the others add their queries to catalog's)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (sorted(map(tuple, x[columns].astype(str).values.tolist())) for x in (got, want))
    assert a == b


def one(spark, expression, value, kind="string"):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("word,key", [("llave", "yabe"), ("queso", "keso"), ("guitarra", "gitara"), ("cena", "sena"), ("enviar", "embiar")])
def test_phonetic_key(spark, word, key):
    from sparkfacet.functions.text import phonetic_key

    assert one(spark, phonetic_key, word) == key


@pytest.mark.parametrize("text,number", [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("12,5", 12.5), ("1,234", 1234.0), ("$ 99.90", 99.9), ("x", None)])
def test_parse_number(spark, text, number):
    from sparkfacet.functions.text import parse_number

    assert one(spark, parse_number, text) == number


def test_luhn32_catches_single_errors(spark):
    from sparkfacet.functions.text import CROCKFORD, luhn32

    good = one(spark, luhn32, "A1B2C3D4")
    assert all(one(spark, luhn32, c + "1B2C3D4") != good for c in CROCKFORD[:6] if c != "A")


def test_tokens(spark):
    from pyspark.sql import functions as F
    from sparkfacet.operators.codes import hmac_sha256, issue, verify

    assert one(spark, lambda x: hmac_sha256(b"secret", x), "hello") == hmac.new(b"secret", b"hello", "sha256").hexdigest()
    token = one(spark, lambda x: issue(b"k", x), '{"a":1}')
    assert one(spark, lambda x: verify(b"k", x), token) is True
    assert one(spark, lambda x: verify(b"other", x), token) is False
    assert one(spark, lambda x: verify(b"k", x), "nonsense") is False


def test_vin(spark):
    from sparkfacet.operators.codes import vin_valid

    assert one(spark, vin_valid, "1M8GDM9AXKP042788") is True
    assert one(spark, vin_valid, "1M8GDM9A1KP042788") is False
    assert one(spark, vin_valid, None) is False


def test_token_bucket(spark):
    from sparkfacet.streaming.keyed import fold_table, token_bucket

    rows = spark.createDataFrame([("a", k, t, None) for k, t in enumerate([0, 0, 0, 1, 10])] + [(None, 9, 0, None), ("a", 9, None, None)], "key string, id int, s int, value string")
    from pyspark.sql import functions as F

    done = fold_table(rows.withColumn("ts", F.timestamp_seconds("s")), token_bucket(2.0, 0.5)).orderBy("id").collect()
    assert [(r.allowed, r.remaining, r.retry, r.reset) for r in done] == [(True, 1, 0.0, 2.0), (True, 0, 0.0, 4.0), (False, 0, 2.0, 4.0), (False, 0, 1.0, 3.0), (True, 1, 0.0, 2.0)]


def test_budget_against_all_subsets(spark):
    """Bundles are atomic, priorities strict, and one plan has values beyond 64 bits."""
    import random
    from itertools import combinations

    from sparkfacet.operators.orders import fit_budget

    rng, rows, budgets = random.Random(4), [], {}
    for plan in range(12):
        n = rng.randrange(1, 8)
        rows += [(plan, rng.choice("abcde"), k, rng.randrange(0, 900), rng.randrange(1, 4) if plan else 30) for k in range(n)]
        budgets[plan] = rng.randrange(0, 20)
    got = {}
    frame = spark.createDataFrame(rows, "plan long, bundle string, nth long, cents long, priority long")
    for r in fit_budget(frame, spark.createDataFrame(list(budgets.items()), "plan long, budget long")).collect():
        got.setdefault(r.plan, {})[r.bundle] = (r.now, r.cost)
    for plan, budget in budgets.items():
        own = [r for r in rows if r[0] == plan]
        names = list(dict.fromkeys(r[1] for r in own))
        cost = {b: max(1, round(sum(r[3] for r in own if r[1] == b) / 100)) for b in names}
        worth = {b: sum((len(own) + 1) ** r[4] for r in own if r[1] == b) for b in names}
        sets = [c for n in range(len(names) + 1) for c in combinations(names, n) if sum(cost[b] for b in c) <= budget]
        now = {b for b, (yes, _) in got[plan].items() if yes}
        assert {b: c for b, (_, c) in got[plan].items()} == cost and sum(cost[b] for b in now) <= budget
        assert sum(worth[b] for b in now) == max(sum(worth[b] for b in c) for c in sets)
