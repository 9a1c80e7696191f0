"""Import, service and retrieval operators on odd values, against literal definitions."""

import random

import pytest
from pyspark.sql import functions as F


def values(spark, expression, rows, kind="string"):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, x {kind}")
    return [r[1] for r in sorted(frame.select("k", expression(F.col("x"))).collect())]


def test_bool_list_specs(spark):
    from sparkfacet.operators import intake

    assert values(spark, intake.parse_bool, ["Sí", " no ", None, "x", "quizá", "0"]) == [True, False, False, True, None, False]
    assert values(spark, intake.split_list, ["a; b|a,c\nd", "", None, ";;"]) == [["a", "b", "c", "d"], [], [], []]
    got = values(spark, lambda c: F.to_json(intake.specs_of(c, ("drop",))), ["k: v; k=w;drop: x; bad", None])
    assert got == ['[{"k":"k","v":"v"},{"k":"k","v":"w"}]', "[]"]


@pytest.mark.parametrize("text, want", [("1998-2002 y 2005", [(1998, 2002), (2005, 2005)]), ("98-02", [(1998, 2002)]), ("desde 2001", [(2001, 2020)]), ("2001+", [(2001, 2020)]), ("hasta 1999", [(1980, 1999)]), ("motor 4 cil", []), ("2002 a 1999", [(1999, 2002)]), ("antes de 2001", [(1980, 2000)]), ("antes de 1980", []), ("1999-02", [(1902, 1999)]), ("1999–03 y 97-98", [(1903, 1999), (1997, 1998)]), ("2001 en adelante", [(2001, 2020)]), ("45-50", []), ("39-40", []), ("a partir de 2015 1.6", [(2015, 2020)]), ("2015, 2016", [(2016, 2016)]), (None, None)])
def test_year_spans(spark, text, want):
    from sparkfacet.operators.intake import year_spans

    got = values(spark, lambda c: year_spans(c, 1980, 2020), [text])[0]
    assert (None if got is None else [tuple(s) for s in got]) == want


def test_mulberry32(spark):
    from sparkfacet.operators.intake import mulberry32

    def stream(seed, n):  # the generator as its author publishes it
        out, mask = [], 0xFFFFFFFF
        for _ in range(n):
            seed = (seed + 0x6D2B79F5) & mask
            t = (seed ^ seed >> 15) * (seed | 1) & mask
            t = (t + ((t ^ t >> 7) * (t | 61) & mask) & mask) ^ t
            out.append((t ^ t >> 14) & mask)
        return out

    seeds = [0, 1, 12345, 2**32 - 1]
    for n in (1, 2, 7):
        assert values(spark, lambda c: mulberry32(c, F.lit(n)), seeds, "long") == [stream(s, n)[-1] for s in seeds]


def test_codes_catch_single_errors(spark):
    from sparkfacet.functions.text import CROCKFORD
    from sparkfacet.operators.service import normal_code, order_code, valid_code

    code = values(spark, order_code, [str(k) for k in range(20)])
    assert len(set(code)) == 20 and all(c.startswith("OC-") and len(c) == 12 for c in code)
    assert values(spark, normal_code, [" oc-" + code[0][3:].lower().replace("0", "o"), code[1]]) == [code[0][3:], code[1][3:]]
    wrong = [code[0][3:][:k] + d + code[0][3:][k + 1 :] for k in range(9) for d in CROCKFORD if d != code[0][3 + k]]
    assert not any(values(spark, valid_code, wrong)) and all(values(spark, valid_code, [c[3:] for c in code]))
    assert values(spark, valid_code, ["", "short", "U" * 9]) == [False, False, False]


def test_allocation(spark):
    from sparkfacet.operators.service import allocate

    rows = [(5, [2, 9, 1], "1"), (10, [2, 9, 1], "01"), (20, [2, 9, 1], "012"), (1, [0, 0, 0], "012"), (0, [1, 1, 1], "0"), (12, [2, 9, 1], "012"), (3, [1, 2, 9], "01"), (2, [1, 2, 9], None)]
    got = allocate(spark.createDataFrame(rows, "qty long, stock array<long>, warehouses string")).collect()
    assert [([tuple(p) for p in r.parts], r.short) for r in got] == [([(1, 5)], 0), ([(1, 9), (0, 1)], 0), ([], 20), ([], 1), ([], 0), ([(1, 9), (0, 2), (2, 1)], 0), ([(1, 2), (0, 1)], 0), ([], 2)]


def test_index_terms(spark):
    from sparkfacet.functions.text import index_terms

    got = values(spark, lambda c: index_terms(c, ("the", "de")), ["The Bujías de 1.6 NGK-BKR/5E", "a--b 1.2.3 x-", "", None, "šut́"])
    assert got == [["bujia", "1.6", "ngk", "bkr", "5e", "ngkbkr5e"], ["a", "b", "1.2", "3", "x"], [], None, ["sut"]]


def test_search_relaxes_and_normalises(spark):
    """Against scores computed by the formula, term by term."""
    import math

    from sparkfacet.operators import retrieval
    from sparkfacet.plans.retrieval import query_words

    rng = random.Random(5)
    docs = {k: [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 9))] for k in range(30)}
    rows = [(t, d, float(ws.count(t))) for d, ws in docs.items() for t in set(ws)]
    index = spark.createDataFrame(rows, "term string, doc long, tf double")
    asked = {1: ["aa", "b"], 2: ["aa", "zz"], 3: ["cc"]}
    words = query_words(spark.createDataFrame(list(asked.items()), "query long, words array<string>"))
    got = {(r.query, r.doc): (r.score, r.hits, r.relaxed) for r in retrieval.search(index, words).collect()}
    avg = sum(map(len, docs.values())) / len(docs)

    def score(term, d):
        df = sum(term in ws for ws in docs.values())
        tf = docs[d].count(term)
        return math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / avg))

    for q, ws in asked.items():
        raw = {}
        for d in docs:
            best = [max([score(t, d) * (1.0 if t == w else 0.8) for t in set(docs[d]) if t == w or (w == ws[-1] and len(w) > 1 and t.startswith(w))], default=None) for w in ws]
            if any(b is not None for b in best):
                raw[d] = (sum(b for b in best if b is not None), sum(b is not None for b in best))
        full = {d: x for d, x in raw.items() if x[1] == len(ws)}
        kept = full or raw
        top = max(x[0] for x in kept.values())
        have = {d: x for (k, d), x in got.items() if k == q}
        assert have.keys() == kept.keys()
        assert all(abs(have[d][0] - kept[d][0] / top) < 1e-9 and have[d][1] == kept[d][1] and have[d][2] == (not full) for d in kept)


def test_number_index(spark):
    """The first kind of a key counts: pn always, then by the lowest product."""
    from sparkfacet.operators.retrieval import number_index

    rows = [("A", "oem", 1), ("A", "pn", 9), ("A", "pn", 7), ("B", "xref", 2), ("B", "oem", 3), ("C", "oem", 4), ("C", "xref", 4), ("D", "xref", 1)]
    got = {(r.key, r.kind, r.i) for r in number_index(spark.createDataFrame(rows, "key string, kind string, i long")).collect()}
    assert got == {("A", "pn", 9), ("A", "pn", 7), ("B", "xref", 2), ("C", "oem", 4), ("D", "xref", 1)}


def test_vehicles_known_in_part(spark):
    from sparkfacet.operators import vehicles

    universe = spark.createDataFrame([(g, y, e) for g in (1, 2) for y in (2000, 2001) for e in "AB"], "gen int, year long, engine string")
    cars = spark.createDataFrame([(1, 1, None, None), (2, 1, 2000, "A"), (3, None, None, None), (4, None, 2001, None), (5, 7, None, None)], "vehicle int, gen int, year long, engine string")
    counts = {r.vehicle: r["count"] for r in vehicles.vehicle_configs(cars, universe).groupBy("vehicle").count().collect()}
    assert counts == {1: 4, 2: 1, 4: 4}
    fits = spark.createDataFrame([("x", "g:1"), ("y", "ye:1:2000:A"), ("z", "*"), ("w", "e:B")], "item string, key string")
    got = {(r.vehicle, r.item): (r.verdict, r.share) for r in vehicles.assess(fits, cars, universe).collect()}
    assert got[(1, "x")] == ("confirmed", 1.0) and got[(1, "y")] == ("conditional", 0.25) and got[(None, "z")] == ("universal", 0.7) and got[(4, "w")] == ("conditional", 0.5)
    assert (2, "w") not in got and not any(v in (3, 5) for v, _ in got)
