"""Imports, applications, headers, files, numbers, codes and stored tables on odd values."""

import pytest
from pyspark.sql import functions as F

from sparkfacet.plans import imports as plans  # noqa: F401


def values(spark, expression, rows, kind="string"):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, x {kind}")
    return [r[1] for r in sorted(frame.select("k", expression(F.col("x"))).collect())]


@pytest.fixture(scope="module")
def catalogue(spark):
    universe = spark.createDataFrame([(g, y, e) for g in (1, 2) for y in (2000, 2001, 2002) for e in ("K10", "K12 turbo")], "gen int, year long, engine string")
    names = spark.createDataFrame([("corolla", "gen", 1, None), ("corolla", "gen", 2, None), ("gen 1", "gen", 1, None), ("gen 2", "gen", 2, None), ("k10", "engine", None, "K10"), ("k12 turbo", "engine", None, "K12 turbo")], "name string, kind string, gen int, engine string")
    sizes = spark.createDataFrame([("K10", 1.0), ("K12 turbo", 1.2)], "engine string, sized double")
    return names, universe, sizes


TEXTS = {
    "Corolla 2000-2001": (8, None, None),
    "Corolla antes de 2001 K10": (2, None, None),
    "gen 1; gen 2 2002": (8, None, None),
    "gen 1, 1,2 L": (3, None, None),
    "Gen 1 1.2": (3, None, None),
    "gen 1 1200 cc": (3, None, None),
    "gen 2 K10 1.2": (3, None, "size disagrees"),
    "K12 TURBO": (6, None, None),
    "k12 turbo 2001": (2, None, None),
    "gen 1 00–01": (4, None, None),
    "Gen 1 2002 en adelante\ngen 2 hasta 2000": (4, None, None),
    "corolla 1980": (0, "not in the catalogue", None),
    "algo raro | nada": (0, "no vehicle", None),
    "algo raro | gen 2 2001": (2, None, "some applications left out"),
    "": (0, "missing", None),
    None: (0, "missing", None),
    " UNIVERSAL ": (0, None, None),
    "gen 1 2001 a 2000": (4, None, None),
}


def test_applications(spark, catalogue):
    from sparkfacet.operators.imports import applications

    configs, notes = applications(spark.createDataFrame([(t,) for t in TEXTS], "text string"), *catalogue)
    n = {r.text: r["count"] for r in configs.groupBy("text").count().collect()}
    told = {r.text: (r.error, r.note, r.universal) for r in notes.collect()}
    assert {t: (n.get(t, 0), *told[t][:2]) for t in TEXTS} == TEXTS
    assert [t for t, x in told.items() if x[2]] == [" UNIVERSAL "]


def test_import_run(spark, catalogue):
    """Duplicates count only among rows that passed; each row's issues stand together."""
    from sparkfacet.operators.imports import import_run, import_summary

    good = ("Filtro de aceite", "10,50", None, ["1", "", "2"], "2 años", "si", "a;b", "PN-1", "Bosch", "", "OEM", "gen 1 2000")
    rows = [(1, *good), (2, *good), (3, *good[:1], "x", *good[2:]), (4, *good[:7], "pn 1", *good[8:]), (5, *good[:7], "", "Nueva", *good[9:])]
    rows += [(6, *good[:8], "Bsoch", "filtro de aire", "raro", "?"), (7, *good[:8], "NKG", *good[9:]), (8, *[None] * 3, [], *[None] * 8), (9, "Bujía", *good[1:8], "BOSCH", "bujias raras", "", "universal")]
    columns = "row long, title string, price string, list_price string, stock array<string>, warranty string, closeout string, extras string, part_number string, brand string, type string, tier string, application string"
    brands = spark.createDataFrame([("Bosch", ["oem", "diario"]), ("NGK", ["desempeno", "oem"])], "brand string, tiers array<string>")
    types = spark.createDataFrame([("Filtro de aceite",), ("Filtro de aire",), ("Filtro",)], "type string")
    done = import_run(spark.createDataFrame(rows, columns), brands, types, *catalogue)
    got = {r.row: r for r in done.collect()}
    said = {k: sorted((x.level, x.column, x.message) for x in r.issues) for k, r in got.items()}
    title = ("warning", "part_type", "taken from the title")
    assert got[1].kept and got[1].part_type == "Filtro de aceite" and got[1].brand == "Bosch" and got[1].pn == "PN1" and said[1] == [title] and got[1].configs == 2 and got[1].tier == "oem"
    assert not got[2].kept and said[2] == [("error", "part_number", "duplicate"), title] and [x.value for x in got[2].issues if x.message == "duplicate"] == ["1"]
    assert said[3] == [("error", "price", "no price"), title] and said[4][0] == ("error", "part_number", "duplicate")
    assert said[5] == [("error", "part_number", "missing"), ("warning", "brand", "new"), title] and got[5].brand == "nueva"
    assert said[6] == [("error", "application", "no vehicle"), ("warning", "brand", "read as another"), ("warning", "tier", "unknown")] and got[6].brand == "Bosch" and got[6].part_type == "Filtro de aire" and got[6].tier == "diario"
    assert got[7].brand == "NGK" and got[7].kept and ("warning", "brand", "read as another") in said[7]
    assert {("error", c, m) for c, m in (("title", "empty"), ("price", "no price"), ("part_number", "missing"), ("brand", "missing"), ("part_type", "unknown"), ("application", "missing"))} <= set(said[8])
    assert ("error", "part_type", "unknown") in said[9] and got[9].universal
    flat = {(r.section, r.name): r.n for r in import_summary(done).collect()}
    assert flat["total", "rows"] == 9 and flat["total", "imported"] == 2 and flat["total", "left_out"] == 7 and flat["part_type", "Filtro de aceite"] == 2
    empty = import_run(spark.createDataFrame([], columns), brands, types, *catalogue)
    assert empty.collect() == []


def test_headers_with_warehouses():
    from sparkfacet.operators.intake import map_headers

    fields = {"price": ("precio",), "stock": ("existencias",), "title": ("descripcion",)}
    got = map_headers(["Existencias almacén Norte", "PRECIO", "Descripcoin", "Existencias", "existencias luna", "precios", "x", ""], fields, ("norte", "sur"))
    assert got == {"Existencias almacén Norte": "stock:0", "PRECIO": "price", "Descripcoin": "title", "Existencias": "stock"}


def test_quoted_delimiters_and_lines(spark, tmp_path):
    from sparkfacet.sources import csv

    (tmp_path / "a.csv").write_text('a;b\n"x,y,z";1\n"p,q,r";2\n"s,t,u";3\n')
    assert [tuple(r) for r in csv.read_csv(spark, f"{tmp_path}/a.csv").collect()] == [("x,y,z", "1"), ("p,q,r", "2"), ("s,t,u", "3")]
    (tmp_path / "b.csv").write_text('a,b\n"two\nlines",1\nx,2\n')
    assert [tuple(r) for r in csv.read_csv(spark, f"{tmp_path}/b.csv").collect()] == [("two\nlines", "1"), ("x", "2")]


@pytest.mark.parametrize("text, lo, hi", [("entre $10 y 20,5", 10, 20.5), ("entre 30 y 20", 20, 30), ("por debajo de 7.5 pesos", None, 7.5), ("máximo $ 9", None, 9), ("MAX 8 max 6", None, 6), ("minimo 3 y hasta 5", 3, 5), ("más de 2015", None, None), ("> 12 < 15", 12, 15), ("arriba de 1.2", 1.2, None), ("desde 1979", 1979, None), ("", None, None), (None, None, None)])
def test_price_phrases(spark, text, lo, hi):
    from sparkfacet.functions.text import price_range

    assert tuple(values(spark, price_range, [text])[0]) == (lo, hi)


def test_numbers_with_notes(spark):
    from sparkfacet.functions.text import parse_number, thousands_note

    texts = ["1.234", "0.500", ",500", "1,234,567", "-1.5", "1.234,5", "1,234.5", "12", "$", "", None, "- 3", "1.2.3", "7."]
    assert values(spark, parse_number, texts) == [1234.0, 0.5, 0.5, 1234567.0, -1.5, 1234.5, 1234.5, 12.0, None, None, None, -3.0, 123.0, 7.0]
    assert values(spark, thousands_note, texts) == ["1.234 read as 1234"] + [None] * 13


def test_vin_parts(spark):
    from sparkfacet.operators import codes

    vins = [" 1m8gdm9axkp042788", "JT2BG22K1Y0123456", "WVWZZZ1JZ3W386752", "1M8GDM9AXKP04278O", "short", None]
    clean = values(spark, codes.vin_clean, vins)
    assert clean[0] == "1M8GDM9AXKP042788" and values(spark, codes.vin_error, clean) == [None, None, None, "letters", "length", None]
    assert values(spark, lambda c: codes.vin_year(c, F.lit(2024)), clean[:3]) == [2019, 2000, 2003]
    assert values(spark, lambda c: codes.vin_year(c, F.lit(1990)), clean[:1]) == [1989]
    assert values(spark, codes.vin_region, clean[:3]) == ["Norteamérica", "Japón", "Europa"]


def test_shipments_take_sums_and_leave_short_lines(spark):
    """Stock 2 and 3 serve five together; a line that nothing can serve doesn't hold up the cart."""
    from sparkfacet.operators.orders import ship_from, shipments
    from sparkfacet.operators.service import allocate

    rows = [(1, 1, 5, [2, 3, 0]), (2, 1, 4, [4, 0, 4]), (2, 2, 9, [1, 1, 1]), (3, 1, 9, [1, 1, 1]), (4, 1, 3, [0, 5, 3]), (4, 2, 2, [2, 2, 0]), (5, 1, 0, [0, 0, 0])]
    lines = spark.createDataFrame(rows, "cart int, line int, qty long, stock array<long>")
    chosen = ship_from(lines, [1, 4, 2])
    assert {r.cart: r.warehouses for r in chosen.collect()} == {1: "01", 2: "0", 3: None, 4: "1", 5: "0"}
    done = {r.cart: r for r in shipments(allocate(lines.join(chosen, "cart")), [1, 3, 1], [1, 4, 2]).collect()}
    assert (done[1].units, done[1].back_lines, done[1].eta_from, done[1].eta_to) == ([2, 3, 0], 0, 3, 4)
    assert (done[2].units, done[2].back_lines, done[2].eta_to) == ([4, 0, 0], 1, 1) and (done[3].units, done[3].eta_to) == ([0, 0, 0], None) and done[4].units == [0, 5, 0]


def test_stored_tables_follow_the_data(spark, tmp_path):
    from sparkfacet.plans.store import forget, stored

    make = lambda: spark.read.parquet(f"{tmp_path}/x.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/x.parquet")
    assert stored(spark, str(tmp_path), "t", make).count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/x.parquet")
    assert stored(spark, str(tmp_path), "t", make).count() == 5
    forget(spark)
    assert stored(spark, str(tmp_path), "t", make).count() == 5


def test_completions_begin_words(spark):
    from sparkfacet.operators.retrieval import complete

    texts = spark.createDataFrame([("concat", 5), ("cat food", 3), ("big cat", 9), ("cat", 7), ("ca", 1)], "text string, weight long")
    asked = spark.createDataFrame([(1, ["ncat"]), (2, ["my", "cat"]), (3, ["big", "ca"]), (4, ["c"]), (5, [])], "query int, words array<string>")
    got = {}
    for r in complete(asked, texts).orderBy("query", "nth").collect():
        got.setdefault(r.query, []).append((r.text, r.score))
    assert got == {2: [("my big cat", 9), ("my cat food", 6)], 3: [("big cat", 18)]}


def test_picks_by_adjusted_rating_then_price(spark):
    from sparkfacet.operators.service import picks

    rows = [("t", 1, "diario", 10.0, 4.9, 0.1, True), ("t", 2, "oem", 20.0, 4.0, 0.3, True), ("t", 3, "oem", 30.0, 4.0, 0.2, True), ("t", 4, "oem", 99.0, 5.0, 0.9, False), ("u", 5, "diario", 1.0, 1.0, 0.1, False)]
    got = {r.task: (r.cheapest, r.value, r.best) for r in picks(spark.createDataFrame(rows, "task string, i long, tier string, price double, adjusted double, score double, in_stock boolean"), ("desempeno", "oem")).collect()}
    assert got == {"t": (1, 2, 3), "u": (5, 5, 5)}
