"""Spelling, ranking, CSV files and streams against plain versions."""

import re
from collections import Counter

import pyarrow.dataset as ds
import pytest

from sparkfacet.plans import assist, catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


def distance(a, b):
    """Restricted edit distance by its definition."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_spelling(spark):
    from sparkfacet.operators.spelling import corrections

    vocabulary = [("frenos", 9), ("balatas", 5), ("filtro", 7), ("filtros", 7), ("bujia", 3), ("amortiguador", 2), ("aceite", 8), ("aceites", 8)]
    words = ["frneos", "balata", "filtroz", "filtro", "bujai", "amortigaudro", "aceiet", "motor", "buj", "", None, "frneos"]
    got = {r.word: (r.term, r.distance) for r in corrections(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(vocabulary, "term string, df long")).collect()}
    want = {}
    for w in filter(None, words):
        k = 2 if len(w) >= 8 else 1 if len(w) >= 5 else 0
        near = [(distance(w, t), -n, t) for t, n in vocabulary if distance(w, t) <= k]
        if near:
            want[w] = (min(near)[2], min(near)[0])
    assert got == want and {"frneos", "bujai", "amortigaudro", "filtro"} <= set(want)


def test_mmr(spark):
    rows = catalog.QUERIES["mmr_picks"](spark, SF).collect()
    of = {}
    from sparkfacet.sources.adapters import products

    for p in products(spark, SF).collect():
        of.setdefault(p.category, []).append(p)
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault(r.category, []).append(r.i)
    assert set(got) == set(of)
    for category, pool in of.items():
        pool = sorted(pool, key=lambda p: (-p.rating, p.i))[:30]
        low, high = min(p.rating for p in pool), max(p.rating for p in pool)
        picked = []
        while len(picked) < min(10, len(pool)):
            def score(p):
                near = max([0.55 * (p.brand == q.brand) + 0.3 * (p.tier == q.tier) + 0.15 * (p.part_type == q.part_type) for q in picked], default=0.0)
                return 0.5 * ((p.rating - low) / (high - low) if high > low else 1.0) - 0.5 * near

            best = max((p for p in pool if p not in picked), key=lambda p: (round(score(p), 12), -pool.index(p)))
            picked.append(best)
        assert got[category] == [p.i for p in picked]


@pytest.mark.parametrize("text,delimiter,encoding", [("a;b;c\n1,5;2;3\n2,5;3;4", ";", "utf-8-sig"), ("a,b\n1,2", ",", "utf-8-sig"), ("a\tb\nñ €\t2", "\t", "cp1252"), ("a|b\nx|y\n", "|", "utf-8-sig"), ("", ",", "utf-8-sig")])
def test_sniff(spark, tmp_path, text, delimiter, encoding):
    from sparkfacet.sources import csv

    raw = text.encode("cp1252")
    found = csv.sniff(raw.split(b"\n") if raw else [])
    assert (found.delimiter, found.encoding) == (delimiter, encoding)
    if text:
        (tmp_path / "x.csv").write_bytes(raw)
        header, first = (line.split(delimiter) for line in text.split("\n")[:2])
        frame = csv.read_csv(spark, f"{tmp_path}/x.csv")
        assert frame.columns == header and list(frame.first()) == first


def test_stream_goes_on(spark, tmp_path):
    """Late and repeated events, and a second run that takes up where the first one stopped."""
    from sparkfacet.streaming import windows

    schema = "event_id long, ts timestamp, event_type string"
    parts = [[(1, 0, "a"), (2, 10, "a"), (2, 10, "a"), (3, 70, "b"), (4, 300, "a")], [(5, 20, "a"), (6, 310, "b"), (7, 900, "a")]]

    def put(k):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(parts[k], "event_id long, m int, event_type string").select("event_id", F.timestamp_seconds(F.col("m") * 60 + 3_600_000).alias("ts"), "event_type")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{k}", mode="overwrite")

    def count():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        out = windows.run_available(windows.window_counts(stream, "1 hour", "1 hour"), f"{tmp_path}/out")
        return sorted((r.start.timestamp() // 3600 - 1000, r.event_type, r.n) for r in out.collect())

    put(0)
    assert count() == [(0, "a", 2), (1, "b", 1)]
    put(1)
    assert count() == [(0, "a", 2), (1, "b", 1), (5, "a", 1), (5, "b", 1)]


def test_spelling_over_documents(spark):
    """The registered query against every pair of a rare and a common word."""
    from sparkfacet.functions.text import ACCENTED, PLAIN

    df = Counter()
    for d in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist():
        folded = (d["text"] or "").lower().translate(str.maketrans(ACCENTED, PLAIN))
        df.update({w for w in re.split("[^a-z0-9]+", folded) if re.fullmatch("[a-z]{4,}", w)})
    common = [(t, set(t)) for t in df if df[t] >= 5]
    rare = sorted(w for w in df if df[w] == 1)
    got = {r.word: (r.term, r.distance) for r in catalog.QUERIES["spell_corrections"](spark, SF).collect()}
    assert set(got) <= set(rare)
    for w in rare:
        k = 2 if len(w) >= 8 else 1 if len(w) >= 5 else 0
        letters = set(w)
        near = [t for t, s in common if abs(len(t) - len(w)) <= k and len(s - letters) <= k and len(letters - s) <= k]
        best = min(((distance(w, t), -df[t], t) for t in near if distance(w, t) <= k), default=None)
        assert got.get(w) == (best and (best[2], best[0])), w
