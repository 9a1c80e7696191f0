"""Nulls, empty texts and tables, ties, repeated rows and clashing columns for the training-data operators."""

import pytest

WORDS = " ".join(f"w{k}" for k in range(80))
ROWS = [
    (1, WORDS, "en", "s", 1), (2, WORDS, "en", None, 1), (2, WORDS, "en", None, 1), (3, None, None, "s", None), (4, "", "en", "s", 0), (5, "one", "de", "s", 3),
    (6, WORDS + " x", "en", "s", 9), (7, "a" * 5000, "en", "s", 5000), (None, "MIT License, mail a.b@c.org or 10.0.0.1", "en", "t", 2), (8, WORDS.replace(" ", "\n"), "en", "t", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F
    from sparkfacet.llm._spark import ship

    ship(spark)
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(7) for c in ("id", "n", "k", "row", "tag", "sha", "maybe", "kept", "group_size")})  # names used inside


def test_exact(docs):
    from sparkfacet.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    rows = exact_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert (by[1].keep_id, by[1].group_size, by[1].kept, by[8].keep_id) == (1, 4, True, 1)
    assert by[3].keep_id == by[4].keep_id == 3
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "7", "None"]


def test_exact_with_a_full_field(docs):
    """A field of the smallest size sends more rows through the shuffle, with the same result."""
    from sparkfacet.llm.exact_dedup import exact_duplicates

    assert sorted(map(str, exact_duplicates(docs, max_bits=32768).collect())) == sorted(map(str, exact_duplicates(docs).collect()))


def test_ngram(docs):
    from sparkfacet.llm.ngram_join import jaccard_components

    rows = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_components(docs).collect()}
    assert rows[(1, 76)] == rows[(2, 76)] == rows[(6, 77)] == rows[(8, 76)] == 1
    assert rows[(3, 0)] == 3 and rows[(4, 0)] == 4 and rows[(5, 1)] == 5 and rows[(None, 2)] is None


def test_repeats(docs):
    from sparkfacet.llm.substring_dedup import remove_repeats

    rows = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert rows[1].n_bytes == len(rows[1].kept) and len(rows[2].kept) == 0
    assert len(rows[7].kept) == 100 and rows[7].spans[0].start == 100 or len(rows[7].kept) == 1
    assert rows[3].n_bytes == rows[4].n_bytes == 0


def test_the_other_operators(spark, docs):
    from sparkfacet.llm import license_scan, mixing, pii, toxicity

    found = {r.doc_id: r for r in pii.with_spans(docs, pii.fit_detector(docs)).collect()}
    assert [s.kind for s in found[None].base] == ["email", "ip"] and found[3].spans == []
    scans = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert scans[None].base[0].label == "mit" and scans[3].n_words == 0
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    tox = toxicity.with_severity(docs, toxicity.fit_severity(docs, labels))
    assert tox.count() == len(ROWS) and tox.filter("severity.toxic").count() == 0
    mixed = mixing.with_mixture(docs)
    assert mixed.count() == len(ROWS) and mixed.columns[: len(docs.columns)] == docs.columns


def test_marginals(spark):
    """Weighted tokens meet the target shares."""
    from pyspark.sql import functions as F
    from sparkfacet.llm.mixing import with_mixture

    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.when(F.col("id") % 5 < 3, "en").otherwise("de").alias("lang"))
    out = with_mixture(frame, targets={"source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}, "lang": {"en": 0.5, "de": 0.5}})
    total = out.agg(F.sum(F.col("mix.n_tokens") * F.col("mix.weight"))).first()[0]
    for dim, goals in (("source", {"s0": 0.2, "s1": 0.3, "s2": 0.5}), ("lang", {"en": 0.5, "de": 0.5})):
        have = {r[0]: r[1] / total for r in out.groupBy(dim).agg(F.sum(F.col("mix.n_tokens") * F.col("mix.weight"))).collect()}
        assert all(abs(have[k] - v) < 0.01 for k, v in goals.items())


def test_vectors(spark):
    from sparkfacet.llm.embedding_dedup import similar_vectors

    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.1, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [0.0, 0.0, 0.0], 1), (6, None, 1), (7, [1.0, None, 0.0], 1), (8, [1.0, 0.0, 0.0], None), (9, [nan, 0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got[1][0] >= 1 and got[2][1] == 1 and got[4] == (0, 4, True)
    assert all(got[k] == (0, k, True) for k in (5, 6, 7, 8, 9))


def test_empty_tables(spark, docs):
    from sparkfacet.llm import bpe, embedding_dedup, exact_dedup, license_scan, mixing, ngram_join, pii, substring_dedup
    from sparkfacet.llm.queries import tokenizer_path

    none = docs.filter("false")
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.drop_exact_duplicates(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == substring_dedup.remove_repeats(none).count() == 0
    assert mixing.with_mixture(none).count() == license_scan.scan_licenses(none).count() == 0
    assert pii.with_spans(none, pii.fit_detector(none)).count() == bpe.encode_decode(none, tokenizer_path()).count() == 0
    assert embedding_dedup.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_bitmaps_bound_the_difference():
    import numpy as np
    from sparkfacet.llm.ngram_join import parities

    rng = np.random.default_rng(5)
    for n in (1, 50, 1000, 20000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
        x, y = (np.frombuffer(parities(s), np.uint8) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_near_copies_of_all_lengths(spark):
    """Families of edited copies, short and long, against every pair's similarity."""
    import random

    from sparkfacet.llm._spark import ship
    from sparkfacet.llm.ngram_join import jaccard_components

    ship(spark)
    rng, texts = random.Random(3), []
    for length in (8, 30, 120, 600, 3000):
        for _ in range(3):
            first = [f"w{rng.randrange(400)}" for _ in range(length)]
            for edits in (0, 1, 1, 2, 4, length // 40, length // 25):
                words = list(first)
                for at in rng.sample(range(length), min(edits, length)):
                    words[at] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * 80 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame).collect()}
    assert got == {k: (len(s), root[k]) for k, s in enumerate(sets)}
