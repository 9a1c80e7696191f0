"""What is deleted and what stays, keys in small tables, very long hosts, and columns with clashing names in the pipeline's stages."""

import math

import pyarrow.dataset as ds

SF = "/root/testdata/sf0.001"


def test_only_own_tables_go(spark):
    from sparkfacet.llm._spark import own_tables, written

    kept = written(spark.range(5))
    with own_tables(spark):
        gone = written(spark.range(6))
        assert gone.count() == 6
    assert kept.count() == 5
    after = written(spark.range(7))
    assert after.count() == 7
    assert spark._jvm.java.io.File(gone.inputFiles()[0].removeprefix("file://")).exists() is False


def test_results_survive_the_pipeline(spark):
    import corpus_pipeline
    from sparkfacet.llm.queries import queries

    names = ("op2_mixing", "op6_itq_dedup", "op7_ngram_jaccard_join", "op12_conversation_trie")
    lazy = {n: queries()[n](spark, SF) for n in names}
    done = corpus_pipeline.run(spark, SF)
    assert done.count() > 0
    assert all(lazy[n].count() > 0 for n in names)


def test_clashing_columns_pass_the_stages(spark):
    """Columns named as a stage's own are kept through all stages but the last."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(c) for c in ("severity", "mix", "__severity", "key", "row", "keep_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns), name
        rows = out.select("severity", "mix", "__severity", "key", "row", "keep_id").distinct().collect()
        assert [tuple(r) for r in rows] == [("severity", "mix", "__severity", "key", "row", "keep_id")], name


def test_keys_are_found_in_a_small_table(spark):
    """sf0.01 has 13 keys of forty hexadecimal digits or so; no generator is switched off for being rare."""
    import re

    from sparkfacet.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    text = {d["doc_id"]: d["text"] or "" for d in ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()}
    spans = {r.doc_id: r.spans for r in queries()["op1_pii"](spark, sf).collect()}
    keys = [(i, m.start(), m.end()) for i, t in text.items() for m in re.finditer(r"(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])", t) if re.search("[a-f]", m.group())]
    found = sum(any(int(s.split(":")[1]) <= a and b <= int(s.split(":")[2]) for s in spans[i].split(",") if s) for i, a, b in keys)
    assert keys and found >= 0.9 * len(keys)
    clean = [i for i, t in text.items() if not re.search("[0-9]", t)]
    assert sum(spans[i] != "" for i in clean) <= 0.02 * len(clean) + sum("@" in text[i] for i in clean)


def test_a_host_and_a_word_of_20000_letters(spark):
    from sparkfacet.llm.url_filter import fit_bayes, marks, segment, with_verdicts

    word = "abcdefghij" * 2000
    rows = [(1, f"http://{word}x.example.org/es/a", f"<p>{word} words stand here</p>"), (2, f"http://{'q' * 20000}.net/", None), (3, "http://wordsstand.net/fr/", "words"), (4, "http://a.com/fr/", ""), (5, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in with_verdicts(pages, fit_bayes(pages)).collect()}
    assert got[1].words[:2] == [word, "x"] and got[3].words[:2] == ["words", "stand"] and got[2].words[0] == "q" * 20000
    assert got[1].verdict == "block" and got[4].verdict == "allow" and got[5].host == ""
    assert len({int(m) for found in marks("abcab", [2]) for m in found}) == 3  # ab, bc, ca
    assert next(marks("xxab", [2]))[0] in next(marks("abzz", [2])) or set(next(marks("xxab", [2])).tolist()) & set(next(marks("abzz", [2])).tolist())
    assert segment("theend", {"the": math.log(2), "end": math.log(3), "then": 5.0}) == ["the", "end"]
