"""The pipeline against a plain version of all its stages, and its stages on odd rows."""

import hashlib
import re

import numpy as np
import pyarrow.dataset as ds
import pytest

SF = "/root/testdata/sf0.001"
WHITE = r"[\x20\x09-\x0D]+"


def read(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pylist()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in re.split(WHITE, text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def not_toxic(docs, model):
    """Scores word by word in Python, with the fitted weights."""
    from sparkfacet.llm._arrow import ALNUM, word_hashes

    weight, known = dict(zip(model.words.tolist(), model.weights.tolist())), {}
    for d in docs:
        score = 0.0
        for w in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"] or ""))):
            if w not in known:
                raw = np.frombuffer(w.encode(), np.uint8)
                known[w] = int(word_hashes(raw, np.array([0, len(raw)]), ALNUM)[0][0])
            score += weight.get(known[w], 0.0)
        if 1 / (1 + np.exp(model.cuts[0] - score)) < 0.5:
            yield d


def first_of_equals(docs):
    best = {}
    for d in docs:
        key, rank = re.sub(WHITE, "", d["text"] or ""), (-len(d["text"] or ""), d["doc_id"])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, d)
    return [d for _, d in best.values()]


def first_of_near(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    sets, root = [], list(range(len(docs)))
    for d in docs:
        w = words(lower(d["text"] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [d for k, d in enumerate(docs) if root[k] == k]


def drawn(docs):
    def topic(t):
        return next((name for sign, name in (("icense", "legal"), ("@", "contact"), ("|", "table"), ("?", "quest")) if sign in (t or "")), "prose")

    cell_of = [(d["source"], d["lang"], topic(d["text"])) for d in docs]
    n = {}
    for cell, d in zip(cell_of, docs):
        n[cell] = n.get(cell, 0) + len(words(d["text"]))
    whole = sum(n.values())
    goals = []
    for dim in range(3):
        sums = {}
        for cell, x in n.items():
            sums[cell[dim]] = sums.get(cell[dim], 0) + x
        tempered = {v: (x / whole) ** 0.7 for v, x in sums.items()}
        goals.append({v: x / sum(tempered.values()) for v, x in tempered.items()})
    w = dict.fromkeys(n, 1.0)
    for _ in range(6):
        for dim in range(3):
            have = {}
            for cell in n:
                have[cell[dim]] = have.get(cell[dim], 0) + n[cell] * w[cell]
            w = {cell: w[cell] * goals[dim][cell[dim]] / have[cell[dim]] if have[cell[dim]] else 0.0 for cell in w}
    c = 0.0
    for _ in range(6):
        full = {cell for cell in n if w[cell] * c >= 1}
        rest = sum(n[cell] * w[cell] for cell in n if cell not in full)
        if not rest:
            break
        c = max(c, (0.5 * whole - sum(n[cell] for cell in full)) / rest)
    for cell, d in zip(cell_of, docs):
        if int(hashlib.md5(f"mix:{d['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32 < min(1.0, w[cell] * c):
            yield d


def test_pipeline(spark):
    """run() gives the rows of the plain version, stage after stage, over the whole table. Only the fitted weights are shared."""
    import corpus_pipeline
    import public_tokenizers
    from sparkfacet.llm import toxicity
    from sparkfacet.llm._spark import ship
    from tokenizers import Tokenizer

    ship(spark)
    docs = read("documents")
    model = toxicity.fit_severity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    left = [list(not_toxic(docs, model))]
    for stage in (first_of_equals, first_of_near, drawn):
        left.append(list(stage(left[-1])))
    assert len(docs) > len(left[0]) > len(left[1]) > len(left[2]) > len(left[3]) > 0  # each stage has work to do
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d in left[-1]:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want[d["doc_id"]] = (ids, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == len(want)
    assert {r.doc_id: (r.token_ids, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


ODD = [
    (1, "one two three four five six", "en", "s", 27), (1, "one two three four five six", "en", "s", 27), (2, "one  two three four five six", None, "s", 28), (3, None, "en", None, None),
    (4, "", "en", "s", 0), (None, "a text without an id", "de", "t", 20), (5, "b" * 300_000, "en", "t", 300_000), (6, " \n\t", "en", "s", 3),
]


@pytest.mark.parametrize("some", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, some):
    """Nulls, repeated rows, empty and long texts, clashing columns; and empty tables. All but the last stage keep the columns."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD if some else [], "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumns({c: F.lit(7) for c in ("id", "k", "tag", "sha", "mix", "severity", "component_id", "row")})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, 1)] if some else [], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == frame.columns
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == (["2", "5", "6", "None"] if some else [])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
