"""Attention over passages, the conversation trie and whitening, against plain versions and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.StringType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("quality", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("n", T.StringType())])


# the trie


def plain_trie(conversations):
    """conversations: id -> list of (role, text), rebuilt already."""
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(conversations):
        for d in range(len(conversations[c]) + 1):
            members[tuple(conversations[c][:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ended = {p: ",".join(str(c) for c in m if len(conversations[c]) == len(p)) for p, m in members.items()}
    return {(m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ended[p].encode()).hexdigest()) for p, m in members.items()}


def rebuilt(rows):
    own = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            own[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + own[c][h[c] :] for c in own}


def as_dict(frame):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()}


def test_trie_query(spark):
    from sparkfacet.llm.queries import queries

    want = plain_trie(rebuilt(ds.dataset(f"{SF}/conversations.parquet").to_table().to_pylist()))
    assert as_dict(queries()["op12_conversation_trie"](spark, SF)) == want


def test_trie_sql(spark):
    import duckdb
    from sparkfacet.llm.queries import oracle_sql, queries

    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = {(r[0], r[1]): r[2:] for r in c.sql(oracle_sql()["op12_conversation_trie"]).fetchall()}
    assert want == as_dict(queries()["op12_conversation_trie"](spark, SF)) and len(want) > 100


def odd_turns():
    draw, rows = random.Random(3), []
    for c in [0, 1, 2, 3, 4, 5, 6, 7, 99, 100, 101, 150, 199, 777, 10**12, 10**12 + 1, -5]:
        for t in range(draw.randrange(1, 9)):
            rows.append((c, draw.choice([None, t, t, 3]), draw.choice([None, "user", "assistant"]), draw.choice([None, "", "a", "é\U0001f600", "a b"]), "x"))
    rows += [(None, 1, "user", "lost", "x"), (8, 0, "user", "a", "x"), (8, 0, "user", "a", "x")]  # no id; repeated rows
    rows += [(9, t, "user", "again", "x") for t in range(30)] + [(11, t, "user", "again", "x") for t in range(33)]
    return rows


def test_trie_on_odd_rows(spark):
    from sparkfacet.llm.conversation_trie import ordered_turns, prefix_trie, with_shared_starts

    rows = odd_turns()
    want = plain_trie(rebuilt([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]))
    turns, convs = with_shared_starts(ordered_turns(spark.createDataFrame(rows, TURNS)))
    assert as_dict(prefix_trie(turns, convs)) == want
    assert as_dict(prefix_trie(turns, convs, shard=3, stretch=4)) == want  # many shards and stretches


def test_trie_of_nothing(spark):
    from sparkfacet.llm.conversation_trie import ordered_turns, prefix_trie, with_shared_starts

    assert prefix_trie(*with_shared_starts(ordered_turns(spark.createDataFrame([], TURNS)))).collect() == []


def test_trie_whose_chains_hang_deep(spark):
    """Each conversation branches off the one before it, so the tree of chains is a path; a long list of ends at the root."""
    from sparkfacet.llm.conversation_trie import prefix_trie

    convs = {c: [("u", "s")] * c + [("u", f"own {c}")] * (c % 3) for c in range(40)} | {c: [] for c in range(100, 160)}
    rows = [(c, k + 1, hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1])) for c, v in convs.items() for k, t in enumerate(v)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, turn binary, n_chars long")
    lengths = spark.createDataFrame([(c, len(v)) for c, v in convs.items()], "conv_id long, n_turns long")
    assert as_dict(prefix_trie(turns, lengths, shard=7, stretch=5)) == plain_trie(convs)


def test_a_lists_pieces_hash_as_one(monkeypatch):
    from sparkfacet.llm import conversation_trie as trie

    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    ids = list(range(5, 100, 3))
    rows = pa.RecordBatch.from_pydict({"key": pa.array([b"a"] * len(ids) + [b"b"], pa.binary()), "id": pa.array([*ids, 1], pa.int64())})
    pieces = list(trie._packed_ends(iter([rows.slice(0, 10), rows.slice(10)])))
    assert len(pieces) > 4
    done = {k: v for b in trie._hashed_ends(iter(pieces)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert done == {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"1").hexdigest()}


# whitening


def plain_whitening(vectors, k=16):
    """(n, deviations, whitened, explained) by the library's eigenvalues."""
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    z = fit - total / n
    value, vector = np.linalg.eigh(z.T @ z / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ vector / np.sqrt(value), value / np.trace(z.T @ z / n)


def test_whitening_query(spark):
    from sparkfacet.llm.queries import queries

    table = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pandas().sort_values("vec_id")
    n, deviation, white, share = plain_whitening(np.stack(table.embedding).astype(float))
    got = queries()["op13_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(table) and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    assert got.deviation.to_numpy().reshape(-1, 16)[:, 0].tolist() == deviation.tolist()
    mine = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-8
    assert np.abs(got.explained.to_numpy().reshape(-1, 16) / share - 1).max() < 1e-10


@pytest.mark.parametrize("make", ["plain", "flat", "equal", "clusters", "steep", "split"])
def test_eigenvectors(make):
    from sparkfacet.llm.whitening import leading

    draw = np.random.default_rng(5)
    a = draw.standard_normal((300, 50))
    turn = np.linalg.qr(draw.standard_normal((50, 50)))[0]
    v = {"plain": a.T @ a, "flat": a[:10].T @ a[:10], "equal": np.eye(50) * 3, "clusters": turn @ np.diag([5.0] * 8 + [5 + 1e-9] * 8 + [1.0] * 34) @ turn.T, "steep": turn @ np.diag(10.0 ** -np.arange(50)) @ turn.T, "split": np.kron(np.eye(5), (a.T @ a)[:10, :10])}[make]
    value, vector = leading(v, 16)
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(value) == {"flat": 10, "steep": 11}.get(make, 16)
    assert np.allclose(value, want[: len(value)], rtol=1e-12, atol=1e-13 * want[0])
    assert np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-12 and np.abs(v @ vector - vector * value).max() < 1e-12 * want[0]


def test_whitening_on_odd_rows(spark):
    from sparkfacet.llm.whitening import fit_whitening, with_whitened

    draw = np.random.default_rng(6)
    good = draw.standard_normal((40, 3))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(good)]
    rows += [(100, good[0].tolist(), "x"), (None, good[1].tolist(), "x")]  # equal vectors count once in the fit
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1e300, 0.0, 0.0]]
    rows += [(200 + i, v, "x") for i, v in enumerate(odd)]
    rows += [(300 + i, v, "x") for i, v in enumerate([[1.0, 2.0], [3.0, 5.0], [1.0, 2.0]])] + [(400, [7.0], "x")]  # other lengths
    frame = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: r for r in with_whitened(frame, fit_whitening(frame)).collect()}
    n, deviation, white, _ = plain_whitening(good)
    mine = np.array([got[i].whitening.whitened for i in range(40)])
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert [got[i].whitening.deviation for i in range(40)] == deviation.tolist() and got[0].whitening.n == n == 40
    assert got[100].whitening == got[0].whitening and got[None].whitening == got[1].whitening
    assert all(got[200 + i].whitening is None for i in range(len(odd)))
    assert got[300].whitening.n == 2 and len(got[300].whitening.whitened) == 1 and abs(abs(got[300].whitening.whitened[0]) - 1) < 1e-12
    assert got[400].whitening.whitened == [] and got[400].whitening.deviation == 0
    assert got[0].n == "x" and got[0].whitening.identity_error < 1e-10
    assert fit_whitening(spark.createDataFrame([], VECTORS)) == {}
    assert with_whitened(spark.createDataFrame([], VECTORS), {}).collect() == []


def test_deviations_beyond_a_long():
    from sparkfacet.llm.whitening import Whitening

    model = Whitening(3_000_000_000, [3_000_000_000 * 1_000_000 + 1] * 2, np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[1_000_000, 1_000_000], [1_000_001, 1_000_000], [1_000_002, 1_000_000]])
    want = [sum((3_000_000_000 * v - 3_000_000_000 * 1_000_000 - 1) ** 2 for v in r) for r in x.tolist()]
    assert model.deviation(x) == [w if w < 1 << 63 else None for w in want]


# quality


def test_quality_on_held_out_labels(spark):
    from sparkfacet.llm.queries import queries

    sf = "/root/testdata/sf0.1"
    good = {r["doc_id"]: r["quality"] for r in ds.dataset(f"{sf}/labels.parquet").to_table().to_pylist()}
    rows = queries()["op11_mil_quality"](spark, sf).collect()
    assert len(rows) == ds.dataset(f"{sf}/documents.parquet").count_rows() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in good]
    bad, fine = ([r.score for r in held if good[r.doc_id] == k] for k in (0, 1))
    order = np.argsort(np.concatenate([bad, fine]), kind="stable").argsort()
    auc = (order[len(bad) :].sum() - len(fine) * (len(fine) - 1) / 2) / len(bad) / len(fine)
    assert auc > 0.9
    assert np.mean(np.array(fine) >= 0.5) > 0.95 and np.mean(np.array(bad) < 0.5) > 0.7


def test_gradients_of_the_attention():
    """A text whose only bad passage is one of many is told from good ones: attention finds it."""
    from sparkfacet.llm.quality import FEATURES, fit

    draw = np.random.default_rng(8)
    counts = draw.integers(1, 30, 1200)
    x = draw.standard_normal((int(counts.sum()), FEATURES)).astype(np.float32)
    good = (np.arange(1200) % 2).astype(np.float32)
    at = np.cumsum(counts) - counts
    x[at[good == 0] + draw.integers(0, counts[good == 0]), :5] += 4
    model = fit(x[: at[900]], counts[:900], good[:900], epochs=60)
    hits = 0
    for a, n, y in zip(at[900:], counts[900:], good[900:]):
        h, e = model.parts(x[a : a + n])
        hits += ((e[:, None] * h).sum(axis=0) / e.sum() @ model.w["c"] + model.w["d"] > 0)[0] == y
    assert hits > 0.9 * 300


def test_passages_against_a_plain_version():
    from sparkfacet.llm import quality
    from sparkfacet.llm._arrow import text_buffers

    draw = random.Random(9)
    texts = ["", "  ", "one", None, " ".join(draw.choice(["a", "bb,", "ccc", "Ünder", "12", "\n"]) for _ in range(300)), "x " * 64, "x " * 65, "\t\v" * 9 + "end"]
    raw, offsets = text_buffers(pa.array(texts))
    features, block = quality.passages(raw, offsets)
    at = 0
    for i, t in enumerate(texts):
        words = (t or "").replace("\v", " ").split()
        n = max(1, -(-len(words) // 64))
        assert (block[at : at + n] == i).all()
        for k in range(n):
            part, row = words[64 * k : 64 * k + 64], features[at + k]
            shape = row[quality.KINDS : quality.KINDS + quality.SHAPES]
            assert shape[0] == np.float32(len(part) / 64) and shape[7] == (len(part) > 0)
            if part:
                assert np.isclose(shape[1], np.log1p(np.mean([len(w.encode()) for w in part])))
                assert np.isclose(shape[4], len({w.lower() for w in part}) / len(part))
                assert np.isclose(shape[6], np.mean([not w[-1].isalnum() for w in part]))
        at += n
    assert at == len(features)


def test_long_texts_go_by_blocks(monkeypatch):
    from sparkfacet.llm import quality
    from sparkfacet.llm._arrow import text_buffers

    monkeypatch.setattr(quality, "BLOCK", 1000)
    texts = ["word " * 1000, "short", "x" * 5000, ""]
    raw, offsets = text_buffers(pa.array(texts))
    cuts, rows = quality.blocks(raw, offsets)
    assert sorted(set(rows.tolist())) == [0, 1, 2, 3] and cuts[0] == 0 and cuts[-1] == len(raw) and np.diff(cuts).max() <= 1000 and (np.diff(cuts)[rows != 3] > 0).all()
    model = quality.fit(np.zeros((0, quality.FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32))
    assert model.scores(pa.array(texts)).tolist() == [0.5] * 4


def test_quality_on_odd_rows(spark):
    from sparkfacet.llm.quality import fit_quality, with_quality

    texts = ["good words stand here and there"] * 30 + ["### !!! ### !!!"] * 30 + [None, "", "a" * 200_000, "w " * 200_000]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "kept") for i, t in enumerate(texts)] + [(7, texts[7], "kept")], DOCS)
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(3, None), (None, 0), (999, 1)], LABELS)
    model = fit_quality(docs, labels)
    rows = with_quality(docs, model, into="score").collect()
    assert len(rows) == len(texts) + 1 and all(0 <= r.score <= 1 and r.quality == "kept" for r in rows)
    assert len({r.score for r in rows if r.text == texts[0]}) == 1
    assert min(r.score for r in rows if r.text == texts[0]) > 0.5 > max(r.score for r in rows if r.text == texts[40])
    assert [f.dataType.simpleString() for f in with_quality(docs, model).schema if f.name == "quality"] == ["double"]
    one_kind = fit_quality(docs, labels.filter("quality = 1"))
    assert {round(r.quality, 3) for r in with_quality(docs, one_kind).collect()} == {0.999}
    assert with_quality(docs.limit(0), fit_quality(docs.limit(0), labels)).collect() == []
