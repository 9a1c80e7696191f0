"""The registered queries of the training-data operators against plain brute-force versions, over whole tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest

SF = "/root/testdata/sf0.001"


def read(name, sf=SF):
    return ds.dataset(f"{sf}/{name}.parquet").to_table().to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {d["doc_id"]: d["text"] or "" for d in read("documents")}


def rows(spark, name, key="doc_id", sf=SF):
    from sparkfacet.llm.queries import queries

    return {r[key]: r for r in queries()[name](spark, sf).collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def base_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii(spark, docs):
    for i, r in rows(spark, "op1_pii").items():
        want = base_pii(docs[i])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone"))
        joined = ["%s:%d:%d" % s for s in want]
        assert r.base_sha256 == sha(",".join(joined))
        assert set(joined) <= set(r.spans.split(","))  or not joined


def without_repeats(texts):
    """(kept bytes, removed bytes, removed runs) of each text, by a set of all strings of 100 bytes before it."""
    out, seen = {}, set()
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        out[i] = bytes(x for x, g in zip(b, gone) if not g), sum(gone), len(re.findall(rb"\x01+", bytes(gone)))
    return out


def test_suffix_dedup(spark, docs):
    got = rows(spark, "op4_suffix_dedup")
    for i, (kept, removed, runs) in without_repeats(docs).items():
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(docs[i].encode()), removed, runs, sha(kept))


def test_passages_of_many_documents(spark):
    """A passage in each document, between words of its own: anchors at its edges spread over tasks, or none does."""
    import random

    from sparkfacet.llm.substring_dedup import remove_repeats

    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))

    def own():
        return " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30)))

    texts = {i: f"{own()} {passage[rng.randrange(40) if i % 3 else 0:]} {own()}" for i in range(60)} | {60: "ab" * 300, 61: "x" + "ab" * 300, 62: "", 63: passage}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = without_repeats(texts)
    for heavy in (1, 8, 10_000):
        got = {r.doc_id: r for r in remove_repeats(frame, heavy=heavy).collect()}
        assert {i: (bytes(r.kept), sum(s.end - s.start for s in r.spans), len(r.spans)) for i, r in got.items()} == want


def test_refinement_of_buckets():
    """The flags of windows in blocks, against a set of their bytes; few letters, so that strings repeat and overlap."""
    import numpy as np

    from sparkfacet.llm.substring_dedup import repeated_windows

    rng = np.random.default_rng(4)
    for letters in (1, 2, 250):
        stock = rng.integers(0, letters, 400).astype(np.uint8)
        parts = [stock[a : a + n].tobytes() for a, n in zip(rng.integers(0, 250, 50).tolist(), rng.integers(100, 151, 50).tolist())]
        lengths, seen, want = np.array([len(p) for p in parts]), set(), []
        for p in parts:
            for k in range(len(p) - 99):
                want.append(p[k : k + 100] in seen)
                seen.add(p[k : k + 100])
        assert repeated_windows(np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(parts), np.uint8)).tolist() == want


def test_itq_dedup(spark):
    data = [r for r in read("embeddings")]
    got = rows(spark, "op6_itq_dedup", "vec_id")
    v = np.array([r["embedding"] for r in data], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    labels = np.array([r["label"] for r in data])
    links = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    want, have = links.sum(), sum(r.n_links for r in got.values())
    assert have <= want and have >= 0.9 * want
    for r in got.values():
        assert r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id


def test_license_scan(spark, docs):
    for i, r in rows(spark, "op8_license_scan").items():
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in docs[i])
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not places
        assert 0 <= r.score <= 1


def test_url_filter(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = {p["page_id"]: p["url"] for p in read("pages")}
    seen = Counter()
    for i, r in rows(spark, "op9_url_filter", "page_id").items():
        rest = urls[i].split("://", 1)[1] if urls[i] and "://" in urls[i] else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")
        seen[r.verdict] += 1
    assert len(seen) == 2


def test_bpe(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in rows(spark, "op10_bpe").items():
        ids = library.encode(docs[i], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_toxicity(spark):
    """Held-out accuracy: the model is fitted on the labels of even ids and judged on odd ones."""
    from pyspark.sql import functions as F
    from sparkfacet.llm import toxicity

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_severity(docs, labels.filter(F.col("doc_id") % 2 == 0))
    out = toxicity.with_severity(docs, model).join(labels.filter(F.col("doc_id") % 2 == 1), "doc_id").select("toxic", F.col("severity.toxic").alias("said"), "severity.expected", "severity.grade").collect()
    assert np.mean([r.said == (r.toxic == 1) for r in out]) > 0.92
    assert all(0 <= r.expected <= 3 and r.grade == round(r.expected) for r in out)
