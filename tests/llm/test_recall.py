"""Recall of op6's tables against brute force, on pairs planted at and above the cosine threshold."""

import math

import numpy as np
import pytest


@pytest.mark.parametrize("rows", [500, 10_000, 1_000_000, 30_000_000, 3_000_000_000])
@pytest.mark.parametrize("bits", [16, 32, 64])
def test_tables(rows, bits):
    from sparkfacet.llm.embedding_dedup import tables

    differ = np.random.default_rng(1).random((20_000, bits)) < math.acos(0.93) / math.pi
    met = np.zeros(len(differ), bool)
    for part in tables(rows, bits):
        met |= ~differ[:, part].any(axis=1)
    assert met.mean() >= 0.95


@pytest.mark.parametrize("size", [2, 8, 16, 32, 64, 100])
@pytest.mark.parametrize("rows", [3000, 30_000_000])
def test_codes(size, rows):
    """Vectors around a common direction too; partners at the threshold."""
    from sparkfacet.llm.embedding_dedup import fit, unit

    draw = np.random.default_rng(2)
    for shift in (0.0, 1.0):
        u = unit(draw.standard_normal((3000, size)) + shift)
        mean, turn, parts, radius = fit(u, rows, 0.93)
        new = unit(draw.standard_normal((3000, size)) + shift)
        side = draw.standard_normal(new.shape)
        side = unit(side - (side * new).sum(axis=1, keepdims=True) * new)
        one, two = ((x - mean) @ turn > 0 for x in (new, 0.93 * new + math.sqrt(1 - 0.93**2) * side))
        met = np.zeros(len(new), bool)
        for part in parts:
            met |= (one[:, part] == two[:, part]).all(axis=1)
        met &= (one != two).sum(axis=1) <= radius
        assert met.mean() >= 0.95, (shift, len(parts), met.mean())


@pytest.mark.parametrize("size, many, kind", [(16, 1000, "double"), (64, 10_500, "float")])
def test_operator_on_planted_pairs(spark, size, many, kind):
    """Partners at cosines of 0.9301 to 0.99 in five labels; the larger table uses wider parts. Links and components by brute force."""
    import pyarrow as pa
    from sparkfacet.llm.embedding_dedup import similar_vectors, unit

    draw = np.random.default_rng(4)
    u = unit(draw.standard_normal((many, size)))
    side = draw.standard_normal(u.shape)
    side = unit(side - (side * u).sum(axis=1, keepdims=True) * u)
    cosine = np.linspace(0.9301, 0.99, len(u))[:, None]
    v = np.concatenate([u, cosine * u + np.sqrt(1 - cosine**2) * side]).astype(np.float32 if kind == "float" else np.float64)
    labels = np.arange(len(v)) % 5
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), size).cast(pa.list_(pa.from_numpy_dtype(v.dtype))), "label": labels}))
    want, root = 0, np.arange(len(v))
    for label in range(5):
        own = np.flatnonzero(labels == label)
        e = unit(v[own])
        i, j = np.nonzero(np.triu(e @ e.T >= 0.93, 1))
        want += 2 * len(i)
        while True:
            before = root.copy()
            np.minimum.at(root, own[i], root[own[j]])
            np.minimum.at(root, own[j], root[own[i]])
            if (root == before).all():
                break
    got = similar_vectors(frame).toPandas().sort_values("vec_id")
    have = got.n_links.sum()
    assert want >= 2 * many and 0.95 * want <= have <= want
    assert (got.component_id.to_numpy() == root).mean() >= 0.95 and (got.component_id.to_numpy() >= root).all()
    assert (got.kept == (got.vec_id == got.component_id)).all()
