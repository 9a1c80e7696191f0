"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on at most max_fit vectors (chosen by a hash of the id): principal components, then alternating
between signs and the orthogonal map closest to them, so that each bit of the code is balanced. Vectors of fewer than BITS
components get further bits from drawn rotations, so every code has BITS bits. Tables index parts of the code; vectors of one
label that agree on a part are candidates and are reranked by cosine in double precision on the original vectors. The
part's width follows the number of vectors. Pairs at the cosine threshold itself are planted beside other vectors of the sample, towards
drawn directions and towards other vectors; tables are drawn until the share RECALL of each kind meets, whatever the width.

Equal vectors are one class. Tables hold keys and codes only. A large bucket is cut into blocks that meet pairwise in separate
tasks; there codes are compared first, and only members with another one within the Hamming radius (that of nearly all planted
pairs) fetch their vectors, as they came (float or double), and are reranked. A pair that several tables find counts in the
first one only. What leaves a task is, for each vector, its number of links and one edge to the smallest member it is
connected with there: never the pairs themselves.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those without label, link with
nothing; vectors of different lengths never link; equal vectors link if valid; repeated rows (same id too) count as
vectors of their own; a null id comes after all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._spark import components, spread_join, written

MAX_FIT, ROUNDS, BLOCK, BITS = 20_000, 30, 512, 64
#: Least share of the pairs at the threshold that meet, and of those planted to see it (more, as they are a sample); these pairs and the most tables of a width.
RECALL, PLANTED_RECALL, PLANTED, MOST = 0.95, 0.965, 4000, 128
#: Share of planted pairs that the Hamming radius takes in.
NEAR = 0.998


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, map): the code of v is the signs of (v - mean) @ map."""
    mean = x.mean(axis=0)
    _, _, basis = np.linalg.svd(x - mean, full_matrices=False)
    basis = basis[:bits].T
    low = (x - mean) @ basis
    draw = np.random.default_rng(7)

    def drawn() -> np.ndarray:
        return np.linalg.qr(draw.standard_normal((low.shape[1],) * 2))[0]

    turn = drawn()
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(low @ turn).T @ low)
        turn = (u @ v).T
    turns = [turn, *(drawn() for _ in range(-(-bits // low.shape[1]) - 1))]
    return mean, basis @ np.concatenate(turns, axis=1)[:, :bits]


def planted(u: np.ndarray, model: tuple[np.ndarray, np.ndarray], least: float) -> list[np.ndarray]:
    """For pairs of cosine least, which bits of the code differ: u (unit vectors) with partners towards drawn directions, and towards each other."""
    mean, turn = model
    draw = np.random.default_rng(5)
    at = draw.integers(0, len(u), PLANTED)
    one, out = u[at], []
    for to in (draw.standard_normal(one.shape), u[draw.integers(0, len(u), PLANTED)]):
        side = to - (to * one).sum(axis=1, keepdims=True) * one
        size = np.sqrt((side * side).sum(axis=1, keepdims=True))
        ok = size[:, 0] > 1e-6  # none beside a vector of one component, or towards itself
        if ok.any():
            other = least * one[ok] + np.sqrt(1 - least * least) * side[ok] / size[ok]
            out.append(((one[ok] - mean) @ turn > 0) != ((other - mean) @ turn > 0))
    return out


def tables(rows: int, bits: int, least: float = 0.93, differ: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The bits of each table's part, drawn until PLANTED_RECALL of each kind of pairs meets. differ: the bits in which
    pairs of cosine least differ; by default those of drawn hyperplanes. If MOST tables don't do, parts get narrower."""
    if differ is None:
        differ = [np.random.default_rng(3).random((PLANTED, bits)) < math.acos(least) / math.pi]
    width = min(max(8, math.ceil(math.log2(max(rows, 1) / 64))), 24, bits)
    while True:
        draw = np.random.default_rng(11)
        out, open_, order = [], list(differ), draw.permutation(bits)
        short = lambda: any(len(o) > (1 - PLANTED_RECALL) * len(d) for o, d in zip(open_, differ))
        while not out or short() and len(out) < MOST:
            if len(order) < width:  # parts of one permutation share no bits
                order = draw.permutation(bits)
            out.append(np.sort(order[:width]))
            order = order[width:]
            open_ = [o[o[:, out[-1]].any(axis=1)] for o in open_]
        if not short():
            return out
        width -= 1


def fit(units: np.ndarray, rows: int, least: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """(mean, map, tables, radius). Pairs are planted beside vectors that the map wasn't learned on: it suits its own ones better."""
    own = np.arange(len(units)) % 5 == 0 if len(units) >= 50 else None
    model = learn_rotation(units if own is None else units[~own])
    bits = model[1].shape[1]
    if len(units) < 50:
        return *model, [np.zeros(0, np.int64)] if rows <= BLOCK else tables(rows, bits, least), bits
    differ = planted(units if own is None else units[own], model, least)
    radius = max((int(np.quantile(d.sum(axis=1), NEAR)) + 1 for d in differ), default=bits)
    near = [d[d.sum(axis=1) <= radius] for d in differ]
    return *model, [np.zeros(0, np.int64)] if rows <= BLOCK else tables(rows, bits, least, near), radius  # up to BLOCK all meet


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, k: key of label and vector or null if it links with nothing, label, v: the components' bytes, float or double as given)."""
    kind = vectors.schema[id_col].dataType.simpleString()
    number = _number(vectors, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, labels = batch.column(1), batch.column(2)
            flat, off = lists.values.to_numpy(zero_copy_only=False).astype(number) + number(0), lists.offsets.to_numpy()  # nulls as NaN, no negative zeros
            ends = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            good = (ends[off[1:]] == ends[off[:-1]]) & (some[off[1:]] > some[off[:-1]]) & np.array(lists.is_valid()) & np.array(labels.is_valid())
            keys: list[bytes | None] = [None] * len(good)
            values: list[bytes | None] = [None] * len(good)
            for i, label in zip(np.flatnonzero(good).tolist(), labels.filter(pa.array(good)).to_pylist()):
                values[i] = flat[off[i] : off[i + 1]].tobytes()
                keys[i] = hashlib.blake2b(values[i] + b"|" + label.encode(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), labels, pa.array(values, pa.binary())], names=["id", "k", "label", "v"])

    return vectors.select(id_col, vector_col, F.col(label_col).cast("string").alias("label")).mapInArrow(run, f"id {kind}, k binary, label string, v binary")


def _number(vectors: DataFrame, vector_col: str) -> type:
    return np.float32 if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int = 5000) -> Iterator[pa.Table]:
    """The rows of sorted batches, a table for each value of the column."""
    held: list[pa.RecordBatch] = []

    def groups(last: bool) -> Iterator[pa.Table]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(column).to_numpy(zero_copy_only=False).astype(object)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        stop = len(edges) - 1 if last else len(edges) - 2
        held = table.slice(edges[stop]).to_batches()
        for a, b in zip(edges[:stop], edges[1 : stop + 1]):
            yield table.slice(a, b - a)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) > rows:
                yield from groups(False)
    if held:
        yield from groups(True)


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, max_fit: int = MAX_FIT) -> DataFrame:
    """id_col, n_links, component_id and kept of each row."""
    spark, number = vectors.sparkSession, _number(vectors, vector_col)
    width = np.dtype(number).itemsize
    rows = written(_keyed(vectors, id_col, vector_col, label_col))
    valid = rows.filter("k is not null")
    classes = written(valid.groupBy("k").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("size"), F.min("id").alias("low")).withColumn("dim", (F.length("v") / width).cast("int")))
    n = classes.count()
    main = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if main is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = main["dim"]
    sample = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("k"), "k").limit(max_fit).select("v").toArrow().column("v").to_pylist()
    units = unit(np.frombuffer(b"".join(sample), number).reshape(-1, dim))
    model = spark.sparkContext.broadcast(fit(units, n, least))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn, parts, _ = model.value
        powers = [np.left_shift(1, np.arange(len(p))[::-1]) for p in parts]
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                own = pa.array(np.flatnonzero(dims == d))
                u = unit(np.frombuffer(b"".join(batch.column(1).take(own).to_pylist()), number).reshape(-1, d))
                u = u[:, np.arange(len(mean)) % d]  # as long as the model's
                code = (u - mean) @ turn > 0
                packed = np.packbits(code, axis=1)
                at = np.stack([code[:, p] @ w for p, w in zip(parts, powers)], axis=1)
                m, size = len(parts), len(own)
                many = pa.array(np.repeat(own.to_numpy(), m))
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), size, [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(many), batch.column(3).take(many), batch.column(2).take(many), pa.array(np.tile(np.arange(m, dtype=np.int32), size)), pa.array(at.ravel().astype(np.int64)), codes.take(pa.array(np.repeat(np.arange(size), m)))], names=["k", "label", "dim", "part", "at", "code"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a bucket with another one (of another block, where two meet) within the radius."""
        radius = model.value[3]
        for table in whole_groups(batches, "bucket"):
            if table.num_rows < 2:
                continue
            code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            close = np.zeros((len(code), len(code)), np.uint16)
            for byte in code.T:
                close += np.bitwise_count(byte[:, None] ^ byte[None, :])
            meets = close <= radius
            np.fill_diagonal(meets, False)
            if table.column("mixed")[0].as_py():
                block = table.column("block").to_numpy()
                meets &= block[:, None] != block[None, :]
            yield from table.filter(pa.array(meets.any(axis=1))).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            found = _links(table, number, model.value[2], model.value[3], least) if table.num_rows > 1 else None
            if found is not None:
                yield found

    indexed = classes.select("k", "v", "dim", "label").mapInArrow(index, "k binary, label string, dim int, part int, at long, code binary")
    indexed = written(indexed.select("k", "part", "code", F.concat_ws("|", "part", "at", "dim", "label").alias("bucket")))
    sizes = indexed.groupBy("bucket").agg(F.count(F.lit(1)).alias("r")).filter("r > 1")
    meet = spread_join(indexed, written(sizes), "bucket", "r")
    blocks = F.ceil(F.col("r") / BLOCK).cast("int")
    meet = meet.withColumn("block", F.pmod(F.xxhash64("k"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.concat_ws("|", F.least("block", "with"), F.greatest("block", "with"), "bucket")
    meet = meet.select(pair.alias("bucket"), (F.least("block", "with") != F.greatest("block", "with")).alias("mixed"), "block", "k", "part", "code")
    meet = meet.repartition("bucket").sortWithinPartitions("bucket")
    close = written(meet.mapInArrow(near, "bucket string, mixed boolean, block int, k binary, part int, code binary"))
    close = close.join(classes.select("k", "v", "size"), "k").select("bucket", "mixed", "block", "k", "v", "size", "part", "code")
    links = written(close.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "k binary, links long, root binary"))
    roots = components(links.filter("k != root"), "k", "root")
    counts = links.groupBy("k").agg(F.sum("links").alias("links"))

    of = classes.select("k", "size", "low").join(roots.withColumnRenamed("id", "k"), "k", "left").join(counts, "k", "left")
    of = written(of.select("k", "size", "low", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    best = written(of.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("r")))
    label = written(spread_join(of.select("k", "size", "root", "links"), best, "root", "r").select("k", "size", "links", "component_id"))
    done = spread_join(valid.select("id", "k"), label, "k", "size").select("id", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id")
    alone = rows.filter("k is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = done.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return both.withColumnRenamed("id", id_col)


def _links(rows: pa.Table, number: type, parts: list[np.ndarray], radius: int, least: float) -> pa.RecordBatch | None:
    """(k, links: rows linked with it here, root: smallest key connected with it here) of a bucket's members that link."""
    k = rows.column("k").to_pylist()
    block, size = rows.column("block").to_numpy(), rows.column("size").to_numpy()
    mixed, part = bool(rows.column("mixed")[0].as_py()), rows.column("part")[0].as_py()
    u = unit(np.frombuffer(b"".join(rows.column("v").to_pylist()), number).reshape(len(k), -1))
    code = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(k), -1), axis=1)
    i, j = np.nonzero(np.triu(u @ u.T >= least - 1e-9, 1))
    if len(i):
        keep = ((u[i] * u[j]).sum(axis=1) >= least) & ((code[i] != code[j]).sum(axis=1) <= radius)
        if mixed:
            keep &= block[i] != block[j]
        for t in range(part):  # a pair counts in the first table that finds it
            keep &= (code[i][:, parts[t]] != code[j][:, parts[t]]).any(axis=1)
        i, j = i[keep], j[keep]
    if not len(i):
        return None
    links = np.bincount(i, size[j], len(k)) + np.bincount(j, size[i], len(k))
    order = np.argsort(np.array(k, object), kind="stable")
    rank = np.empty(len(k), np.int64)
    rank[order] = np.arange(len(k))
    root = rank.copy()
    while True:  # the smallest rank of the neighbours, until nothing changes
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            break
        root = new
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array([k[h] for h in hit], pa.binary()), pa.array(links[hit].astype(np.int64)), pa.array([k[order[root[h]]] for h in hit], pa.binary())], names=["k", "links", "root"])
