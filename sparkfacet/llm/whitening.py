"""Whitening of embeddings: principal components of the distinct vectors, fitted over all of them, and every vector projected.

An entry c becomes the whole number x = floor(64 c) + 1000000. The fit list holds each distinct x-vector once. Passes over it
add up, task by task: exact sums; products of the centred entries (the covariance, divisor n); and at the end the covariance
of the whitened vectors, whose distance from the identity is returned. What a pass sends is a square of the vector's length
for each task, never rows. The covariance goes to the driver (its size is the square of the vector's length, whatever the
number of rows) and is decomposed there: Householder reflections to tridiagonal form, bisection on Sturm counts for the
leading eigenvalues, inverse iteration for their vectors, orthogonalised again within clusters of close eigenvalues. The
components, up to 16 vectors, are broadcast, and all rows are projected in one pass without a shuffle.

Cases: a vector that is null, empty, or holds null or non-finite entries, or entries of 2**56 or more that leave no room for
x as a long, gets null. Vectors of each length are fitted on their own. Components whose eigenvalue is no more than 1e-10 of
the largest are noise of the arithmetic, can't be whitened and are left out, so a single distinct vector has none. A
deviation beyond a long is null. Repeated rows count once in the fit and each get their result; ties of eigenvalues give any
orthogonal vectors of their space; an empty table gives an empty result; other columns pass through, but for one named as
the result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._arrow import gather, list_array
from sparkfacet.llm._spark import written

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Least eigenvalue that counts, as a share of the largest; numbers in a slice that a task works on at once.
NOISE, SLICE = 1e-10, 4_000_000


@dataclass
class Whitening:
    """Of one length: n distinct vectors with their exact sums; components in columns, their eigenvalues and the covariance's trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def __post_init__(self) -> None:
        middle = [round(s / self.n) for s in self.sums]
        self.middle = np.array(middle, np.int64)
        self.left = np.array([s - self.n * m for s, m in zip(self.sums, middle)], np.int64)  # at most about n / 2

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: an exact difference of whole numbers less a fraction, so nothing cancels."""
        return (x - self.middle).astype(np.float64) - self.left / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2: in longs where they hold it, else in Python's whole numbers."""
        apart = x - self.middle
        rough = ((self.n * apart.astype(np.float64) - self.left) ** 2).sum(axis=1)
        exact = self.n * apart - self.left
        out: list[int | None] = (exact * exact).sum(axis=1).tolist()
        for i in np.flatnonzero(rough > 4e18).tolist():
            wide = sum((self.n * a - b) ** 2 for a, b in zip(apart[i].tolist(), self.left.tolist()))
            out[i] = wide if wide < 1 << 63 else None
        return out


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the rows that hold a valid vector, the lengths of these, their x one after another)."""
    flat = vectors.flatten()
    at = np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    scaled = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < 2.0**62))])
    rows = np.flatnonzero((np.diff(at) > 0) & (bad[at[1:]] == bad[at[:-1]]))
    lengths = np.diff(at)[rows]
    return rows, lengths, gather(scaled, at[rows], lengths).astype(np.int64) + SHIFT


def matrices(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Binary x-vectors of one size, in slices."""
    _, offsets, data = column.buffers()
    first, last = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]] if len(column) else (0, 0)
    x = np.frombuffer(data, np.int64, (last - first) // 8, first).reshape(-1, size) if last > first else np.zeros((0, size), np.int64)
    step = max(1, SLICE // size)
    for a in range(0, len(x), step):
        yield x[a : a + step]


def fit_list(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Each distinct x-vector once, as x: the bytes of its longs. Equal vectors of a task become one before they shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, x = whole(batch.column(0))
            ends = np.concatenate([[0], np.cumsum(lengths * 8)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([packed], names=["x"])

    return vectors.select(vector_col).mapInArrow(pack, "x binary").groupBy("x").agg(F.count(F.lit(1)).alias("copies"))


def sums(fit: DataFrame, size: int) -> list[int]:
    """Exact sums of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            for x in matrices(batch.column(0), size):
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (h << 32) + l for t, h, l in zip(total, high.tolist(), low.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "total"])

    rows = fit.select("x").mapInArrow(add, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    got = {r.i: int(r.total) for r in rows.collect()}  # a row for each dimension
    return [got[i] for i in range(size)]


def gram(fit: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of the rows that of makes of x-vectors: width numbers and their square, a matrix from each task, summed row by row."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, any_ = np.zeros(width), np.zeros((width, width)), False
        for batch in batches:
            for x in matrices(batch.column(0), size):
                z, any_ = of(x), True
                total += z.sum(axis=0)
                products += z.T @ z
        if any_:
            rows = [total.tobytes(), *(p.tobytes() for p in products)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(rows, pa.binary())], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(row)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([r.tobytes() for r in held.values()], pa.binary())], names=["i", "row"])

    parts = fit.select("x").mapInArrow(multiply, "i int, row binary").repartition(min(width + 1, 64), "i")
    got = {r.i: np.frombuffer(r.row) for r in parts.mapInArrow(add, "i int, row binary").collect()}  # width + 1 rows
    return got[0], np.array([got[i + 1] for i in range(width)])


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(diagonal, beside it, reflections) of the symmetric matrix, by Householder reflections."""
    a, d, mirrors = matrix.copy(), len(matrix), []
    beside = np.zeros(max(d - 1, 0))
    for k in range(d - 1):
        below = a[k + 1 :, k].copy()
        if not below[1:].any():
            beside[k] = below[0]
            mirrors.append(None)
            continue
        beside[k] = -np.copysign(np.linalg.norm(below), below[0])
        below[0] -= beside[k]
        v = below / np.linalg.norm(below)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        mirrors.append(v)
    return np.diag(a).copy(), beside, mirrors


def sturm_count(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each number of at."""
    least = np.finfo(float).tiny * 1e20 + np.finfo(float).eps ** 2 * np.abs(diagonal).max(initial=0)
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for a, b in zip(diagonal[1:], beside):
        q = a - at - b * b / np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues in falling order, each halved in until no double lies between its bounds."""
    pad = np.concatenate([[0], np.abs(beside), [0]])
    reach = pad[1:] + pad[:-1]
    slack = 1e-12 * (np.abs(diagonal) + reach).max() + np.finfo(float).tiny
    low, high = np.full(k, (diagonal - reach).min() - slack), np.full(k, (diagonal + reach).max() + slack)
    most = len(diagonal) - 1 - np.arange(k)  # so many are less than it
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        less = sturm_count(diagonal, beside, middle)
        low, high = np.where(less <= most, middle, low), np.where(less <= most, high, middle)
    return (low + high) / 2


def solved(diagonal: np.ndarray, beside: np.ndarray, at: float, right: np.ndarray, least: float) -> np.ndarray:
    """y of (T - at) y = right, by elimination with row exchanges; a pivot below least is replaced by it."""
    d = len(diagonal)
    main, up, up2, y = (diagonal - at).tolist(), [*beside.tolist(), 0.0], [0.0] * d, right.tolist()
    for i in range(d - 1):
        under, nxt, after = beside[i], main[i + 1], up[i + 1]
        if abs(under) > abs(main[i]):  # exchange
            f = main[i] / under
            main[i], up[i], up2[i], main[i + 1], up[i + 1] = under, nxt, after, up[i] - f * nxt, -f * after
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > least else least
            f = under / main[i]
            main[i + 1] = nxt - f * up[i]
            y[i + 1] -= f * y[i]
    main[-1] = main[-1] if abs(main[-1]) > least else least
    for i in range(d - 1, -1, -1):
        y[i] = (y[i] - (up[i] * y[i + 1] if i + 1 < d else 0) - (up2[i] * y[i + 2] if i + 2 < d else 0)) / main[i]
    return np.array(y)


def eigenvectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of the tridiagonal matrix for falling values. Those of values closer than a thousandth of the norm are
    a cluster: each is made orthogonal to the earlier ones in every step, and again at the end."""
    norm = max(np.abs(diagonal).max() + 2 * np.abs(beside).max(initial=0), np.finfo(float).tiny)
    eps, draw, out, start = np.finfo(float).eps * norm, np.random.default_rng(13), [], 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            start = j
        at, y = value - (j - start) * eps, draw.standard_normal(len(diagonal))
        cluster = np.array(out[start:j]).reshape(j - start, len(diagonal))
        for step in range(6):
            y = solved(diagonal, beside, at, y / np.abs(y).max(), eps)
            for _ in range(2):
                y = y - cluster.T @ (cluster @ y)
            size = np.linalg.norm(y)
            if size < 1e-8 * np.abs(y).max(initial=1):  # all of it lay in the cluster
                y = draw.standard_normal(len(diagonal))
                continue
            y = y / size
        out.append(y)
    return np.array(out).reshape(len(values), len(diagonal)).T


def leading(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, unit eigenvectors in columns) of the k leading ones that aren't noise. Of each vector the largest entry is positive."""
    scale = np.abs(covariance).max(initial=0)
    if scale == 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    diagonal, beside, mirrors = tridiagonal(covariance / scale)
    values = leading_values(diagonal, beside, min(k, len(diagonal)))
    values = values[values > NOISE * max(values[0], 0)]
    y = eigenvectors(diagonal, beside, values)
    for i in range(len(mirrors) - 1, -1, -1):
        if mirrors[i] is not None:
            y[i + 1 :] -= 2 * np.outer(mirrors[i], mirrors[i] @ y[i + 1 :])
    sign = np.sign(y[np.abs(y).argmax(axis=0), np.arange(y.shape[1])])
    return values * scale, y * sign


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of vectors."""
    every = written(fit_list(vectors, vector_col).select("x"))
    out = {}
    for r in every.groupBy((F.length("x") / 8).cast("int").alias("size")).count().collect():  # a row for each length
        fit, size = every.filter(F.length("x") == 8 * r.size), r.size
        model = Whitening(r["count"], sums(fit, size), np.zeros((size, 0)), np.zeros(0), 0.0)
        covariance = gram(fit, size, model.centred, size)[1] / model.n
        values, parts = leading(covariance, components)
        model = Whitening(model.n, model.sums, parts, values, float(np.trace(covariance)))
        if len(values):
            total, products = gram(fit, size, model.whitened, len(values))
            mean = total / model.n
            model.identity_error = float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(len(values))).max())
        out[size] = model
    return out


RESULT = "struct<n: long, deviation: long, whitened: array<double>, explained: array<double>, identity_error: double>"


def with_whitened(vectors: DataFrame, models: dict[int, Whitening], vector_col: str = "embedding", into: str = "whitening") -> DataFrame:
    """vectors and a struct column: n, deviation, whitened and explained (an entry for each component), identity_error."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # components x length for each length

    @F.arrow_udf(RESULT)
    def project(column: pa.Array) -> pa.Array:
        rows, lengths, flat = whole(column)
        ends = np.cumsum(lengths)
        place = np.full(len(column), -1)
        kinds = [(size, model, np.flatnonzero(lengths == size)) for size, model in sorted(shared.value.items())]
        n, deviation, white, share, error = [], [], [], [], []
        counts, at = [], 0
        for size, model, own in kinds:
            place[rows[own]] = at + np.arange(len(own))
            at += len(own)
            for a in range(0, len(own), max(1, SLICE // size)):
                some = own[a : a + max(1, SLICE // size)]
                x = gather(flat, ends[some] - size, np.full(len(some), size)).reshape(-1, size)
                deviation += model.deviation(x)
                white.append(model.whitened(x).ravel())
            k = len(model.values)
            n += [model.n] * len(own)
            error += [model.identity_error] * len(own)
            counts += [k] * len(own)
            share.append(np.tile(model.values / (model.trace or 1.0), len(own)))
        many = np.array(counts, np.int64)
        lists = [list_array(np.concatenate([np.zeros(0), *v]), many, pa.float64()) for v in (white, share)]
        done = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(deviation, pa.int64()), *lists, pa.array(error, pa.float64())], ["n", "deviation", "whitened", "explained", "identity_error"])
        return done.take(pa.array(place, pa.int64(), mask=place < 0))

    return vectors.withColumn(into, project.asNondeterministic()(F.col(vector_col)))
