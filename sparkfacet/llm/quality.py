"""Quality of documents by attention-based multiple-instance learning: passages are encoded, only documents have labels.

A text is cut into passages of PASSAGE words, all of it. A passage's features are the shares of its bytes by value, the shape
of its words (length, spread, punctuation), how many of them differ, how many of its three-word shingles stood earlier in
the block, and hashed words. An encoder h = tanh(W x + b) reads each passage; gated attention a = softmax(w . (tanh(V h) *
sigmoid(U h))) weighs the passages of a document; the score is sigmoid(c . sum(a h) + d). All of it is learned together from
the documents' labels by gradient descent (Adam on the logistic loss). Attention needs two sums for each text only, so texts
of any length are read block by block (BLOCK bytes, cut at white space; shingles are looked up within the block).

Training takes at most max_rows labelled rows, chosen by a hash of the id among those of MOST passages or fewer. Scores use
the text alone.

Cases: a null or empty text is one passage without words, and is scored like any other; repeated rows score alike; a null id
is never used in training; of several labels for an id the smallest counts; a null label isn't used; without both kinds of labels every score is
the share of good ones (0.5 without any); an empty table gives an empty result; extra columns pass through, but for one named
as the result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._arrow import BASE, SPACE, mix, slices, text_buffers, word_hashes

PASSAGE, BLOCK, BUCKETS = 64, 1 << 20, 128
#: Labelled rows that a model is fitted on at most, and the passages of each at most.
MAX_ROWS, MOST = 6000, 400
HIDDEN, GATE = 32, 16
#: Values of bytes: ASCII each on its own, the rest by the length of their sequence.
KIND = np.concatenate([np.arange(128), np.full(64, 128), np.full(32, 129), np.full(16, 130), np.full(16, 131)])
KINDS, SHAPES = 132, 8
WORD = ~SPACE
#: Bytes that are no letters, digits or white space of ASCII.
MARK = np.array([b < 128 and not chr(b).isalnum() and not SPACE[b] for b in range(256)])
FEATURES = KINDS + SHAPES + BUCKETS


def blocks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of blocks, the row of each): a row is a block, or several if it is long."""
    if not (np.diff(offsets) > BLOCK).any():
        return offsets, np.arange(len(offsets) - 1)
    cuts, rows = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while True:
            cuts.append(a)
            rows.append(i)
            if b - a <= BLOCK:
                break
            spaces = np.flatnonzero(SPACE[raw[a + BLOCK // 2 : a + BLOCK]])
            a += BLOCK // 2 + int(spaces[-1]) + 1 if len(spaces) else BLOCK
    return np.array([*cuts, offsets[-1]]), np.array(rows)


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the passages, the block of each). offsets: of blocks in raw."""
    n = len(offsets) - 1
    inside = WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, words = word_hashes(raw, offsets, WORD)
    many = np.maximum(1, -(-words // PASSAGE))  # passages of each block
    base = np.cumsum(many) - many
    block = np.repeat(np.arange(n), many)
    before = np.cumsum(words) - words
    of_word = np.repeat(base, words) + (np.arange(len(starts)) - np.repeat(before, words)) // PASSAGE
    total = int(many.sum())
    # a passage's bytes: from its first word on, or from the start of its block, to the next passage
    begin = offsets[:-1][block].copy()
    heads = np.flatnonzero(np.diff(of_word, prepend=-1))
    inner = of_word[heads] != base[block[of_word[heads]]]
    begin[of_word[heads[inner]]] = starts[heads[inner]]
    sizes = np.diff(begin, append=len(raw))
    of_byte = np.repeat(np.arange(total) * KINDS, sizes) + KIND[raw]
    shares = np.sqrt(np.bincount(of_byte, minlength=total * KINDS).reshape(total, KINDS) / np.maximum(sizes, 1)[:, None])
    count = np.bincount(of_word, minlength=total)
    each = np.maximum(count, 1)
    long = (stops - starts).astype(float)
    mean = np.bincount(of_word, long, total) / each
    spread = np.sqrt(np.maximum(np.bincount(of_word, long * long, total) / each - mean * mean, 0))

    def differ(group: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which values are the first of their kind in their group."""
        key = mix(values + group.astype(np.uint64) * BASE)
        new = np.zeros(len(key), bool)
        new[np.unique(key, return_index=True)[1]] = True
        return new

    distinct = np.bincount(of_word, differ(of_word, hashes), total) / each
    seen = np.zeros(total)
    if len(hashes) > 2:
        own = block[of_word]
        whole = np.flatnonzero(own[2:] == own[:-2])
        triple = mix(hashes[whole] + mix(hashes[whole + 1] + mix(hashes[whole + 2]) * BASE) * BASE)
        at = of_word[whole]
        seen = np.bincount(at, ~differ(own[whole], triple), total) / np.maximum(np.bincount(at, minlength=total), 1)
    marks = MARK[raw[stops - 1]] if len(stops) else np.zeros(0, bool)
    shapes = np.column_stack([count / PASSAGE, np.log1p(mean), np.log1p(spread), np.log1p(np.bincount(block, minlength=n)[block]), distinct, seen, np.bincount(of_word, marks, total) / each, count > 0])
    bucket = np.bincount(of_word * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    return np.concatenate([shares, shapes, np.sqrt(bucket / each[:, None])], axis=1).astype(np.float32), block


def encoded(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of passages, the row of each) of texts, slice by slice."""
    raw, offsets = text_buffers(texts)
    cuts, rows = blocks(raw, offsets)
    for a, b in slices(cuts):
        features, block = passages(raw[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
        yield features, rows[a + block]


@dataclass
class Attention:
    """The learned model; middle and width standardise the features."""

    middle: np.ndarray
    width: np.ndarray
    w: dict[str, np.ndarray]

    def parts(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(encoded passages, their attention before it is normalised)."""
        w = self.w
        x = (features.astype(np.float64) - self.middle) / self.width  # in doubles, so that what shares a batch doesn't tell
        h = np.tanh(x @ w["W"] + w["b"])
        return h, np.exp(np.clip(np.tanh(h @ w["V"]) / (1 + np.exp(-h @ w["U"])) @ w["w"], -30, 30))

    def scores(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        weight, total = np.zeros(n), np.zeros((n, len(self.w["c"])))
        for features, row in encoded(texts):
            h, a = self.parts(features)
            weight += np.bincount(row, a, n)
            cuts = np.flatnonzero(np.diff(row, prepend=-1))
            total[row[cuts]] += np.add.reduceat(a[:, None] * h, cuts)
        return np.round(1 / (1 + np.exp(-np.clip(total / np.maximum(weight, 1e-30)[:, None] @ self.w["c"] + self.w["d"], -40, 40))), 9)


def fit(features: np.ndarray, counts: np.ndarray, good: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 2e-3, penalty: float = 1e-4) -> Attention:
    """features: of all passages, document after document; counts: passages of each document; good: its label, 0 or 1."""
    draw, n = np.random.default_rng(11), len(good)
    shape = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,)}
    w = {k: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for k, s in shape.items()}
    share = float(np.clip(good.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    w |= {"b": np.zeros(HIDDEN, np.float32), "c": np.zeros(HIDDEN, np.float32), "d": np.full(1, np.log(share / (1 - share)), np.float32)}
    middle, width = (features.mean(axis=0), features.std(axis=0) + 0.01) if len(features) else (np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32))
    if len(set(good.tolist())) < 2:
        return Attention(middle, width, w)
    x, at = (features - middle) / width, np.cumsum(counts) - counts
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    for epoch in range(epochs):
        order = draw.permutation(n)
        for a in range(0, n, batch):
            own = order[a : a + batch]
            size = counts[own]
            cuts = np.cumsum(size) - size
            rows = np.repeat(at[own] - cuts, size) + np.arange(int(size.sum()))
            doc = np.repeat(np.arange(len(own)), size)
            xs = x[rows]
            h = np.tanh(xs @ w["W"] + w["b"])
            t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-h @ w["U"]))
            e = np.exp(np.clip((t * s) @ w["w"], -30, 30))
            e = e / np.add.reduceat(e, cuts)[doc]
            z = np.add.reduceat(e[:, None] * h, cuts)
            p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -40, 40)))
            out = ((p - good[own]) / len(own)).astype(np.float32)
            g_z = out[:, None] * w["c"]
            along = (h * g_z[doc]).sum(axis=1)
            g_e = e * (along - np.add.reduceat(e * along, cuts)[doc])
            g_t, g_s = g_e[:, None] * w["w"] * s * (1 - t * t), g_e[:, None] * w["w"] * t * s * (1 - s)
            g_h = (e[:, None] * g_z[doc] + g_t @ w["V"].T + g_s @ w["U"].T) * (1 - h * h)
            grad = {"W": xs.T @ g_h, "b": g_h.sum(axis=0), "V": h.T @ g_t, "U": h.T @ g_s, "w": (t * s).T @ g_e, "c": z.T @ out, "d": out.sum(keepdims=True)}
            step += 1
            for k, g in grad.items():
                g = g + penalty * w[k] * (k not in "bd")
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Attention(middle, width, w)


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Attention:
    """A model from the texts of docs and labels (id_col, label_col: 0 or 1), but for held-out ids."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("__good"))
    lot = F.xxhash64(F.col(id_col), F.lit("quality"))
    sample = known.orderBy(lot, id_col).limit(max_rows)  # bounded, so it may be broadcast

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                short = [i for i in range(a, b) if offsets[i + 1] - offsets[i] <= BLOCK]
                for part in (batch.column(1).take(pa.array(short, pa.int64())),) if short else ():
                    for found, row in encoded(part):
                        sizes = np.bincount(row, minlength=len(short))
                        ends = np.cumsum(sizes)
                        few = np.flatnonzero((sizes > 0) & (sizes <= MOST))
                        if len(few):
                            packed = [found[ends[i] - sizes[i] : ends[i]].tobytes() for i in few.tolist()]
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([short[i] for i in few.tolist()], pa.int64())), pa.array(packed, pa.binary())], names=["good", "passages"])

    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select("__good", text_col).mapInArrow(features, "good int, passages binary")
    table = rows.orderBy(F.xxhash64("passages"), "good").limit(max_rows).toArrow()  # an id may repeat in docs: the same rows in each run
    packed = table.column("passages").to_pylist()
    counts = np.array([len(p) // (4 * FEATURES) for p in packed], np.int64)
    x = np.frombuffer(b"".join(packed), np.float32).reshape(-1, FEATURES)
    return fit(x, counts, np.array(table.column("good").to_pylist(), np.float32))


def with_quality(docs: DataFrame, model: Attention, text_col: str = "text", into: str = "quality") -> DataFrame:
    """docs and a column: the score of each whole text, 0 to 1, higher for labels of 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts).astype(np.float64))

    return docs.withColumn(into, score.asNondeterministic()(F.col(text_col)))
