"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text (lower-cased runs of letters, digits and characters beyond ASCII; each counts once).
P(grade <= k) = sigmoid(cut_k - w.x): one weight per word for all grades, and ordered cuts between them. The result is the
expected grade, the sum of P(grade > k).

Training takes at most max_rows labelled rows, chosen by a hash of the id. Labels say toxic or not; grades above 1 come
from the words themselves: among toxic training texts, a text with more of the words that set toxic texts apart has a
higher grade (tertiles of their number). The words kept as features are all those whose G-squared score is beyond what chance gives
among so many words.

Cases: a null or empty text has no features and scores as the cuts alone say; long texts are read whole; repeated rows
score alike; a label that is null or whose document is missing is not used, and of several labels for an id the largest
counts; without both toxic and other labels nothing is toxic and severity is 0; an empty table gives an empty result; extra columns
pass through, but for one named as the result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._arrow import ALNUM, list_array, slices, text_buffers, word_hashes

#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 8000
GRADES = 4


@dataclass
class Severity:
    """words: hashes in ascending order; weights: of each; cuts: GRADES - 1 ascending numbers."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw, offsets = text_buffers(texts)
        out = [np.zeros(0)]
        for a, b in slices(offsets):
            hashes, counts = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
            row, word = look_up(self.words, hashes, counts)
            out.append(np.bincount(row, self.weights[word], b - a))
        return np.concatenate(out)


def look_up(words: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, index in words) pairs of the hashes that occur in words."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    few = np.zeros(1 << 16, bool)
    few[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
    may = np.flatnonzero(few[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, hashes[may]), len(words) - 1)
    same = words[at] == hashes[may]
    row = np.searchsorted(np.cumsum(counts), may[same], "right")
    pair = np.unique(row * len(words) + at[same])
    return pair // len(words), pair % len(words)


def fit(hashes: np.ndarray, counts: np.ndarray, toxic: np.ndarray, steps: int = 300, penalty: float = 1e-5) -> Severity:
    """hashes, counts: distinct words of each training row, one row after another; toxic: 0 or 1 for each row."""
    none = Severity(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 40.0))
    n, ill = len(toxic), int(toxic.sum())
    if not 0 < ill < n:
        return none
    row = np.repeat(np.arange(n), counts)
    words, index = np.unique(hashes, return_inverse=True)
    a = np.bincount(index, toxic[row], len(words))  # toxic texts with the word
    b = np.bincount(index, minlength=len(words)) - a
    usual = (a + b) / n
    gain = np.zeros(len(words))
    for seen, all_ in ((a, ill), (b, n - ill)):
        gain += seen * np.log(np.maximum(seen, 1e-9) / (usual * all_)) + (all_ - seen) * np.log(np.maximum(all_ - seen, 1e-9) / np.maximum((1 - usual) * all_, 1e-9))
    # words that chance alone would hardly set apart among so many
    keep = np.flatnonzero(gain > np.log(len(words)) + 1)
    new = np.full(len(words), -1)
    new[keep] = np.arange(len(keep))
    col = new[index]
    row, col = row[col >= 0], col[col >= 0]
    # grades: tertiles of the number of words that clearly set toxic texts apart (G-squared of 30 or more, 2 at least)
    apart = (gain[keep] > 15) & (a[keep] / ill > b[keep] / (n - ill))
    hits = np.bincount(row, apart[col], n)[toxic == 1]
    grade = np.zeros(n, np.int64)
    grade[toxic == 1] = 1 + sum((hits > np.quantile(hits, q)).astype(np.int64) for q in (1 / 3, 2 / 3))
    # full-batch gradient descent (Adam) on the mean negative log likelihood
    w, cuts = np.zeros(len(keep)), np.array([1.0, 2.0, 3.0])
    theta = np.concatenate([w, [cuts[0]], np.log(np.diff(cuts))])
    m, v, k = np.zeros_like(theta), np.zeros_like(theta), len(keep)
    for step in range(1, steps + 1):
        w, steps_up = theta[:k], np.exp(theta[k + 1 :])
        cuts = theta[k] + np.concatenate([[0], np.cumsum(steps_up)])
        score = np.bincount(row, w[col], n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        up = 1 / (1 + np.exp(np.clip(score - edge[grade + 1], -40, 40)))  # P(<= grade)
        low = 1 / (1 + np.exp(np.clip(score - edge[grade], -40, 40)))
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        d_score = d_up - d_low  # of the negative log likelihood
        d_cut = np.array([(-d_up[grade == g]).sum() + d_low[grade == g + 1].sum() for g in range(GRADES - 1)])
        g_first, g_up = d_cut.sum(), np.array([d_cut[j + 1 :].sum() for j in range(GRADES - 2)]) * steps_up
        grad = np.concatenate([np.bincount(col, d_score[row], k), [g_first], g_up]) / n
        grad[:k] += penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[k] + np.concatenate([[0], np.cumsum(np.exp(theta[k + 1 :]))])
    return Severity(words[keep], theta[:k], cuts)


def fit_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Severity:
    """A model from docs and labels (id_col, label_col: 0 or 1)."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    lot = F.xxhash64(F.col(id_col), F.lit("toxicity"))
    sample = known.orderBy(lot, id_col).limit(max_rows)  # bounded, so it may be broadcast

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                hashes, counts = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], list_array(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64())], names=["toxic", "words"])

    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select("__toxic", text_col).mapInArrow(words, "toxic int, words array<long>")
    table = rows.orderBy(F.xxhash64("words"), "toxic").limit(max_rows).toArrow().combine_chunks()  # an id may repeat in docs: the same rows in each run
    lists = table.column("words").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    toxic = table.column("toxic").to_numpy().astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
    hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(lists) else np.zeros(0, np.uint64)
    return fit(hashes, counts, toxic)


def with_severity(docs: DataFrame, model: Severity, text_col: str = "text", into: str = "severity", threshold: float = 0.5) -> DataFrame:
    """docs and a struct column: expected (0 to 3), grade (the nearest), p_toxic (grade 1 or more), toxic (p_toxic >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("expected double, grade int, p_toxic double, toxic boolean")
    def score(texts: pa.Array) -> pa.Array:
        above = shared.value.above(shared.value.scores(texts))
        expected = above.sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(np.rint(expected).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= threshold)], ["expected", "grade", "p_toxic", "toxic"])

    return docs.withColumn(into, score.asNondeterministic()(F.col(text_col)))
