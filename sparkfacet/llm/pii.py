"""Personal data: candidate spans scored by gradient-boosted trees.

Generators with high recall propose spans that may overlap: e-mail addresses, IP addresses, card and phone numbers by their
base patterns (valid or not), phone numbers in tight form, runs of digits with loose separators, and long runs of
letters, digits and the signs that keys are made of, with a letter at least. Trees score every proposal by format (length, digits, separators,
letters, variety) and context (neighbouring characters).

Labels come from what the features don't see. A card is positive if it passes Luhn's check and negative if not, an address if
its parts are in range or not; e-mail addresses and valid phone numbers are positive; a loose or tight number is what the
base span says that covers about the same place; a long run is positive if a word like token or key stands before it
and negative if none does, and that word is no feature, so that a key without such a word is found by its form. Other
proposals have no label. All documents and all their spans count in the fit: equal spans count once and lie in one of FOLDS
parts, tasks sum histograms of gradients over them, and the driver gets sums only, whose size doesn't grow with the table
(values of features as floats of 8 bits behind the point, gradients as whole multiples of 2**-30, so that sums are the same in
any order, scores in steps of STEP for calibration and thresholds). Trees fitted on the others score each part, so
that every span has a score it wasn't fitted to. On these scores calibration (Platt) and thresholds rest: each generator gets
the lowest one with the asked precision over LEAST_HELD of its spans or more; one with fewer spans of its own gets that of
all generators' spans together, so that small tables are treated like large ones. The trees that are used are fitted on all. Valid base spans always stay;
of the others, those above their threshold, best first, unless they lie in or cut through what is taken already (a key may hold
a run that passes for a card).

Cases: a null text is an empty text; an empty text has no spans; texts and spans are read whole, whatever their length, in
linear time; repeated rows get equal results; a corpus without both kinds of labels adds nothing to the base spans; an
empty table gives an empty result; the result has the id and the spans only, whatever other columns there are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._arrow import slices, text_buffers
from sparkfacet.llm._spark import written

#: In the order of the results.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "number", "secret", "call")
PRECISION = 0.98
#: A threshold is taken from so many spans at least: fewer may be right by chance. Parts of the spans for their scores.
LEAST_HELD, FOLDS = 8, 3
#: Scores lie within REACH and are counted in steps; spans in a block of the written table; rounds, depth, rate and bins of the trees; parts of 1 that gradients are counted in.
STEP, REACH, BLOCK = 0.005, 40, 100_000
ROUNDS, DEPTH, RATE, BINS, UNIT = 40, 3, 0.2, 32, 2.0**30

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CALL = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
NUMBER = re.compile(r"\(?[0-9][0-9() .-]{6,}[0-9]")
LONG_RUN = re.compile(r"[A-Za-z0-9_+/-]{12,}")
LETTER = re.compile(r"[A-Za-z]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SAID = re.compile(r"(?i)token|key|secret|passw|credential|bearer")

Span = tuple[str, int, int, bool]  # kind, start, end, whether the base check holds


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the base pattern finds them, in linear time: what fails behind one @ fails from each character before it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four numbers in a row, as the base pattern finds them, and whether all are 255 at most."""
    for run in DOTTED.finditer(text):
        if run.end() - run.start() > 6 and run.group().count(".") > 2:
            parts, start = run.group().split("."), run.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                yield start, end, all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in four)
                start = end + 1


def base_spans(text: str) -> list[Span]:
    """All matches of the base patterns, leftmost and non-overlapping per kind, with the check's outcome."""
    out: list[Span] = [("email", a, b, True) for a, b in emails(text)]
    out += [("ip", a, b, ok) for a, b, ok in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() > 8:
            digits = m.group().replace(" ", "").replace("-", "")
            out.append(("card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        out += [("phone", m.start(), m.end(), 9 <= sum(c.isdigit() for c in m.group()) <= 15) for m in PHONE.finditer(text)]
    return out


def candidates(text: str) -> list[Span]:
    out = base_spans(text)
    out += [("number", m.start(), m.end(), False) for m in NUMBER.finditer(text)]
    out += [("secret", m.start(), m.end(), False) for m in LONG_RUN.finditer(text) if LETTER.search(m.group())]
    if "+" in text:
        out += [("call", m.start(), m.end(), False) for m in CALL.finditer(text)]
    return out


def labels(text: str, spans: list[Span]) -> list[int | None]:
    """1, 0 or None (unknown) for each proposal of a text."""
    base = sorted((a, b, k, ok) for k, a, b, ok in spans if k in BASE_KINDS)
    starts, widest = [b[0] for b in base], max((b - a for a, b, _, _ in base), default=0)

    def about(a: int, b: int) -> int | None:
        said = None
        for x, y, kind, ok in base[bisect_left(starts, a - widest) : bisect_left(starts, b)]:
            if min(b, y) - max(a, x) >= 0.8 * (max(b, y) - min(a, x)):
                if ok:
                    return 1
                said = 0 if kind in ("card", "ip") else said
        return said

    out: list[int | None] = []
    for kind, a, b, ok in spans:
        if kind in ("card", "ip"):
            out.append(int(ok))
        elif kind in ("email", "phone"):
            out.append(1 if ok else None)
        elif kind == "secret":
            out.append(int(SAID.search(text, max(0, a - 24), a) is not None))
        else:
            out.append(about(a, b))
    return out


def features(text: str, span: Span) -> list[float]:
    kind, a, b, _ = span
    s, last, after = text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]
    n, digits = len(s), sum("0" <= c <= "9" for c in s)
    return [
        KINDS.index(kind), n, digits, digits / n, sum(c in " .-()" for c in s), s.count("."), s.count("-"), s.count(" "), float("@" in s), float(s[0] == "+"), float("(" in s),
        sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n, len(set(s)) / n, max(map(len, re.split(r"[^0-9]", s))), sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        float(last.isalnum()), float(last != "" and last in "\"'"), float(after.isalnum()), float(after != "" and after in "\"'"), float(last == "." or after == "."), float(last in "=:" and last != ""),
    ]


def coded(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the features' values (none is below 0), few enough to be counted: values up to 256 that are whole keep apart."""
    return (np.ascontiguousarray(x, np.float32).view(np.uint32) >> 15).astype(np.int32)


@dataclass
class Trees:
    """Boosted trees of a fixed depth: for each tree, feature and cut of each inner node and the value of each leaf."""

    depth: int = DEPTH
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            out += leaf[leaves(x, feature, cut, self.depth)]
        return out


def leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Each row's place among the nodes of a level."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node - (2**levels - 1)


@dataclass
class Detector:
    trees: Trees | None
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.scores(coded(x)) + self.shift, -40, 40)))

    def select(self, texts: list[str]) -> list[tuple[list[Span], list[tuple[str, int, int, float]]]]:
        """For each text its valid base spans, and all spans with their probability (1 for base spans)."""
        found = [candidates(t) for t in texts]
        base = [sorted((s for s in c if s[3]), key=lambda s: (KINDS.index(s[0]), s[1])) for c in found]
        more = [(k, s) for k, c in enumerate(found) for s in c if not s[3]]
        every = [[(*s[:3], 1.0) for s in b] for b in base]
        if self.trees is not None and more:
            p = self.probabilities(np.array([features(texts[k], s) for k, s in more], float))
            least = [self.thresholds.get(s[0], 2.0) for _, s in more]
            taken = [merged([(a, b) for _, a, b, _ in e]) for e in every]
            for prob, k, s in sorted(((q, k, s) for q, t, (k, s) in zip(p.tolist(), least, more) if q >= t), key=lambda c: (-c[0], c[1], c[2])):
                own, (a, b) = taken[k], s[1:3]
                i = bisect_left(own, (a, a))
                i -= i > 0 and own[i - 1][1] > a
                j = bisect_left(own, (b, b))
                if all(a <= x and y <= b and (x, y) != (a, b) for x, y in own[i:j]):
                    own[i:j] = [(a, b)]
                    every[k].append((*s[:3], prob))
        return [(b, sorted(e, key=lambda s: (KINDS.index(s[0]), s[1]))) for b, e in zip(base, every)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same places, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def lowest(p: np.ndarray, n: np.ndarray, right: np.ndarray, precision: float) -> float | None:
    """The lowest threshold with the precision over LEAST_HELD spans or more; None if there is none. p: rising, of n spans each, right of them true."""
    taken, true = n[::-1].cumsum()[::-1], right[::-1].cumsum()[::-1]
    good = np.flatnonzero((n > 0) & (true >= precision * taken) & (taken >= LEAST_HELD))
    return max(0.5, float(p[good[0]])) if len(good) else None


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # features (bins), labels, parts and kinds of some spans


def summed(blocks: RDD, of: Callable[[Block], np.ndarray]) -> np.ndarray:
    """The sum of what is counted in each block."""
    def count(rows: Iterable[tuple]) -> Iterator[np.ndarray]:
        total = None
        for x, y, fold, kind in rows:
            y = np.frombuffer(y, np.uint8)
            more = of((np.frombuffer(x, np.uint8).reshape(len(y), -1), y, np.frombuffer(fold, np.uint8), np.frombuffer(kind, np.uint8)))
            total = more if total is None else total + more
        if total is not None:
            yield total

    return blocks.mapPartitions(count).treeReduce(np.add)


def gradients(block: Block, models: list[Trees], features: np.ndarray, cuts: np.ndarray, level: int, part_of: int) -> np.ndarray:
    """(model, node, feature, bin, 2): sums of gradients and weights at a level of each model's new tree; model k leaves part k out."""
    x, y, fold, _ = block
    many, out = 2**level, []
    for k, model in enumerate(models):
        use = fold != k if k < part_of else slice(None)
        rows, p = x[use], 1 / (1 + np.exp(-model.scores(x[use])))
        node = leaves(rows, features[k], cuts[k], level)
        g, h = np.rint((y[use] - p) * UNIT), np.rint(p * (1 - p) * UNIT)
        out.append([[np.bincount(node * BINS + rows[:, f], w, many * BINS).reshape(many, BINS) for f in range(x.shape[1])] for w in (g, h)])
    return np.array(out).transpose(0, 3, 2, 4, 1).astype(np.int64)


def grown(blocks: RDD, counts: np.ndarray, edges: list[np.ndarray]) -> list[Trees]:
    """A model without each part and one of all (cuts: places in edges), level by level; counts (part, label): of spans."""
    models = []
    for of in (*(np.delete(counts, k, 0) for k in range(len(counts))), counts):
        p = np.clip(of[:, 1].sum() / of.sum(), 1e-3, 1 - 1e-3)
        models.append(Trees(start=float(np.log(p / (1 - p)))))
    inner, parts = 2**DEPTH - 1, len(counts)
    for _ in range(ROUNDS):
        feature, cut = np.zeros((len(models), inner), np.int64), np.full((len(models), inner), BINS)
        for level in range(DEPTH):
            sums = summed(blocks, partial(gradients, models=models, features=feature, cuts=cut, level=level, part_of=parts)) / UNIT
            left = sums.cumsum(3)
            lg, lh, tg, th = left[..., 0], left[..., 1], left[..., -1:, 0], left[..., -1:, 1]
            gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
            for f, e in enumerate(edges):
                gain[:, :, f, len(e) :] = 0
            best = gain.reshape(*gain.shape[:2], -1).argmax(2)
            for k, j in np.ndindex(best.shape):
                f, c = divmod(int(best[k, j]), BINS)
                if gain[k, j, f, c] > 1e-6:
                    feature[k, 2**level - 1 + j], cut[k, 2**level - 1 + j] = f, c
        for k, model in enumerate(models):
            at, last = np.arange(2 ** (DEPTH - 1)), slice(2 ** (DEPTH - 1) - 1, inner)
            f, c = feature[k, last], np.minimum(cut[k, last], BINS - 1)  # BINS: no cut, all stay on the left
            l, t = left[k, at, f, c], left[k, at, 0, -1]
            both = np.stack([l, t - l], 1).reshape(-1, 2)
            model.feature.append(feature[k])
            model.cut.append(cut[k])
            model.leaf.append(RATE * both[:, 0] / (both[:, 1] + 1))
    return models


def held(block: Block, models: list[Trees]) -> np.ndarray:
    """(kind, label, step): spans by their scores of the model that was fitted without them."""
    x, y, fold, kind = block
    steps = int(2 * REACH / STEP) + 1
    score = np.zeros(len(y))
    for k, model in enumerate(models[:-1]):
        score[fold == k] = model.scores(x[fold == k])
    at = np.floor((np.clip(score, -REACH, REACH) + REACH) / STEP).astype(np.int64)
    return np.bincount((kind.astype(np.int64) * 2 + y) * steps + at, minlength=len(KINDS) * 2 * steps).reshape(len(KINDS), 2, steps)


def fit(blocks: RDD, counts: np.ndarray, edges: list[np.ndarray], precision: float = PRECISION) -> Detector:
    """counts (part, label): of the spans in blocks; edges: upper ends of the features' bins."""
    if (counts.sum(1) > 0).sum() < 2 or any((np.delete(counts, k, 0).sum(0) == 0).any() for k in range(len(counts))):
        return Detector(None)
    models = grown(blocks, counts, edges)
    seen = summed(blocks, partial(held, models=models))
    all_ = models[-1]
    all_.cut = [np.array([edges[f][c] if c < BINS else np.inf for f, c in zip(fs, cs)]) for fs, cs in zip(all_.feature, all_.cut)]
    out, score = Detector(all_), np.arange(seen.shape[2]) * STEP - REACH
    n, y = seen.sum((0, 1)), seen[:, 1].sum(0)
    for _ in range(50):  # Newton steps of Platt's two parameters, slightly penalised
        p = 1 / (1 + np.exp(-np.clip(out.slope * score + out.shift, -40, 40)))
        w, r = n * (p * (1 - p) + 1e-6), n * p - y
        g = np.array([(r * score).sum() + 1e-2 * (out.slope - 1), r.sum()])
        m = np.array([[(w * score * score).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(m, g)
        out.slope, out.shift = out.slope - step[0], out.shift - step[1]
    p = 1 / (1 + np.exp(-np.clip(out.slope * score + out.shift, -40, 40)))
    if out.slope <= 0:  # scores say nothing
        return Detector(None)
    together = lowest(p, n, y, precision)
    for k, kind in enumerate(KINDS):
        own = seen[k].sum(0)
        least = lowest(p, own, seen[k, 1], precision) if own.sum() >= LEAST_HELD else together
        out.thresholds[kind] = 2.0 if least is None else least
    return out


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lot, x, y) of every labelled span of every document, once each: the span's hash, its coded features and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                named, rows = [], []
                for text in batch.column(0)[a:b].to_pylist():
                    found = candidates(text or "")
                    known = [(s, y) for s, y in zip(found, labels(text or "", found)) if y is not None]
                    named += [f"{s[0]}:{text[s[1] : s[2]]}" for s, _ in known]
                    rows += [[*features(text, s), float(y)] for s, y in known]
                codes = coded(np.array(rows, float))
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array(codes.tolist(), pa.list_(pa.int32()))], names=["span", "x"])

    rows = docs.select(text_col).mapInArrow(run, "span string, x array<int>")
    once = rows.groupBy(F.xxhash64("span", F.lit("fold")).alias("lot")).agg(F.min("x").alias("x"))  # a span counts once, and so lies on one side, however many copies there are
    return once.select("lot", F.slice("x", 1, F.size("x") - 1).alias("x"), (F.element_at("x", -1) > 0).cast("int").alias("y"))


def fit_detector(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """Fitted on all labelled spans of all documents (of those with an id)."""
    spans = written(labelled(docs.filter(F.col(id_col).isNotNull()), text_col).withColumn("fold", F.pmod("lot", F.lit(FOLDS)).cast("int")))
    counts = np.zeros((FOLDS, 2), np.int64)
    for r in spans.groupBy("fold", "y").count().collect():  # six rows at most
        counts[r.fold, r.y] = r["count"]
    values: dict[int, list[tuple[int, int]]] = {}
    for r in spans.select(F.posexplode("x").alias("f", "code")).groupBy("f", "code").count().orderBy("f", "code").collect():  # a feature has some hundreds of codes
        values.setdefault(r.f, []).append((r.code, r["count"]))
    edges = []
    for f in sorted(values):
        code, n = np.array(values[f]).T
        below = n.cumsum()
        ends = code[np.searchsorted(below, np.arange(1, BINS) / BINS * below[-1])]
        edges.append(np.unique(ends[ends < code[-1]]))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
            bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)
            kind = np.searchsorted(coded(np.arange(len(KINDS))), x[:, 0]).astype(np.uint8)
            y, fold = (batch.column(k).to_numpy().astype(np.uint8) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, y, fold, kind)], names=["x", "y", "fold", "kind"])

    total = int(counts.sum())
    tasks = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, total // 20_000), total // BLOCK)
    table = written(spans.select("x", "y", "fold").coalesce(tasks).mapInArrow(packed, "x binary, y binary, fold binary, kind binary"))
    blocks = table.rdd.map(tuple).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit(blocks, counts, edges)
    finally:
        blocks.unpersist()


def with_spans(docs: DataFrame, model: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base (array of struct<kind, start, end>) and spans (the same with p) of each row; code points, end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                found = shared.value.select([t or "" for t in batch.column(1)[a:b].to_pylist()])
                base = [[dict(zip(("kind", "start", "end"), s)) for s in x] for x, _ in found]
                spans = [[dict(zip(("kind", "start", "end", "p"), s)) for s in x] for _, x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(base, base_type), pa.array(spans, span_type)], names=["id", "base", "spans"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, base array<struct<kind: string, start: int, end: int>>, spans array<struct<kind: string, start: int, end: int, p: double>>")
    return out.withColumnRenamed("id", id_col)
