"""Removal of repeated byte strings, by bucket-pointer refinement of the strings' suffixes.

A string of LENGTH bytes that also starts earlier (in a document of smaller id, or earlier in the same one) is removed.
1. Every window of LENGTH bytes has one anchor: the Q-gram in it with the smallest hash, the leftmost of equals. Equal windows
   have equal anchors at equal places, so they can only be found among windows whose anchor's Q-gram occurs twice. One in
   35 positions or so is an anchor. Their hashes are counted over the corpus; those that occur twice go into a bit
   field of bounded size (when a corpus outgrows it, more windows are looked at, and the result is the same).
2. The windows of one anchor, next to each other, form a block. Equal blocks: all but the first are removed whole.
3. First blocks meet by their anchor's Q-gram, the initial bucket. There every position points to the bucket of its first START
   bytes, and buckets are refined by sorting on the pair of bucket pointers at a position and at a later offset; the pointers
   that this gives are used again, for strings of twice the length, until whole windows are told apart. Positions alone in
   their bucket drop out. In each last bucket all windows but the first are removed. Bytes decide, not hashes.
4. An anchor with more than HEAVY places, as at the edges of a passage that many documents share, isn't gathered: its blocks
   are written as they are, their windows get the bucket identifiers of their Q-grams as a key, and windows whose key can't
   occur twice are sieved out by a bit field. Runs of the others that equal an earlier run go whole; the windows of the first
   of each are grouped by their keys. So such an anchor spreads over all tasks.

A task sends a block's bytes only when it is new to the task or starts earlier than what was sent, so a passage that many
documents share meets in one place as often as there are tasks, not as there are documents.

Cases: a null text is an empty text; texts shorter than LENGTH lose nothing; equal rows (same id and text) count as one
document and get equal results; rows of one id but different texts are ordered by a hash of the text; a null id comes
after all others; an empty table gives an empty result; positions are those of the UTF-8 bytes;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._arrow import BASE, gather, mix, slices, text_buffers
from sparkfacet.llm._spark import bit_field, field_bits, marked, spread_join, written

LENGTH, Q = 100, 32
#: Length of the strings of the first buckets: a 64-bit number.
START = 8
#: Places of an anchor up to which its blocks meet in one task: 1.7 MB of blocks.
HEAVY = 10_000
#: Q-grams in a window.
WIDE = LENGTH - Q + 1
SLICE = 500_000
LAST = (1 << 63) - 1
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """The hash of the Q bytes from each position on, by doubling; the last Q - 1 are of no use."""
    h, base, span = raw.astype(np.uint64) + np.uint64(1), np.array([BASE]), 1
    while span < Q:
        h = h[:-span] * base + h[span:]
        base, span = base * base, span * 2
    return mix(h)


def sliding_min(v: np.ndarray, wide: int) -> np.ndarray:
    span = 1
    while 2 * span <= wide:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (wide - span)], v[wide - span :]) if wide > span else v


def blocks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor) of each block of a slice, and the Q-grams' hashes."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(raw)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(v, WIDE) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + LENGTH <= offsets[1:][row]
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none, none, h
    anchor = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    return row[first], first, last, anchor[new], h


def _texts(batches: Iterator[pa.RecordBatch]):
    """Slices (ids, raw, offsets) of batches of id and text, and each row's place in the order: id, then a hash of the text."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        ids = batch.column(0).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets, SLICE):
            part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            x = np.array([xxhash.xxh3_64_intdigest(part[p:q]) for p, q in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64).view(np.int64)
            yield batch.column(0)[a:b], ids[a:b], x, part, off


def _marked(heads: np.ndarray, field: bytes, bits: int) -> np.ndarray:
    """Whether the field holds the heads (longs)."""
    at, marks = heads % bits, np.frombuffer(field, np.uint8)  # as pmod
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _flagged(batches: Iterator[pa.RecordBatch], field: bytes, bits: int):
    """(d, x, first window in its document, bytes, anchor's hash, two hashes of the block, start in part, part) of marked blocks."""
    for _, d, x, part, off in _texts(batches):
        row, first, last, anchor, h = blocks(part, off)
        if not len(row):
            continue
        head = h[anchor]
        keep = _marked(head.view(np.int64), field, bits)
        row, first, last, head, anchor = row[keep], first[keep], last[keep], head[keep], anchor[keep]
        one, two = (anchor - first).astype(np.uint64), (last - first).astype(np.uint64) + _B
        for k in range(0, WIDE + LENGTH, Q):  # Q-grams that cover the block
            gram = h[np.minimum(first + k, last + LENGTH - Q)]
            one, two = mix(one * _A + gram), mix(two * _B + gram)
        yield d[row], x[row], first - off[row], last - first + LENGTH, head, one, two, first, part


def repeated_windows(starts: np.ndarray, lengths: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Which windows of blocks (in order of their place) occur in an earlier window of them: a flag for each window of each block."""
    room = np.repeat(starts + lengths, lengths) - np.arange(len(raw))  # bytes from a position to the end of its block
    at, span, first = np.flatnonzero(room >= START), START, np.zeros(0, np.int64)
    key = np.ndarray(len(raw) - START + 1, "<u8", raw, strides=(1,))[at]
    pointer = np.full(len(raw), -1)  # to the position's bucket; -1: no other string of the block is equal
    while True:
        _, first, bucket, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        pointer[:] = -1
        shared = size[bucket] > 1
        pointer[at[shared]] = bucket[shared]
        if span == LENGTH:
            break
        step = min(span, LENGTH - span)
        at = at[shared]
        at = at[room[at] >= span + step]
        at = at[pointer[at + step] >= 0]
        key = pointer[at] << 32 | pointer[at + step]
        span += step
    later = pointer >= 0
    later[at[first]] = False
    return later[gather(np.arange(len(raw)), starts, lengths - LENGTH + 1)]


def window_keys(block: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, start in it, two keys) of each window of the blocks: the keys mix the identifiers of the Q-grams that cover it."""
    parts = block.to_pylist()
    lengths = np.array([len(p) for p in parts], np.int64)
    many = lengths - LENGTH + 1
    h = gram_hashes(np.frombuffer(b"".join(parts), np.uint8))
    at = gather(np.arange(int(lengths.sum())), np.cumsum(lengths) - lengths, many)
    one, two = np.zeros(len(at), np.uint64), np.full(len(at), _B)
    for k in (*range(0, LENGTH - Q, Q), LENGTH - Q):
        one, two = mix(one * _A + h[at + k]), mix(two * _B + h[at + k])
    own = np.repeat(np.arange(len(parts)), many)
    return own, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many), one.view(np.int64), two.view(np.int64)


def _later(rows: DataFrame) -> DataFrame:
    """(d, x, s, e) of the strings that equal an earlier one. Rows: one and two (the string's keys), d, x, s (its place), n (its length)."""
    rows = rows.select(F.struct("one", "two").alias("block"), "d", "x", "s", "n")
    firsts = rows.groupBy("block").agg(F.min(F.struct("d", "x", "s")).alias("first"), F.count(F.lit(1)).alias("r")).filter("r > 1")
    return spread_join(rows, written(firsts), "block", "r").filter(F.struct("d", "x", "s") != F.col("first")).select("d", "x", "s", (F.col("s") + F.col("n")).alias("e"))


def _runs(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first, last) of each run of flagged windows."""
    block = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(flags)) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit, hit
    new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (block[hit[1:]] != block[hit[:-1]])]))
    end = hit[np.append(new[1:], len(hit)) - 1]
    return block[hit[new]], place[hit[new]], place[end]


def _refine(rows: pa.Table) -> pa.RecordBatch:
    """(d, x, s, e) of the removed strings of first blocks. Rows of whole anchors: h, d, x, s, block."""
    c = {n: rows.column(n).to_numpy() for n in ("h", "d", "x", "s")}
    same = rows.column("block").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((c["s"], c["x"], c["d"], same, c["h"]))
    h, same = c["h"][order], same[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (same[1:] != same[:-1])])
    order, h = order[new], h[new]  # the first of equal blocks
    edge = np.concatenate([[True], h[1:] != h[:-1]])
    alone = edge & np.append(edge[1:], True)
    order = order[~alone]
    order = order[np.lexsort((c["s"][order], c["x"][order], c["d"][order]))]
    if not len(order):
        return pa.RecordBatch.from_pydict({"d": pa.array([], pa.int64()), "x": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "e": pa.array([], pa.int64())})
    parts = rows.column("block").take(pa.array(order)).to_pylist()
    lengths = np.array([len(p) for p in parts], np.int64)
    flags = repeated_windows(np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(parts), np.uint8))
    block, first, last = _runs(flags, lengths - LENGTH + 1)
    own = order[block]
    s = c["s"][own] + first
    return pa.RecordBatch.from_pydict({"d": c["d"][own], "x": c["x"][own], "s": s, "e": s + (last - first) + LENGTH})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """id_col, n_bytes, spans (array of struct<start, end>: maximal removed runs of bytes) and kept (binary) of each row.

    heavy: anchors with more places spread over tasks; the result is the same.
    """
    spark, two = docs.sparkSession, docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    send = spark.sparkContext.broadcast

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, part, off in _texts(batches):
            _, _, _, anchor, h = blocks(part, off)
            yield pa.RecordBatch.from_arrays([pa.array(h[anchor].view(np.int64))], names=["h"])

    twice = written(two.mapInArrow(anchors, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = twice.filter(F.col("n") > heavy)
    known, hot_anchors, hot_places = twice.agg(F.count("n"), F.count(F.when(F.col("n") > heavy, 1)), F.coalesce(F.sum(F.when(F.col("n") > heavy, F.col("n"))), F.lit(0))).first()
    bits, hot_bits = field_bits(known), field_bits(hot_anchors)
    marks = send(bit_field(twice.select("h"), bits, 1))
    hot_marks = send(bit_field(hot.select("h"), hot_bits, 1))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, s, n, _, one, other, _, _ in _flagged(batches, marks.value, bits):
            yield pa.RecordBatch.from_pydict({"one": one.view(np.int64), "two": other.view(np.int64), "d": d, "x": x, "s": s, "n": n})

    def contents(batches: Iterator[pa.RecordBatch], spread: bool) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, x, s, n, h, one, other, first, part in _flagged(batches, marks.value, bits):
            own = np.flatnonzero(_marked(h.view(np.int64), hot_marks.value, hot_bits) == spread)
            keep, text = [], part.tobytes()
            for k, key, place in zip(own.tolist(), zip(one[own].tolist(), other[own].tolist()), zip(d[own].tolist(), x[own].tolist(), s[own].tolist())):
                before = sent.get(key)
                if before is None or place < before:
                    if len(sent) < 500_000 or before is not None:  # beyond, equal blocks are sent again: slower, not different
                        sent[key] = place
                    keep.append(k)
            if keep:
                k = np.array(keep)
                yield pa.RecordBatch.from_pydict({"h": h[k].view(np.int64), "d": d[k], "x": x[k], "s": s[k], "block": pa.array([text[a:b] for a, b in zip(first[k].tolist(), (first[k] + n[k]).tolist())], pa.binary())})

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > 20_000:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                stop = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0  # the last anchor may go on
                if stop:
                    yield _refine(table.slice(0, stop))
                    held = table.slice(stop).to_batches()
        if held:
            yield _refine(pa.Table.from_batches(held))

    # blocks that equal an earlier one go whole; the first of each goes through the refinement
    again = _later(two.mapInArrow(places, "one long, two long, d long, x long, s long, n long"))
    fields = "h long, d long, x long, s long, block binary"
    met = two.mapInArrow(lambda batches: contents(batches, False), fields).repartition("h").sortWithinPartitions("h")
    gone = again.unionByName(met.mapInArrow(refine, "d long, x long, s long, e long"))
    if hot_anchors:
        spread = written(two.mapInArrow(lambda batches: contents(batches, True), fields).select("d", "x", "s", "block"))

        def keys(batch: pa.RecordBatch) -> np.ndarray:
            return window_keys(batch.column(3))[2] if batch.num_rows else np.zeros(0, np.int64)

        window_bits = field_bits(WIDE * hot_places)
        met_twice = send(bit_field(spread, window_bits, 2, of=keys))  # packed where they are made

        def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    parts = batch.column(3).to_pylist()
                    _, _, one, _ = window_keys(batch.column(3))
                    own, first, last = _runs(_marked(one, met_twice.value, window_bits), np.array([len(p) - LENGTH + 1 for p in parts]))
                    strings = [parts[i][a : b + LENGTH] for i, a, b in zip(own.tolist(), first.tolist(), last.tolist())]
                    keys = np.array([xxhash.xxh3_128_intdigest(p).to_bytes(16, "little") for p in strings], "S16").view(np.int64).reshape(-1, 2) if strings else np.zeros((0, 2), np.int64)
                    d, x, s = (batch.column(c).to_numpy()[own] for c in range(3))
                    yield pa.RecordBatch.from_pydict({"one": keys[:, 0].copy(), "two": keys[:, 1].copy(), "d": d, "x": x, "s": s + first, "n": last - first + LENGTH, "block": pa.array(strings, pa.binary())})

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own, start, one, other = window_keys(batch.column(3))
                    d, x, s = (batch.column(c).to_numpy()[own] for c in range(3))
                    yield pa.RecordBatch.from_pydict({"one": one, "two": other, "d": d, "x": x, "s": s + start, "n": np.full(len(own), LENGTH)})

        # as with whole blocks: runs of such windows that equal an earlier run go whole, and the first of each is looked at by windows
        runs = written(spread.mapInArrow(trimmed, "one long, two long, d long, x long, s long, n long, block binary"))
        kinds = runs.groupBy("one", "two").agg(F.min_by(F.struct("d", "x", "s", "block"), F.struct("d", "x", "s")).alias("first")).select("first.*")
        gone = gone.unionByName(_later(runs)).unionByName(_later(kinds.mapInArrow(windows, "one long, two long, d long, x long, s long, n long")))
    cuts = written(gone.groupBy("d", "x").agg(F.collect_list(F.struct("s", "e")).alias("cuts")))

    # texts that lose nothing pass straight through; the others meet their cuts
    field, size = marked(cuts.select(F.col("x").alias("head")), 1)
    losers = send(field)
    result = f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, x, part, off in _texts(batches):
            k = np.flatnonzero(~_marked(x, losers.value, size))
            text, n = part.tobytes(), off[k + 1] - off[k]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(n), pa.array([[]] * len(k), pa.list_(span)), pa.array([text[a:b] for a, b in zip(off[k].tolist(), off[k + 1].tolist())], pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, d, x, part, off in _texts(batches):
            k = np.flatnonzero(_marked(x, losers.value, size))
            text = part.tobytes()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(d[k]), pa.array(x[k]), pa.array([text[a:b] for a, b in zip(off[k].tolist(), off[k + 1].tolist())], pa.binary())], names=["id", "d", "x", "bytes"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                pairs = batch.column(2)[i].values
                s, e = (np.array(pairs.field(k)) for k in (0, 1)) if pairs is not None else (np.zeros(0, np.int64),) * 2
                order = np.argsort(s)
                s, e = s[order], np.maximum.accumulate(e[order]) if len(e) else e
                new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else s
                s, e = s[new], e[np.append(new[1:], len(s)) - 1] if len(s) else e
                edges = [0, *(y for p in zip(s.tolist(), e.tolist()) for y in p), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([len(text)], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())]], pa.list_(span)), pa.array([kept], pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    clean = two.mapInArrow(whole, result)
    hit = two.mapInArrow(losing, f"id {kind}, d long, x long, bytes binary").join(cuts, ["d", "x"], "left").select("id", "bytes", "cuts").mapInArrow(without, result)
    return clean.unionByName(hit).withColumnRenamed("id", id_col)
