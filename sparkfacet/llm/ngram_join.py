"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by grouped prefixes.

1. Documents with the same set are one class. Sets are hashed in tasks; a corpus-wide sketch of fixed size estimates how
   common each shingle is, and all sets are ordered by (estimate, hash), so that very common shingles come last.
2. A set of n shingles has a prefix of n - ceil(t n) + 1: two sets that link share a prefix shingle. Classes with the same
   prefix and size form one group; groups, not classes, meet on prefix shingles.
3. Each group is first verified against the leader of each of its shingles only (the most typical group there), which links
   most of a family of copies with few comparisons. A bitmap for each class bounds the overlap from above; whole sets are
   shuffled only for pairs that it leaves. Components follow from these links.
4. What the leaders haven't settled: members in different components that share a prefix shingle are compared within the
   shingle's bucket, by size and bitmap; a large bucket is cut into blocks that
   meet pairwise in separate tasks. Pairs that may link are verified on the whole sets.

No link between different components is lost, no pair inside a component has to be made, and only verified pairs link.

Cases: a null or empty text, or one without words, has an empty set, links with nothing and is its own component; fewer
words than n are one shingle; repeated rows and equal sets are one class, always linked; a null id counts as larger
than all others (a component of such rows only has a null id); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._arrow import SPACE, list_array, mix, slices, text_buffers, word_hashes
from sparkfacet.llm._spark import components, marked, spread_join, written
from sparkfacet.llm.exact_dedup import maybe_repeated

#: Counters of the sketch, and counters in one of its chunks.
CELLS, CHUNK = 1 << 21, 1 << 12
#: Bits of a class's bitmap, and classes in one block of a bucket.
BITMAP, BLOCK = 1024, 512
#: Groups in a bucket that is sifted before sets are made; larger ones go on whole.
SMALL = 64

SPACE_FREE = ~SPACE
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct hashes of each row's n-grams of words, in ascending order."""
    hashes, counts = word_hashes(raw, offsets, SPACE_FREE)
    ends = np.cumsum(counts)
    total, gram = len(hashes), np.zeros(len(hashes), np.uint64)
    for k in range(words):
        gram[: max(total - k, 0)] = gram[: max(total - k, 0)] * _STEP + hashes[k:]
    gram = mix(gram)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(gram[end - n : end - words + 1]))
        elif n:
            few = np.array([n], np.uint64)
            for k in range(end - n, end):
                few = few * _STEP + hashes[k]
            out.append(mix(few))
        else:
            out.append(gram[:0])
    return out


def parities(s: np.ndarray) -> bytes:
    """A bitmap of a set: whether an odd number of shingles falls on each bit. Two bitmaps differ in at most as many bits as
    the sets have shingles that they don't share, also where a long set falls on each bit several times."""
    return np.packbits(np.bincount((s >> np.uint64(32)).astype(np.int64) % BITMAP, minlength=BITMAP).astype(np.uint8) & 1).tobytes()


def _maps(bits: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint8).view(np.uint64).reshape(-1, BITMAP // 64)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch], column: int, words: int):
    """Slices of the batches: the first column's rows, and their sets."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(column))
        for a, b in slices(offsets):
            yield batch.column(0)[a:b], shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)


def classes_and_sketch(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, k: the set's key) of each row, and the sketch's counters."""
    kind = docs.schema[id_col].dataType
    names = ["id", "n", "k", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, arrow = np.zeros(CELLS, np.int32), None
        for ids, sets in _sets(batches, 1, words):
            arrow, none = ids.type, [None] * len(ids)
            sketch += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)
        chunks = [k for k in range(CELLS // CHUNK) if sketch[k * CHUNK : (k + 1) * CHUNK].any()]
        if chunks:
            none, parts = [None] * len(chunks), [sketch[k * CHUNK : (k + 1) * CHUNK].astype(np.int32) for k in chunks]
            parts = [zlib.compress(p.tobytes(), 1) for p in parts]  # mostly small numbers
            yield pa.RecordBatch.from_arrays([pa.array(none, arrow), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())], names=names)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(part), np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    both = written(docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, n long, k binary, chunk int, counts binary"))
    summed = both.filter("chunk is not null").select("chunk", "counts").repartition(64, "chunk").mapInArrow(add_up, "chunk int, counts binary")
    sketch = np.zeros(CELLS, np.int64)  # 16 MB
    for k, part in summed.toLocalIterator():  # CELLS numbers in all
        sketch[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(part, np.int64)
    return both.filter("chunk is null").select("id", "n", "k"), sketch


def prefixes(docs: DataFrame, text_col: str, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """(k, g: key of prefix and size, n, usual: mean estimate of the prefix, prefix, bits: parities) of each class with a shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for _, sets in _sets(batches, 0, words):
            rows = []
            for s in sets:
                n = len(s)
                if n:
                    usual = table[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                    first = np.lexsort((s, usual))[: n - (n * percent + 99) // 100 + 1]
                    head = s[first]
                    rows.append((_key(s), hashlib.blake2b(head.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest(), n, float(usual[first].mean()), head, parities(s)))
            if rows:
                k, g, n, usual, heads, maps = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(g, pa.binary()), pa.array(n, pa.int64()), pa.array(usual, pa.float64()), list_array(np.concatenate(heads).view(np.int64), np.array([len(h) for h in heads]), pa.int64()), pa.array(maps, pa.binary())], names=["k", "g", "n", "usual", "prefix", "bits"])

    return docs.select(text_col).mapInArrow(run, "k binary, g binary, n long, usual double, prefix array<long>, bits binary").dropDuplicates(["k"])


def whole_sets(docs: DataFrame, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """(k, s: the set) of the classes in wanted (k, each once). A bit field of bounded size drops most other texts early."""
    spark = docs.sparkSession
    heads = wanted.select(F.conv(F.hex(F.substring("k", 1, 7)), 16, 10).cast("long").alias("head"))
    field, bits = marked(heads, 1)
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for _, sets in _sets(batches, 0, words):
            rows = []
            for s in sets:
                key = _key(s)
                at = int.from_bytes(key[:7], "big") % bits
                if len(s) and marks[at >> 3] >> (at & 7) & 1:
                    rows.append((key, s))
            if rows:
                k, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), list_array(np.concatenate(s).view(np.int64), np.array([len(x) for x in s]), pa.int64())], names=["k", "s"])

    return docs.select(text_col).mapInArrow(run, "k binary, s array<long>").dropDuplicates(["k"]).join(wanted, "k", "left_semi")


def may_link(percent: int):
    """A function of the columns n, bits of two classes: whether their bitmaps leave room for enough common shingles."""

    @F.arrow_udf("boolean")
    def room(n: pa.Array, bits: pa.Array, m: pa.Array, others: pa.Array) -> pa.Array:
        both = n.to_numpy() + m.to_numpy()
        most = (both - np.bitwise_count(_maps(bits) ^ _maps(others)).sum(axis=1).astype(np.int64)) // 2  # of the intersection
        return pa.array(100 * most >= percent * (both - most))

    return room


def verified(docs: DataFrame, text_col: str, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    wanted = written(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct())
    sets = written(whole_sets(docs, text_col, wanted, words))
    own = sets.select(F.col("k").alias("a"), F.col("s").alias("sa"))
    other = sets.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    full = pairs.join(own, "a").join(other, "b")
    return full.select("a", "b", both.alias("x"), (F.size("sa") + F.size("sb") - both).alias("u")).filter(F.col("x") * 100 >= F.col("u") * percent).select("a", "b")


def open_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket (t, lo, hi) that may link though their components differ. Rows: t, lo, hi, block, k, n, root, bits."""

    def compare(rows: pa.Table) -> list[tuple[bytes, bytes]]:
        k, root = rows.column("k").to_pylist(), np.unique(rows.column("root").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)[1]
        n = rows.column("n").to_numpy()
        block = rows.column("block").to_numpy()
        maps = _maps(rows.column("bits"))
        out, mixed = [], rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py()
        for i in range(len(k) - 1):
            rest = np.arange(i + 1, len(k))
            may = root[rest] != root[i]
            if mixed:
                may &= block[rest] != block[i]
            may &= 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])
            rest = rest[may]
            if len(rest):
                apart = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1)
                most = (n[rest] + n[i] - apart.astype(np.int64)) // 2  # of the intersection
                for j in rest[100 * most >= percent * (n[rest] + n[i] - most)].tolist():
                    out.append((min(k[i], k[j]), max(k[i], k[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: set[tuple[bytes, bytes]] = set()

        def groups(last: bool):
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([table.column(c).to_numpy() for c in ("t", "lo", "hi")])
            edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
            stop = len(edges) - 1 if last else len(edges) - 2
            for a, b in zip(edges[:stop].tolist(), edges[1 : stop + 1].tolist()):
                if b - a > 1:
                    seen.update(compare(table.slice(a, b - a)))
            held = table.slice(int(edges[stop])).to_batches()

        def found():
            a, b = zip(*seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                groups(False)
            if len(seen) > 100_000:
                yield found()
        if held:
            groups(True)
        if seen:
            yield found()

    return buckets.mapInArrow(run, "a binary, b binary").distinct()


def with_partner(quiet: DataFrame, busy: DataFrame, percent: int) -> DataFrame:
    """Rows (t, g, n, members, lead: the most typical of the bucket) of two frames (t, at, g, n, usual, members),
    without those that link with nothing on this shingle. Buckets in quiet have at most SMALL groups; busy has their number, r.

    If a shingle is the first that two sets share, at most n - at of each are common: sizes and places rule most chance
    meetings out. Buckets of up to SMALL groups are sifted; larger ones are kept as they are.
    """
    small, row = F.col("r") <= SMALL, F.struct("usual", "g", "n", "at", "members")

    def meets(x, y):
        sizes = F.least(x.n, y.n) * 100 >= F.greatest(x.n, y.n) * percent
        room = F.least(x.n - x.at, y.n - y.at) * (100 + percent) >= (x.n + y.n) * percent
        return (x.g != y.g) & sizes & room

    lists = quiet.unionByName(busy.filter(small).select(quiet.columns)).groupBy("t").agg(F.collect_list(row).alias("all"))
    left = F.filter("all", lambda x: (x.members > 1) | F.exists("all", lambda y: meets(x, y)))
    few = lists.select("t", left.alias("left")).select("t", F.explode("left").alias("x"), F.array_max("left").alias("lead")).select("t", "x.g", "x.n", "x.members", "lead")
    large = busy.filter(~small)
    leads = large.groupBy("t").agg(F.max(row).alias("lead"), F.count(F.lit(1)).alias("many"))
    many = spread_join(large.select("t", "g", "n", "members"), written(leads), "t", "many").select("t", "g", "n", "members", "lead")
    return few.unionByName(many)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id reachable by links of percent/100 or more) of each row."""
    rows, sketch = classes_and_sketch(docs, id_col, text_col, words)
    cls = written(prefixes(docs, text_col, sketch, words, percent))
    groups = written(cls.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.first("n").alias("n"), F.first("usual").alias("usual"), F.first("prefix").alias("prefix")))
    tokens = groups.select(F.posexplode("prefix").alias("at", "t"), "g", "n", "usual", "members")
    counts = groups.select(F.explode("prefix").alias("t"), "members").groupBy("t").agg(F.sum("members").alias("m"), F.count(F.lit(1)).alias("r"))
    buckets = written(counts.filter("m > 1").select("t", "r"))
    # bit fields of bounded size: most shingles stay alone, and their rows are dropped before they shuffle; of the rest,
    # few may be in a large bucket, and only their rows have to be joined with the bucket's size
    spark = docs.sparkSession
    heads, large = buckets.select(F.col("t").alias("head"), "r"), F.col("r") > SMALL
    (field, bits), (large_field, large_bits) = marked(heads.select("head"), 1), marked(heads.filter(large).select("head"), 1)
    shared, crowded = maybe_repeated(spark, field, bits), maybe_repeated(spark, large_field, large_bits)
    tokens = tokens.filter(shared(F.pmod("t", F.lit(bits))))
    in_large = crowded(F.pmod("t", F.lit(large_bits)))
    busy = written(spread_join(tokens.filter(in_large), buckets, "t", "r"))
    hits = written(with_partner(tokens.filter(~in_large), busy, percent))
    kept = hits.select("g").distinct()
    light = written(cls.select("k", "g", "n", "bits").join(kept, "g", "left_semi"))

    # each member of a group against one member of the leading groups
    alike = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    stars = hits.filter(alike & ((F.col("g") != F.col("lead.g")) | (F.col("members") > 1))).select("g", F.col("lead.g").alias("of")).distinct()
    first = light.groupBy(F.col("g").alias("of")).agg(F.min(F.struct("k", "n", "bits")).alias("b"))
    pairs = stars.join(light.select("g", F.struct("k", "n", "bits").alias("a")), "g").join(first, "of").filter("a.k != b.k")
    pairs = written(pairs.filter(may_link(percent)("a.n", "a.bits", "b.n", "b.bits")).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")))
    edges = written(verified(docs, text_col, pairs, words, percent))
    roots = components(edges, "a", "b")

    # what is left: classes of different components in one bucket
    light = written(light.join(roots.withColumnRenamed("id", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")))
    in_bucket = hits.select("t", "g").join(light.select("k", "g", "root"), "g").select("t", "k", "root")
    several = written(in_bucket.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("r")).filter("low != high").select("t", "r"))
    meet = spread_join(in_bucket.select("t", "k"), several, "t", "r").join(light.select("k", "n", "root", "bits"), "k")
    parts = F.ceil(F.col("r") / BLOCK).cast("int")
    meet = meet.withColumn("block", F.pmod(F.xxhash64("k"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    meet = meet.select("t", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "k", "n", "root", "bits")
    meet = meet.repartition("t", "lo", "hi").sortWithinPartitions("t", "lo", "hi")
    more = verified(docs, text_col, written(open_pairs(meet, percent)), words, percent)
    every = written(edges.unionByName(more))
    roots = components(every, "a", "b")

    # ids: the smallest of each class, then of each component
    low = rows.filter("n > 0").groupBy("k").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("size"))
    of = written(low.join(roots.withColumnRenamed("id", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")))
    best = of.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("r"))
    label = spread_join(of.select("k", "size", "root"), written(best), "root", "r").select("k", "size", "component_id")
    done = spread_join(rows.filter("n > 0"), written(label), "k", "size").select("id", "n", "component_id")
    none = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return done.unionByName(none).withColumnsRenamed({"id": id_col, "n": "n_shingles"})
