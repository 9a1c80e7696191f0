"""Prefix trie of conversations, by vertical bitmaps in shards that are merged by node.

Turns get their positions by one range sort over all rows, so a conversation of any length spreads over tasks. A shard holds
the turns of about SHARD conversations at STRETCH positions in a row, as hashes. Its index maps (position, turn) to the bitset
of the shard's conversations, in the order of their ids, with one more bitset for each position of those that end there. From
the bitset of those that agree on all earlier turns it goes depth first: the lowest bit left names a turn, the parent's bitset
and that turn's posting give the child, the number of its bits the members, its lowest bit the smallest id. So there is one
intersection for each node. Shards send a row for each node, summed before and after it shuffles.

A node is known by a 128-bit sum of hashes of its turns and their positions; texts aren't compared again. Nodes with one
smallest member form a chain, as that member stays the smallest further down. Sums over subtrees are sums of chains: their
totals go up the tree of chains in doubling steps, then along each chain. The lists of ends are sorted by ranges, packed into
pieces of text and hashed piece by piece, so a list of any length passes through, never held whole.

Cases: rows with a null id are left out; a null role or text is empty; rows of one turn are ordered by role, then text, a
null turn first; repeated rows count as turns of their own; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfacet.llm._spark import spread_join, written

#: Conversations and positions of a shard; ids in a piece of a list; nodes of a chain that one window sums.
SHARD, STRETCH, PIECE_IDS, RUN = 1024, 64, 65_536, 1024
MOD = 1 << 128
NODE = "key binary, depth long, parent binary, conv_id long, n_convs long, n_chars long, ends array<long>"


def ordered_turns(table: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn (16 bytes that stand for role and text), n_chars. Positions come from one sort by ranges of
    all rows: where a conversation begins in its partition, and how many rows of it earlier partitions hold."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = table.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("turn"), F.length("text").cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    runs = placed.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"))  # a row for each partition that a conversation touches
    return placed.withColumn("part", part).join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "turn", "n_chars")


def with_shared_starts(turns: DataFrame, family: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv_id, n_turns) after each conversation c took over the first h turns of c - c % family
    for its own first h ones, h = crc32(c) % (most + 1). As everywhere in SQL, % has the sign of what is divided."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = turns.filter(F.col("pos") <= most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "n_chars"))).alias("head")).withColumnRenamed("conv_id", "base")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    plan = lengths.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(heads, "base", "left")  # a base has family dependants at most
    plan = written(plan.select("conv_id", "n", "h", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")).alias("head")))
    shift = plan.select("conv_id", "n", "h", (F.size("head") - F.col("h")).alias("shift"))
    own = spread_join(turns, shift, "conv_id", "n").filter("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn", "n_chars")
    given = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    convs = plan.select("conv_id", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return given.unionByName(own), convs


def shard_nodes(conv: np.ndarray, pos: np.ndarray, turn: list[int], n_chars: list[int], last: np.ndarray, start: list[int]) -> Iterator[tuple]:
    """The nodes of one shard, whose rows are sorted by conversation and position; start: the sum over each row's conversation
    before the stretch. Yields (key, depth, parent key, smallest id, members, n_chars, ids that end there)."""
    first = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
    ids, begin, low = conv[first].tolist(), pos[first].tolist(), int(pos.min())
    bit = np.repeat(np.arange(len(first)), np.diff(first, append=len(conv))).tolist()
    places, ending, rows = pos.tolist(), last.tolist(), first.tolist()
    postings: dict[tuple[int, int], int] = {}
    ends: dict[int, int] = {}
    for r, b in enumerate(bit):
        at = places[r], turn[r]
        postings[at] = postings.get(at, 0) | 1 << b
        if ending[r]:
            ends[places[r]] = ends.get(places[r], 0) | 1 << b
    alike: dict[int, int] = {}  # conversations that agree on everything before the stretch
    for b, r in enumerate(rows):
        alike[start[r]] = alike.get(start[r], 0) | 1 << b
    top = int(pos.max())
    stack = [(members, low, key) for key, members in alike.items()]
    while stack:
        rest, depth, parent = stack.pop()
        while rest:
            b = (rest & -rest).bit_length() - 1
            r = rows[b] + depth - begin[b]
            child = rest & postings[depth, turn[r]]
            rest ^= child
            key, ended, done = (parent + turn[r]) % MOD, child & ends.get(depth, 0), []
            left = ended
            while left:
                done.append(ids[(left & -left).bit_length() - 1])
                left &= left - 1
            yield key, depth, parent, ids[b], child.bit_count(), n_chars[r], done
            if depth < top and child != ended:
                stack.append((child ^ ended, depth + 1, key))


def _nodes_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def nodes() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        column = lambda name: table.column(name).to_numpy()
        turn = [(a << 64 | b) % MOD for a, b in zip(column("one").astype(np.uint64).tolist(), column("two").astype(np.uint64).tolist())]
        lanes = [table.column(f"sum{k}").to_pylist() for k in range(4)]
        start = [sum(v << 96 - 32 * k for k, v in enumerate(s)) % MOD for s in zip(*lanes)]
        found = list(shard_nodes(column("conv_id"), column("pos"), turn, table.column("n_chars").to_pylist(), table.column("last").to_numpy(zero_copy_only=False), start))
        key, depth, parent, conv, n, chars, ends = zip(*found)
        keys = [pa.array([k.to_bytes(16, "big") for k in x], pa.binary()) for x in (key, parent)]
        return pa.RecordBatch.from_arrays([keys[0], pa.array(depth, pa.int64()), keys[1], *(pa.array(x, pa.int64()) for x in (conv, n, chars)), pa.array(ends, pa.list_(pa.int64()))], names=["key", "depth", "parent", "conv_id", "n_convs", "n_chars", "ends"])

    for batch in batches:
        stretch, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(stretch) | np.diff(bucket)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and b > a and (held[-1].column(0)[0], held[-1].column(1)[0]) != (batch.column(0)[a], batch.column(1)[a]):
                yield nodes()
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield nodes()


def _packed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the comma-joined ids of a node; rows are sorted by key and id."""
    key, ids = b"", []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "joined"])

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or len(ids) >= PIECE_IDS):
                yield piece()
                ids.clear()
            key = k
            ids.append(i)
    if ids:
        yield piece()


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces in their order, one piece at a time."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for k, joined in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if state:
                    yield done()
                key, state = k, hashlib.sha256(joined.encode())
            else:
                state.update(b"," + joined.encode())
    if state:
        yield done()


def merged_nodes(turns: DataFrame, convs: DataFrame, shard: int = SHARD, stretch: int = STRETCH) -> DataFrame:
    """key, parent, depth, conv_id, n_convs, n_chars and ends_sha256 of each node."""
    convs = written(convs)
    buckets = max(1, -(-convs.count() // shard))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("n_chars"))
    rows = turns.unionByName(roots)
    one, two = (F.xxhash64(F.lit(k), "pos", "turn") for k in (1, 2))
    lanes = [F.shiftrightunsigned("one", 32), F.col("one").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("two", 32), F.col("two").bitwiseAND(0xFFFFFFFF)]
    rows = written(rows.select("conv_id", "pos", one.alias("one"), two.alias("two"), "n_chars", F.expr(f"pos div {stretch}").alias("stretch")))
    # what stands before each stretch of the conversations that have several, one row each
    sums = rows.groupBy("conv_id", "stretch").agg(*(F.sum(x).alias(f"lane{k}") for k, x in enumerate(lanes)), F.max("pos").alias("top"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "stretch", "top", *(F.coalesce(F.sum(f"lane{k}").over(earlier), F.lit(0)).alias(f"sum{k}") for k in range(4)))
    sums = sums.join(convs, "conv_id").withColumn("end", F.when(F.col("top") == F.col("n_turns"), F.col("top"))).drop("top", "n_turns")
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(buckets))
    held = rows.join(sums, ["conv_id", "stretch"]).select("stretch", bucket.alias("bucket"), "conv_id", "pos", "one", "two", "n_chars", F.col("pos").eqNullSafe(F.col("end")).alias("last"), *(f"sum{k}" for k in range(4)))
    dealt = held.repartition("stretch", "bucket").sortWithinPartitions("stretch", "bucket", "conv_id", "pos")
    parts = written(dealt.mapInArrow(_nodes_of_shards, NODE))
    nodes = parts.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("n_chars").alias("n_chars"))
    listed = parts.filter("size(ends) > 0").select("key", F.explode("ends").alias("id"))
    pieces = listed.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(_packed_ends, "key binary, first long, joined string")
    hashed = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed_ends, "key binary, ends_sha256 string")
    return nodes.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def subtree_sums(chains: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """chains (conv_id, up: the chain it hangs on, null at the top, and values) with each value summed over the chain and all
    below it: in each step a chain takes in those whose link ends at it, and links get twice as long."""
    done = written(chains)
    while not done.filter("up is not null").isEmpty():
        linked = done.filter("up is not null")
        gain = written(linked.groupBy("up").agg(F.count(F.lit(1)).alias("n_links"), *(F.sum(v).alias(f"{v}_below") for v in values)).withColumnRenamed("up", "conv_id"))
        tops = done.select("conv_id", F.col("up").alias("up_up"))
        further = spread_join(linked.select(F.col("conv_id").alias("id"), "up"), tops.join(gain.select("conv_id", "n_links"), "conv_id").withColumnRenamed("conv_id", "up"), "up", "n_links")
        further = further.select(F.col("id").alias("conv_id"), F.col("up_up").alias("up"))
        sums = done.drop("up").join(gain.drop("n_links"), "conv_id", "left").select("conv_id", *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values))
        done = written(sums.join(further, "conv_id", "left"))
    return done.drop("up")


def prefix_trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, stretch: int = STRETCH) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos from 1 without gaps, turn, n_chars; convs: conv_id, n_turns, also of those without turns."""
    nodes = written(merged_nodes(turns, convs, shard, stretch))
    kids = nodes.filter("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids.withColumnRenamed("parent", "key"), "key", "left").fillna(0, ["n_children"]))
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = spread_join(nodes.filter("depth > 0").withColumnRenamed("n_children", "children").drop("key"), parents, "parent", "n_children")
    root = nodes.filter("depth = 0").withColumnRenamed("n_children", "children").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), (F.col("children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"), "ends_sha256"]
    nodes = written(root.select(*columns).unionByName(below.select(*columns)))
    # chains: nodes with one smallest member
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("head"), F.min_by("parent_conv_id", "depth").alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chains = written(chains)
    totals = subtree_sums(chains.drop("head"), ("leaves", "saved"))
    hung = chains.filter("up is not null").select("conv_id", "up", (F.col("head") - 1).alias("depth")).join(totals, "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    both = [(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in ("leaves", "saved")]
    nodes = written(nodes.join(hung, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *both, "ends_sha256", F.expr(f"depth div {RUN}").alias("run")))
    # from each node to the end of its chain: within its run, and the runs after it
    after = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = nodes.groupBy("conv_id", "run").agg(F.sum("leaves").alias("a"), F.sum("saved").alias("b"))
    later = runs.select("conv_id", "run", F.sum("a").over(after).alias("later_leaves"), F.sum("b").over(after).alias("later_saved")).filter("later_leaves is not null")
    within = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = nodes.withColumns({"leaves": F.sum("leaves").over(within), "saved": F.sum("saved").over(within)}).join(later, ["conv_id", "run"], "left")
    n_leaves, saved = ((F.col(v) + F.coalesce(f"later_{v}", F.lit(0))).alias(name) for v, name in (("leaves", "n_leaves"), ("saved", "saved_tokens")))
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", n_leaves, saved, "ends_sha256")
