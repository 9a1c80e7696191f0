"""Helpers for plans: written cuts of the lineage, joins that survive hot keys, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT of all rows is hot. There are fewer than HOT such keys, whatever the data.
HOT = 2000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A local session may have none (as in tests) and
    gets its own; anywhere else a machine's folder would be lost on the others, so it must be named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkfacet-"))
    return context._jsc.sc().getCheckpointDir().get()


#: The list that tables are noted in, while own_tables() is open.
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what written() makes inside, and nothing else: tables of other results stay. What is made inside
    must be consumed inside."""
    paths: list[str] = []
    token = _OWNER.set(paths)
    try:
        yield
    finally:
        _OWNER.reset(token)
        for path in paths:
            delete(spark, path)


def cut(frame: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder: computed once, and safe from lost executors."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder, of the open own_tables() if there is one."""
    path, owner = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}", _OWNER.get()
    if owner is not None:
        owner.append(path)
    return path


def written(frame: DataFrame, *by: str) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder. Unlike cut(), the plan starts anew with the table's true size,
    so that loops of joins don't multiply size estimates. by: columns with a folder for each value."""
    path = table_path(frame.sparkSession)
    frame.write.parquet(path, partitionBy=list(by) or None, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with keyed (one row per key, with size: the key's number of rows) on key, inner.

    The hot keys are fewer than HOT by their definition; their rows of keyed are broadcast, and rows stay where they
    are. All other keys have at most 1/HOT of the rows each and are shuffled.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    names = [c for c in keyed.columns if c != key]
    right = keyed.select(key, F.struct(*names).alias("__of"))
    few = right.filter(F.col(f"__of.{size}") > total / HOT)
    with_hot = rows.join(F.broadcast(few), key, "left")
    done = with_hot.filter("__of is not null")
    rest = with_hot.filter("__of is null").drop("__of").join(right.filter(F.col(f"__of.{size}") <= total / HOT), key)
    return done.unionByName(rest).select(*rows.columns, *(F.col(f"__of.{c}").alias(c) for c in names))


#: Bits in one piece of a field, and at most in a field (32 MB).
PIECE, MAX_BITS = 32768, 1 << 28


def field_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """16 bits a row, up to max_bits."""
    return min(max_bits, max(PIECE, 1 << (16 * max(rows, 1) - 1).bit_length()))


def bit_field(heads: DataFrame, bits: int, least: int, positions: Callable[[np.ndarray], np.ndarray] | None = None, of: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> bytes:
    """A field in which bit p is 1 if at least `least` positions of heads are p; by default a head's position is its value
    modulo bits. heads: one column of longs, or any rows of which `of` makes longs in the task, so that these are no rows.

    Each task packs its positions by pieces of the field, two bytes each and none more than `least` times for some CHUNK
    of them, before they shuffle; pieces are then counted apart from each other.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.repeat(at, np.minimum(n, least))
            held.clear()
            first = np.flatnonzero(np.diff(at // PIECE, prepend=-1))
            low, ends = (at % PIECE).astype(np.uint16).tobytes(), [*(2 * first[1:]).tolist(), 2 * len(at)]
            return pa.RecordBatch.from_arrays([pa.array((at[first] // PIECE).astype(np.int32)), pa.array([low[a:b] for a, b in zip((2 * first).tolist(), ends)], pa.binary())], names=["piece", "low"])

        for batch in batches:
            h = batch.column(0).drop_null().to_numpy() if of is None else of(batch)
            if len(h):
                held.append(h % bits if positions is None else positions(h))
                if sum(map(len, held)) > 2_000_000:
                    yield packed()
        if held:
            yield packed()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(np.frombuffer(low, np.uint16), minlength=PIECE)
                counts[k] = np.minimum(counts.get(k, 0) + found, least).astype(np.uint8)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([np.packbits(c == least, bitorder="little").tobytes() for c in counts.values()], pa.binary())], names=["piece", "map"])

    packed_ = heads.mapInArrow(pack, "piece int, low binary").repartition(min(64, max(1, bits // PIECE)), "piece")
    field = np.zeros(bits // 8, np.uint8)
    for piece, chunk in packed_.mapInArrow(add_up, "piece int, map binary").toLocalIterator():  # bits / PIECE rows at most
        a = piece * PIECE // 8
        field[a : a + len(chunk)] = np.frombuffer(chunk, np.uint8)[: len(field) - a]
    return field.tobytes()


def marked(heads: DataFrame, least: int, max_bits: int = MAX_BITS) -> tuple[bytes, int]:
    """The field of the rows' head (a long) modulo its size, and its size."""
    heads = cut(heads)
    bits = field_bits(heads.count(), max_bits)
    return bit_field(heads, bits, least), bits


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) of each end of the edges: root is the smallest id that is reachable.

    Each round takes the smallest root among the neighbours, then the root's own root, until nothing changes. A hub with
    many edges is a skewed key of plain joins, which adaptive execution splits, and is summed before it is shuffled.
    """
    x, y = F.col(a), F.col(b)
    links = written(edges.select(x.alias("id"), y.alias("to")).union(edges.select(y.alias("id"), x.alias("to"))).distinct())
    labels = written(links.groupBy("id").agg(F.min("to").alias("root")).select("id", F.least("id", "root").alias("root")))
    while True:
        near = links.join(labels.select(F.col("id").alias("to"), "root"), "to").groupBy("id").agg(F.min("root").alias("best"))
        hooked = written(labels.join(near, "id").select("id", F.least("root", "best").alias("root"), F.col("root").alias("old")))
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        jumped = written(hooked.join(up, "root").select("id", F.least("root", "top").alias("root"), "old"))
        labels = jumped.select("id", "root")
        if jumped.filter("root != old").isEmpty():
            return labels


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_sparkfacet_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="sparkfacet-")) / "sparkfacet_files.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._sparkfacet_sent = True
