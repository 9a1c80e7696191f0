"""Exact deduplication by two-pass Bloom filtering.

Pass 1 hashes every normalised text and marks PROBES positions of a bit field for it; a position that two rows mark is
kept as "twice". Pass 2 tests each row: unless all its positions are "twice", its hash occurs once and the row passes
straight through. Only the others (all repeats and a few false alarms) shuffle, to be grouped by their whole SHA-256.

A field has at most max_bits bits, so what is broadcast is bounded (32 MB by default). When a corpus outgrows one field,
hashes are dealt into ranges with a field each, and rows lie in a folder for each range, so that each field is as sparse as
the first. Positions are packed and pre-aggregated in each task (two bytes each) before they meet.

Cases: a null text is an empty text, and all empty texts are equal; texts that differ in white space only are equal; of
equal texts the one with the most code points stays, then the smallest id, an id that is null coming last; of wholly
equal rows (same id too) exactly one is kept; an empty table gives an empty result; columns of any other name pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._arrow import BASE, mix, text_buffers
from sparkfacet.llm._spark import MAX_BITS, bit_field, cut, field_bits, spread_join, table_path, written

WHITE = b" \t\n\x0b\x0c\r"
PROBES = 3
RANGE = "__range"


def _prints(texts: pa.Array) -> tuple[list[str], np.ndarray, list[int]]:
    """SHA-256 of each normalised text, its first 8 bytes as a number, and the code points of the original."""
    raw, offsets = text_buffers(texts)
    sha, head, points = [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = raw[a:b]
        digest = hashlib.sha256(text.tobytes().translate(None, WHITE)).digest()
        sha.append(digest.hex())
        head.append(digest[:8])
        points.append(b - a - int(np.count_nonzero((text & 0xC0) == 0x80)))
    return sha, np.frombuffer(b"".join(head), np.int64), points


def _positions(heads: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES positions (rows) of hashes in a field of bits bits."""
    h = heads.view(np.uint64)
    return np.stack([mix(h + step) % np.uint64(bits) for step in np.arange(1, PROBES + 1, dtype=np.uint64) * BASE]).astype(np.int64)


def _all_marked(field: bytes, at: np.ndarray) -> np.ndarray:
    marks = np.frombuffer(field, np.uint8)
    return ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1).all(axis=0)


def fingerprint(text: str | Column, test: Callable[[np.ndarray], np.ndarray] | None = None) -> Column:
    """struct<sha, head, points, maybe> of a text; maybe: what test says of head."""

    @F.arrow_udf("sha string, head long, points long, maybe boolean")
    def prints(texts: pa.Array) -> pa.Array:
        sha, head, points = _prints(texts)
        maybe = pa.array(test(head)) if test else pa.nulls(len(sha), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(sha, pa.string()), pa.array(head), pa.array(points, pa.int64()), maybe], ["sha", "head", "points", "maybe"])

    return prints.asNondeterministic()(text)  # so that Spark doesn't compute it again for each use


def repeated_bits(heads: DataFrame, bits: int) -> bytes:
    """The field: bit p is 1 if at least two of the rows' positions are p. heads has one column, head."""
    return bit_field(heads, bits, 2, lambda h: _positions(h, bits).ravel())


def in_field(spark, field: bytes, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whether all positions of hashes are marked, for use in tasks."""
    shared = spark.sparkContext.broadcast(field)
    return lambda heads: _all_marked(shared.value, _positions(heads, bits))


def _tester(test: Callable[[np.ndarray], np.ndarray]):
    @F.arrow_udf("boolean")
    def tester(heads: pa.Array) -> pa.Array:
        return pa.array(test(heads.to_numpy()))

    return tester


def maybe_repeated(spark, field: bytes, bits: int):
    """A function of columns of positions: whether all of them are marked."""
    shared = spark.sparkContext.broadcast(field)

    @F.arrow_udf("boolean")
    def test(*at: pa.Array) -> pa.Array:
        return pa.array(_all_marked(shared.value, np.stack([p.to_numpy(zero_copy_only=False) for p in at])))

    return test


def ranges_of(rows: int, max_bits: int) -> int:
    return max(1, -(-16 * rows // max_bits))


def _by_range(rows: DataFrame, heads: DataFrame, ranges: int, max_bits: int) -> DataFrame:
    """rows (with head) and maybe, a range of hashes at a time, each appended to one table. heads: all hashes. Each range reads
    its own folders only; one field is held at a time, and plans don't grow with the ranges."""
    spark = rows.sparkSession
    of = F.pmod(F.xxhash64("head", F.lit("range")), F.lit(ranges)).cast("int")
    heads, rows = (written(x.withColumn(RANGE, of), RANGE) for x in (heads, rows))
    path, schema = table_path(spark), None
    for k in range(ranges):
        shared = spark.sparkContext.broadcast(repeated_bits(heads.filter(F.col(RANGE) == k).select("head"), max_bits))
        test = _tester(lambda h, shared=shared: _all_marked(shared.value, _positions(h, max_bits)))
        part = rows.filter(F.col(RANGE) == k).drop(RANGE).withColumn("maybe", test("head"))
        part.write.mode("append").parquet(path, compression="zstd")
        shared.unpersist()
        schema = part.schema
    return spark.read.schema(schema).parquet(path)


def _groups(rows: DataFrame) -> DataFrame:
    """sha, group_size, best (of the row that stays) from sha, points, id, tag; partial sums come before the shuffle."""
    order = F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("last"), F.col("id"), F.col("tag"))
    return rows.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, head, points = _prints(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(head), pa.array(points, pa.int64())], names=["id", "sha", "head", "points"])

    # 100 bytes a row, without the text; a written copy, so that both passes see the same tags
    hashed = cut(docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, sha string, head long, points long").withColumn("tag", F.monotonically_increasing_id()))
    tested = cut(_by_field(hashed, hashed.select("head"), hashed.count(), max_bits))
    single = tested.filter("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = tested.filter("maybe").drop("maybe", "head")
    groups = cut(_groups(again))
    joined = spread_join(again, groups, "sha", "group_size")
    several = joined.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("tag") == F.col("best.tag")).alias("kept"), "sha")
    return single.unionByName(several).withColumnsRenamed({"id": id_col, "sha": "text_sha256"})


def _by_field(rows: DataFrame, heads: DataFrame, n: int, max_bits: int) -> DataFrame:
    """rows and maybe, by one field or a field for each range."""
    if ranges_of(n, max_bits) > 1:
        return _by_range(rows, heads, ranges_of(n, max_bits), max_bits)
    bits = field_bits(n, max_bits)
    test = in_field(rows.sparkSession, repeated_bits(heads, bits), bits)
    return rows.withColumn("maybe", _tester(test)("head"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that pass the filter straight through don't shuffle.

    The first pass reads the texts alone and writes their hashes; the second fingerprints and tests in one function and writes
    the rows with what it found, so that nothing computes a fingerprint again.
    """
    spark, columns = docs.sparkSession, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_prints(batch.column(0))[1])], names=["head"])

    heads = cut(docs.select(text_col).mapInArrow(run, "head long"))
    n = heads.count()
    bits, one = field_bits(n, max_bits), ranges_of(n, max_bits) == 1
    test = in_field(spark, repeated_bits(heads, bits), bits) if one else None
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), fingerprint(F.col(text_col), test).alias("p"))
    rows = rows.select("row", "p.*", F.col(f"row.`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("tag"))
    tested = written(rows if one else _by_range(rows.drop("maybe"), heads, ranges_of(n, max_bits), max_bits))
    again = tested.filter("maybe")
    stay = written(_groups(again.select("sha", "points", "id", "tag")).select(F.col("best.tag").alias("tag")))
    return tested.filter("not maybe").select("row.*").unionByName(again.join(stay, "tag", "left_semi").select("row.*"))
