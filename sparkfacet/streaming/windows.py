"""Event streams: late and repeated rows, windows, and runs over all files that have come in."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows in one part of a table that is run as a stream.
CHUNK = 20_000_000


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder; without files_per_batch all that have come in make one batch, in which no row is late."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def window_counts(events: DataFrame, length: str, delay: str) -> DataFrame:
    """(start, event_type, n) of windows of ts that are over, each event_id counted once; rows later than delay are dropped.
    State holds the ids and open windows of the delay only."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    counts = once.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


def run_available(stream: DataFrame, target: str) -> DataFrame:
    """Runs the stream over what is there, into Parquet files under target, and reads them. With the same target, a later
    call goes on where the last one stopped, also after a failure."""
    query = stream.writeStream.format("parquet").option("path", f"{target}/rows").option("checkpointLocation", f"{target}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{target}/rows")


def run_table(events: DataFrame, length: str, delay: str, target: str, chunk: int = CHUNK) -> DataFrame:
    """window_counts of a whole table, however its files lie: it comes in as parts of about chunk rows in order of ts, and the
    stream goes on after each, so that no row is late and state stays bounded by a part and the delay."""
    spark = events.sparkSession
    events = events.filter("ts is not null")  # in no window
    second = F.col("ts").cast("double")
    parts = math.ceil(events.count() / chunk)
    edges = sorted(set(events.select(second.alias("s")).approxQuantile("s", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    folder, out = f"{target}/in", None
    for a, b in zip([None, *edges], [*edges, None]):
        part = events if a is None else events.filter(second >= a)
        (part if b is None else part.filter(second < b)).write.mode("append").parquet(folder)
        out = run_available(window_counts(file_stream(spark, folder, events.schema), length, delay), target)
    return out
