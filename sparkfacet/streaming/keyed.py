"""Folds over each key's rows in order of time: over a table, and over a stream with the state kept between batches.

A Fold takes a key's state and its next row to the new state and the row's result. The same fold runs in both ways, so a
stream gives what the table gives. A stream keeps one small value for each key in the state store, and forgets it by a timer
once the fold says that it makes no difference any more.

Cases: rows with a null key or time are left out; rows of one time are taken by id; repeated rows count each; an empty table
or stream gives no rows; rows of a stream that are later than its watermark are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sparkfacet.streaming.windows import file_stream, run_available

#: About how many rows of one key a batch of a table that is run as a stream holds at most.
CHUNK = 2_000_000


@dataclass(frozen=True)
class Fold:
    """state and result: schemas. step(state or None, seconds, value) -> (state, result). until(state): the second from which
    the state may be forgotten, None for never."""

    state: str
    result: str
    step: Callable[[tuple | None, float, object], tuple[tuple, tuple]]
    until: Callable[[tuple], float | None] = lambda state: None

    def names(self, schema: str) -> list[str]:
        return [c.split()[0] for c in schema.split(", ")]


def token_bucket(capacity: float, rate: float) -> Fold:
    """Each row takes a token of its key's bucket, which holds capacity tokens and gets rate tokens a second. A key that was
    idle until its bucket was full is as good as new."""

    def step(state: tuple | None, now: float, value: object) -> tuple[tuple, tuple]:
        tokens, last = state or (capacity, now)
        tokens = min(capacity, tokens + (now - last) * rate)
        allowed = tokens >= 1
        tokens -= 1.0 * allowed
        return (tokens, now), (allowed, int(tokens), 0.0 if allowed else (1 - tokens) / rate, (capacity - tokens) / rate)

    return Fold("tokens double, at double", "allowed boolean, remaining int, retry double, reset double", step, lambda s: s[1] + (capacity - s[0]) / rate + 1)


def state_machine(allowed: dict[str, tuple[str, ...]]) -> Fold:
    """Each row asks for a state (value). The first of a key is taken; later ones if allowed from the key's state, which else
    stays as it is."""

    def step(state: tuple | None, now: float, value: object) -> tuple[tuple, tuple]:
        before = state[0] if state else None
        ok = before is None or value in allowed.get(before, ())
        after = value if ok else before
        return (after,), (before, ok, after)

    return Fold("status string", "before string, valid boolean, after string", step)


def _keyed(rows: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rows.filter("key is not null and ts is not null").select("key", "id", F.col("ts").cast("timestamp").alias("ts"), at.alias("at"), "value")


def _schema(rows: DataFrame, fold: Fold) -> str:
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return f"key {types['key']}, id {types['id']}, {fold.result}"


def fold_table(rows: DataFrame, fold: Fold) -> DataFrame:
    """(key, id, ...): the result of each row (key, id, ts, value). Sorted batches of a key stream through one task, which
    holds its state only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, at, value in zip(batch["key"].tolist(), batch["at"].tolist(), batch["value"].tolist()):
                if k != key:
                    key, state = k, None
                state, result = fold.step(state, at, value)
                out.append(result)
            yield pd.concat([batch[["key", "id"]].reset_index(drop=True), pd.DataFrame(out, columns=fold.names(fold.result))], axis=1)

    ordered = _keyed(rows).drop("ts").repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, _schema(rows, fold))


class _Keyed(StatefulProcessor):
    def __init__(self, fold: Fold) -> None:
        self.fold = fold

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.fold.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(["at", "id"], ignore_index=True)
        before = self.state.get()
        state, out = None if before is None else tuple(before), []
        for at, value in zip(held["at"].tolist(), held["value"].tolist()):
            state, result = self.fold.step(state, at, value)
            out.append(result)
        self.state.update(state)
        until = self.fold.until(state)
        if before is not None and self.fold.until(tuple(before)) is not None:  # else there is no timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(math.ceil(until * 1000))
        yield pd.concat([held[["key", "id"]], pd.DataFrame(out, columns=self.fold.names(self.fold.result))], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])


def fold_stream(rows: DataFrame, fold: Fold, delay: str = "0 seconds") -> DataFrame:
    """The same of a stream of rows (key, id, ts, value); rows later than delay behind the newest are dropped."""
    keyed = _keyed(rows).withWatermark("ts", delay)
    return keyed.groupBy("key").transformWithStateInPandas(_Keyed(fold), _schema(rows, fold), "append", "eventTime")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that arbitrary state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_table(rows: DataFrame, fold: Fold, target: str, chunk: int = CHUNK) -> DataFrame:
    """fold_stream over a whole table, however its files lie: it comes in as parts in order of time, and the stream goes on
    after each, so no row is late. A part costs a step of each key that has rows in it, and only a key's rows are held
    together; so the parts are as many as keep keys of more than chunk rows to about chunk rows in each, and one if there are
    none such. With the same target a later call takes up what has come since."""
    spark, rows = rows.sparkSession, rows.filter("key is not null and ts is not null")
    second = F.col("ts").cast("timestamp").cast("double")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    parts = max(1, math.ceil((large.agg(F.sum("n")).first()[0] or 0) / chunk))
    held = rows.join(large.select("key"), "key", "left_semi") if parts > 1 else rows
    edges = sorted(set(held.select(second.alias("s")).approxQuantile("s", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    folder, out = f"{target}/in", None
    with state_store(spark):
        for a, b in zip([None, *edges], [*edges, None]):
            part = rows if a is None else rows.filter(second >= a)
            (part if b is None else part.filter(second < b)).write.mode("append").parquet(folder)
            out = run_available(fold_stream(file_stream(spark, folder, rows.schema), fold), target)
    return out
