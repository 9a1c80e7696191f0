"""Diversified ranking within short candidate lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What two products that agree in a column have in common.
SIMILARITY = {"brand": 0.55, "tier": 0.3, "part_type": 0.15}


def pick(rank: np.ndarray, attributes: np.ndarray, weights: np.ndarray, top: int, trade: float) -> list[int]:
    """Positions picked greedily: the best of trade * relevance - (1 - trade) * similarity to the nearest picked; first wins."""
    span = rank.max() - rank.min()
    relevance = (rank - rank.min()) / span if span else np.ones(len(rank))
    nearest, open_, out = np.zeros(len(rank)), np.ones(len(rank), bool), []
    for _ in range(min(top, len(rank))):
        score = np.where(open_, trade * relevance - (1 - trade) * nearest, -np.inf)
        best = int(score.argmax())
        out.append(best)
        open_[best] = False
        nearest = np.maximum(nearest, (attributes == attributes[best]) @ weights)
    return out


def mmr(frame: DataFrame, group: str, key: str, relevance: Column, top: int, trade: float = 0.5) -> DataFrame:
    """(group, key, place from 1): the top picks of each group out of its 3 * top most relevant rows. Only these rows leave
    the window, which Spark also limits before the shuffle, so a group of any size fits."""
    order = Window.partitionBy(group).orderBy(F.desc("__r"), F.asc(key))
    pool = frame.select(group, key, *SIMILARITY, relevance.cast("double").alias("__r")).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= 3 * top)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__n", ignore_index=True)
        codes = np.stack([pd.factorize(rows[c])[0] for c in SIMILARITY], axis=1)
        at = pick(rows["__r"].to_numpy(), codes, np.array(list(SIMILARITY.values())), top, trade)
        return pd.DataFrame({group: rows[group].iloc[at], key: rows[key].iloc[at], "place": np.arange(1, len(at) + 1)})

    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return pool.groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, `{key}` {types[key]}, place int")


def pages(frame: DataFrame, group: str, key: str, relevance: Column, numbers: tuple[int, ...], size: int, trade: float = 0.5) -> DataFrame:
    """(group, page, key, place from 1): diversified pages of each group's rows in order of relevance. Page n is what comes
    after n * size picks: the first (n + 1) * size of them out of the first 3 (n + 1) * size rows, and no more than (n + 3) * size,
    so that later pages diversify among fewer rows than their picks could reach. Rows that aren't picked follow in their old
    order, after all picks; a page within the picks never needs them. Only the rows of the last page's pool leave the window."""
    order = Window.partitionBy(group).orderBy(F.desc("__r"), F.asc(key))
    most = max((n + 3) * size for n in numbers)
    pool = frame.select(group, key, *SIMILARITY, relevance.cast("double").alias("__r")).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__n", ignore_index=True)
        codes, rank = np.stack([pd.factorize(rows[c])[0] for c in SIMILARITY], axis=1), rows["__r"].to_numpy()
        out = []
        for n in numbers:
            top = (n + 1) * size
            among = min(len(rows), 3 * top, (n + 3) * size)
            at = pick(rank[:among], codes[:among], np.array(list(SIMILARITY.values())), top, trade) if among else []
            at = (at + [i for i in range(len(rows)) if i not in set(at)])[n * size : top]
            out.append(pd.DataFrame({group: rows[group].iloc[at], "page": n, key: rows[key].iloc[at], "place": np.arange(1, len(at) + 1)}))
        return pd.concat(out)

    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return pool.groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, page int, `{key}` {types[key]}, place int")
