"""Spelling: candidates share a string left by deletions; the restricted edit distance decides."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfacet.functions.text import deletes, typo_budget


def osa(a: str, b: str, most: int | None = None) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no substring edited twice. With most, counting stops as
    soon as the result is beyond it, and some number beyond it is returned."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if most is not None and min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def damerau(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps, where letters may stand between those swapped, each at one more: what
    DuckDB's damerau_levenshtein counts."""
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}  # the last row of each letter of a
    for i, x in enumerate(a, 1):
        row, at = [far, i], 0  # at: the last place in b, in this row, of a's letter
        for j, y in enumerate(b, 1):
            k = seen.get(y, 0)
            swap = rows[k][at] + (i - k - 1) + 1 + (j - at - 1)
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap))
            if x == y:
                at = j
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]


def damerau_distance(a: str, b: str) -> Column:
    @F.arrow_udf("int")
    def distance(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else damerau(x, y) for x, y in zip(xs.to_pylist(), ys.to_pylist())], pa.int32())

    return distance(F.col(a), F.col(b))


def osa_distance(a: str, b: str, most: int = 2) -> Column:
    """Beyond most, the largest typo budget, some number beyond it."""

    @F.arrow_udf("int")
    def distance(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else osa(x, y, most) for x, y in zip(xs.to_pylist(), ys.to_pylist())], pa.int32())

    return distance(F.col(a), F.col(b))


#: So many first letters of a word are keys' source; of long words no more keys than this makes (137).
PREFIX = 16


def _keys(word: Column, most: int) -> Column:
    """Hashes of what deletions leave of a word; equal ones of unlike strings only bring pairs that are then refused."""
    return F.transform(deletes(word, PREFIX, most), lambda x: F.xxhash64(x))


def _swapped(a: Column, b: Column) -> Column:
    """Whether one swap of neighbours makes b of a."""
    return F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda k: F.concat(F.substring(a, F.lit(1), k - 1), F.substring(a, k + 1, F.lit(1)), F.substring(a, k, F.lit(1)), F.substring(a, k + 2, F.length(a))) == b)


def sorted_letters(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("word").agg(F.min(F.struct("distance", (-F.col("df")).alias("less"), "term")).alias("best"))


def corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term, distance): for each word, the term of vocabulary (term, df; unique) within the word's typo budget:
    the nearest, then the most frequent, then the first by name. Words without any are left out; a word that is a term is
    its own correction.

    Words and terms meet on strings that deletions leave of them: first with one deletion at most, for the word itself and
    terms one edit away. Only words that have none look two edits away, so the denser the vocabulary is, the fewer these are.
    The built-in Levenshtein distance decides unless neighbours may be swapped beside another edit, which tasks' Python does.
    """
    asked = words.select("word", typo_budget(F.col("word")).alias("k")).distinct()
    word, term, k = F.col("word"), F.col("term"), F.col("k")
    exact = asked.join(vocabulary.select(term.alias("word"), term, "df"), "word").select("word", "term", "df", F.lit(0).alias("distance"))
    left = asked.filter(k >= 1).select("word", F.explode(_keys(word, 1)).alias("key"))
    right = vocabulary.select("term", "df", F.explode(_keys(term, 1)).alias("key"))
    # exploded rows look few to the planner, so merging is asked for
    met = left.join(right.hint("merge"), "key").filter(F.abs(F.length("word") - F.length("term")) <= 1)
    near = F.levenshtein("word", "term", 2)
    one = met.filter((near == 1) | ((near == 2) & (F.length("word") == F.length("term")) & _swapped(word, term))).select("word", "term", "df", F.lit(1).alias("distance"))
    first = _best(exact.unionByName(one))
    lost = asked.filter(k >= 2).join(first, "word", "left").filter("best is null")
    left = lost.select("word", F.explode(_keys(word, 2)).alias("key"))
    right = vocabulary.filter(F.length("term") >= 6).select("term", "df", F.explode(_keys(term, 2)).alias("key"))
    met = left.join(right.hint("merge"), "key").filter(F.abs(F.length("word") - F.length("term")) <= 2).withColumn("far", F.levenshtein("word", "term", 4))
    # a swap counts as two of these edits; other edits of two change at most two of the letters in order
    met = met.filter((F.col("far") == 2) | ((F.col("far") > 2) & (F.levenshtein(sorted_letters(word), sorted_letters(term), 2) >= 0)))
    two = met.withColumn("asked", F.when(F.col("far") > 2, word)).withColumn("swaps", osa_distance("asked", "term")).filter("swaps is null or swaps = 2")
    second = _best(two.select("word", "term", "df", F.lit(2).alias("distance")))
    return first.unionByName(second).select("word", "best.term", "best.distance")
