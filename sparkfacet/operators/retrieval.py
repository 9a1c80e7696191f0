"""An inverted index of boosted fields, batches of queries over it, part numbers and completions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfacet.operators.language import EXACT, PREFIX, PREFIXES, prefixed

K1, B = 1.2, 0.75


def postings(documents: DataFrame, boosts: dict[str, float], cut: Callable[[Column], Column], words: Callable[[Column], Column], term: Callable[[Column], Column], tasks: int) -> DataFrame:
    """(term, doc, tf) of documents (doc and a text column for each field): tf sums the boosts of the fields that a term
    occurs in, once for each place. cut makes an array of runs, words the array of a run's words, called once for each
    distinct run of a document; term makes a word's term (null: none).

    Documents are dealt to so many tasks by doc, and texts are all that is shuffled: a document's runs and terms are counted where it is."""
    fields = F.array(*(F.struct(F.lit(float(boost)).alias("w"), cut(F.col(c)).alias("runs")) for c, boost in boosts.items()))
    each = documents.repartition(tasks, "doc").select("doc", F.inline(fields)).select("doc", "w", F.explode("runs").alias("run"))
    runs = each.filter("run != ''").groupBy("doc", "run").agg(F.sum("w").alias("w"))
    said = runs.select("doc", F.explode(words(F.col("run"))).alias("word"), "w")
    terms = said.select("doc", term(F.col("word")).alias("term"), "w").filter("term is not null")
    return terms.groupBy("term", "doc").agg(F.sum("w").alias("tf"))


def lengths(index: DataFrame) -> DataFrame:
    """(doc, dl): the sum of a document's weighted counts."""
    return index.groupBy("doc").agg(F.sum("tf").alias("dl"))


def statistics(index: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df, idf); n: one row with the number of documents."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row is broadcast


def variants(words: DataFrame, vocabulary: DataFrame, prefixes: int | None = PREFIXES) -> DataFrame:
    """(query, place, term, weight) of words (query, place, word, last): the word itself, and for a query's last word the
    first terms that it begins (prefixes: so many; None: all)."""
    exact = words.join(vocabulary, words["word"] == vocabulary["term"]).select("query", "place", "term", F.lit(EXACT).alias("weight"))
    begin = words.filter(F.col("last") & (F.length("word") >= 2))
    more = begin.join(prefixed(begin.select("word").distinct(), vocabulary, prefixes), "word").filter("term != word")
    return exact.unionByName(more.select("query", "place", "term", F.lit(PREFIX).alias("weight")))


#: Terms of a batch of queries that are broadcast to the postings; of more, both sides are shuffled.
MAX_TERMS = 200_000


def search(index: DataFrame, words: DataFrame, terms: DataFrame | None = None, size: DataFrame | None = None, prefixes: int | None = PREFIXES, lengths: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, hits, relaxed) for a batch of queries (query, place, word, last). A word counts with its best
    variant. Documents with all words are kept; if none has them, those with any, relaxed. Scores are divided by the query's highest.

    index: term, doc, tf; with lengths (doc, dl), terms (term, idf) and size (one row: avgdl) from written tables nothing is
    summed over the index. The terms of a batch, few against the index, are broadcast if there are MAX_TERMS at most, else
    held by tasks, so that postings are never sorted; what they match is dealt out by doc, once, for lengths and scores."""
    if terms is None:
        lengths = index.groupBy("doc").agg(F.sum("tf").alias("dl"))
        size = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        terms = statistics(index, size.select("n"))
    found = variants(words, terms.select("term"), prefixes).join(terms.select("term", "idf"), "term")
    few = found.limit(MAX_TERMS + 1).count() <= MAX_TERMS
    met = index.join(F.broadcast(found) if few else found.hint("shuffle_hash"), "term")
    scored = met.join(lengths.hint("shuffle_hash"), "doc").join(F.broadcast(size.select("avgdl")))  # one row
    part = F.col("weight") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    best = scored.select("query", "doc", "place", part.alias("s")).groupBy("query", "doc", "place").agg(F.max("s").alias("s"))
    hits = best.groupBy("query", "doc").agg(F.aggregate(F.array_sort(F.collect_list("s")), F.lit(0.0), lambda a, x: a + x).alias("raw"), F.count(F.lit(1)).alias("hits")).repartition("query", "doc")  # used twice, computed once
    asked = words.groupBy("query").agg(F.count_distinct("place").alias("asked"))
    # of each query the most words that a document has, and the highest score of those with as many and of all
    tops = hits.groupBy("query", "hits").agg(F.max("raw").alias("raw")).groupBy("query").agg(F.max(F.struct("hits", "raw")).alias("most"), F.max("raw").alias("any")).join(asked, "query")
    whole = F.col("most.hits") >= F.col("asked")
    tops = tops.select("query", "asked", F.when(whole, F.col("most.raw")).otherwise(F.col("any")).alias("top"), (~whole).alias("relaxed"))
    return hits.join(tops, "query").filter(F.col("relaxed") | (F.col("hits") == F.col("asked"))).select("query", "doc", (F.col("raw") / F.col("top")).alias("score"), "hits", "relaxed")


def in_both(one: DataFrame, other: DataFrame) -> DataFrame:
    """(query, i, score): what both ways of searching (query, i, score) have found, with the sum of their scores."""
    return one.join(other.withColumnRenamed("score", "__more"), ["query", "i"]).select("query", "i", (F.col("score") + F.col("__more")).alias("score"))


def fused(candidates: DataFrame, signals: dict[str, tuple[list[Column], float]], key: str = "doc", k: int = 60, only: dict[str, Column] | None = None) -> DataFrame:
    """candidates (query, key, ...) with rrf: the sum of weight / (k + rank) in the query's list of each signal, ties by key.
    only: signals that count for a query only if some candidate of it meets a condition."""
    of = Window.partitionBy("query")
    total = F.lit(0.0)
    for name, (order, w) in signals.items():
        part = F.lit(w) / (k + F.row_number().over(of.orderBy(*order, key)))
        total = total + (F.when(F.bool_or(only[name]).over(of), part).otherwise(0.0) if name in (only or {}) else part)
    return candidates.withColumn("rrf", total)


def number_index(numbers: DataFrame) -> DataFrame:
    """(key, kind, i) of numbers (key, kind: pn, oem or xref, i). Of several kinds of one key the first counts: pn before
    all others, then the kind of the lowest i, oem before xref."""
    order = F.struct((F.col("kind") != "pn").alias("pass"), F.when(F.col("kind") == "pn", 0).otherwise(F.col("i")).alias("i"), F.col("kind"))
    first = numbers.groupBy("key").agg(F.min_by("kind", order).alias("kind"))
    return numbers.join(first.hint("merge"), ["key", "kind"]).select("key", "kind", "i").distinct()  # exploded rows look few to the planner


def partial_numbers(queries: DataFrame, numbers: DataFrame) -> DataFrame:
    """(query, i, weight) of products with a number of any kind that contains one of the query's (query, parts: array, each of
    three characters or more): 1.0 if it begins with the query's first one, else 0.7. They meet on the first three characters."""
    grams = numbers.select("i", "key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - 2), lambda k: F.substring("key", k, F.lit(3))))).alias("gram"))
    asked = queries.select("query", F.get("parts", F.lit(0)).alias("first"), F.explode("parts").alias("part"))
    met = asked.withColumn("gram", F.substring("part", 1, 3)).join(grams, "gram").filter(F.col("key").contains(F.col("part")))
    return met.groupBy("query", "i").agg(F.max(F.when(F.col("key").startswith(F.col("first")), 1.0).otherwise(0.7)).alias("weight"))


def number_windows(texts: DataFrame, index: DataFrame, norm: Callable[[Column], Column], most: int = 4) -> DataFrame:
    """(query, key, kind) of the first part number in each text (query, text): the whole text, else windows of most to 1
    words from the left; keys of four characters or more that aren't years."""
    tokens = F.filter(F.split("text", " +"), lambda w: w != "")
    places = [F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("at"), norm(F.col("text")).alias("key")))]

    def of(n: int) -> Column:
        starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(F.lit(1 + most - n).alias("rank"), k.alias("at"), norm(F.array_join(F.slice("tokens", k, F.lit(n)), "")).alias("key")))

    places += [of(n) for n in range(most, 0, -1)]
    each = texts.withColumn("tokens", tokens).select("query", F.explode(F.concat(*places)).alias("w")).select("query", "w.*").filter((F.length("key") >= 4) & ~F.col("key").rlike("^(19|20)[0-9]{2}$"))
    # a text's fifteen windows count as one row in Spark's sizes, so that without the hint they would be broadcast
    met = each.join(index.select("key", "kind").distinct().hint("merge"), "key")
    return met.groupBy("query").agg(F.min(F.struct("rank", "at", "key", "kind")).alias("first")).select("query", "first.key", "first.kind")


def complete(queries: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """(query, text, score, nth): the best completions of each query (query, words: array). texts: text, weight (unique).
    The last two words count if they complete to anything, else the last one, of two letters at least: twice the weight if a
    text begins with them, once if they stand after a blank in it; what was said in full already is no completion. The words
    before are put back in front. Texts are indexed by the first two letters of each of their words."""
    last = lambda n: F.array_join(F.slice("words", F.greatest(F.lit(1), F.size("words") - (n - 1)), F.lit(n)), " ")
    head = lambda n: F.array_join(F.slice("words", F.lit(1), F.greatest(F.lit(0), F.size("words") - n)), " ")
    asked = queries.select("query", F.explode(F.filter(F.array(*(F.when(F.size("words") >= n, F.struct(F.lit(n).alias("n"), head(n).alias("head"), last(n).alias("said"))) for n in (2, 1))), lambda x: x.isNotNull())).alias("a")).select("query", "a.*").filter(F.length("said") >= 2)
    cut = F.split("text", " ")
    tails = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.struct((k == 1).alias("whole"), F.array_join(F.slice(cut, k, F.size(cut)), " ").alias("tail")))
    index = texts.select("text", "weight", F.explode(tails).alias("t")).select("text", "weight", "t.*").withColumn("two", F.substring("tail", 1, 2))
    met = asked.withColumn("two", F.substring("said", 1, 2)).join(index, "two").filter(F.startswith("tail", "said") & (F.col("text") != F.col("said")))
    full = F.trim(F.concat_ws(" ", "head", "text"))
    scored = met.groupBy("query", "n", full.alias("text")).agg(F.max(F.when(F.col("whole"), F.col("weight") * 2).otherwise(F.col("weight"))).alias("score"))
    widest = scored.groupBy("query").agg(F.max("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "text"))
    return scored.join(widest, ["query", "n"]).select("query", "text", "score", nth.alias("nth")).filter(F.col("nth") <= most)
