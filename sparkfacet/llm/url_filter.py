"""URL verdicts: rules first, then naive Bayes on segmented host and path words.

Word counts come from the text of all pages and form a unigram model. A Viterbi pass splits each part of a host name into
the likeliest words (unknown stretches cost UNKNOWN per letter). Tokens are the host's words and, marked, the path's.
Multinomial naive Bayes is trained on the pages that a rule decides (counts per token and verdict over all of them) and
decides the others.

All words and tokens count, however rare. They stay in written tables: words are joined to the substrings of distinct
host parts, hosts' words to distinct URLs and tokens' evidence to these URLs' tokens, each by a join that survives hot keys.

Rules: (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's; the longest
fitting one (host and path together) wins, the first in the list among equals.

Cases: a null URL or one without :// has an empty host and path, fits no rule and is decided by the prior; empty and very
long URLs are handled whole; repeated rows get equal verdicts; without pages of both verdicts every other page is allowed;
an empty table gives an empty result; null page texts add no words; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._spark import spread_join, written

UNKNOWN = 12.0

#: Fixed values.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

WORDS = re.compile(r"[a-z]{2,}")
TAGS = re.compile(r"<[^>]*>")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule as host and path, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, where, start in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the last to fit wins
        fits = ((host == where) | F.endswith(host, F.lit(f".{where}"))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, F.lit(where + start)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def segment(text: str, costs: dict[str, float]) -> list[str]:
    """The words of least total cost that make up the text; letters that no word covers stay together."""
    best, cut, lengths = [0.0], [0], sorted({len(w) for w in costs}, reverse=True)
    for end in range(1, len(text) + 1):
        cost, at = best[end - 1] + UNKNOWN, end - 1
        for n in lengths:
            c = costs.get(text[end - n : end]) if n <= end else None
            if c is not None and best[end - n] + c < cost:
                cost, at = best[end - n] + c, end - n
        best.append(cost)
        cut.append(at)
    out: list[str] = []
    end = len(text)
    while end:
        word = text[cut[end] : end]
        if out and word not in costs and out[-1] not in costs:
            out[-1] = word + out[-1]
        else:
            out.append(word)
        end = cut[end]
    return out[::-1]


def path_tokens(path: str) -> list[str]:
    return [f"/{part}" if not part[0].isdigit() else f"/0{len(part)}{part[0]}" for part in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7F]+", path.lower())]


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) of all words of all pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for html in batch.column(0).to_pylist():
                seen.update(WORDS.findall(TAGS.sub(" ", html or "").lower()))
            if len(seen) > 200_000:
                yield rows()
                seen = Counter()
        yield rows()

    return pages.select(html_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Bayes:
    words: DataFrame  # word, n, mark
    total: int  # sum of n
    lengths: list[int]  # lengths of the words: few, as k of them take k * k / 2 letters
    ratio: DataFrame | None  # token, ratio: log P(token | block) - log P(token | allow); None without pages of both verdicts
    prior: float


#: Odd base of the marks of words, and its inverse modulo 2**64.
BASE_MARK = 0x9E3779B97F4A7C15
INVERSE_MARK = pow(BASE_MARK, -1, 1 << 64)


def marks(text: str, lengths: list[int]) -> Iterator[np.ndarray]:
    """The distinct marks of all runs of letters of each length: sums of letters times powers of a base, as differences of
    running sums. Equal words have equal marks; others with the same one are told apart by their letters afterwards."""
    letters = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint64)

    def powers(base: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(letters), base, np.uint64)]))[: len(letters)]

    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers(BASE_MARK))])
    back = powers(INVERSE_MARK)
    for n in lengths:
        if n <= len(letters):
            yield np.unique((sums[n:] - sums[:-n]) * back[: len(letters) - n + 1]).view(np.int64)


def mark_of(word: Column) -> Column:
    @F.arrow_udf("long")
    def of(words: pa.Array) -> pa.Array:
        return pa.array([int(next(marks(w, [len(w)]))[0]) for w in words.to_pylist()], pa.int64())

    return of(word)


def host_words(hosts: DataFrame, words: DataFrame, total: int, lengths: list[int]) -> DataFrame:
    """(host, size, words) of hosts (host, size; unique): the segments of the host's parts. A part sends one number for each
    run of letters as long as some word, not the letters themselves, so parts and words of any length go through."""

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in marks(part, lengths):
                    for k in range(0, len(found), 100_000):
                        some = found[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.binary()), pa.array(some)], names=["part_key", "mark"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [segment(part, {x["word"]: math.log(total / x["n"]) for x in known or ()}) for part, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["part", "words"])

    each = F.filter(F.split("host", "[^a-z]+"), lambda x: x != "")
    placed = hosts.select("host", F.posexplode(each).alias("at", "part"))
    part_key = F.substring(F.unhex(F.sha2(F.col("part").cast("binary"), 256)), 1, 16)
    parts = written(placed.groupBy("part").agg(F.count(F.lit(1)).alias("r")).withColumn("part_key", part_key))
    inside = written(parts.select("part_key", "part").mapInArrow(substrings, "part_key binary, mark long"))
    often = inside.groupBy("mark").agg(F.count(F.lit(1)).alias("r"))
    of_mark = words.groupBy("mark").agg(F.collect_list(F.struct("word", "n")).alias("of"))  # one word, but for rare equal marks
    known = spread_join(inside, written(often.join(of_mark, "mark")), "mark", "r")
    known = known.groupBy("part_key").agg(F.flatten(F.collect_list("of")).alias("known"))
    done = parts.join(known, "part_key", "left").select("part", "known").mapInArrow(split, "part string, words array<string>")
    joined = spread_join(placed, written(done.join(parts.select("part", "r"), "part")), "part", "r")
    of = joined.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x.words)).alias("words"))
    return hosts.join(of, "host", "left").select("host", "size", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def _tokens(rows: DataFrame, model: Bayes) -> DataFrame:
    """(key, verdict, r: rows, words: the tokens) of the distinct URLs of rows (key, host, path, verdict)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[*w, *path_tokens(p)] for w, p in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(found, pa.list_(pa.string()))], names=["key", "verdict", "r", "words"])

    urls = written(rows.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("verdict").alias("verdict"), F.count(F.lit(1)).alias("r")))
    hosts = written(urls.groupBy("host").agg(F.count(F.lit(1)).alias("size")))
    known = written(host_words(hosts, model.words, model.total, model.lengths))
    joined = spread_join(urls, known, "host", "size").select("key", "verdict", "r", "path", "words")
    return written(joined.mapInArrow(run, "key binary, verdict string, r long, words array<string>"))


def with_parts(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    url = F.col(url_col)
    parts = pages.withColumn("__host", host_of(url)).withColumn("__path", path_of(url))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    return parts.withColumn("__rule", rule).withColumn("__verdict", verdict)


def _keyed(parts: DataFrame, *columns: str) -> DataFrame:
    """columns, key (of host and path: hosts hold no /, paths start with one), host, path, rule, verdict."""
    key = F.substring(F.unhex(F.sha2(F.concat("__host", "__path").cast("binary"), 256)), 1, 16).alias("key")
    return parts.select(*columns, key, *(F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def fit_bayes(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES) -> Bayes:
    words = written(word_counts(pages, html_col).withColumn("mark", mark_of(F.col("word"))))
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = Bayes(words, total, lengths, None, -40.0)
    rows = _keyed(with_parts(pages.select(url_col), url_col, rules).filter("__verdict is not null"))
    urls = _tokens(rows, model)

    def count(verdict: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("verdict") == verdict, F.col("r"))), F.lit(0)).alias(verdict)

    ruled = urls.agg(count("block"), count("allow")).first()
    if not ruled["block"] or not ruled["allow"]:
        return model
    counts = written(urls.select("verdict", "r", F.explode("words").alias("token")).groupBy("token").agg(count("block"), count("allow")))
    of = counts.agg(F.count(F.lit(1)).alias("v"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("block", "allow"))).first()
    log = [F.log((F.col(k) + 1) / F.lit(float(of[k] + of["v"] or 1))) for k in ("block", "allow")]
    model.ratio, model.prior = counts.select("token", (log[0] - log[1]).alias("ratio")), math.log(ruled["block"] / ruled["allow"])
    return model


def with_verdicts(pages: DataFrame, model: Bayes, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id_col, host, path, rule, verdict, words (of the host and path) and p_block of each row."""
    rows = written(_keyed(with_parts(pages.select(id_col, url_col), url_col, rules), F.col(id_col).alias("id")))
    urls = _tokens(rows, model)
    z = F.lit(model.prior)
    if model.ratio is not None:
        each = urls.select("key", F.explode("words").alias("token"))
        often = each.groupBy("token").agg(F.count(F.lit(1)).alias("r"))
        evidence = spread_join(each, written(often.join(model.ratio, "token")), "token", "r")
        sums = evidence.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list("ratio")), F.lit(0.0), lambda a, x: a + x).alias("sum"))  # sorted: the same sum in each run
        urls = urls.join(sums, "key", "left")
        z = z + F.coalesce("sum", F.lit(0.0))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    done = spread_join(rows, written(urls.select("key", "r", "words", p.alias("p_block"))), "key", "r")
    final = F.coalesce("verdict", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict")
    return done.select(F.col("id").alias(id_col), "host", "path", "rule", final, "words", "p_block")
