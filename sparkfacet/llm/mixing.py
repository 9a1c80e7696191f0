"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Token counts are summed by cell (source, language, topic) once. Each round scales the cells to the target shares of
sources, then of languages, then of topics; the factors of a cell's source, language and topic give its weight. Rounds go on
until no marginal is off by more than TOLERANCE (ROUNDS at most); residuals() tells how far off they are at the end. A
document's probability is min(1, c * weight), where c is solved so that the expected tokens meet the budget. A document
is taken when a hash of its id, as a number in [0, 1), is below its probability, so the draw can be repeated.

The topic is a column expression that the caller may give; by default it is the kind of text by its marks (topic_of).

Targets default to tempered shares: a value with the share s of all tokens aims at s**alpha, rescaled to sum to 1.
Values that a given target doesn't name aim at 0 and are never taken.

Cases: a null source or language is a value of its own; a null text has no tokens; documents without tokens have
their cell's probability; a null id counts as an empty one in the draw; repeated rows are taken or left together; an
empty table gives an empty result; extra columns pass through, but for one named as the result, which is replaced.
Targets that can't be met together (a value whose cells all have a goal of 0) leave residuals, which are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfacet.llm._spark import written

DIMS = ("source", "lang", "topic")
ROUNDS, TOLERANCE, ALPHA, BUDGET, SOLVE = 30, 1e-12, 0.7, 0.5, 12
#: Cells up to this number are broadcast (some 100 bytes each); more are joined by a salted shuffle.
MAX_BROADCAST, SALTS = 50_000, 64


def token_count(text: str = "text") -> Column:
    """Words of [^\\x20\\x09-\\x0D]; 0 for a null text. (regexp_count copies the whole text for each match.)"""
    words = F.regexp_replace(F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(words), F.lit(0)).cast("long")


def topic_of(text: str = "text") -> Column:
    """The first rule that fits: legal (names a licence), contact (has an @), table (has a |), quest (has a ?), else prose."""
    t = F.col(text)
    return F.when(F.contains(t, F.lit("icense")), "legal").when(F.contains(t, F.lit("@")), "contact").when(F.contains(t, F.lit("|")), "table").when(F.contains(t, F.lit("?")), "quest").otherwise("prose")


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _targets(cells: DataFrame, dim: str, alpha: float, given: dict[str, float] | None) -> DataFrame:
    """(dim, goal), goals summing to 1 over the values that have tokens."""
    sums = cells.groupBy(dim).agg(F.sum("n").alias("goal"))
    if given is None:
        sums = sums.select(dim, F.pow(F.col("goal") / F.lit(float(cells.agg(F.sum("n")).first()[0] or 1)), F.lit(alpha)).alias("goal"))
    else:
        named = cells.sparkSession.createDataFrame([("null" if k is None else f"={k}", float(v)) for k, v in given.items()], T.StructType([T.StructField(dim, T.StringType()), T.StructField("share", T.DoubleType())]))
        sums = sums.join(named, dim, "left").select(dim, F.coalesce("share", F.lit(0.0)).alias("goal"))
    whole = sums.agg(F.sum("goal")).first()[0] or 1.0
    return sums.select(dim, (F.col("goal") / F.lit(float(whole))).alias("goal"))


def _with_goals(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """cells with the goal of each of their values (g_source, ...)."""
    for dim in DIMS:
        cells = cells.join(targets[dim].withColumnRenamed("goal", f"g_{dim}"), dim)
    return cells


def residuals(cells: DataFrame) -> float:
    """The largest relative distance of a marginal of cells (with w and goals) from its goal."""
    each = F.array(*(F.struct(F.lit(dim).alias("dim"), F.col(dim).alias("value"), F.col(f"g_{dim}").alias("goal")) for dim in DIMS))
    sums = cells.select(F.explode(each).alias("m"), (F.col("n") * F.col("w")).alias("t")).groupBy("m").agg(F.sum("t").alias("have"))
    off = F.when(F.col("m.goal") > 0, F.abs(F.col("have") / F.nullif(F.col("m.goal"), F.lit(0.0)) - 1)).otherwise(F.col("have"))
    return sums.agg(F.max(off)).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, n) with their goals and w: the product of the three factors. Cells are written after each
    dimension, so that plans stay small."""
    now = written(_with_goals(cells, targets).withColumn("w", F.lit(1.0)))
    for _ in range(rounds):
        for dim in DIMS:
            sums = now.groupBy(dim).agg(F.sum(F.col("n") * F.col("w")).alias("have"))
            factor = F.when(F.col("have") > 0, F.col(f"g_{dim}") / F.col("have")).otherwise(0.0)
            now = written(now.join(sums, dim).select(*DIMS, "n", *(f"g_{d}" for d in DIMS), (F.col("w") * factor).alias("w")))
        if residuals(now) <= tolerance:
            break
    return now


def scale(cells: DataFrame, budget: float) -> float:
    """c for which the sum of n * min(1, c * w) is budget times all tokens, by fixed-point steps from below."""
    c, w, n = 0.0, F.col("w"), F.col("n")
    for _ in range(SOLVE):
        full = F.col("w") * F.lit(c) >= 1
        row = cells.agg(F.sum(n).alias("all"), F.sum(F.when(full, n).otherwise(0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(n * w)).alias("open")).first()
        if not row["open"]:
            break
        c, before = max(c, (budget * row["all"] - row["taken"]) / row["open"]), c
        if c == before:
            break
    return c


def draw(id_col: str = "doc_id", seed: str = "mix") -> Column:
    """A number in [0, 1) from the id: the first 32 bits of MD5 of 'seed:id'."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = "mix", topic: Column | None = None, into: str = "mix") -> DataFrame:
    """docs and a struct column: topic, n_tokens, weight, prob, selected."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c != into]
    tokens, kind = token_count(text_col), topic if topic is not None else topic_of(text_col)
    cell = [_key(F.col("source")).alias("source"), _key(F.col("lang")).alias("lang"), _key(kind).alias("topic")]
    cells = written(docs.select(*cell, tokens.alias("n")).groupBy(*DIMS).agg(F.sum("n").alias("n")))
    goals = {dim: written(_targets(cells, dim, alpha, (targets or {}).get(dim))) for dim in DIMS}
    raked = rake(cells, goals, rounds)
    c = scale(raked, budget)
    average = float(cells.agg(F.sum("n")).first()[0] or 1)
    of = raked.select(F.struct(*DIMS).alias("__cell"), F.struct((F.col("w") * F.lit(average)).alias("weight"), F.least(F.lit(1.0), F.col("w") * F.lit(c)).alias("prob")).alias("__of"))
    rows = docs.select(F.struct(*columns).alias("__row"), F.struct(*cell).alias("__cell"), draw(id_col, seed).alias("__u"), tokens.alias("__n"), kind.alias("__topic"))
    if cells.count() <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(of), "__cell", "left")
    else:
        of = of.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__u", "__n"), F.lit(SALTS)).cast("int")).join(of, ["__cell", "__salt"], "left")
    prob = F.coalesce(F.col("__of.prob"), F.lit(0.0))
    mix = F.struct(F.col("__topic").alias("topic"), F.col("__n").alias("n_tokens"), F.coalesce(F.col("__of.weight"), F.lit(0.0)).alias("weight"), prob.alias("prob"), (F.col("__u") < prob).alias("selected"))
    return rows.select("__row.*", mix.alias(into))


def oracle(alpha: float = ALPHA, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = "mix") -> str:
    """The default mixture of documents in DuckDB's SQL; source and lang are not null there."""
    ctes = [
        r"""d AS (SELECT doc_id, source, lang, CASE WHEN contains(text, 'icense') THEN 'legal' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '?') THEN 'quest' ELSE 'prose' END AS topic,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS n, 1.0::DOUBLE AS w FROM d GROUP BY ALL)",
    ]
    for dim in DIMS:
        ctes.append(f"g_{dim} AS MATERIALIZED (SELECT {dim}, goal / sum(goal) OVER () AS goal FROM (SELECT {dim}, pow(sum(n) / (SELECT sum(n) FROM c0), {alpha}::DOUBLE) AS goal FROM c0 GROUP BY {dim}))")
    k = 0
    for _ in range(rounds):
        for dim in DIMS:
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.n, c.w * g.goal / s.have AS w FROM c{k} c JOIN g_{dim} g USING ({dim}) JOIN (SELECT {dim}, sum(n * w) AS have FROM c{k} GROUP BY {dim}) s USING ({dim}))")
            k += 1
    ctes.append("s0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS c)")
    for j in range(SOLVE):
        ctes.append(f"s{j + 1} AS MATERIALIZED (SELECT coalesce(greatest(any_value(s.c), ({budget} * sum(n) - sum(CASE WHEN w * s.c >= 1 THEN n ELSE 0 END)) / nullif(sum(CASE WHEN w * s.c >= 1 THEN 0 ELSE n * w END), 0)), any_value(s.c)) AS c FROM c{k}, s{j} s)")
    ctes.append(f"p AS (SELECT source, lang, topic, w * (SELECT sum(n) FROM c0) AS weight, least(1.0, w * (SELECT c FROM s{SOLVE})) AS prob FROM c{k})")
    u = f"CAST('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    return f"WITH {', '.join(ctes)} SELECT doc_id, source, lang, topic, d.n AS n_tokens, round(weight, 6) AS weight, round(prob, 6) AS prob, {u} < prob AS selected FROM d JOIN p USING (source, lang, topic)"
