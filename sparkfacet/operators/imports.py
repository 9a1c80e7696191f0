"""A whole import: applications read from text, brands, types and tiers resolved, rows that can't be taken told with reasons.

Every step works on distinct texts or names and meets dictionaries by joins; nothing is looked up on the driver. Issues of
all steps are gathered in one array for each row: struct<level, column, message, value>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfacet.functions.text import fold, norm_pn, words
from sparkfacet.operators import intake, language
from sparkfacet.sources.adapters import TIERS

#: What says that a part fits anything, and how a size in litres or cubic centimetres is written.
UNIVERSAL_WORDS = ("universal", "universales", "todos", "todas", "cualquier vehiculo", "*")
LITRES, CUBIC = r"(?<![\w.,])([0-9])[.,]([0-9])(?![0-9.,])", r"(?<![0-9])([0-9]{3,4})\s*cc\b"
ISSUE = "array<struct<level: string, column: string, message: string, value: string>>"


def issue(level: str, column: str, message: str, value: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(column).alias("column"), F.lit(message).alias("message"), value.cast("string").alias("value"))


def applications(texts: DataFrame, names: DataFrame, universe: DataFrame, sizes: DataFrame, by: str = "text", write: Callable[[str, DataFrame], DataFrame] = lambda name, frame: frame) -> tuple[DataFrame, DataFrame]:
    """(configurations, notes) of texts (text; distinct). configurations: text, gen, year, engine (the universal text has
    none); notes: text, universal, error (null if some application of the text was read), note.

    by: a column of texts that names them in place of text, in the results and wherever they are dealt out (long texts then
    move no more than once). write: as in understood, for what is read of the texts; plans then begin at what was written.

    names: name (as written), kind (gen or engine), gen, engine: what may be named, several rows for one of several
    generations; sizes: engine, sized (litres). A text holds applications between ; | line ends and commas that no digit follows. Of
    each, spans of years are read and masked, then sizes, then names, the longest first. Generations that aren't named are
    those of the engines; engines that aren't named are those of the size, or all. An engine that is named rules over a size
    that disagrees. A generation, or an engine with years, must be named; engines alone stand for themselves everywhere."""
    ends = universe.agg(F.coalesce(F.min("year"), F.lit(0)).alias("a"), F.coalesce(F.max("year"), F.lit(0)).alias("b")).first()
    clean = F.trim(F.regexp_replace(fold(F.coalesce("text", F.lit(""))), r"[ \t]+", " "))
    asked = texts.select(by, clean.alias("t"))
    free = F.col("t").isin(*UNIVERSAL_WORDS)
    parts = write("parts", asked.filter(~free & (F.col("t") != "")).select(by, F.posexplode(F.filter(F.transform(F.split("t", r"[;|\n]+|,(?!\s*[0-9])"), lambda x: F.trim(x)), lambda x: x != "")).alias("nth", "part")))
    # engines are masked first, as their names may hold digits; then years, then sizes
    ids = parts.select("part").distinct().withColumn("id", F.xxhash64("part"))
    lexicon = names.select("name", "kind").distinct().withColumns({"phrase": F.xxhash64("name", "kind"), "words": words(F.col("name")), "rank": F.when(F.col("kind") == "engine", 0).otherwise(1)})
    said = words(F.regexp_replace("part", r"(?<=[0-9])[.,](?=[0-9])", "_"))
    found = language.phrase_matches(ids.select("id", said.alias("words")), lexicon.select("phrase", "words", "rank"))
    named = found.join(lexicon.select("phrase", "name", "kind"), "phrase").select("id", "name", "kind").distinct()
    of = named.groupBy("id").agg(F.collect_set(F.when(F.col("kind") == "engine", F.col("name"))).alias("engines"), F.collect_set(F.when(F.col("kind") == "gen", F.col("name"))).alias("gens"))
    litres = F.coalesce(F.when(F.regexp_extract("part", LITRES, 1) != "", F.concat_ws(".", F.regexp_extract("part", LITRES, 1), F.regexp_extract("part", LITRES, 2)).try_cast("double")), F.round(F.regexp_extract("part", CUBIC, 1).try_cast("double") / 1000, 1))
    spans = intake.year_spans(F.col("part"), ends["a"], ends["b"])
    years_said = F.regexp_like("part", F.lit(r"(?<![0-9.,])(19|20)[0-9]{2}(?![0-9.,])|(?<![\w.,])[0-9]{2}\s*[-–—]\s*[0-9]{2}(?![\w.,])"))
    empty = F.array().cast("array<string>")
    read = write("read", ids.join(of, "id", "left").select("part", F.coalesce("engines", empty).alias("engines"), F.coalesce("gens", empty).alias("gens"), spans.alias("spans"), years_said.alias("dated"), litres.alias("litres")))
    fine = read.filter((F.size("gens") > 0) | (F.size("engines") > 0))
    # each application's generations (all if only engines are named) and the configurations that agree
    gens = names.filter("kind = 'gen'").select(F.col("name").alias("g"), "gen").distinct()
    by_name = fine.filter(F.size("gens") > 0).select("*", F.explode("gens").alias("g")).join(gens, "g").drop("g")
    by_engine = fine.filter(F.size("gens") == 0).select("*", F.explode("engines").alias("g"))
    engines = names.filter("kind = 'engine'").select(F.col("name").alias("g"), "engine").distinct()
    sized = universe.join(sizes, "engine", "left")
    keys = engines.groupBy("engine").agg(F.collect_set("g").alias("called"))
    sized = sized.join(keys, "engine", "left")
    met = by_name.join(sized, "gen").unionByName(by_engine.join(engines, "g").drop("g").join(sized, "engine").select(*by_name.columns, *(c for c in sized.columns if c != "gen")))
    in_years = ~F.col("dated") | F.exists("spans", lambda s: F.col("year").between(s.first, s.last))
    own_engine = (F.size("engines") == 0) | F.arrays_overlap("engines", F.coalesce("called", empty))
    own_size = F.col("litres").isNull() | (F.size("engines") > 0) | (F.abs(F.coalesce("sized", F.lit(-1.0)) - F.col("litres")) < 0.05)
    met = write("met", met.filter(in_years & own_engine & own_size).select("part", "gen", "year", "engine").distinct())
    some = met.groupBy("part").agg(F.count(F.lit(1)).alias("configs"))
    disagrees = fine.filter(F.col("litres").isNotNull() & (F.size("engines") > 0)).select("part", "litres", F.explode("engines").alias("g")).join(engines, "g").join(sizes, "engine").filter(F.abs(F.col("sized") - F.col("litres")) >= 0.05).select("part").distinct().withColumn("note", F.lit("size disagrees"))
    state = read.select("part", ((F.size("gens") > 0) | (F.size("engines") > 0)).alias("known")).join(some, "part", "left").join(disagrees, "part", "left")
    error = F.when(~F.col("known"), "no vehicle").when(F.col("configs").isNull(), "not in the catalogue")
    told = parts.join(state.select("part", error.alias("error"), "note"), "part")
    each = told.groupBy(by).agg(F.count_if(F.col("error").isNull()).alias("read"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("nth"))).alias("first_error"), F.max("note").alias("note"), F.count("error").alias("errors"))
    notes = asked.join(each, by, "left").select(
        by, free.alias("universal"), F.when(F.col("t") == "", "missing").when(~free & (F.coalesce("read", F.lit(0)) == 0), F.coalesce("first_error", F.lit("no vehicle"))).alias("error"),
        F.when(F.coalesce("read", F.lit(0)) > 0, F.coalesce("note", F.when(F.col("errors") > 0, F.lit("some applications left out")))).alias("note"),
    )
    return parts.join(met, "part").select(by, "gen", "year", "engine").distinct(), notes


def import_run(rows: DataFrame, brands: DataFrame, types: DataFrame, names: DataFrame, universe: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (row and what take_in reads, part_number, brand, type, tier, application; all text) with what was understood: kept,
    brand, part_type, tier, pn, price, list_price, stock, warranty, closeout, universal, configs and issues.

    brands: brand, tiers (array; null or empty: any); types: type. Of rows that passed every step and have one brand and part
    number, the first stays and the others are errors that name it."""
    return without_repeats(understood(rows, brands, types, names, universe, sizes))


def understood(rows: DataFrame, brands: DataFrame, types: DataFrame, names: DataFrame, universe: DataFrame, sizes: DataFrame, write: Callable[[str, DataFrame], DataFrame] = lambda name, frame: frame) -> DataFrame:
    """import_run's rows before repeated numbers are looked for, with passed (no error so far) in place of kept.

    Each row meets what its brand, type, title and application were found to mean, and no rows meet each other. write: writes
    such a frame of distinct values, by its name, and reads it again: small ones are then known to be small and sent to
    the rows, which needn't be dealt out by keys that are few and uneven."""
    said = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("part_number", "brand", "type", "tier", "application")}
    text = rows.withColumns({f"{c}_text": x for c, x in said.items()})
    values = intake.take_in(text, *(f"{c}_text" for c in said))
    brands = write("brands", brands.select("brand", "tiers"))
    resolved = write("brand-names", intake.resolve_brands(text.filter("brand_text != ''").select(F.col("brand_text").alias("name")).distinct(), brands.select("brand")))
    typed = intake.resolve_types(values.withColumns({"said": F.col("type_text"), "title": F.coalesce("title", F.lit(""))}), types, write).withColumnRenamed("type", "part_type")
    configs, notes = applications(text.select(F.col("application_text").alias("text")).distinct(), names, universe, sizes)
    counted = write("applications", notes.join(configs.groupBy("text").agg(F.count(F.lit(1)).alias("configs")), "text", "left").withColumnRenamed("text", "application_text"))
    joined = typed.withColumnRenamed("issues", "read").join(resolved.select(F.col("name").alias("brand_text"), "brand", "how"), "brand_text", "left").join(counted, "application_text", "left").join(brands, "brand", "left")
    own = F.array(*map(F.lit, TIERS))
    asked = F.array_join(words(F.col("tier_text")), "")
    usual = F.when(F.coalesce(F.size("tiers"), F.lit(0)) <= 0, "diario").when(F.array_contains("tiers", "diario"), "diario").otherwise(F.get(F.array_intersect(own, "tiers"), F.lit(0)))
    known_tier = F.array_contains(own, asked)
    pn = norm_pn(F.col("part_number_text"))
    steps = F.array_compact(F.array(
        F.when(pn == "", issue("error", "part_number", "missing", F.col("part_number_text"))),
        F.when(F.col("brand_text") == "", issue("error", "brand", "missing", F.col("brand_text"))),
        F.when(F.col("how") == "fuzzy", issue("warning", "brand", "read as another", F.col("brand_text"))),
        F.when(F.col("how") == "new", issue("warning", "brand", "new", F.col("brand_text"))),
        F.when(F.col("part_type").isNull(), issue("error", "part_type", "unknown", F.col("type_text"))),
        F.when(F.col("part_type").isNotNull() & ~F.col("sure"), issue("warning", "part_type", "taken from the title", F.col("type_text"))),
        F.when(F.col("tier_text") == "", issue("warning", "tier", "missing", F.col("tier_text"))).when(~known_tier, issue("warning", "tier", "unknown", F.col("tier_text"))),
        F.when(F.col("error").isNotNull(), F.struct(F.lit("error").alias("level"), F.lit("application").alias("column"), F.col("error").alias("message"), F.col("application_text").alias("value"))),
        F.when(F.col("note").isNotNull(), F.struct(F.lit("warning").alias("level"), F.lit("application").alias("column"), F.col("note").alias("message"), F.col("application_text").alias("value"))),
    ))
    told = joined.withColumn("issues", F.concat("read", steps).cast(ISSUE))
    tier = F.when(known_tier, asked).otherwise(usual)
    values = ("price", "list_price", "stock", "warranty", "closeout", "universal")
    return told.select("row", (~F.exists("issues", lambda x: x.level == "error")).alias("passed"), "brand", "part_type", tier.alias("tier"), pn.alias("pn"), *values, F.coalesce("configs", F.lit(0)).alias("configs"), "issues")


def without_repeats(done: DataFrame) -> DataFrame:
    """import_run's result from understood rows. Only repeated numbers have a first row to meet; one with very many rows is
    split by adaptive execution."""
    firsts = done.filter("passed").groupBy("brand", "pn").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = F.coalesce(F.col("passed") & (F.col("row") != F.col("first")), F.lit(False))
    issues = F.when(again, F.array_append("issues", issue("error", "part_number", "duplicate", F.col("first")))).otherwise(F.col("issues"))
    out = done.join(firsts, ["brand", "pn"], "left")
    return out.select("row", (F.col("passed") & ~again).alias("kept"), "brand", "part_type", "tier", "pn", "price", "list_price", "stock", "warranty", "closeout", "universal", "configs", issues.alias("issues"))


def import_summary(done: DataFrame, most: int = 12) -> DataFrame:
    """(section, name, level, n) of an import: rows, imported, universal, rows left out, errors, warnings, the most frequent
    issues (column: message), and products of each type. One pass counts rows, one issues."""
    kinds = done.groupBy("part_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("imported"), F.count_if(F.col("kept") & F.col("universal")).alias("universal"), F.count_if(~F.col("kept")).alias("left_out"))
    names = kinds.columns[1:]
    said = lambda section, name, n: F.struct(F.lit(section).alias("section"), name.alias("name"), F.lit("").alias("level"), n.alias("n"))
    told = kinds.select(F.explode(F.array(*(said("total", F.lit(c), F.col(c)) for c in names), said("part_type", F.col("part_type"), F.col("imported")))).alias("x"))
    none = done.sparkSession.range(1).select(F.explode(F.array(*(said("total", F.lit(c), F.lit(0).cast("long")) for c in names))).alias("x"))  # an empty import has totals too
    rows = told.unionByName(none).select("x.*").groupBy("section", "name", "level").agg(F.sum("n").alias("n")).filter("section = 'total' or n > 0")
    each = done.select(F.explode("issues").alias("x")).select("x.*").groupBy("level", "column", "message").agg(F.count(F.lit(1)).alias("n"))
    levels = each.groupBy("level").agg(F.sum("n").alias("n")).select(F.lit("level").alias("section"), F.col("level").alias("name"), "level", "n")
    top = each.orderBy(F.desc("n"), "level", "column", "message").limit(most).select(F.lit("issue").alias("section"), F.concat_ws(": ", "column", "message").alias("name"), "level", "n")
    return rows.unionByName(levels).unionByName(top)
