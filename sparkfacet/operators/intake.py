"""Rows as suppliers send them: values read from text, brands resolved, issues kept, and a seeded generator of rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfacet.functions.text import deletes, fold, parse_number, typo_budget, warranty_years, words
from sparkfacet.operators.spelling import osa, osa_distance

YES, NO = ("si", "s", "yes", "y", "true", "1", "x"), ("no", "n", "false", "0", "")
YEAR = "((?:19|20)[0-9]{2})"
_FREE, _ENDS, _DASH = "(?<![0-9.,])", "(?![0-9.,])", "(?:-|–|—)"
#: How spans of years are put (folded text), in the order in which they are looked for; what one has taken is blank for the
#: next. Kinds: both years; the second in two digits, of the first one's century; open at the end; at the start; before the
#: year; two digits each, 40 and above of the last century; one year.
YEAR_SPANS = (
    (f"{_FREE}{YEAR}\\s*(?:{_DASH}|/|\\ba\\b|\\bal\\b|\\bhasta\\b|\\bto\\b)\\s*{YEAR}{_ENDS}", "both"),
    (f"{_FREE}{YEAR}\\s*{_DASH}\\s*([0-9]{{2}}){_ENDS}", "century"),
    (f"{_FREE}{YEAR}\\s*(?:[+]|en adelante|y posteriores|o posterior|onwards|and up)", "from"),
    (f"\\b(?:desde|a partir de|from)\\s*{YEAR}{_ENDS}", "from"),
    (f"\\b(?:hasta|until|up to)\\s*{YEAR}{_ENDS}", "to"),
    (f"\\bantes de\\s*{YEAR}{_ENDS}", "before"),
    (f"(?<![\\w.,])([0-9]{{2}})\\s*{_DASH}\\s*([0-9]{{2}})(?![\\w.,])", "short"),
    (f"{_FREE}{YEAR}{_ENDS}", "one"),
)


def alnum_key(text: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(text), "[^a-z0-9]", "")


def parse_bool(text: Column) -> Column:
    """True or false by the usual words, null for others."""
    t = F.trim(fold(F.coalesce(text, F.lit(""))))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def split_list(text: Column) -> Column:
    """Parts between ; | , and line ends, trimmed, each once in the order they come."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;|,\\n]+"), lambda x: F.trim(x)), lambda x: x != ""))


def specs_of(text: Column, dropped: tuple[str, ...] = ()) -> Column:
    """array<struct<k, v>> of 'key: value; key=value', in order; keys may repeat; dropped keys are left out."""
    pairs = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:=]+)[:=]", 1)).alias("k"), F.trim(F.regexp_extract(x, "[:=](.*)$", 1)).alias("v")))
    return F.filter(pairs, lambda p: (p.k != "") & (p.v != "") & ~p.k.isin(*(dropped or ("",))))


def year_spans(text: Column, oldest: int, newest: int) -> Column:
    """array<struct<first, last>> of the spans of years that a text names, distinct and in order; open ends reach oldest or
    newest. Spans written the wrong way round are turned; short ones that can't be years of vehicles are no spans; what
    lies before the oldest year only is an empty span and left out."""
    rest, out = fold(text), None

    def spans(rest: Column, pattern: str, kind: str) -> Column:
        def span(x: Column) -> Column:
            a, b = (F.regexp_extract(x, pattern, g).try_cast("int") for g in (1, 2)) if kind in ("both", "century", "short") else (F.regexp_extract(x, pattern, 1).try_cast("int"), F.lit(None).cast("int"))
            if kind == "century":
                b = a - a % 100 + b
            if kind == "short":
                a, b = (F.when(y < 40, 2000 + y).otherwise(1900 + y) for y in (a, b))
                fine = (a >= oldest - 30) & (a <= b) & (b <= newest + 1)
                return F.when(fine, F.struct(a.alias("first"), b.alias("last")))
            first, last = {"from": (a, F.lit(newest)), "to": (F.lit(oldest), a), "before": (F.lit(oldest), a - 1), "one": (a, a)}.get(kind, (F.least(a, b), F.greatest(a, b)))
            return F.when(first <= last, F.struct(first.alias("first"), last.alias("last")))

        return F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), span)

    for pattern, kind in YEAR_SPANS:
        own = spans(rest, pattern, kind)
        out = own if out is None else F.concat(out, own)
        # short spans that can't be years stay, as their digits may mean something else
        rest = F.regexp_replace(rest, pattern, " ") if kind != "short" else rest
    return F.array_sort(F.array_distinct(F.array_compact(out)))


def application_configs(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """(item, gen, year, engine) of rows (item, text), where text names one generation ('gen 3'), spans of years and perhaps
    engines by name (all if none is named). Distinct texts are read, and meet the universe by generation."""
    ends = universe.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
    g = F.regexp_extract("text", r"gen ([0-9]+)", 1).try_cast("int")
    body = F.regexp_replace("text", r"gen [0-9]+", " ")
    each = rows.select("text").distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism)  # small to Spark, slow to read
    parsed = each.select("text", g.alias("gen"), F.explode(year_spans(body, ends["a"] or 0, ends["b"] or 0)).alias("s"))
    met = parsed.join(universe, "gen").filter(F.col("year").between(F.col("s.first"), F.col("s.last")))
    named = F.col("text").contains(F.concat(F.lit("("), F.col("engine"), F.lit(")")))
    anywhere = F.col("text").contains("(")
    said = met.filter(~anywhere | named).select("text", "gen", "year", "engine").distinct()
    return rows.select("item", "text").join(said, "text").select("item", "gen", "year", "engine").distinct()


def resolve_brands(names: DataFrame, brands: DataFrame) -> DataFrame:
    """(name, brand, how) of names (name) against brands (brand): alias (equal letters and digits), fuzzy (the one nearest
    within the typo budget; of names of three or four letters only those with two neighbours swapped) or new (its slug). Distinct
    names only; near ones meet on strings left by deletions."""
    asked = names.select("name", alnum_key(F.col("name")).alias("key")).distinct()
    known = brands.select("brand", alnum_key(F.col("brand")).alias("bkey"))
    same = asked.join(known, F.col("key") == F.col("bkey")).groupBy("name").agg(F.min("brand").alias("brand"))
    open_ = asked.join(same, "name", "left_anti").withColumn("long", typo_budget(F.col("key"))).withColumn("k", F.when(F.col("long") > 0, F.col("long")).when(F.length("key") >= 3, 1).otherwise(0))
    left = open_.filter("k > 0").select("name", "key", "k", "long", F.explode(deletes(F.col("key"))).alias("part"))
    right = known.select("brand", "bkey", F.explode(deletes(F.col("bkey"))).alias("part"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    near = left.join(right, "part").filter(F.levenshtein("key", "bkey") <= 2 * F.col("k")).filter((F.col("long") > 0) | (letters("key") == letters("bkey"))).select("name", "key", "k", "brand", "bkey").distinct()
    near = near.withColumn("d", osa_distance("key", "bkey")).filter("d <= k")
    best = near.groupBy("name").agg(F.min("d").alias("d"))
    fuzzy = near.join(best, ["name", "d"]).groupBy("name").agg(F.min("brand").alias("brand"), F.count_distinct("brand").alias("n")).filter("n = 1")
    found = same.withColumn("how", F.lit("alias")).unionByName(fuzzy.select("name", "brand", F.lit("fuzzy").alias("how")))
    slug = F.array_join(words(F.col("name")), "-")
    return asked.join(found, "name", "left").select("name", F.coalesce("brand", slug).alias("brand"), F.coalesce("how", F.lit("new")).alias("how"))


def type_keys(types: DataFrame) -> DataFrame:
    """(key, type, n): the words that name a type, the first type by name of those with equal ones, and their number."""
    known = types.select("type", F.array_join(words(F.col("type")), " ").alias("key"), F.size(words(F.col("type"))).alias("n")).filter("key != ''")
    return known.groupBy("key", "n").agg(F.min("type").alias("type"))


def title_types(titles: DataFrame, keys: DataFrame) -> DataFrame:
    """(title, type) of titles (title; distinct): the longest type whose words stand together in the title, of equals the first
    by name; titles without any are left out. Runs of a title's words meet the types by equality, whatever their number."""
    longest = keys.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(longest, 1))), lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice("w", k, n), " "))))
    inside = titles.select("title", words(F.col("title")).alias("w")).select("title", F.explode(F.array_distinct(runs)).alias("key")).join(keys, "key")
    return inside.groupBy("title").agg(F.min(F.struct((-F.col("n")).alias("less"), "type")).alias("g")).select("title", "g.type")


def resolve_types(rows: DataFrame, types: DataFrame, write: Callable[[str, DataFrame], DataFrame] = lambda name, frame: frame) -> DataFrame:
    """rows (said and title, and any others) with type and sure: the type (types: type) that the type column names (sure), else
    that of the title (a guess), else null. Distinct titles are read. write: as in imports.understood."""
    keys = write("types", type_keys(types))
    guesses = write("titles", title_types(rows.select("title").distinct(), keys))
    said = rows.withColumn("key", F.array_join(words(F.col("said")), " ")).join(keys.select("key", F.col("type").alias("named")), "key", "left")
    joined = said.join(guesses.withColumnRenamed("type", "guess"), "title", "left")
    return joined.select(*rows.columns, F.coalesce("named", "guess").alias("type"), F.col("named").isNotNull().alias("sure"))


def map_headers(headers: list[str], synonyms: dict[str, tuple[str, ...]], warehouses: tuple[str, ...] = ()) -> dict[str, str]:
    """header -> field: equal folded words first, then the nearest synonym within the typo budget (one at least, from four
    letters on); each field once, the first column that names it. A column whose first word names the stock and whose others
    name a warehouse is stock:n, its stock."""

    def plain(text: str) -> str:
        marks = unicodedata.normalize("NFD", text.lower())
        return " ".join(re.findall("[a-z0-9]+", "".join(c for c in marks if not unicodedata.combining(c))))

    known = {plain(n): f for f, names in synonyms.items() for n in names}
    out: dict[str, str] = {}
    for header in headers:
        h = plain(header)
        first, *rest = h.split() or [""]
        place = "".join(w for w in rest if w not in ("almacen", "bodega"))
        if rest and known.get(first) == "stock" and place in warehouses:
            out[header] = f"stock:{warehouses.index(place)}"
            continue
        field = known.get(h)
        if field is None and len(h) >= 4:
            budget = 2 if len(h) >= 8 else 1
            field = min(((d, n, f) for n, f in known.items() if (d := osa(h, n, budget)) <= budget), default=(0, "", None))[2]
        if field and field not in out.values():
            out[header] = field
    return out


def take_in(rows: DataFrame, *kept: str) -> DataFrame:
    """Rows (row, title, price, list_price, stock: array of text, warranty, closeout, extras) read, with issues: an array of
    struct<level, column, message, value>. Rows with an error aren't products; warnings leave a default. kept: columns that
    stay as they are."""
    # each value is read once, and then named as often as it is needed
    read = rows.withColumns({"_price": parse_number(F.col("price")), "_was": parse_number(F.col("list_price")), "_stock": F.transform("stock", parse_number), "_closeout": parse_bool(F.col("closeout"))})
    price, was, closeout = F.col("_price"), F.col("_was"), F.col("_closeout")
    levels = F.transform("_stock", lambda n: F.greatest(F.lit(0), F.coalesce(n.cast("int"), F.lit(0))))

    def issue(bad: Column, level: str, column: str, message: str) -> Column:
        return F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(column).alias("column"), F.lit(message).alias("message"), F.col(column).cast("string").alias("value")))

    issues = F.array_compact(F.array(
        issue(F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0, "error", "title", "empty"),
        issue(price.isNull() | (price <= 0), "error", "price", "no price"),
        issue(was.isNotNull() & (was < price), "warning", "list_price", "below the price"),
        issue(closeout.isNull(), "warning", "closeout", "neither yes nor no"),
        issue(F.exists(F.zip_with("stock", "_stock", lambda s, n: (F.trim(s) != "") & n.isNull()), lambda odd: odd), "warning", "stock", "no number"),
    ))
    return read.select("row", "title", price.alias("price"), F.when(was >= price, was).alias("list_price"), levels.alias("stock"), F.round(warranty_years(F.col("warranty")), 6).alias("warranty"), F.coalesce(closeout, F.lit(False)).alias("closeout"), split_list(F.col("extras")).alias("extras"), issues.alias("issues"), *kept)


def issue_summary(taken: DataFrame, most: int = 12) -> DataFrame:
    """(level, column, message, n, rows: of all rows with an error) of the most frequent issues."""
    each = taken.select("row", F.explode("issues").alias("x")).select("row", "x.*")
    errors = each.filter("level = 'error'").agg(F.count_distinct("row").alias("error_rows"))
    top = each.groupBy("level", "column", "message").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level", "column", "message").limit(most)
    return top.join(F.broadcast(errors))  # one row


#: Fixed values of the generator.
STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The lower 32 bits of a product of two 32-bit numbers, without overflow."""
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def mulberry32(seed: Column, nth: Column) -> Column:
    """The nth number (from 1) of a seed's stream, 0 to 2**32 - 1: the state only counts, so each is computed by itself."""
    a = (seed.cast("long") + nth.cast("long") * F.lit(STEP)).bitwiseAND(F.lit(MASK))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    u = (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(F.lit(MASK))
    t = u.bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14))


def filled(mask: Column, seed: Column) -> Column:
    """The mask with # filled by digits and @ by letters, the kth character by the kth number of the seed's stream."""
    return F.array_join(F.transform(F.split(mask, ""), lambda c, k: F.when(c == "#", (mulberry32(seed, k + 1) % 10).cast("string")).when(c == "@", F.char(65 + mulberry32(seed, k + 1) % 26)).otherwise(c)), "")
