"""What a text says: known phrases in it, symptoms it describes, words to highlight, and clues that are combined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfacet.functions.text import deletes, fold, stem, typo_budget
from sparkfacet.operators.spelling import damerau_distance, osa_distance, sorted_letters

_MATCH = "array<struct<place: int, n: int, phrase: bigint>>"


def phrase_matches(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, place, n, phrase): the phrases of each text, read from the left: the longest one at a word is taken with all its
    words, else the word is skipped. Of phrases with equal words the lowest rank, then the lowest id counts.

    texts: id, words (array); phrases: phrase (long), words, rank. Runs of words meet phrases by equality, so neither a
    text nor the phrases are held in a task; the walk over a text's matches is a fold."""
    known = phrases.filter(F.size("words") > 0).groupBy(F.array_join("words", " ").alias("key"), F.size("words").alias("n")).agg(F.min(F.struct("rank", "phrase")).alias("best"))
    known = known.select("key", "n", F.col("best.phrase").cast("long").alias("phrase"))
    longest = known.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    runs = F.transform(F.sequence(F.lit(1), F.lit(max(longest, 1))), lambda n: F.transform(F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct((k - 1).alias("place"), n.alias("n"), F.array_join(F.slice("words", k, n), " ").alias("key"))))
    met = texts.filter(F.size("words") > 0).select("id", F.explode(F.flatten(runs)).alias("r")).select("id", "r.*").join(known, ["key", "n"])
    each = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("n")).alias("less"), "phrase"))).alias("found"))

    def take(state: Column, x: Column) -> Column:
        free = x.place >= state.free
        taken = F.array_append(state.out, F.struct(x.place.alias("place"), (-x.less).alias("n"), x.phrase.alias("phrase")))
        return F.struct(F.when(free, x.place - x.less).otherwise(state.free).alias("free"), F.when(free, taken).otherwise(state.out).alias("out"))

    walked = F.aggregate("found", F.struct(F.lit(0).alias("free"), F.array().cast(_MATCH).alias("out")), take, lambda s: s.out)
    return each.select("id", F.explode(walked).alias("m")).select("id", "m.*")


def _left_over() -> Column:
    """What deletes has of a word whose first eight letters are head, some of it more than once: written out, as that is
    compiled and functions of arrays aren't."""
    cut = lambda *at: F.concat(*(F.substring("head", a + 1, b - a - 1) for a, b in zip((0, *at), (*at, 9)) if b - a > 1))
    return F.array(cut(), *(cut(i) for i in range(1, 9)), *(cut(i, j) for i in range(1, 9) for j in range(i + 1, 9)))


def near_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """words with known, for each pair that is equal or within the typo budget of the known word. words: word and any other
    columns, distinct; known: distinct words. Pairs meet on strings left by deletions of their first letters, known words
    without a budget only themselves; all in one pass over the words. The built-in distance decides unless swaps may, as in
    spelling.corrections."""
    left = words.withColumn("head", F.substring("word", 1, 8)).select(*words.columns, F.explode(_left_over()).alias("part"))
    k = typo_budget(F.col("known"))
    right = known.select("known", k.alias("k"), F.explode(F.when(k > 0, deletes(F.col("known"))).otherwise(F.array("known"))).alias("part"))
    met = left.join(right, "part").filter(F.abs(F.length("word") - F.length("known")) <= F.col("k")).withColumn("far", F.levenshtein("word", "known", 4))
    maybe = (F.col("far") >= 0) & (F.col("far") <= 2 * F.col("k"))
    swaps = (F.col("far") <= F.col("k")) | (F.levenshtein(sorted_letters(F.col("word")), sorted_letters(F.col("known")), 2) >= 0)
    met = met.filter(maybe).select(*words.columns, "known", "k", "far").distinct().filter(swaps)
    swapped = met.withColumn("asked", F.when(F.col("far") > F.col("k"), F.col("word"))).withColumn("distance", osa_distance("asked", "known"))
    return swapped.filter("distance is null or distance <= k").select(*words.columns, "known")


def symptom_words(texts: DataFrame, phrases: DataFrame, content: Callable[[Column], Column] | None = None) -> DataFrame:
    """(word, known): the words of texts that a word of some phrase may take. content: what a word of a text counts as (null:
    nothing), found once for each distinct word; itself if none is given."""
    raw = texts.select(F.explode("words").alias("raw")).distinct()
    words = raw.withColumn("word", content(F.col("raw")) if content else F.col("raw")).filter("word is not null")
    pairs = near_words(words, phrases.select(F.explode("words").alias("known")).distinct())
    return pairs.select(F.col("raw").alias("word"), "known")


#: So many pairs of words (some 20 MB in memory) are sent to all tasks.
PAIRS = 200_000


def symptoms_found(texts: DataFrame, phrases: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(id, symptom, place, words, score): the symptoms that each text describes, the best first.

    texts: id, words (array of content words); phrases: symptom, nth (long, unique), words. A phrase takes for each of its
    words the first word of the text that equals it or, from five letters on, lies within its typo budget, and that the phrase
    hasn't taken yet. It counts with all its words, or all but one of three and more. Its score is the number of words taken
    and their share. The best score is found first, then of equals the first phrase; each symptom once, and only if it brings
    a word that no symptom found before has. What a phrase takes doesn't depend on the others, so one pass over a text's
    phrases in order of score does it.

    pairs: symptom_words of these texts, if they are written already; words that aren't in it count as nothing. Up to PAIRS of
    them are sent to all tasks, so that texts' words needn't be moved; more are met as Spark chooses. Of phrases no two words of
    which may take the same word, each takes its first one, a minimum; lists of places are kept for other phrases only."""
    parts = phrases.select("nth", F.posexplode("words").alias("k", "known"))
    few = pairs is not None and pairs.count() <= PAIRS
    pairs = symptom_words(texts, phrases) if pairs is None else pairs
    sent = F.broadcast if few else lambda frame: frame
    shared = pairs.join(parts, "known").groupBy("nth", "word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("nth").distinct()
    plain, others = parts.join(shared, "nth", "left_anti"), parts.join(shared, "nth", "left_semi")
    met = lambda pairs: texts.select("id", F.posexplode("words").alias("at", "word")).join(sent(pairs), "word").select("id", "known", "at")
    most = max(phrases.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0], 1)
    firsts = [F.min(F.when(F.col("k") == k, F.col("at"))).alias(f"at{k}") for k in range(most)]
    taken = met(pairs).join(plain, "known").groupBy("id", "nth").agg(*firsts).select("id", "nth", F.array_compact(F.array(*(f"at{k}" for k in range(most)))).alias("used"))
    # of a text's words that a phrase's word may take, as many as a phrase has words are enough
    places = met(pairs.join(others, "known", "left_semi")).groupBy("id", "known").agg(F.slice(F.array_sort(F.collect_list("at")), 1, most).alias("ats"))
    lists = places.join(others, "known").groupBy("id", "nth").agg(F.array_sort(F.collect_list(F.struct("k", "ats"))).alias("parts"))

    def take(used: Column, x: Column) -> Column:
        first = F.get(F.filter(x.ats, lambda at: ~F.array_contains(used, at)), F.lit(0))
        return F.when(first.isNull(), used).otherwise(F.array_append(used, first))

    taken = taken.unionByName(lists.select("id", "nth", F.aggregate("parts", F.array().cast("array<int>"), take).alias("used")))
    n, size = F.size("used"), F.col("size")
    fit = taken.join(phrases.select("nth", "symptom", F.size("words").alias("size")), "nth").filter(n >= F.when(size >= 3, size - 1).otherwise(size))
    scored = fit.withColumn("score", n + n / size)
    each = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "nth", "symptom", "used"))).alias("found"))
    kind = scored.schema["symptom"].dataType.simpleString()

    def accept(state: Column, x: Column) -> Column:
        new = ~F.array_contains(F.transform(state.out, lambda o: o.symptom), x.symptom) & (F.size(F.array_except(x.used, state.used)) > 0)
        got = F.array_append(state.out, F.struct(x.symptom.alias("symptom"), F.size(x.used).alias("words"), (-x.less).alias("score")))
        return F.struct(F.when(new, F.array_union(state.used, x.used)).otherwise(state.used).alias("used"), F.when(new, got).otherwise(state.out).alias("out"))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<struct<symptom: {kind}, words: int, score: double>>").alias("out"))
    done = each.select("id", F.posexplode(F.aggregate("found", start, accept, lambda s: s.out)).alias("place", "o"))
    return done.select("id", "o.symptom", (F.col("place") + 1).alias("place"), "o.words", "o.score")


def symptom_types(posteriors: DataFrame, least: float = 0.04) -> DataFrame:
    """(case, cause, posterior) of the causes that narrow a search: those with at least the posterior."""
    return posteriors.filter(F.col("posterior") >= least)


def _places(words: Column, text: Column) -> Column:
    """array<struct<word, start, end>> of words that stand in text one after another; places in code points from 0."""

    def step(state: Column, w: Column) -> Column:
        start = F.position(w, text, state.pos + 1) - 1
        return F.struct((start + F.length(w)).alias("pos"), F.array_append(state.out, F.struct(w.alias("word"), start.alias("start"), (start + F.length(w)).alias("end"))).alias("out"))

    return F.aggregate(words, F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<word: string, start: int, end: int>>").alias("out")), step, lambda s: s.out)


def words_at(text: Column, between: str) -> Column:
    """array<struct<word, start, end>> of what stands between matches of a pattern, with places in code points."""
    return _places(F.filter(F.split(text, between), lambda w: w != ""), text)


def marks(title: Column, terms: Column) -> Column:
    """array<struct<start, end>>: the words of a title (between white space) to highlight, in code points: those whose stem
    begins with a term, or is the beginning of one of more than three letters. Stems and terms of one letter mark nothing."""

    def lit_up(w: Column) -> Column:
        s = stem(fold(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
        return (F.length(s) > 1) & F.exists(terms, lambda t: (F.length(t) > 1) & (F.startswith(s, t) | ((F.length(t) > 3) & F.startswith(t, s))))

    return F.transform(F.filter(words_at(title, r"(?U)\s+"), lambda x: lit_up(x.word)), lambda x: F.struct(x.start, x.end))


#: Letters and digits of any script, with a decimal part after a point or comma.
_TOKEN = r"[\p{L}\p{N}]+(?:[.,]\p{Nd}+)?"


def tokens(text: Column) -> Column:
    """array<struct<raw, f, s, start, end>>: words and decimals as they stand, folded (a comma as a point) and stemmed, with
    their places in the text in code points."""

    def full(x: Column) -> Column:
        f = F.translate(fold(x.word), ",", ".")
        return F.struct(x.word.alias("raw"), f.alias("f"), stem(f).alias("s"), x.start, x.end)

    return F.transform(_places(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), text), full)


def engine_of(clues: Column, by_size: Column, of_model: Column) -> Column:
    """The one engine that the clues leave, null for none or several. clues: array of arrays of engines, null without any;
    by_size: engines of the size that was named (null if none was); of_model: engines of the model (null without a model).

    Named engines are what all clues have in common. A size then narrows these, or those of the model if no engine was
    named, as far as it leaves any; and so does the model."""
    none = F.array().cast("array<string>")
    common = F.aggregate(F.slice(clues, 2, F.greatest(F.size(clues) - 1, F.lit(0))), F.get(clues, F.lit(0)), lambda a, x: F.array_intersect(a, x))
    named = F.when(F.size(clues) > 0, common)
    pool = F.coalesce(named, of_model, none)
    sized = F.array_intersect(pool, F.coalesce(by_size, none))
    left = F.when(F.size(sized) > 0, sized).otherwise(named)
    both = F.array_intersect(left, F.coalesce(of_model, none))
    last = F.coalesce(F.when((F.size(left) > 0) & (F.size(both) > 0), both), left)
    return F.when(F.size(last) == 1, F.get(last, F.lit(0)))


def merged_request(said: dict[str, Column], asked: dict[str, Column], lists: tuple[str, ...], first_said: tuple[str, ...] = ("vehicle",)) -> dict[str, Column]:
    """One request out of what a query says and what the form asks: lists are united; of single values the form's counts,
    but for those in first_said, where the query's does."""
    out = {}
    for name in said.keys() | asked.keys():
        a, b = said.get(name), asked.get(name)
        if name in lists:
            none = F.array().cast("array<string>")
            out[name] = F.array_sort(F.array_union(F.coalesce(*(c for c in (b, none) if c is not None)), F.coalesce(*(c for c in (a, none) if c is not None))))
        else:
            order = (a, b) if name in first_said else (b, a)
            out[name] = F.coalesce(*(c for c in order if c is not None))
    return out


#: Weights of the ways in which a query's word meets a term, and how many terms a prefix may stand for.
EXACT, PREFIX, ONE_EDIT, MORE_EDITS, SOUND, PREFIXES = 1.0, 0.8, 0.7, 0.5, 0.75, 48


def deletion_index(vocabulary: DataFrame) -> DataFrame:
    """(part, term, df) of a vocabulary (term, df): what deletions leave of each term."""
    return vocabulary.select(F.explode(deletes(F.col("term"))).alias("part"), "term", "df")


def sound_index(vocabulary: DataFrame, key) -> DataFrame:
    """(sound, term)."""
    return vocabulary.select(key(F.col("term")).alias("sound"), "term")


def prefixed(words: DataFrame, vocabulary: DataFrame, most: int | None = PREFIXES) -> DataFrame:
    """(word, term) of the first `most` terms, in order, that each word (two letters or more) begins; None: of all. Terms meet
    words on their beginnings of as many letters as a word has; of each task's terms only so many go on."""
    sizes = [r[0] for r in words.select(F.length("word")).distinct().collect() if r[0] and r[0] >= 2]  # lengths of words: some tens
    if not sizes:
        return words.select("word", F.col("word").alias("term")).limit(0)
    begins = vocabulary.select("term", F.explode(F.filter(F.array(*(F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sorted(sizes))), lambda x: x.isNotNull())).alias("word"))
    met = begins.join(words.select("word").distinct(), "word")
    if most is None:
        return met.select("word", "term")
    nth = F.row_number().over(Window.partitionBy("word").orderBy("term"))  # limited before the shuffle
    return met.withColumn("nth", nth).filter(F.col("nth") <= most).select("word", "term")


def search_variants(words: DataFrame, vocabulary: DataFrame, deletions: DataFrame, sounds: DataFrame, key, most: int = 5) -> DataFrame:
    """(query, place, word, term, weight, channel) of words (query, place, word, last): the terms that each word may stand for.

    exact: the word itself; prefix: for a query's last word, terms that it begins. Only if there are none of these, for words
    of four letters or more, spelling: the `most` nearest terms within one edit, or the word's typo budget if that is more
    (nearest, then most frequent, then by name); and sound: other terms that sound alike. vocabulary: term, df; deletions and
    sounds: its two indexes. Each distinct word is looked up once."""
    asked = words.select("word", "last").distinct()
    exact = asked.join(vocabulary.select(F.col("term").alias("word")), "word").select("word", "last", F.col("word").alias("term"), F.lit(EXACT).alias("weight"), F.lit("exact").alias("channel"))
    begun = prefixed(asked.filter(F.col("last") & (F.length("word") >= 2)).select("word"), vocabulary).filter("term != word")
    begun = begun.select("word", F.lit(True).alias("last"), "term", F.lit(PREFIX).alias("weight"), F.lit("prefix").alias("channel"))
    sure = exact.unionByName(begun)
    open_ = asked.filter(F.length("word") >= 4).join(sure.select("word", "last").distinct(), ["word", "last"], "left_anti")
    lost = open_.select("word").distinct().withColumn("k", F.greatest(F.lit(1), typo_budget(F.col("word"))))
    pairs = lost.select("word", "k", F.explode(deletes(F.col("word"))).alias("part")).join(deletions, "part")
    pairs = pairs.filter((F.abs(F.length("word") - F.length("term")) <= F.col("k")) & (F.levenshtein("word", "term") <= 2 * F.col("k"))).select("word", "k", "term", "df").distinct()
    pairs = pairs.withColumn("distance", damerau_distance("word", "term")).filter("distance <= k")
    nth = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.desc("df"), "term"))
    spelt = pairs.withColumn("nth", nth).filter(F.col("nth") <= most).select("word", "term", F.when(F.col("distance") == 1, ONE_EDIT).otherwise(MORE_EDITS).alias("weight"), F.lit("spelling").alias("channel"))
    alike = lost.select("word", key(F.col("word")).alias("sound")).join(sounds, "sound").join(spelt.select("word", "term"), ["word", "term"], "left_anti")
    alike = alike.select("word", "term", F.lit(SOUND).alias("weight"), F.lit("sound").alias("channel"))
    unsure = open_.join(spelt.unionByName(alike), "word").select("word", "last", "term", "weight", "channel")
    return words.join(sure.unionByName(unsure), ["word", "last"]).select("query", "place", "word", "term", "weight", "channel")


def lexicon_corrections(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, entry, distance): the entry of a lexicon (entry, nth) nearest to each word within the word's typo budget, the
    first of equals. Words that differ from an entry in a last a or o only aren't errors of it; words in it stand for themselves."""
    asked = words.select("word").distinct().withColumn("k", typo_budget(F.col("word"))).filter("k > 0")
    left = asked.select("word", "k", F.explode(deletes(F.col("word"))).alias("part"))
    right = lexicon.select("entry", "nth", F.explode(deletes(F.col("entry"))).alias("part"))
    gender = F.col("word").rlike("[ao]$") & (F.length("word") == F.length("entry")) & (F.expr("left(word, length(word) - 1)") == F.expr("left(entry, length(entry) - 1)")) & (F.col("word") != F.col("entry"))
    near = left.join(right, "part").filter((F.abs(F.length("word") - F.length("entry")) <= F.col("k")) & (F.levenshtein("word", "entry") <= 2 * F.col("k")) & ~gender).select("word", "k", "entry", "nth").distinct()
    near = near.withColumn("distance", damerau_distance("word", "entry")).filter("distance <= k")
    best = near.groupBy("word").agg(F.min(F.struct("distance", "nth", "entry")).alias("b"))
    return best.select("word", "b.entry", "b.distance")
