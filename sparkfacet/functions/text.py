"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, by Unicode's decomposition, and the letters that are left without them.
_MARKED = {c: base[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if (base := unicodedata.normalize("NFD", c)) != c and "a" <= base[0] <= "z" and all(map(unicodedata.combining, base[1:]))}
ACCENTED, PLAIN = "".join(_MARKED), "".join(_MARKED.values())
COMBINING = "[\u0300-\u036f]"


def fold(text: Column) -> Column:
    """Lower case without accents and combining marks (Latin letters)."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), COMBINING, "")


def _blanked(text: Column, kept: str) -> Column:
    """fold(text) with a blank for each character other than the ASCII ones kept: to be split at blanks, which is several times
    faster than at a pattern."""
    other = "".join(c for c in map(chr, range(128)) if c not in kept)
    plain = F.translate(F.lower(text), ACCENTED + other, PLAIN + " " * len(other))
    return F.regexp_replace(F.regexp_replace(plain, COMBINING, ""), "[^\\u0000-\\u007f]", " ")


_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"

#: Marks inside raw terms: a decimal point, and the start of a term that was joined by - or /.
POINT, JOINED = "\u0001", "\u0002"


def raw_terms(text: Column) -> Column:
    """The runs that index terms are made from, by term_of."""
    return _raw(fold(text))


def _raw(t: Column) -> Column:
    single = F.split(F.regexp_replace(t, "([a-z0-9])[.]([0-9]+)", f"$1{POINT}$2 "), f"[^a-z0-9{POINT}]+")
    rest = F.regexp_replace(t, "(?<![a-z0-9/-])[a-z0-9]+(?![a-z0-9/-])", " ")  # few words are joined
    return F.concat(single, F.transform(F.split(rest, "[^a-z0-9/-]+|[/-]{2,}"), lambda w: F.concat(F.lit(JOINED), w)))


def _word_of(raw: Column) -> Column:
    joined = F.regexp_replace(raw, f"^{JOINED}[/-]?|[/-]$", "")
    return F.when(raw.startswith(JOINED), F.when(joined.rlike("[/-]"), F.translate(joined, "-/", ""))).otherwise(F.translate(raw, POINT, "."))


def kept(word: Column, stop: tuple[str, ...] = ()) -> Column:
    """A word's stem; null for stop words and remains."""
    return F.when((word != "") & ~word.isin(*(stop or ("",))), stem(word))


def term_of(raw: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words, decimals whole (1.6), and words joined by - or / once more as one, stemmed; null for stop words and remains."""
    return kept(_word_of(raw), stop)


def index_terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """The array of a short text's terms."""
    return F.array_compact(F.transform(raw_terms(text), lambda w: term_of(w, stop)))


def term_runs(text: Column) -> Column:
    """The folded text's runs of letters, digits, points, - and /: no term reaches beyond one, so that a run's terms can be
    found once, however often it stands in a text."""
    return F.split(_blanked(text, _ALNUM + "./-"), " ")


def run_words(run: Column) -> Column:
    """The words in a run of term_runs, unstemmed; most runs are one word and need no pattern."""
    plain = F.btrim(run, F.lit("./-"))
    marks = F.contains(plain, F.lit(".")) | F.contains(plain, F.lit("-")) | F.contains(plain, F.lit("/"))
    return F.when(~marks, F.array(plain)).otherwise(F.transform(_raw(plain), _word_of))


def stem(word: Column) -> Column:
    """Plural endings off: -ces to -z, -es after r, l, n, d, j, -s unless -ss; words up to 3 letters or with digits stay."""
    n = F.length(word)
    return (
        F.when(~word.endswith("s") | (n <= 3) | word.rlike("[0-9]"), word)  # all endings have an s, and most words none
        .when(word.endswith("ces"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("z")))
        .when((n > 4) & word.rlike("[rlndj]es$"), F.substring(word, F.lit(1), n - 2))
        .when(word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def words(text: Column) -> Column:
    """Runs of a-z and digits of the folded text."""
    return F.array_remove(F.split(_blanked(text, _ALNUM), " "), "")


def norm_pn(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def typo_budget(word: Column) -> Column:
    n = F.length(word)
    return F.when(n >= 8, 2).when(n >= 5, 1).otherwise(0)


#: Rewrites of a folded Spanish word to how it sounds, in order. Capitals are sounds that later rules leave alone.
SOUNDS = (
    ("ch", "X"), ("qu(?=[ei])", "k"), ("gu(?=[ei])", "G"), ("w", "gu"), ("c(?=[ei])", "s"), ("g(?=[ei])", "j"), ("g", "G"), ("z", "s"), ("c", "k"), ("q", "k"),
    ("x", "ks"), ("ll", "y"), ("y$", "i"), ("v", "b"), ("h", ""), ("n(?=[bp])", "m"), ("(.)\\1+", "$1"),
)


def phonetic_key(word: Column) -> Column:
    out = fold(word)
    for pattern, sound in SOUNDS:
        out = F.regexp_replace(out, pattern, F.lit(sound))
    return F.lower(out)


def deletes(word: Column, prefix: int = 8, most: int = 2) -> Column:
    """The first letters and all strings that one or two deletions (most: 1, only one) make of them."""

    def once(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))

    head = F.substring(word, 1, prefix)
    one = F.when(F.length(head) > 0, once(head)).otherwise(F.array().cast("array<string>"))
    if most == 1:
        return F.array_sort(F.array_distinct(F.concat(F.array(head), one)))
    two = F.flatten(F.transform(one, lambda w: F.when(F.length(w) > 0, once(w)).otherwise(F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(F.array(head), one, two)))


def _number_parts(text: Column) -> tuple[Column, Column, Column]:
    """The digits and separators of a text without its sign; that cut at its one kind of separator; whether the separator is
    for thousands: it stands several times, or once before three digits that a number other than 0 comes before."""
    s = F.replace(F.regexp_replace(text, "[^0-9,.-]", ""), F.lit("-"), F.lit(""))
    parts = F.split(s, F.when(s.contains(","), ",").otherwise("[.]"))
    return s, parts, _thousands(parts)


def _thousands(parts: Column) -> Column:
    groups = F.size(parts) - 1
    return (groups > 1) | ((groups == 1) & (F.length(F.get(parts, F.lit(1))) == 3) & ~F.get(parts, F.lit(0)).isin("", "0"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parse_number(text: Column) -> Column:
    """A number written with , or . for decimals or thousands: of both, the last is decimal; one alone is for thousands if it
    stands several times, or once before three digits (but 0,500 is a half). A minus in front counts, other signs don't."""

    def value(clean: Column, s: Column, parts: Column, thousands: Column) -> Column:
        last_comma = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
        both = F.when(last_comma, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
        head = F.get(parts, F.lit(0))
        one = F.when(thousands, F.array_join(parts, "")).when(F.size(parts) > 1, F.concat(F.when(head == "", "0").otherwise(head), F.lit("."), F.get(parts, F.lit(1)))).otherwise(s)
        number = F.when(s.contains(",") & s.contains("."), both).otherwise(one).try_cast("double")
        return F.when(s.rlike("[0-9]"), number * F.when(F.startswith(clean, F.lit("-")), -1.0).otherwise(1.0))

    def cut(clean: Column) -> Column:
        s = F.replace(clean, F.lit("-"), F.lit(""))
        return _once(s, lambda s: _once(F.split(s, F.when(s.contains(","), ",").otherwise("[.]")), lambda parts: value(clean, s, parts, _thousands(parts))))

    return _once(F.regexp_replace(text, "[^0-9,.-]", ""), cut)


def thousands_note(text: Column) -> Column:
    """How a number was read whose only separator might have been decimal, else null."""
    s, parts, thousands = _number_parts(text)
    alone = thousands & (F.size(parts) == 2) & ~(s.contains(",") & s.contains("."))
    return F.when(alone, F.concat(F.trim(text), F.lit(" read as "), F.array_join(parts, "").try_cast("long").cast("string")))


#: Fixed value: the 32 digits of Crockford's base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def luhn32(code: Column) -> Column:
    """The check digit (0 to 31) of a code in CROCKFORD's digits: alternate factors 2 and 1 from the right."""
    digits = F.reverse(F.transform(F.split(code, ""), lambda c: F.instr(F.lit(CROCKFORD), c) - 1))
    total = F.aggregate(F.transform(digits, lambda d, k: F.when(k % 2 == 0, F.floor(d * 2 / 32).cast("int") + d * 2 % 32).otherwise(d)), F.lit(0), lambda a, b: a + b)
    return (F.lit(32) - total % 32) % 32


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the characters' code points, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295)))


def looks_like_pn(word: Column) -> Column:
    """Three characters or more, no year (19xx, 20xx), and four digits, or two digits and a letter among four characters."""
    digits = F.length(F.regexp_replace(word, "[^0-9]", ""))
    return (F.length(word) >= 3) & ~word.rlike("^(19|20)[0-9]{2}$") & ((digits >= 4) | ((digits >= 2) & word.rlike("[A-Za-z]") & (F.length(word) >= 4)))


#: How a price range is put into words (folded text), lower and upper bounds; and the years that are no prices.
_SUM = r"\$?\s*([0-9]+(?:[.,][0-9]+)?)"
BETWEEN = rf"\bentre\s*{_SUM}\s*y\s*{_SUM}"
BELOW = rf"(?:\bmenos de|\bpor debajo de|\bbajo|\bhasta|\bmaximo|\bmax|<)\s*{_SUM}"
ABOVE = rf"(?:\bmas de|\bdesde|\bminimo|\barriba de|>)\s*{_SUM}"
NO_PRICE = "^(19[89][0-9]|20[0-3][0-9])([.,].*)?$"


def price_range(text: Column) -> Column:
    """struct<lo, hi> (double, null where open) of the last phrase of each kind; bounds of their own go before those of a
    range. Numbers that look like years are no prices."""
    t = fold(text)

    def last(pattern: str, groups: int) -> Column:
        """The numbers of the last phrase in which none is a year."""
        all_ = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.array(*(F.regexp_extract(m, pattern, g) for g in range(1, groups + 1))))
        fine = F.filter(all_, lambda n: ~F.exists(n, lambda x: x.rlike(NO_PRICE)))
        return F.transform(F.get(F.reverse(fine), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))

    both, above, below = last(BETWEEN, 2), last(ABOVE, 1), last(BELOW, 1)
    return F.struct(F.coalesce(F.get(above, F.lit(0)), F.array_min(both)).alias("lo"), F.coalesce(F.get(below, F.lit(0)), F.array_max(both)).alias("hi"))


def slug(text: Column) -> Column:
    """Words of the folded text joined by -."""
    return F.array_join(words(text), "-")


def warranty_years(text: Column) -> Column:
    """10 for life, n / 12 for n months, n for n years, 1 if nothing is said."""

    def years(t: Column) -> Column:
        n = F.regexp_extract(t, "([0-9]+)", 1).try_cast("double")
        return F.when(t.contains("vida"), F.lit(10.0)).when(n.isNotNull() & t.rlike("[0-9] *mes"), n / 12).otherwise(F.coalesce(n, F.lit(1.0)))

    return _once(fold(text), years)
