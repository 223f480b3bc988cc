"""Column helpers: rewriting matched spans, number words, and fixed word lists. All native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = " thousand million billion trillion quadrillion quintillion sextillion septillion octillion".split(" ")
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MONTHS = "January February March April May June July August September October November December".split()


def _list(words: list[str]) -> Column:
    """A constant array, written as one literal: plans stay small."""
    return F.split(F.lit("|".join(words)), r"\|")


#: The words of 0 to 99.
TWO_DIGITS = UNITS + [f"{t} {u}" if i else t for t in TENS for i, u in enumerate(UNITS[:10])]


def _below_1000(g: Column) -> Column:
    two, r = _list(TWO_DIGITS), g % 100
    return F.concat_ws(" ", F.when(g >= 100, F.concat(F.get(two, (g / 100).cast("int")), F.lit(" hundred"))), F.when(r > 0, F.get(two, r)))


def literal_map(d: dict[str, str]) -> Column:
    """A constant map, written as one literal that the optimizer folds."""
    return F.str_to_map(F.lit("\u0005".join(f"{k}\u0004{v}" for k, v in d.items())), F.lit("\u0005"), F.lit("\u0004"))


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value worked out once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


#: Cuts a text where its matches were; texts that hold it are cut by the pattern itself.
_CUT = "\u0006"


def rewrite(text: Column, pattern: str, fn: Callable[[Column], Column], guard: str | None = None) -> Column:
    """Every match of pattern replaced by fn(match). Texts that do not hold the cheaper guard, or no match, are passed on. split()
    compiles a pattern anew for every row, so matches are first replaced by one character, at which cutting is cheap."""

    def one(t: Column) -> Column:
        def said(found: Column) -> Column:
            pieces = F.when(t.contains(_CUT), F.split(t, pattern, -1)).otherwise(F.split(F.regexp_replace(t, pattern, _CUT), _CUT, -1))
            done = F.array_join(F.zip_with(pieces, F.concat(F.transform(found, fn), F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
            return F.when(F.size(found) == 0, t).otherwise(done)

        return F.when(t.rlike(guard or pattern), bind(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), said)).otherwise(t)

    return bind(text, one)


def where_found(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """fn(text) for texts that hold pattern; others, which fn would not change, are passed on. translate() looks every character up, which
    is much dearer than one search."""
    return bind(text, lambda t: F.when(t.rlike(pattern), fn(t)).otherwise(t))


def integer_words(digits: Column) -> Column:
    """Cardinal words of a string of digits, up to 10 ** 30; those below 10 ** 9 by numbers, without a walk over the string."""
    names = _list(SCALES)

    def small(n: Column) -> Column:
        parts = F.array((n / 1_000_000).cast("int"), (n / 1000).cast("int") % 1000, n % 1000)
        return F.array_join(F.transform(parts, lambda g, i: F.when(g > 0, F.concat_ws(" ", _below_1000(g), F.when(i < 2, F.get(names, 2 - i))))), " ")

    def groups(v: Column) -> Column:
        k = F.ceil(F.length(v) / 3).cast("int")
        parts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.substring(F.lpad(v, k * 3, "0"), i * 3 + 1, F.lit(3)).cast("int").alias("g"), F.get(names, k - 1 - i).alias("name")))
        said = F.transform(F.filter(parts, lambda x: x["g"] > 0), lambda x: F.rtrim(F.concat_ws(" ", _below_1000(x["g"]), x["name"])))
        return F.when(v == "", F.lit("zero")).when(F.length(v) <= 9, bind(v.try_cast("int"), small)).otherwise(F.array_join(said, " "))

    return bind(F.ltrim(digits, F.lit("0")), groups)


def digit_words(digits: Column) -> Column:
    """Digit by digit."""
    return F.array_join(F.transform(F.split(digits, ""), lambda c: F.get(_list(UNITS), c.cast("int"))), " ")


def ordinal_words(cardinal: Column) -> Column:
    """``twenty one`` -> ``twenty first``."""

    def ending(c: Column) -> Column:
        last = F.regexp_extract(c, r"(\S+)$", 1)
        plain = F.when(c.endswith("y"), F.regexp_replace(last, "y$", "ieth")).otherwise(F.concat(last, F.lit("th")))
        return F.concat(F.regexp_extract(c, r"^(.* )?\S+$", 1), F.coalesce(F.element_at(literal_map(ORDINALS), last), plain))

    return bind(cardinal, ending)


def year_words(year: Column) -> Column:
    """Spoken form of a year (a string of four digits from 1000 to 2099)."""

    def said(x: Column) -> Column:
        early = F.when(x["y"].endswith("00"), F.concat(x["a"], F.lit(" hundred"))).when(x["y"].startswith("100"), F.concat(F.lit("ten oh "), x["b"])).otherwise(F.concat_ws(" ", x["a"], x["b"]))
        return F.when(x["y"] == "2000", "two thousand").when(x["y"].startswith("200"), F.concat(F.lit("two thousand "), x["b"])).otherwise(early)

    two = lambda at: F.coalesce(F.get(_list(TWO_DIGITS), F.substring(year, at, 2).try_cast("int")), F.lit("zero"))
    return bind(F.struct(year.alias("y"), two(1).alias("a"), two(3).alias("b")), said)


def plural_year(words: Column) -> Column:
    return F.regexp_replace(F.concat(words, F.lit("s")), "ys$", "ies")
