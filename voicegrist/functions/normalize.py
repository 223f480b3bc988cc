"""Rewriting of non-standard words into spoken ones. Each rule is Column -> Column; normalize() is the cascade."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .text import MONTHS, _list, bind, digit_words, integer_words, literal_map, ordinal_words, plural_year, rewrite, where_found, year_words

IsWord = Callable[[Column], Column]

# Fixed values.
GREEK = dict(zip("αβγδεζηθικλμνξπρστυφχψω", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split(), strict=True))
SUITS = {"♠": "spades", "♥": "hearts", "♦": "diamonds", "♣": "clubs"}
RANKS = {"A": "ace", "K": "king", "Q": "queen", "J": "jack", "10": "ten", "9": "nine", "8": "eight", "7": "seven", "6": "six", "5": "five", "4": "four", "3": "three", "2": "two"}
SPOKEN = {
    "mrs.": "Missus", "mr.": "Mister", "ms.": "Miz", "dr.": "Doctor", "prof.": "Professor", "st.": "Saint", "jr.": "Junior", "sr.": "Senior",
    "e.g.": "for example", "i.e.": "that is", "etc.": "et cetera", "vs.": "versus", "cf.": "compare", "a.m.": "A M", "p.m.": "P M",
}
SAY_AS_WORD = "NASA NATO RADAR ASCII JSON ASAP FAQ PIN".split()
TLDS = "com org net edu gov io co uk de fr jp cn ru us info biz me ai app dev tv".split()
URL_MARKS = {".": "dot", "/": "slash", ":": "colon", "-": "dash", "_": "underscore", "?": "question mark", "=": "equals", "&": "and", "#": "hash", "~": "tilde"}
EMPHASIS = "to in on at of or as by is be an no so we he my me do if it up am go".split()
MATH_ALWAYS = {"≤": "less than or equal to", "≥": "greater than or equal to", "≠": "not equal to", "×": "times", "÷": "divided by", "±": "plus or minus"}
UNIT_WORDS = {
    "km/h": ("kilometers per hour",) * 2, "mph": ("miles per hour",) * 2, "kph": ("kilometers per hour",) * 2, "gbps": ("gigabits per second",) * 2, "mbps": ("megabits per second",) * 2, "kbps": ("kilobits per second",) * 2,
    "°c": ("degrees Celsius",) * 2, "°f": ("degrees Fahrenheit",) * 2, "°k": ("degrees Kelvin",) * 2,
    "kib": ("kibibyte", "kibibytes"), "mib": ("mebibyte", "mebibytes"), "gib": ("gibibyte", "gibibytes"), "tib": ("tebibyte", "tebibytes"), "kb": ("kilobyte", "kilobytes"), "mb": ("megabyte", "megabytes"), "gb": ("gigabyte", "gigabytes"), "tb": ("terabyte", "terabytes"), "pb": ("petabyte", "petabytes"),
    "ghz": ("gigahertz",) * 2, "mhz": ("megahertz",) * 2, "khz": ("kilohertz",) * 2, "hz": ("hertz",) * 2,
    "mm": ("millimeter", "millimeters"), "cm": ("centimeter", "centimeters"), "km": ("kilometer", "kilometers"), "in": ("inch", "inches"), "ft": ("foot", "feet"), "yd": ("yard", "yards"),
    "mg": ("milligram", "milligrams"), "kg": ("kilogram", "kilograms"), "g": ("gram", "grams"), "min": ("minute", "minutes"), "mi": ("mile", "miles"), "lb": ("pound", "pounds"), "oz": ("ounce", "ounces"),
    "hr": ("hour", "hours"), "sec": ("second", "seconds"), "s": ("second", "seconds"), "m": ("meter", "meters"), "t": ("ton", "tons"),
}
MONEY = {"$": ("dollar", "dollars"), "€": ("euro", "euros"), "£": ("pound", "pounds"), "¥": ("yen", "yen")}


def _group(s: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(s, pattern, n)


def apply_rewrites(t: Column, rules: list[tuple[str, str]]) -> Column:
    """The user's patterns, in order."""
    for pattern, replacement in rules:
        t = F.regexp_replace(t, pattern, replacement)
    return t


def fold_dashes(t: Column) -> Column:
    """N2"""
    return where_found(t, r"[\[\]–−]", lambda x: F.translate(F.regexp_replace(F.translate(x, "[]", ""), r"(?<=[0-9])–(?=[0-9])", " to "), "–−", "--"))


def greek_letters(t: Column) -> Column:
    """Blanks on either side but where a hyphen touches."""
    said = literal_map(GREEK | {k.upper(): v for k, v in GREEK.items()})
    t = rewrite(t, "[α-ωΑ-Ω]", lambda m: F.coalesce(F.concat(F.lit("\u0001"), F.element_at(said, m), F.lit("\u0001")), m))
    return where_found(t, "\u0001", lambda x: F.regexp_replace(F.regexp_replace(x, "(?<=-)\u0001|\u0001(?=-)", ""), "\u0001", " "))


def super_sub_digits(t: Column) -> Column:
    """N4"""
    digits = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
    return where_found(t, "[²³¹⁰⁴-⁹₀-₉]", lambda x: F.translate(F.regexp_replace(x, f"([{digits}])", " $1 "), digits, "01234567890123456789"))


def playing_cards(t: Column) -> Column:
    """N5"""
    suit, rank = literal_map(SUITS), literal_map(RANKS)
    t = rewrite(t, "(?<![A-Za-z0-9])(?:10|[2-9AKQJ])[♠♥♦♣]", lambda m: F.concat(F.lit(" "), F.element_at(rank, F.regexp_replace(m, "[♠♥♦♣]", "")), F.lit(" of "), F.element_at(suit, F.substring(m, -1, 1)), F.lit(" ")), "[♠♥♦♣]")
    return rewrite(t, "[♠♥♦♣]", lambda m: F.concat(F.lit(" "), F.element_at(suit, m), F.lit(" ")))


def feet_inches(t: Column) -> Column:
    """N6; a decade or possessive year such as 1920's is left alone."""
    feet = lambda x: F.regexp_replace(x, r"(?<=[0-9])(?<!(?<![0-9])[12][0-9]{3}(?=['’]s))['’]", " feet ")
    return where_found(t, "[0-9]['’\"”]", lambda x: F.regexp_replace(feet(x), '(?<=[0-9])["”]', " inches "))


def hex_literals(t: Column) -> Column:
    """N7"""
    return rewrite(t, "(?<![A-Za-z0-9])0[xX][0-9A-Fa-f]+(?![A-Za-z0-9])", lambda m: F.concat(F.lit(" hex"), F.regexp_replace(F.upper(F.substring(m, 3, 1 << 20)), "(.)", " $1"), F.lit(" ")), "0[xX]")


def roman_numerals(t: Column, is_word: IsWord | None = None) -> Column:
    """Two letters or more, of one case, that are no word; whatever their order, a letter before a larger one is subtracted.
    Without a dictionary only numbers in canonical form are read, for else "did" and "mild" would be."""
    value = literal_map({"i": "1", "v": "5", "x": "10", "l": "50", "c": "100", "d": "500", "m": "1000"})

    def said(m: Column) -> Column:
        vs = F.transform(F.split(F.lower(m), ""), lambda c: F.element_at(value, c).cast("int"))
        total = F.aggregate(F.transform(vs, lambda v, i: F.when(v < F.coalesce(F.get(vs, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
        number = integer_words(total.cast("string"))
        return number if is_word is None else F.when(is_word(F.lower(m)), m).otherwise(number)

    form = "[IVXLCDM]{2,}" if is_word else "(?=[MDCLXVI]{2})M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
    return rewrite(t, rf"(?<![A-Za-z0-9])(?:{form}|{form.lower()})(?![A-Za-z0-9])", said, "(?:[IVXLCDM]{2}|[ivxlcdm]{2})(?<=(?<![A-Za-z0-9])..)(?:[IVXLCDM]*|[ivxlcdm]*)(?![A-Za-z0-9])")


#: Where letters with diacritics lie.
LATIN = "[À-ɏ]"


def _folding() -> dict[str, str]:
    """Latin letters to their ASCII base, by Unicode decomposition."""
    base = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFD", c))[0] < "\x80" and d[0].isalpha() and len(d) > 1}
    return base | dict(zip("œŒæÆßøØłŁđĐ", "oOaAsoOlLdD", strict=True))


def fold_diacritics(t: Column) -> Column:
    """Latin letters to their ASCII base; the table is built by rule."""
    base = _folding()
    return where_found(t, LATIN, lambda x: F.translate(x, "".join(base), "".join(base.values())))


#: What ends the span of a URL, inside a class of characters.
_URL_END = "\\s,\"'<>()“”‘’"
_URL = rf"(?<![A-Za-z0-9])(?:(?i:https?://|www\.)[^{_URL_END}]*|(?=[^{_URL_END}]*?[A-Za-z0-9-](?i:\.(?:{'|'.join(TLDS)}))(?:[/?#{_URL_END}]|$))[^{_URL_END}]+|~/[^{_URL_END}]+|/[A-Za-z0-9][^{_URL_END}]+)"
_IPV4 = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?::[0-9]{1,5})?(?![0-9]|\.[0-9])"


def urls(t: Column, is_word: IsWord | None = None) -> Column:
    """A scheme and unknown words letter by letter, known words in small letters, digits one by one, some marks by name; others stay."""
    mark = literal_map(URL_MARKS)

    def piece(p: Column, i: Column) -> Column:
        spelled = F.rtrim(F.regexp_replace(F.upper(p), "(.)", "$1 "))
        known = F.lit(False) if is_word is None else is_word(F.lower(p)) & ~((i == 0) & F.lower(p).isin("http", "https", "www", "ftp"))
        return F.when(p.rlike("^[0-9]"), F.rtrim(F.regexp_replace(p, "(.)", "$1 "))).when(p.rlike("^[A-Za-z]"), F.when(known, F.lower(p)).otherwise(spelled)).otherwise(F.coalesce(F.element_at(mark, p), p))

    def said(m: Column) -> Column:
        body, tail = F.regexp_replace(m, "[.,;:!?]+$", ""), _group(m, "([.,;:!?]*)$", 1)
        parts = F.transform(F.regexp_extract_all(body, F.lit(r"^(?i:https|http|www|ftp)|[A-Za-z]+|[0-9]+|[^A-Za-z0-9]"), F.lit(0)), piece)
        return F.concat(F.array_join(parts, " "), tail)

    return rewrite(ip_addresses(t), _URL, said, rf"://|(?i:www\.|\.(?:{'|'.join(TLDS)}))|/")


def ip_addresses(t: Column) -> Column:
    """N10a"""
    said = lambda m: F.concat(F.lit(" "), F.regexp_replace(F.replace(m, F.lit("."), F.lit(" dot ")), ":([0-9]+)$", " , port $1"), F.lit(" "))
    return rewrite(t, _IPV4, said, r"[0-9]\.[0-9]")


def abbreviations(t: Column) -> Column:
    """N11"""
    pattern = "(?<![A-Za-z0-9])(?i:" + "|".join(a.replace(".", r"\.") for a in SPOKEN) + ")"
    return rewrite(t, pattern, lambda m: F.element_at(literal_map(SPOKEN), F.lower(m)), r"[A-Za-z]\.")


def _date_words(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws(" ", F.get(_list(MONTHS), m.cast("int") - 1), ordinal_words(integer_words(d)), year_words(y))


_M, _D, _Y = r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12][0-9]|0?[1-9])", r"(?:1[0-9]{3}|20[0-9]{2})"


def dates(t: Column) -> Column:
    """ISO, month/day/year, month-day-year, and month names; a boundary is needed on the left."""
    some = r"[0-9][-/][0-9]"

    def of_digits(t: Column) -> Column:
        t = rewrite(t, rf"(?<![0-9/-]){_Y}-(?:1[0-2]|0[1-9])-(?:3[01]|[12][0-9]|0[1-9])(?![0-9/-])", lambda s: _date_words(F.substring(s, 1, 4), F.substring(s, 6, 2), F.substring(s, 9, 2)), some)
        for sep in "/-":
            p = rf"({_M}){sep}({_D}){sep}({_Y})"
            t = rewrite(t, rf"(?<![0-9/-]){p}(?![0-9/-])", _numeric_date(p), some)
        return t

    t = where_found(t, some, of_digits)
    names = "|".join(MONTHS)
    p = rf"((?i:{names}))\s+({_D})(?:st|nd|rd|th)?(?:(,?\s+)({_Y}))?(?![0-9A-Za-z/:-])"

    def named(s: Column) -> Column:
        year = _group(s, p, 4)
        return F.concat(_group(s, p, 1), F.lit(" "), ordinal_words(integer_words(_group(s, p, 2))), F.when(year != "", F.concat(F.lit(" "), year_words(year))).otherwise(""))

    # most texts have no digit after a last letter of a month, for which there is no need to try all names at every place
    ends = "".join(sorted({m[-1] for m in MONTHS}))
    return where_found(t, rf"(?i:[{ends}])\s+[0-9]", lambda x: rewrite(x, rf"(?<![A-Za-z0-9]){p}", named, rf"(?i:{names})\s+[0-9]"))


def _numeric_date(p: str) -> Callable[[Column], Column]:
    return lambda s: _date_words(_group(s, p, 3), _group(s, p, 1), _group(s, p, 2))


#: Operators with their words, and what must stand around them. Between are operands; blanks on either side do not matter.
_LEFT, _RIGHT = r"(?<=[A-Za-z0-9)\]}}]\s?){}", r"(?=\s?[A-Za-z0-9)\]}}])"
MATH_BETWEEN = {"<=": "less than or equal to", ">=": "greater than or equal to", "+": "plus", "=": "equals", "^": "to the power of", "<": "less than", ">": "greater than"}
MATH_ANYWHERE = {"=>": "arrow", "==": "equals equals", ":=": "gets"}
MATH_DIGITS = {"-": "minus", "*": "times", "/": "divided by", "%": "percent"}
_SIGNS = "[≤≥≠×÷±<>+=:*/^%-]"
#: A place that holds no sign is left at once, before any of the alternatives looks around it.
_MATH = f"(?={_SIGNS})(?:" + "|".join([
    *MATH_ALWAYS, *MATH_ANYWHERE,
    *[_LEFT.format(op) + _RIGHT.format() for op in ("<=", ">=", r"\+", "=(?![=>])", r"\^", "<(?!=)", ">(?!=)")],
    r"(?<=[0-9]\s?)[-*](?=\s?[0-9])", r"(?<![^\s(\[{=,:])-(?=[A-Za-z0-9])",
    r"(?<=[0-9]\s)/(?=\s?[0-9])", r"(?<=[0-9])/(?=\s[0-9])", r"(?<=[0-9]{2})/(?=[0-9])", r"(?<=[0-9])/(?=[0-9]{2})", r"(?<=(?<![A-Za-z0-9/])[0-9])/(?=[0-9](?![A-Za-z0-9/]))",
    r"(?<=[0-9]\s?)%",
]) + ")"


def math_symbols(t: Column) -> Column:
    """Signs always spoken, others between operands, a minus before a word or number too; blanks collapse only if something changed."""
    spoken = literal_map(MATH_ALWAYS | MATH_BETWEEN | MATH_ANYWHERE | MATH_DIGITS)

    def one(x: Column) -> Column:
        new = rewrite(x, _MATH, lambda m: F.concat(F.lit(" "), F.element_at(spoken, m), F.lit(" ")), _SIGNS)
        return bind(new, lambda y: F.when(y == x, t).otherwise(F.trim(F.regexp_replace(y, r"\s+", " "))))

    # most texts have single spaces only, which need not be put in place of themselves
    spaced = lambda x: F.when(x.contains("  ") | x.rlike(r"[\t\n\x0B\f\r]"), F.regexp_replace(x, r"\s+", " ")).otherwise(x)
    return where_found(t, _SIGNS, lambda x: bind(spaced(x), one))


_NUM = r"[0-9]+(?:,[0-9]{3})*"


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(integer_words(n), F.lit(" "), F.when(F.regexp_replace(n, "^0+", "") == "1", one).otherwise(many))


def money_time(t: Column) -> Column:
    """Amounts of money, cents, identifiers after $, and clock times."""

    def amount(m: Column) -> Column:
        n, cents = F.replace(_group(m, rf"({_NUM})", 1), F.lit(","), F.lit("")), F.rpad(_group(m, r"\.([0-9]{1,2})", 1), 2, "0")
        sign = F.substring(m, 1, 1)
        one, many = (F.element_at(literal_map({k: v[i] for k, v in MONEY.items()}), sign) for i in (0, 1))
        whole = F.concat(integer_words(n), F.lit(" "), F.when(F.regexp_replace(n, "^0+", "") == "1", one).otherwise(many))
        return F.concat(whole, F.when(_group(m, r"\.([0-9]{1,2})", 1).rlike("[1-9]"), F.concat(F.lit(" "), _counted(cents, "cent", "cents"))).otherwise(""))

    def signed(t: Column) -> Column:
        t = rewrite(t, rf"[$€£¥]{_NUM}(?:\.[0-9]{{1,2}}(?![0-9]))?", amount, "[$€£¥][0-9]")
        t = F.regexp_replace(t, r"\$(?<=(?<![A-Za-z0-9])\$)(?=[A-Za-z])", " dollar ")
        return rewrite(t, rf"(?<![A-Za-z0-9:/]){_NUM}¢", lambda m: _counted(F.regexp_replace(m, "[,¢]", ""), "cent", "cents"), "¢")

    t = where_found(t, "[$€£¥¢]", signed)

    def clock(m: Column) -> Column:
        h, mm = _group(m, "^([0-9]+):", 1), _group(m, ":([0-9]{2})$", 1)
        minutes = F.when(mm == "00", "").when(mm.startswith("0"), F.concat(F.lit(" oh "), integer_words(mm))).otherwise(F.concat(F.lit(" "), integer_words(mm)))
        return F.concat(integer_words(h), minutes)

    return rewrite(t, r"(?<![A-Za-z0-9:/.])[0-9]{1,2}:[0-9]{2}(?![0-9A-Za-z:])", clock, "[0-9]:[0-9]")


def units(t: Column) -> Column:
    """A number and a unit, the longest that fits; years and decades are left alone."""
    names = sorted(UNIT_WORDS, key=len, reverse=True)
    p = rf"(-?{_NUM}(?:\.[0-9]+)?)(\s*)((?i:{'|'.join(names)}))"

    def said(m: Column) -> Column:
        n, u = _group(m, p, 1), F.lower(_group(m, p, 3))
        one, many = (F.element_at(literal_map({k: v[i] for k, v in UNIT_WORDS.items()}), u) for i in (0, 1))
        year = (_group(m, p, 2) == "") & (F.length(u) == 1) & n.rlike("^(?:1[0-9]{3}|20[0-9]{2})$")
        return F.when(year, m).otherwise(F.concat(numbers(n), F.lit(" "), F.when(n.rlike(r"^-?0*1$"), one).otherwise(many)))

    return rewrite(t, rf"(?=[0-9-])(?<![A-Za-z0-9.,:/]){p}(?![A-Za-z0-9/])", said, rf"[0-9]\s*(?i:{'|'.join(names)})")


def digit_letter_gap(t: Column) -> Column:
    """N16"""
    after = lambda x: F.regexp_replace(x, r"(?<=[0-9])(?=[A-Za-z])(?!(?i:st|nd|rd|th)(?![A-Za-z]))", " ")
    before = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?<=[A-Za-z])(?=[0-9])", " "), r"(?<=[A-Za-z]:)(?=[0-9])", " ")
    return where_found(t, "[0-9][A-Za-z]|[A-Za-z]:?[0-9]", lambda x: before(after(x)))


def emphasis_words(t: Column) -> Column:
    """Two-letter function words beside an all-caps word of three letters or more."""
    w = "|".join(x.upper() for x in EMPHASIS)
    return rewrite(t, rf"(?<![A-Za-z])(?:{w})(?=[^A-Za-z]+[A-Z]{{3,}}(?![A-Za-z]))|(?<=(?<![A-Za-z])[A-Z]{{3,40}}[^A-Za-z]{{1,20}})(?:{w})(?![A-Za-z])", F.lower, "[A-Z]{3}")


def acronyms(t: Column, is_word: IsWord | None = None) -> Column:
    """All-caps words are spelled unless possessive, said as words, or real words."""

    def said(m: Column) -> Column:
        spelled = F.rtrim(F.regexp_replace(m, "(.)", "$1 "))
        keep = m.isin(SAY_AS_WORD) | m.rlike("'[sS]$")
        return F.when(keep, m).otherwise(spelled if is_word is None else F.when(is_word(F.lower(m)), m).otherwise(spelled))

    return rewrite(t, r"(?<![A-Za-z0-9])[A-Z]{2,}(?:'[sS])?(?![A-Za-z])", said, "[A-Z]{2}")


def numbers(t: Column) -> Column:
    """Decades, years, ordinals, decimals and cardinals, with signs and commas."""
    p = rf"([+-]?)({_NUM}|[0-9]+)(?:\.([0-9]+))?((?i:st|nd|rd|th|['’]?s)(?![A-Za-z]))?"

    def parts(m: Column) -> Column:
        return F.struct(*[_group(m, p, i).alias(k) for i, k in ((1, "sign"), (2, "raw"), (3, "frac"), (4, "tail"))], m.alias("m"))

    def words(x: Column) -> Column:
        year = x["raw"].rlike("^(?:1[0-9]{3}|20[0-9]{2})$") & (x["sign"] == "")
        cardinal = F.concat(F.when(x["sign"] == "-", "minus ").otherwise(""), integer_words(F.replace(x["raw"], F.lit(","), F.lit(""))))
        return F.struct(x.alias("x"), cardinal.alias("c"), F.when(year & (x["frac"] == ""), year_words(x["raw"])).alias("y"))

    def plain(m: Column) -> Column:
        return F.when(m.rlike("^(?:1[0-9]{3}|20[0-9]{2})$"), year_words(m)).otherwise(integer_words(m))

    def said(w: Column) -> Column:
        x, tail = w["x"], F.lower(w["x"]["tail"])
        number = F.when(x["frac"] != "", F.concat(w["c"], F.lit(" point "), digit_words(x["frac"]))).when(tail != "", ordinal_words(w["c"])).otherwise(F.coalesce(w["y"], w["c"]))
        return F.when(tail.endswith("s"), F.coalesce(plural_year(w["y"]), x["m"])).otherwise(number)

    return rewrite(t, rf"(?=[0-9+-])(?<![A-Za-z0-9:/.]){p}(?![A-Za-z0-9:/%$°]|\.[0-9])", lambda m: F.when(m.rlike("^[0-9]+$"), plain(m)).otherwise(bind(bind(parts(m), words), said)), "[0-9]")


RULES: dict[str, Callable[[Column], Column]] = {
    "n02_dashes": fold_dashes, "n03_greek": greek_letters, "n04_super_sub": super_sub_digits, "n05_cards": playing_cards, "n06_feet_inches": feet_inches, "n07_hex": hex_literals, "n08_roman": roman_numerals,
    "n09_diacritics": fold_diacritics, "n10_urls": urls, "n11_abbreviations": abbreviations, "n12_dates": dates, "n13_math": math_symbols, "n14_money_time": money_time, "n15_units": units,
    "n16_digit_letter_gap": digit_letter_gap, "n17_emphasis": emphasis_words, "n18_acronyms": acronyms, "n19_numbers": numbers,
}


#: Rules that change no text of ASCII and letters without square brackets, nor bring such characters in.
ODD = {"n02_dashes", "n03_greek", "n04_super_sub", "n05_cards"}

#: Rules that change no text without a digit or $. None of the rules between them brings a digit in, so one look serves them all.
NUMERIC = {"n06_feet_inches", "n07_hex", "n12_dates", "n14_money_time", "n15_units", "n16_digit_letter_gap", "n19_numbers"}


#: What a text must hold for any rule but N9 to change it: a character beyond letters, blanks and common marks, an abbreviation, or the dot
#: of a host; or letters only, capitals side by side or small ones that may be a numeral.
_SIGN, _LETTERS = r"[^A-Za-zÀ-ÖØ-öø-ɏ\s.,!?;'\"()]", r"[A-Z]{2}|(?<![A-Za-z0-9])[ivxlcdm]{2,}(?![A-Za-z0-9])"
_DOTTED = "|".join(a[:-1].replace(".", "[.]") for a in SPOKEN)
_TOUCHED = rf"{_SIGN}|{_LETTERS}|\.(?i:{'|'.join(TLDS)})|\.(?<=(?<![A-Za-z0-9])(?i:www|{_DOTTED})\.)"
#: The same without looking around, for the matcher of Arrow, which takes one look at each character: all but letters; letters.
_BEFORE, _AFTER = "(?:^|[^A-Za-z0-9])", "(?:$|[^A-Za-z0-9])"
_SIGN_SEEN = rf"{_SIGN}|\.(?i:{'|'.join(TLDS)})|{_BEFORE}(?i:www|{_DOTTED})\.".replace(r"\s", r"\t\n\x0b\f\r ")
_LETTERS_SEEN = f"[A-Z]{{2}}|{_BEFORE}[ivxlcdm]{{2,}}{_AFTER}"
#: Rules that may change a text of letters, blanks and common marks without abbreviations and hosts. None of them brings in anything else.
OF_LETTERS = ("n08_roman", "n09_diacritics", "n17_emphasis", "n18_acronyms")


def touched(t: Column) -> Column:
    """Whether a rule other than N9 may change t, as it is or after N9."""
    return bind(t, lambda x: x.rlike(_TOUCHED) | F.when(x.rlike(LATIN), fold_diacritics(x).rlike(_TOUCHED)).otherwise(False))


def sifted(rows: DataFrame, column: str) -> DataFrame:
    """rows with __rules: which rules may change the text: 0 none but N9, which is done with, 1 those OF_LETTERS, 2 any."""
    at, folded = rows.columns.index(column), str.maketrans(_folding())

    def rules(texts: pa.Array) -> pa.Array:
        return pc.fill_null(pc.if_else(pc.match_substring_regex(texts, _SIGN_SEEN), 2, pc.if_else(pc.match_substring_regex(texts, _LETTERS_SEEN), 1, 0)), 0)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found = rules(texts)
            latin = pc.fill_null(pc.and_(pc.match_substring_regex(texts, LATIN), pc.less(found, 2)), False)
            if pc.any(latin).as_py():
                plain = pa.array([t.translate(folded) for t in pc.filter(texts, latin).to_pylist()], texts.type)
                after = pc.max_element_wise(rules(plain), pc.filter(found, latin))
                texts = pc.replace_with_mask(texts, latin, pc.if_else(pc.equal(after, 0), plain, pc.filter(texts, latin)))
                found = pc.replace_with_mask(found, latin, after)
            columns = [*batch.columns[:at], texts, *batch.columns[at + 1 :], found.cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "__rules"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(sift, f"{kind}, __rules int")


def normalize_corpus(sentences: DataFrame, column: str = "text", rewrites: list[tuple[str, str]] = (), is_word: IsWord | None = None, is_emphatic: IsWord | None = None, rules: Iterable[str] = tuple(RULES)) -> DataFrame:
    """The whole cascade on one column, each rule in a projection of its own. is_emphatic tells all-caps words that are real words (default:
    is_word). rules: those that may change the texts, in order."""
    text = F.col(column)
    out = sentences.withColumn(column, where_found(apply_rewrites(text, list(rewrites)), "\u0001", lambda t: F.translate(t, "\u0001", "")))
    for name in rules:
        if name in ODD and "__odd" not in out.columns:
            out = out.withColumn("__odd", text.rlike(r"[\[\]\x80-¿ɐ-\x{10FFFF}]"))
        if name in NUMERIC and "__digits" not in out.columns:
            out = out.withColumn("__digits", text.rlike("[0-9$]"))
        extra = {"is_word": is_word} if name in ("n08_roman", "n10_urls") else {"is_word": is_emphatic or is_word} if name == "n18_acronyms" else {}
        said = RULES[name](text, **extra)
        on = "__odd" if name in ODD else "__digits" if name in NUMERIC else None
        out = out.withColumn(column, F.when(F.col(on), said).otherwise(text) if on else said)
    return out.drop("__odd", "__digits")


def normalize_with_lexicon(rows: DataFrame, keys: list[str], column: str, gold: DataFrame, phones: DataFrame, rewrites: list[tuple[str, str]] = ()) -> DataFrame:
    """N20 with the words of two lexicons as its dictionary. keys name a row. Words that N8, N10 or N18 may ask for are joined
    with the lexicons and come back as an array in the row; all-caps words are real from 3 letters in gold, 6 in the other."""
    if rewrites:
        rows = rows.withColumn(column, apply_rewrites(F.col(column), list(rewrites)))
    # written once, as they are read three times; rows that only N9 may change neither meet the lexicons nor go through the cascade
    names = rows.columns
    rows = stored(sifted(rows, column), "rows")
    plain = rows.where("__rules = 0").drop("__rules")
    rows = rows.where("__rules > 0")
    text = F.when(F.col(column).rlike(LATIN), F.concat_ws(" ", F.col(column), fold_diacritics(F.col(column)))).otherwise(F.coalesce(column, F.lit("")))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    asked = F.when(F.col(column).rlike(r"/|www\.|\.[A-Za-z]"), found("[A-Za-z]{2,}")).otherwise(found("(?<![A-Za-z])(?:[A-Z]{2,}|[ivxlcdm]{2,})(?![A-Za-z])"))
    words = rows.select(*keys, F.explode(F.array_distinct(F.transform(asked, F.lower))).alias("w"))
    known = gold.select(F.lower("word").alias("w"), F.lit(True).alias("g")).unionByName(phones.select(F.lower("word").alias("w"), F.lit(False).alias("g"))).groupBy("w").agg(F.max("g").alias("g"))
    real = (F.col("g") & (F.length("w") >= 3)) | (F.length("w") >= 6)
    held = stored(words.join(known, "w").groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.collect_set("w").alias("__known"), F.collect_set(F.when(real, F.col("w"))).alias("__emphatic")), "asked")
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = one if same is None else same & one
    has = lambda name: lambda w: F.coalesce(F.array_contains(name, w), F.lit(False))
    for k, some in ((1, OF_LETTERS), (2, RULES)):
        plain = plain.unionByName(normalize_corpus(rows.where(f"__rules = {k}").join(held, same, "left"), column, (), has("__known"), has("__emphatic"), some).select(names))
    return plain


CENSUS = {"digits": "[0-9]+", "money": r"[$€£¥][0-9]", "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "caps": "[A-Z][A-Z]+", "accents": r"[À-ɏ]", "email_at": "@", "url": r"https?://|www\.", "percent": "%"}


def nsw_census(docs: DataFrame, *groups: str) -> DataFrame:
    """How often each class of non-standard word occurs, by group."""
    return docs.groupBy(*groups).agg(*[F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)).cast("long").alias(f"n_{k}") for k, p in CENSUS.items()])


def nsw_rollup(docs: DataFrame, *groups: str) -> DataFrame:
    """N21 with subtotals: level is 0 for whole groups and has a bit for each group summed over, the last group's first."""
    counts = [F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)).cast("long").alias(f"n_{k}") for k, p in CENSUS.items()]
    return docs.rollup(*groups).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("docs"), *counts)


def verbalize_columns(df: DataFrame, cardinals: list[str] = (), dates_: list[str] = ()) -> DataFrame:
    """Numbers and dates of typed columns as text, in new columns named <column>_words; no regular expression on text."""
    out = df
    for c in cardinals:
        v = F.col(c).cast("decimal(38,0)")
        out = out.withColumn(f"{c}_words", F.concat(F.when(v < 0, "minus ").otherwise(""), integer_words(F.abs(v).cast("string"))))
    for c in dates_:
        out = out.withColumn(f"{c}_words", F.concat_ws(" ", F.get(_list(MONTHS), F.month(c) - 1), ordinal_words(integer_words(F.dayofmonth(c).cast("string"))), year_words(F.year(c).cast("string"))))
    return out
