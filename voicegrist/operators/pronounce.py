"""Pronunciation. Lexicons are tables: gold (word, ipa) and phones (word, phones); lookups are equi joins on distinct word types.

Tiers are functions from words to answers, each asked for what the ones before it left. A word's possible keys (itself, its
base without an ending, its spelling without a hyphen, ...) are candidates with a priority: all tiers that need the lexicons
meet them in one join, and the first that is found wins. Words said by their parts are put together from the answers to
the parts, which are resolved as words of their own in further rounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import SAY_AS_WORD, normalize_with_lexicon
from ..functions.text import bind, literal_map
from ..sources.shared import stored
from .lookup import said_by_table
from .tokens import MARKS, OPENING, tokens_of, word_totals, words_of

# Phone symbols (a vowel takes a stress mark), letter names, affixes, initialisms.
VOWELS = {"AA": "ɑ", "AE": "æ", "AO": "ɔ", "AW": "W", "AY": "I", "EH": "ɛ", "EY": "A", "IH": "ɪ", "IY": "i", "OW": "O", "OY": "Y", "UH": "ʊ", "UW": "u"}
CONSONANTS = {"B": "b", "CH": "ʧ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h", "JH": "ʤ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ", "SIL": "", "T": "t", "TH": "θ", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ"}
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "eɪ bi si di i ɛf dʒi eɪʧ aɪ dʒeɪ keɪ ɛl ɛm ɛn oʊ pi kju ɑɹ ɛs ti ju vi dʌbəlju ɛks waɪ zi".split(), strict=True))
PREFIXES = "anti astro auto bi bio co cyber de dis eco electro en ex extra geo hydro hyper inter intra macro mega micro mid mini mis mono multi nano neo neuro non ortho over photo poly post pre pro proto pseudo psycho quasi re retro self semi socio sub super tele thermo trans ultra un under uni".split()
TAILS = "name group work set house board list mark point line case type side way time back down out off field space".split()
INFLECTIONS = {"ings": "ɪŋz", "ing": "ɪŋ", "ness": "nəs", "ers": "əɹz", "er": "əɹ", "ly": "li", "ies": "iz"}
INITIALISMS = "ieee html css sql vhdl json xml yaml http https ftp ssh url ui ux api ci cd sdk ide ocr asr tts gui cpu gpu ram rom ssd hdd usb ai ml nlp ar vr iot".split()
SPELLINGS = {"JSON": "ˈdʒeɪsən", "FAQ": "fæk"}

# Letter-to-sound. A star marks a vowel.
LTS_PREFIX = {"under": "*ʌ n d ɹ", "inter": "*ɪ n t ɹ", "over": "*oʊ v *ɚ", "trans": "t ɹ *æ n s", "pre": "p ɹ *i", "re": "ɹ *i", "dis": "d *ɪ s", "mis": "m *ɪ s", "non": "n *ɑ n", "un": "*ʌ n"}
LTS_SUFFIX = {
    "isation": "*aɪ z *eɪ ʃ *ən", "ising": "*aɪ z *ɪ ŋ", "ised": "*aɪ z d", "ise": "*aɪ z", "ities": "*ɪ t *i z", "ity": "*ɪ t *i", "ization": "*ə z *eɪ ʃ *ən", "ation": "*eɪ ʃ *ən", "tion": "ʃ *ən", "sion": "ʒ *ən", "cian": "ʃ *ən",
    "ing": "*ɪ ŋ", "ed": "*ɪ d", "ly": "l *i", "er": "*əɹ", "ous": "*ə s", "able": "*ə b *əl", "ible": "*ɪ b *əl", "ment": "m *ə n t", "ness": "n *ə s", "less": "l *ə s", "ful": "f *ə l", "ship": "ʃ *ɪ p", "hood": "h *ʊ d", "ist": "*ɪ s t", "ism": "*ɪ z *əm",
}
GRAPHEMES = {
    "tch": "ʧ", "dge": "ʤ", "eigh": "*eɪ", "igh": "*aɪ", "sch": "s k", "qu": "k w", "tion": "ʃ *ən", "sion": "ʒ *ən", "ph": "f", "ch": "ʧ", "sh": "ʃ", "th": "θ", "wh": "w", "ng": "ŋ", "ck": "k", "ee": "*i", "ea": "*i", "ar": "*ɑɹ", "or": "*ɔɹ", "ir": "*ɪɹ", "ur": "*ɜɹ",
    "ai": "*eɪ", "ay": "*eɪ", "oa": "*oʊ", "oe": "*oʊ", "oi": "*ɔɪ", "oy": "*ɔɪ", "ow": "*oʊ", "ou": "*aʊ", "oo": "*u", "ue": "*ju", "ew": "*ju", "ie": "*aɪ", "gn": "n", "kn": "n", "wr": "ɹ", "gh": "",
    "a": "*æ", "e": "*ɛ", "i": "*ɪ", "o": "*ɑ", "u": "*ʌ", "y": "*ɪ", "b": "b", "c": "k", "d": "d", "f": "f", "g": "ɡ", "h": "h", "j": "ʤ", "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "q": "k", "r": "ɹ", "s": "s", "t": "t", "v": "v", "w": "w", "x": "k s", "z": "z",
}
#: Letters marked by their place: long vowels before a silent e, soft c and g.
MARKED = {"A": "*eɪ", "E": "*i", "I": "*aɪ", "O": "*oʊ", "U": "*ju", "Y": "*aɪ", "C": "s", "G": "ʤ"}


def phones_to_ipa(phones: Column) -> Column:
    """A stress digit becomes a mark before the vowel; AH and ER change with stress; an unknown symbol is an error."""
    plain = {k: v for k, v in CONSONANTS.items()} | {"AH": "ə", "ER": "əɹ", "AH0": "ə", "ER0": "əɹ", "AH1": "ˈʌ", "AH2": "ˌʌ", "ER1": "ˈɜɹ", "ER2": "ˌɜɹ"}
    plain |= {k + d: m + v for k, v in VOWELS.items() for d, m in (("", ""), ("0", ""), ("1", "ˈ"), ("2", "ˌ"))}
    table = literal_map(plain)
    return F.array_join(F.transform(phones, lambda p: F.coalesce(F.element_at(table, p), F.raise_error(F.concat(F.lit("unsupported phone "), p)).cast("string"))), "")


def allomorph(ipa: Column) -> Column:
    """The sound of a plural or possessive after ipa."""
    end = F.regexp_replace(ipa, r"[ˈˌː\s]+$", "")
    return F.when(end.rlike("(?:tʃ|dʒ|[szʃʒʧʤ])$"), "ɪz").when(end.rlike("[ptkfθ]$"), "s").otherwise("z")


def letter_names(word: Column) -> Column:
    """X3"""
    return F.array_join(F.filter(F.transform(F.split(F.lower(word), ""), lambda c: F.element_at(literal_map(LETTERS), c)), lambda x: x.isNotNull()), " ")


def _core(word: Column) -> Column:
    """Phones of the body of a word, by graphemes in order of preference."""
    w = word
    for v in "aeiouy":
        few = "{0,2}" if v in "ay" else "{1,2}"
        w = F.regexp_replace(w, f"{v}(?=[^aeiouy]{few}e$)", v.upper())
    w = F.regexp_replace(w, "c(?=[eiyEIY])", "C")
    w = F.regexp_replace(w, "(?<![dn])g(?=[eiyEIY])|(?<=d)g(?=[iyIY])", "G")
    pattern = "^ku|" + "|".join(g if len(g) == 1 else f"(?i:{g})" for g in GRAPHEMES) + "|[A-Z]"
    table = literal_map(GRAPHEMES | MARKED | {"ku": "k *ju"})

    def sounds(gs: Column) -> Column:
        last = F.size(gs) - 1
        one = lambda g, i: F.when((g == "e") & (i == last), "").when((g == "y") & (i == 0), "j").when((g == "y") & (i == last), "*aɪ").otherwise(F.element_at(table, F.when(F.length(g) > 1, F.lower(g)).otherwise(g)))
        return F.array_join(F.filter(F.transform(gs, one), lambda x: x != ""), " ")

    return bind(F.regexp_extract_all(w, F.lit(pattern), F.lit(0)), sounds)


def letter_to_sound(word: Column) -> Column:
    """A prefix or else a suffix is said by rule, the rest by graphemes; the first of up to two vowels is stressed, else the last but one."""

    def whole(w: Column) -> Column:
        prefix = F.regexp_extract(w, f"^({'|'.join(LTS_PREFIX)})(?=.{{3}})", 1)
        suffix = F.coalesce(*[F.when(w.endswith(s) & (F.length(w) >= len(s) + 2), F.lit(s)) for s in LTS_SUFFIX], F.lit(""))
        return bind(F.struct(w.alias("w"), prefix.alias("p"), F.when(prefix == "", suffix).otherwise("").alias("s")), said)

    def said(x: Column) -> Column:
        body = F.substring(x["w"], F.length(x["p"]) + 1, F.length(x["w"]) - F.length(x["p"]) - F.length(x["s"]))
        phones = F.concat_ws(" ", F.element_at(literal_map(LTS_PREFIX), x["p"]), _core(body), F.element_at(literal_map(LTS_SUFFIX), x["s"]))
        return bind(F.filter(F.split(phones, " "), lambda p: p != ""), stressed)

    def stressed(ps: Column) -> Column:
        nuclei = F.filter(F.transform(ps, lambda p, i: F.when(p.startswith("*"), i)), lambda i: i.isNotNull())
        at = bind(nuclei, lambda n: F.when(F.size(n) <= 2, F.get(n, F.lit(0))).otherwise(F.get(n, F.size(n) - 2)))
        # bound, for inside the list it would be worked out anew for every phone
        marked = bind(at, lambda a: F.transform(ps, lambda p, i: F.when(i == a, F.concat(F.lit("ˈ"), p)).otherwise(p)))
        return F.replace(F.array_join(marked, ""), F.lit("*"), F.lit(""))

    said_word = bind(F.regexp_replace(F.lower(word), "[^a-z]", ""), whole)
    return bind(said_word, lambda said: F.when(F.coalesce(said, F.lit("")) == "", letter_names(word)).otherwise(said))


def lexicon(gold: DataFrame, phones: DataFrame) -> DataFrame:
    """(key, ipa, is_gold): one row per word, gold first. A lower-case key serves where the exact one is missing."""
    both = gold.select(F.col("word").alias("key"), "ipa", F.lit(True).alias("is_gold")).unionByName(phones.select(F.lower("word").alias("key"), phones_to_ipa(F.col("phones")).alias("ipa"), F.lit(False).alias("is_gold")))
    return both.groupBy("key").agg(F.max_by(F.struct("ipa", "is_gold"), F.struct("is_gold", "ipa")).alias("v")).select("key", "v.ipa", "v.is_gold")


#: First priority of compounds; the order of PREFIXES and TAILS follows.
AFFIXED = 100


def _candidate(on: Column, prio: Column, tier: str, key: Column, gold_only: bool, affix: Column, before: bool, add: str | Column) -> Column:
    add = F.lit(add) if isinstance(add, str) else add
    return F.when(on, F.struct(prio.alias("prio"), F.lit(tier).alias("tier"), key.alias("key"), F.lit(gold_only).alias("gold_only"), affix.alias("affix"), F.lit(before).alias("before"), add.alias("add")))


def _affixed(low: Column, on: Column, order: dict[str, int], before: bool) -> Column:
    """Candidates with an affix of order (affix -> place) cut off: one lookup for each length an affix has, not one for each affix."""
    lengths = sorted(set(map(len, order)))
    table = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])

    def one(k: Column) -> Column:
        affix = F.substring(low, F.lit(1), k) if before else F.substring(low, F.length(low) - k + 1, k)
        key = F.substring(low, k + 1, F.length(low)) if before else F.substring(low, F.lit(1), F.length(low) - k)
        return _candidate(on & (F.length(low) > k + 2) & F.element_at(table, affix).isNotNull(), F.element_at(table, affix) + AFFIXED, "compound", key, False, affix, before, "")

    return F.transform(F.array(*[F.lit(k) for k in lengths]), one)


#: The possessive of any word; of an all-caps one, which keeps its own rule; an all-caps word with or without that end.
POSSESSIVE, CAPS = "[^']'[sS]$", "^[A-Z]{2,}(?:'[sS])?$"


def candidates(word: Column) -> Column:
    """Array of struct(prio, tier, key, gold_only, affix, before, add): keys under which a word may be found, in order. Possessives and
    hyphenated words that the lexicons lack are left to their parts, before any of the later tiers."""
    low = F.lower(word)
    caps, owner = word.rlike(CAPS), word.rlike(POSSESSIVE)
    n = iter(range(AFFIXED))

    def c(tier: str, on: Column, key: Column, gold_only: bool = False, add: str | Column = "", prio: int | None = None) -> Column:
        return _candidate(on, F.lit(next(n) if prio is None else prio), tier, key, gold_only, F.lit(""), False, add)

    cut = lambda k: F.substring(low, 1, F.length(low) - k)
    small = ~caps
    whole = small & ~owner & ~word.contains("-")
    base = F.regexp_replace(word, "'[sS]$", "")
    said, size = base.isin(*[w for w in SAY_AS_WORD if w not in SPELLINGS]), F.length(base)
    z, allo = F.when(owner, "z").otherwise(""), F.when(owner, "allo").otherwise("")
    out = [c("acronym_word", caps & said, base, add=z), c("acronym_word", caps & said, F.lower(base), add=z)]
    emphasis = caps & ~base.isin(*SAY_AS_WORD)
    out += [c("emphasis", emphasis & (size >= 3), F.lower(base), True, allo), c("emphasis", emphasis & (size >= 6), F.lower(base), add=allo)]
    out += [c("gold", small, word, gold_only=True), c("gold", small, low, gold_only=True)]
    out += [c("plural", small & low.rlike(".ies$"), F.concat(cut(3), F.lit("y")), True, add="allo"), c("plural", small & low.rlike(".s$"), cut(1), True, add="allo"), c("plural", small & low.rlike(".es$"), cut(2), True, add="allo")]
    out += [c("phones", small, low), c("hyphenated", small & ~owner & word.contains("-"), F.replace(low, F.lit("-"), F.lit("")))]
    ae, oe = F.replace(low, F.lit("ae"), F.lit("e")), F.replace(low, F.lit("oe"), F.lit("e"))
    out += [c("british", whole & low.contains("ae"), ae), c("british", whole & low.contains("oe"), oe), c("british", whole & low.contains("ae") & low.contains("oe"), F.replace(ae, F.lit("oe"), F.lit("e")))]
    out += [c("inflection", whole & low.endswith(s) & (F.length(low) >= len(s) + 3), cut(len(s)), add=ipa, prio=AFFIXED + 1000 + i) for i, (s, ipa) in enumerate(INFLECTIONS.items())]
    compounds = [_affixed(low, whole, {p: i for i, p in enumerate(PREFIXES)}, True), _affixed(low, whole, {t: len(PREFIXES) + i for i, t in enumerate(TAILS)}, False)]
    return F.array_compact(F.concat(F.array(*out), *compounds))


def _said_affixes(lex: DataFrame) -> DataFrame:
    """(affix, said) of the fixed affixes, at most 77: as the lexicon has them, else by rule."""
    every = lex.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(PREFIXES + TAILS)], "affix string")
    return stored(every.join(lex.select(F.col("key").alias("affix"), "ipa"), "affix", "left").select("affix", F.coalesce("ipa", letter_to_sound(F.col("affix"))).alias("said")), "affixes")


def _found(types: DataFrame, lex: DataFrame, affixes: DataFrame) -> DataFrame:
    """(word, ipa, tier) of the types that some candidate answers: one join of all candidates, then one of the affixes."""
    c = types.select("word", F.explode(candidates(F.col("word"))).alias("c")).select("word", "c.*")
    hit = c.join(lex, "key").where(F.col("is_gold") | ~F.col("gold_only"))
    best = hit.groupBy("word").agg(F.min_by(F.struct("ipa", "tier", "affix", "before", "add"), "prio").alias("b")).select("word", "b.*")
    body = best.join(F.broadcast(affixes), "affix", "left")
    ipa = F.when(F.col("affix") == "", F.col("ipa")).when(F.col("before"), F.concat("said", "ipa")).otherwise(F.concat("ipa", "said"))
    return body.select("word", F.concat(ipa, F.when(F.col("add") == "allo", allomorph(F.col("ipa"))).otherwise(F.col("add"))).alias("ipa"), "tier")


def _fallback(word: Column) -> tuple[Column, Column]:
    """(ipa, tier) without a lexicon: letter names or letter-to-sound."""
    low = F.lower(word)
    base = F.regexp_replace(word, "'[sS]$", "")
    acronym = base.rlike("^[A-Z]{2,}$")
    spelled = low.rlike("^[a-z]{2,5}$") & (low.isin(INITIALISMS) | ~low.rlike("[aeiouy]"))
    fixed = F.element_at(literal_map(SPELLINGS), base)
    z = F.when(word != base, "z").otherwise("")
    ipa = F.when(acronym, F.concat(F.coalesce(fixed, letter_names(base)), z)).when(spelled, letter_names(word)).otherwise(F.concat(letter_to_sound(base), z))
    return ipa, F.when(acronym, "acronym").when(spelled, "letters").otherwise("lts")


#: A tier: from words (word) the ones it knows (word, ipa), with a column tier where it has several kinds of answers.
Tier = Callable[[DataFrame], DataFrame]

#: Rounds in which parts of words become words of their own.
ROUNDS = 3


def override_tier(overrides: DataFrame) -> Tier:
    """The user's own (word, ipa), whatever the case."""
    own = overrides.select(F.lower("word").alias("k"), "ipa").dropDuplicates(["k"])
    return lambda types: types.join(own, F.lower("word") == F.col("k")).select("word", "ipa")


def lexicon_tier(gold: DataFrame, phones: DataFrame) -> Tier:
    """All that two lexicons answer, whole, as plural, with other spelling, affix or ending, in one join."""
    lex = stored(lexicon(gold, phones), "lexicon")
    affixes = _said_affixes(lex)
    return lambda types: _found(types, lex, affixes)


def _parts(word: Column) -> Column:
    """Struct(kind, parts) of a word that is said by its parts; null for others: P9 possessives, P10 hyphens, P14 camelCase."""
    base = F.regexp_replace(word, "'[sS]$", "")
    hyphens = F.filter(F.split(word, "-"), lambda p: p != "")
    camel = F.split(F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2"), " ")
    as_struct = lambda kind, parts: F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))
    by = F.when(word.rlike(POSSESSIVE), as_struct("possessive", F.array(base))).when(word.contains("-") & (F.size(hyphens) > 1), as_struct("hyphenated", hyphens)).when(F.size(camel) > 1, as_struct("camel", camel))
    return F.when(~word.rlike(CAPS), by)


def rule_tier(types: DataFrame) -> DataFrame:
    """Letter names or letter-to-sound."""
    ipa, tier = _fallback(F.col("word"))
    return types.select("word", ipa.alias("ipa"), tier.alias("tier"))


def default_tiers(gold: DataFrame, phones: DataFrame, overrides: DataFrame | None = None) -> list[tuple[str, Tier]]:
    """Names and tiers in order of priority. Put tiers of your own among them: each is asked for what all before it left, the
    last one only once, after all rounds."""
    own = [("override", override_tier(overrides))] if overrides is not None else []
    return [*own, ("lexicon", lexicon_tier(gold, phones)), ("rule", rule_tier)]


def answered(types: DataFrame, tiers: list[tuple[str, Tier]]) -> DataFrame:
    """(word, ipa, tier): each tier's answers to the words that no earlier one knows."""
    out = None
    for name, tier in tiers:
        got = tier(types if out is None else types.join(out, "word", "left_anti"))
        got = got.select("word", "ipa", F.coalesce("tier", F.lit(name)).alias("tier") if "tier" in got.columns else F.lit(name).alias("tier"))
        out = stored(got if out is None else out.unionByName(got), "answers")
    return out


def resolve_by_rounds(types: DataFrame, tiers: list[tuple[str, Tier]], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(answers, leftovers): (word, ipa, tier) of all words, and the words whose parts would take more rounds.

    Words that no tier but the last answers are taken apart; the parts that are new go through the tiers in the next round, as words
    of their own. Then the last tier reads the words without parts, and leftovers as one word. Answers are put together from their
    parts, innermost first."""
    *first, (closing, close) = tiers
    frontier = seen = stored(types.select("word").where("word is not null").distinct(), "types")
    known, apart = None, None
    for i in range(rounds + 1):
        got = answered(frontier, first) if first else frontier.limit(0).selectExpr("word", "'' AS ipa", "'' AS tier")
        known = got if known is None else known.unionByName(got)
        cut = frontier.join(got, "word", "left_anti").withColumn("p", _parts(F.col("word"))).select("word", "p.kind", F.posexplode("p.parts").alias("i", "part"))
        if i == rounds:  # their parts that nobody knows would be new words
            leftovers = cut.join(seen.withColumnRenamed("word", "part"), "part", "left_anti").select("word").distinct()
            cut = cut.join(leftovers, "word", "left_anti")
        cut = stored(cut, "parts")
        apart = cut if apart is None else apart.unionByName(cut)
        frontier = cut.select(F.col("part").alias("word")).distinct().join(seen, "word", "left_anti")
        if i == rounds or frontier.isEmpty():
            break
        frontier = stored(frontier, "types")
        seen = seen.unionByName(frontier)
    if i < rounds:
        leftovers = seen.limit(0)
    leftovers = stored(leftovers, "leftovers")
    read = close(seen.join(known, "word", "left_anti").join(apart.select("word").distinct(), "word", "left_anti"))
    read = read.select("word", "ipa", F.coalesce("tier", F.lit(closing)).alias("tier") if "tier" in read.columns else F.lit(closing).alias("tier"))
    marked = read.join(leftovers.withColumn("left", F.lit(True)), "word", "left")
    known = known.unionByName(stored(marked.select("word", "ipa", F.when(F.col("left"), "leftover").otherwise(F.col("tier")).alias("tier")), "read"))
    # parts are shorter than their words, so every pass puts some together
    while not (left := stored(apart.join(known, "word", "left_anti"), "apart")).isEmpty():
        met = left.join(known.select(F.col("word").alias("part"), "ipa"), "part", "left")
        whole = met.groupBy("word").agg(F.first("kind").alias("tier"), F.array_sort(F.collect_list(F.struct("i", "ipa"))).alias("ps"), F.count_if(F.col("ipa").isNull()).alias("missing"))
        ipas = F.transform("ps", lambda p: p["ipa"])
        own = F.element_at(ipas, 1)
        ipa = F.when(F.col("tier") == "possessive", F.concat(own, F.when(own != "", allomorph(own)).otherwise(""))).when(F.col("tier") == "camel", F.array_join(ipas, " ")).otherwise(F.array_join(ipas, ""))
        known = known.unionByName(stored(whole.where("missing = 0").select("word", ipa.alias("ipa"), "tier"), "composed"))
    return known, leftovers


def resolve_words(types: DataFrame, gold: DataFrame, phones: DataFrame, overrides: DataFrame | None = None, tiers: list[tuple[str, Tier]] | None = None) -> DataFrame:
    """(word, ipa, tier) for every distinct word, by ``tiers`` (default_tiers)."""
    answers, _ = resolve_by_rounds(types, tiers or default_tiers(gold, phones, overrides))
    return answers.join(types.select("word").distinct(), "word", "left_semi")


# Homograph senses, as phones where the rule holds and where it does not.
HOMOGRAPHS = {
    "read": ("past", "R EH1 D", "R IY1 D"), "lead": ("noun", "L EH1 D", "L IY1 D"), "live": ("verb", "L IH1 V", "L AY1 V"), "wind": ("verb", "W AY1 N D", "W IH1 N D"), "bow": ("verb", "B AW1", "B OW1"), "tear": ("verb", "T EH1 R", "T IH1 R"),
    "wound": ("verb_past", "W AW1 N D", "W UW1 N D"), "bass": ("music", "B EY1 S", "B AE1 S"), "close": ("verb", "K L OW1 Z", "K L OW1 S"), "present": ("verb_later", "P R IY0 Z EH1 N T", "P R EH1 Z AH0 N T"), "record": ("verb_later", "R IH0 K AO1 R D", "R EH1 K ER0 D"),
    "object": ("verb_later", "AH0 B JH EH1 K T", "AA1 B JH EH0 K T"), "produce": ("noun_adj", "P R OW1 D UW0 S", "P R AH0 D UW1 S"), "content": ("noun_copula", "K AA1 N T EH0 N T", "K AH0 N T EH1 N T"), "address": ("noun_copula", "AE1 D R EH2 S", "AE0 D R EH1 S"), "desert": ("verb", "D IH0 Z ER1 T", "D EH1 Z ER0 T"),
    "contract": ("verb_later", "K AH0 N T R AE1 K T", "K AA1 N T R AE2 K T"), "contest": ("verb_later", "K AH0 N T EH1 S T", "K AA1 N T EH0 S T"), "conduct": ("verb_later", "K AH0 N D AH1 K T", "K AA1 N D AH0 K T"), "conflict": ("verb_later", "K AH0 N F L EH1 K T", "K AA1 N F L IH0 K T"),
    "convert": ("verb_later", "K AH0 N V ER1 T", "K AA1 N V ER0 T"), "digest": ("noun_later", "D AY1 JH EH0 S T", "D AY0 JH EH1 S T"), "insult": ("verb_later", "IH1 N S AH2 L T", "IH2 N S AH1 L T"), "permit": ("verb_later", "P ER1 M IH2 T", "P ER0 M IH1 T"), "project": ("verb_later", "P R AA0 JH EH1 K T", "P R AA1 JH EH0 K T"),
    "progress": ("verb_later", "P R AH0 G R EH1 S", "P R AA1 G R EH2 S"), "refuse": ("noun_later", "R EH1 F Y UW2 Z", "R AH0 F Y UW1 Z"), "subject": ("verb_later", "S AH1 B JH IH0 K T", "S AH0 B JH EH1 K T"), "suspect": ("verb_later", "S AH1 S P EH2 K T", "S AH0 S P EH1 K T"), "invalid": ("noun_copula", "IH1 N V AH0 L AH0 D", "IH1 N V AH0 L IH0 D"),
}
DETERMINERS = "the a an this that these those my your our their his her its some any each every".split()
NOUN_BEFORE = DETERMINERS + "of in on at with by".split()
VERB_BEFORE = "i you he she it we they who what that will shall would can could should may might must to do does did don't doesn't didn't not".split()
COPULAS = "am is are was were be been being seem seems seemed become becomes became look looks looked sound sounds sounded feel feels felt appear appears appeared remain remains remained stay stays stayed".split()
FUTURE_MODALS, FUTURE = "will shall would".split(), "tomorrow later next soon tonight afternoon evening".split()
PAST = "yesterday ago last before earlier previously already then today tonight this morning afternoon evening".split()
NOUN_LATER, VERB_LATER = "the a an this that these those my your our their".split(), "will shall can could should would may might must do does did to not don't please".split()
MUSIC, MUSIC_HEADS = "play plays played playing hear heard listen listened bass guitar band line voice part".split(), "guitar line voice part clef riff".split()


def homograph_senses(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, word_idx, word, sense_ipa): homographs read by the words around them, inside each row, without a shuffle."""
    low = F.transform(words_of("text"), F.lower)
    held = sentences.where(F.lower("text").rlike(rf"(?<![a-z'-])(?:{'|'.join(HOMOGRAPHS)})(?![a-z'-])")).select("doc_id", "sent_idx", low.alias("ws"))
    # only homographs leave the row, with their neighbours and the last place of each list of words that may come later
    lists = {"past": PAST, "future": FUTURE, "verb": VERB_LATER, "noun": NOUN_LATER}
    last = lambda ws: F.coalesce(F.array_max(F.transform("ws", lambda w, i: F.when(w.isin(ws), i))), F.lit(-1))
    placed = held.select("*", *[last(ws).alias(f"last_{k}") for k, ws in lists.items()])
    around = lambda w, i: F.struct(i.alias("word_idx"), w.alias("word"), *[F.coalesce(F.get("ws", i + k), F.lit("")).alias(name) for name, k in (("b2", -2), ("b1", -1), ("a1", 1))])
    spots = F.filter(F.transform("ws", lambda w, i: F.when(w.isin(*HOMOGRAPHS), around(w, i))), lambda x: x.isNotNull())
    at = placed.select("doc_id", "sent_idx", *[f"last_{k}" for k in lists], F.inline(spots))
    near = lambda k: F.col({-2: "b2", -1: "b1", 1: "a1"}[k])
    either = lambda ws: near(-1).isin(ws) | near(-2).isin(ws)
    later = lambda ws: F.col(next(f"last_{k}" for k, v in lists.items() if v is ws)) > F.col("word_idx")
    verb = either(VERB_BEFORE) | ((F.col("word_idx") == 0) & near(1).isin([*DETERMINERS, "to"]))
    noun = either(NOUN_BEFORE)
    past = ~near(-1).isin([*FUTURE_MODALS, "to"]) & (either(PAST) | later(PAST) | later(FUTURE))
    rules = {"past": past, "noun": noun, "verb": verb, "verb_past": either(VERB_BEFORE) | later(PAST), "music": either(MUSIC) | near(1).isin(MUSIC_HEADS), "verb_later": verb | later(VERB_LATER), "noun_adj": noun | either(COPULAS), "noun_copula": noun | near(1).isin(COPULAS), "noun_later": noun | later(NOUN_LATER)}
    rule = F.element_at(literal_map({w: r for w, (r, _, _) in HOMOGRAPHS.items()}), F.col("word"))
    holds = F.coalesce(*[F.when(rule == k, c) for k, c in rules.items()])
    phones = F.when(holds, F.element_at(literal_map({w: y for w, (_, y, _) in HOMOGRAPHS.items()}), F.col("word"))).otherwise(F.element_at(literal_map({w: n for w, (_, _, n) in HOMOGRAPHS.items()}), F.col("word")))
    return at.select("doc_id", "sent_idx", "word_idx", "word", phones_to_ipa(F.split(phones, " ")).alias("sense_ipa"))


#: The answer of a silent word; those of others begin with a blank.
SILENT = "\u0000"


def said_tokens(ts: list[str], answers: list[str | None], senses: list[tuple[int, str]] | None, kept: set[str] = frozenset()) -> str:
    """render_phonemes of one sentence: words spaced, punctuation glued. senses: (word_idx, ipa) of words that are said otherwise, but for kept ones."""
    if senses:
        words = [i for i, t in enumerate(ts) if t not in MARKS]
        for k, ipa in senses:
            if ts[words[k]] not in kept:
                answers[words[k]] = f" {ipa}" if ipa else SILENT
    if None not in answers:
        whole = "".join(answers)
        if not any(map(whole.__contains__, _UNEVEN)):  # every word but the first has its blank
            return whole.removeprefix(" ")
    out, before = [], ""
    for t, answer in zip(ts, answers, strict=True):
        if t in MARKS:
            before = answer
        else:
            if before and before[-1] not in OPENING:
                out.append(" ")
            before = "" if answer is None or answer == SILENT else answer[1:]
        out.append(before)
    return "".join(out)


_UNEVEN = (SILENT, "  ", *OPENING.strip())


def phonemize_corpus(sentences: DataFrame, gold: DataFrame, phones: DataFrame, overrides: DataFrame | None = None, rewrites: list[tuple[str, str]] = (), tiers: list[tuple[str, Tier]] | None = None) -> DataFrame:
    """(doc_id, sent_idx, phonemes): sentences normalised once, types resolved once; tokens are said in their sentence; empty output dropped.
    A user's override comes before all else, a homograph's sense before the other tiers."""
    sentences = stored(normalize_with_lexicon(sentences.select("doc_id", "sent_idx", "text"), ["doc_id", "sent_idx"], "text", gold, phones, rewrites), "normalized")
    counts = stored(word_totals(sentences), "words")
    types = resolve_words(counts, gold, phones, overrides, tiers)
    table = stored(counts.join(types, "word", "left").select("word", "n", F.when(F.col("ipa") != "", F.concat(F.lit(" "), "ipa")).otherwise(SILENT).alias("answer"), F.coalesce(F.col("tier") == "override", F.lit(False)).alias("fixed")), "said")
    homograph = F.lower("word").isin(*HOMOGRAPHS)

    def senses(rows: DataFrame) -> DataFrame:
        held = rows.where(F.exists("asked", lambda w: F.lower(w).isin(*HOMOGRAPHS))).select(F.col("id").alias("doc_id"), F.lit(0).alias("sent_idx"), "text")
        return homograph_senses(held).groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("word_idx", "sense_ipa"))).alias("extra"))

    kept = {r["word"] for r in table.where(homograph & F.col("fixed")).select("word").collect()}  # a homograph's spellings
    said = said_by_table(sentences, "text", table, tokens_of, partial(said_tokens, kept=kept), {m: m for m in MARKS}, homograph & ~F.col("fixed"), senses)
    return said.where("said <> ''").select("doc_id", "sent_idx", F.col("said").alias("phonemes"))
