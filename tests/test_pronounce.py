"""Literal cases of the pronunciation tiers, their order, parts and rounds; the cap over text."""

import pytest
from pyspark.sql import functions as F

from voicegrist.operators import chunks as C
from voicegrist.operators import pronounce as P


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame([("cat", "kˈæt"), ("eye", "ˈI"), ("us", "ˌʌs"), ("war", "wˈɔɹ"), ("bus", "bˈʌs"), ("color", "kˈʌlɚ"), ("estrogen", "ˈɛstɹəʤən"), ("taichi", "tˈIʧi"), ("foo", "fˈu"), ("json", "wrong"), ("fly", "flˈI"), ("name", "nˈAm")], "word string, ipa string")


@pytest.fixture(scope="module")
def phones(spark):
    rows = [("nasa", "N AE1 S AH0"), ("fbi", "EH1 F B IY1 AY1"), ("systems", "S IH1 S T AH0 M Z"), ("system", "S IH1 S T AH0 M"), ("bar", "B AA1 R"), ("type", "T AY1 P"), ("group", "G R UW1 P"), ("hamster", "HH AE1 M S T ER0")]
    return spark.createDataFrame([(w, p.split()) for w, p in rows], "word string, phones array<string>")


LETTERS = {c: n for c, n in P.LETTERS.items()}


def spell(w):
    return " ".join(LETTERS[c] for c in w.lower())


def test_tiers(spark, gold, phones):
    want = {
        # all-caps words: said as a word, meant as emphasis, or spelled; their possessives stay with them
        "NASA": ("nˈæsə", "acronym_word"), "NASA's": ("nˈæsəz", "acronym_word"), "ASAP": (spell("asap"), "acronym"), "PIN's": (spell("pin") + "z", "acronym"),
        "JSON": ("ˈdʒeɪsən", "acronym"), "JSON's": ("ˈdʒeɪsənz", "acronym"), "FAQ": ("fæk", "acronym"),
        "US": (spell("us"), "acronym"), "US's": (spell("us") + "z", "acronym"), "FBI": (spell("fbi"), "acronym"), "FBI's": (spell("fbi") + "z", "acronym"), "FBI'S": (spell("fbi") + "z", "acronym"),
        "WAR": ("wˈɔɹ", "emphasis"), "WAR's": ("wˈɔɹz", "emphasis"), "CAT's": ("kˈæts", "emphasis"), "SYSTEMS": ("sˈɪstəmz", "emphasis"), "SYSTEMS's": ("sˈɪstəmzɪz", "emphasis"), "TYPE": (spell("type"), "acronym"),
        "us": ("ˌʌs", "gold"), "Us": ("ˌʌs", "gold"), "cats": ("kˈæts", "plural"), "flies": ("flˈIz", "plural"), "buses": ("bˈʌsɪz", "plural"), "systems": ("sˈɪstəmz", "phones"),
        "tai-chi": ("tˈIʧi", "hyphenated"), "oestrogen": ("ˈɛstɹəʤən", "british"), "semigroup": (None, "compound"), "typename": (None, "compound"), "hamstering": ("hˈæmstəɹɪŋ", "inflection"),
        "html": (spell("html"), "letters"), "xkcd": (spell("xkcd"), "letters"), "blick": (None, "lts"), "qwrtyp": (None, "lts"),
        # parts, and parts of parts
        "cat's": ("kˈæts", "possessive"), "fooBar": ("fˈu bˈɑɹ", "camel"), "cat-eye": ("kˈætˈI", "hyphenated"), "cat's-eye": ("kˈætsˈI", "hyphenated"), "fooBar's": ("fˈu bˈɑɹz", "possessive"), "fooBar-cat's": ("fˈu bˈɑɹkˈæts", "possessive"), "NASA-cat": ("nˈæsəkˈæt", "hyphenated"),
    }
    types = spark.createDataFrame([(w,) for w in [*want, *want]] + [(None,)], "word string")
    got = {r.word: (r.ipa, r.tier) for r in P.resolve_words(types, gold, phones).collect()}
    assert set(got) == set(want)
    for w, (ipa, tier) in want.items():
        assert got[w][1] == tier and (ipa is None or got[w][0] == ipa) and got[w][0], (w, got[w])


def test_rounds_are_bounded_and_leftovers_reported(spark, gold, phones):
    types = spark.createDataFrame([("fooBar-cat's",), ("cat's",), ("foo",)], "word string")
    tiers = P.default_tiers(gold, phones)
    answers, leftovers = P.resolve_by_rounds(types, tiers, 1)
    assert {r.word for r in leftovers.collect()} == {"fooBar-cat"}
    got = {r.word: r.tier for r in answers.collect()}
    assert got["foo"] == "gold" and got["cat's"] == "possessive" and "leftover" in got.values()
    assert P.resolve_by_rounds(types, tiers, 3)[1].count() == 0
    assert P.resolve_words(types.limit(0), gold, phones).count() == 0


def test_a_tier_of_ones_own(spark, gold, phones):
    asked = []

    def names(types):
        asked.append(sorted(r.word for r in types.collect()))
        return types.where("word like 'Z%'").select("word", F.lit("zˈi").alias("ipa"))

    own = spark.createDataFrame([("CAT", "kˈAt")], "word string, ipa string")
    tiers = P.default_tiers(gold, phones, own)
    assert [n for n, _ in tiers] == ["override", "lexicon", "rule"]
    tiers.insert(2, ("names", names))
    types = spark.createDataFrame([("Zork",), ("Cat",), ("cat's",), ("foo",), ("blick",)], "word string")
    got = {r.word: (r.ipa, r.tier) for r in P.resolve_words(types, gold, phones, tiers=tiers).collect()}
    assert got["Zork"] == ("zˈi", "names") and got["Cat"] == ("kˈAt", "override") and got["foo"][1] == "gold" and got["blick"][1] == "lts"
    assert got["cat's"] == ("kˈAts", "possessive"), "the base goes through all tiers"
    assert asked[0] == ["Zork", "blick", "cat's"], "only what is left"


SENTENCES = [
    # each rule both ways
    ("I read it yesterday.", "ɹˈɛd"), ("I will read it.", "ɹˈid"), ("The lead pipe.", "lˈɛd"), ("They lead us.", "lˈid"), ("They live here.", "lˈɪv"), ("A live show.", "lˈIv"), ("Play the bass.", "bˈAs"), ("A bass swam.", "bˈæs"),
    ("We close it.", "klˈOz"), ("So close now.", "klˈOs"), ("They wound it.", "wˈWnd"), ("A wound heals.", "wˈund"), ("The produce is fresh.", "pɹˈOdus"), ("They produce it.", "pɹədˈus"), ("The content here.", "kˈɑntɛnt"), ("She felt content.", "kəntˈɛnt"),
    ("We refuse it.", "ɹəfjˈuz"), ("The refuse.", "ɹˈɛfjˌuz"), ("They record it.", "ɹɪkˈɔɹd"), ("A record.", "ɹˈɛkəɹd"),
]


def test_homographs(spark, gold, phones):
    rows = spark.createDataFrame([(i, 0, t) for i, (t, _) in enumerate(SENTENCES)], "doc_id long, sent_idx int, text string")
    got = {r.doc_id: r.sense_ipa for r in P.homograph_senses(rows).collect()}
    assert {SENTENCES[i][0]: x for i, x in got.items()} == dict(SENTENCES)


def test_overrides_and_rewrites_come_first(spark, gold, phones):
    rows = spark.createDataFrame([(1, 0, "I read it yesterday. ")], "doc_id long, sent_idx int, text string")
    own = spark.createDataFrame([("read", "OWN")], "word string, ipa string")
    said = P.phonemize_corpus(rows, gold, phones, own, [("(?i)yesterday", "cat yesterday")]).first().phonemes
    assert "OWN" in said and "kˈæt" in said
    assert "ɹˈɛd" in P.phonemize_corpus(rows, gold, phones).first().phonemes


def test_cap_over_text(spark):
    """Halves are spoken anew: what a word sounds like depends on those before it."""

    def sound(text):
        words = text.split()
        return " ".join(w.strip(",") + ("xxxx" if i and words[i - 1] == "to" else "") for i, w in enumerate(words))

    def speak(df):
        words = F.split(F.trim("text"), r"\s+")
        one = lambda w, i: F.concat(F.regexp_replace(w, "^,+|,+$", ""), F.when((i > 0) & (F.get(words, i - 1) == "to"), "xxxx").otherwise(""))
        return df.select("doc_id", "sent_idx", F.array_join(F.transform(words, one), " ").alias("phonemes"))

    def halves(text, cap):
        if not sound(text):
            return []
        if len(sound(text)) <= cap:
            return [sound(text)]
        words = text.split()
        if len(words) <= 1:
            return []
        mid = len(words) // 2
        return halves(" ".join(words[:mid]), cap) + halves(" ".join(words[mid:]), cap)

    def plain(text, cap):
        if len(sound(text)) <= cap:
            return [sound(text)] if sound(text) else []
        pieces = [p.strip() for p in text.split(",") if p.strip()]
        return halves(text, cap) if len(pieces) <= 1 else [x for p in pieces for x in halves(p, cap)]

    texts = ["short", "a to b", "one two to three four five to six seven, eight nine to ten, x", "averyveryverylongword", "a averyveryverylongword to be", "word " * 20, "to go to go to go to go to go", ", , ,"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, sent_idx int, text string")
    for cap in (6, 30):
        pieces, dropped = C.cap_text(rows, speak, cap)
        got = {}
        for r in pieces.orderBy("sent_idx", "piece_idx").collect():
            got.setdefault(r.sent_idx, []).append(r.phonemes)
        assert got == {i: p for i, t in enumerate(texts) if (p := plain(t, cap))}
        assert {r.text for r in dropped.collect()} == ({"averyveryverylongword"} if cap < 30 else set())
