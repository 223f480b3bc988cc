"""Literal cases of the corpus operators."""

import pytest
from pyspark.sql import functions as F

from voicegrist.functions import normalize as N
from voicegrist.operators import chunks as C
from voicegrist.operators import evaluation as E
from voicegrist.operators import pronounce as P
from voicegrist.operators import structure as T

RULES = {
    N.numbers: {"82": "eighty two", "1,234": "one thousand two hundred thirty four", "-42": "minus forty two", "3.14": "three point one four", "0.5": "zero point five", "1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth", "21st": "twenty first", "100th": "one hundredth", "101st": "one hundred first", "1234": "twelve thirty four", "1900": "nineteen hundred", "1999": "nineteen ninety nine", "2000": "two thousand", "2008": "two thousand eight", "2010": "twenty ten", "2026": "twenty twenty six", "1920s": "nineteen twenties", "1990s": "nineteen nineties", "2010s": "twenty tens", "1900s": "nineteen hundreds", "2000s": "two thousands", "1920's": "nineteen twenties", "In the 1920s the world changed.": "In the nineteen twenties the world changed.", "3:45": "3:45"},
    N.money_time: {"$5": "five dollars", "$1": "one dollar", "$5.50": "five dollars fifty cents", "$1,234.56": "one thousand two hundred thirty four dollars fifty six cents", "€5": "five euros", "£1": "one pound", "¥5": "five yen", "5¢": "five cents", "1¢": "one cent", "99¢": "ninety nine cents", "3:45": "three forty five", "3:05": "three oh five", "3:00": "three", "12:00": "twelve"},
    N.acronyms: {"FBI": "F B I", "CIA": "C I A", "USA": "U S A", "SQL": "S Q L", "HTML": "H T M L", "USB": "U S B", "NASA": "NASA", "NATO": "NATO", "RADAR": "RADAR", "JSON": "JSON", "NASA's": "NASA's", "FBI's": "FBI's", "iNTRO": "iNTRO"},
    N.abbreviations: {"Dr. Smith called Mr. Jones at 3 p.m.": "Doctor Smith called Mister Jones at 3 P M", "Mrs. Lee met Ms. Kim.": "Missus Lee met Miz Kim.", "Prof. Adams lectured.": "Professor Adams lectured."},
    N.dates: {"2026-05-06": "May sixth twenty twenty six", "5/6/2026": "May sixth twenty twenty six", "5-6-2026": "May sixth twenty twenty six", "May 6, 2026": "May sixth twenty twenty six", "May 6th, 2026": "May sixth twenty twenty six", "May 5": "May fifth", "Monday, May 6th": "Monday, May sixth", "May 5 we": "May fifth we", "15/6/2026": "15/6/2026"},
    N.units: {"5 kg": "five kilograms", "1 kg": "one kilogram", "0 kg": "zero kilograms", "0.5 kg": "zero point five kilograms", "5.5 kg": "five point five kilograms", "5 km": "five kilometers", "5 g": "five grams", "5 mph": "five miles per hour", "5 km/h": "five kilometers per hour", "5°C": "five degrees Celsius", "1 ft": "one foot", "2 ft": "two feet", "5 s": "five seconds", "5 sec": "five seconds", "5 min": "five minutes", "5 hr": "five hours", "10mbps": "ten megabits per second"},
    N.math_symbols: {"2 + 2 = 4": "2 plus 2 equals 4", "5 - 3": "5 minus 3", "2*3": "2 times 3", "2 * 3": "2 times 3", "10/2": "10 divided by 2", "8 / 2": "8 divided by 2", "x^2": "x to the power of 2", "a <= b": "a less than or equal to b", "a >= b": "a greater than or equal to b", "a < b": "a less than b", "a > b": "a greater than b", "3×4": "3 times 4", "8÷2": "8 divided by 2", "x≠y": "x not equal to y", "x≤y": "x less than or equal to y", "x≥y": "x greater than or equal to y", "10 ± 2": "10 plus or minus 2", "50%": "50 percent", "text-to-speech": "text-to-speech", "**bold**": "**bold**", "5/6": "5 divided by 6", "a/b/c": "a/b/c", "1/2/3": "1/2/3", "v1/2": "v1/2"},
    N.emphasis_words: {"COME TO PARIS ON IMPORTANT BUSINESS": "COME to PARIS on IMPORTANT BUSINESS", "BUT FIND LIVINGSTONE": "BUT FIND LIVINGSTONE", "the US economy": "the US economy", "In IT we trust": "In IT we trust"},
    N.roman_numerals: {"XIV's page": "fourteen's page", "MMXXVI, xii": "two thousand twenty six, twelve", "Iv IIV2 X": "Iv IIV2 X"},
    N.urls: {
        "(http://a.com) now": "(H T T P colon slash slash A dot C O M) now", "a.com/x,y": "A dot C O M slash X,y", 'at "www.b.org/50%?u=me@x".': 'at "W W W dot B dot O R G slash 5 0 % question mark U equals M E @ X".', "see ~/a_b and /usr/lib. or /a": "see tilde slash A underscore B and slash U S R slash L I B. or /a",
        "end of a.com. Next": "end of a.com. Next", "and/or": "and/or", "httpbin.org": "H T T P B I N dot O R G",
    },
    N.hex_literals: {"0xDEAD": " hex D E A D "},
    N.feet_inches: {"6'2\"": "6 feet 2 inches ", "1920's": "1920's"},
}


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.__name__)
def test_rule(spark, rule):
    rows = spark.createDataFrame([*RULES[rule].items()], "text string, want string").withColumn("got", rule(F.col("text"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_math(spark):
    cases = {
        "a => b": "a arrow b", "x==y": "x equals equals y", "n := 3": "n gets 3", "a*b": "a*b", "2  *  3": "2 times 3", "5-3": "5 minus 3", "the -EV line": "the minus EV line", "(-3)": "( minus 3)", "well-known": "well-known", "a - b": "a - b", "3/4 cup": "3 divided by 4 cup", "a/b/c": "a/b/c",
        "1/2/2024": "1/2 divided by 2024", "10/2": "10 divided by 2", "4 / 2": "4 divided by 2", "x   <   y": "x less than y", "a <= ": "a <=", "50 %": "50 percent", "% off": "% off", "no  change": "no  change", "]=}": "] equals }",
    }
    cases["a <= "] = "a <= "
    rows = spark.createDataFrame([*cases.items()], "text string, want string").withColumn("got", N.math_symbols(F.col("text"))).collect()
    assert {r.text: r.got for r in rows} == cases


def test_roman_numerals_with_a_dictionary(spark):
    cases = {"IIII": "four", "IC": "ninety nine", "did MIX": "did MIX", "xvx": "fifteen"}
    rows = spark.createDataFrame([*cases.items()], "text string, want string").withColumn("got", N.roman_numerals(F.col("text"), lambda w: w.isin("did", "mix"))).collect()
    assert {r.text: r.got for r in rows} == cases


def test_resampling(spark):
    from voicegrist.operators import timeline as U

    x = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],), ([5.0],), ([],)], "s array<float>")
    assert [r.r for r in x.select(U.resample_24k_16k(F.col("s")).alias("r")).collect()] == [[0.0, 2.0], [], []]
    assert [r.r for r in x.select(U.resample_linear(F.col("s"), 8_000, 24_000).alias("r")).collect()][1:] == [[5.0], []]
    assert len(x.select(U.resample_linear(F.col("s"), 8_000, 24_000).alias("r")).first().r) == 12


def test_similarity_in_bytes(spark):
    p = spark.createDataFrame([("ɑb", "b"), ("", "")], "a string, b string")
    assert [round(r.s, 6) for r in p.select(E.ipa_similarity(F.col("a"), F.col("b"), True).alias("s")).collect()] == [round(1 - 1 / 3, 6), 1.0]


def test_many_distinct_words(spark):
    words = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(36_000))
    row = E.wer_plain(spark.createDataFrame([(1, words, words + " more")], "idx int, ref string, hyp string")).first()
    assert (row.edits, row.ref_words) == (1, 36_000)


def test_sentences(spark):
    cases = [("Mr. Smith arrived. He waited.", 2), ("She's 3.14 meters tall? Yes.", 2), ("Hello.\n\nWorld.", 2), ("one; two; three", 3), ("Dr. Who at 3 p.m. on Monday.", 1), ("A.\n\n\n\nB.", 4), ("wait... what. ok", 2), ("We laughed in hilarious terms. We struggled to communicate.", 2), ("Thanks to Alice; thanks to Bob; thanks to Carol.", 3), ("Dr. Smith called Mr. Jones at 3 p.m. on Monday.", 1), ("", 0)]
    rows = spark.createDataFrame(cases, "text string, n int").select("n", F.size(T.sentence_pieces(F.col("text"))).alias("got")).collect()
    assert [r.got for r in rows] == [r.n for r in rows]


def test_headings(spark):
    cases = [("Chapter 1", True), ("42", True), ("XIV", True), ("iNTRODUCTION", True), ("Foreword by John Boyne", True), ("12345", False), ("Hello", False), ("—John Boyne", False), ("Really?", False)]
    rows = spark.createDataFrame(cases, "text string, want boolean").select("want", T.is_heading(F.col("text")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_phones_and_letters(spark):
    one = spark.createDataFrame([(["AA1", "OW1", "ER0", "ER1", "AH0", "AH1"],)], "p array<string>")
    assert one.select(P.phones_to_ipa(F.col("p"))).first()[0] == "ˈɑˈOəɹˈɜɹəˈʌ"
    w = spark.createDataFrame([("photon", "f"), ("church", "ʧ"), ("shoot", "ʃ"), ("kite", "aɪ"), ("motion", "ʃ"), ("running", "ɪŋ"), ("scene", "sˈi")], "w string, has string")
    assert all(r.has in r.ipa for r in w.select("has", P.letter_to_sound(F.col("w")).alias("ipa")).collect())


def test_cap(spark):
    u = spark.createDataFrame([(1, 0, "aa bb cc dd, ee ff"), (1, 1, "short"), (1, 2, "abcdefghijklmnop")], "doc_id long, sent_idx int, phonemes string")
    got = [(r.sent_idx, r.phonemes) for r in C.enforce_cap(u, 6).orderBy("sent_idx", "piece_idx").collect()]
    assert got == [(0, "aa bb"), (0, "cc dd"), (0, "ee ff"), (1, "short")]


def test_word_errors(spark):
    p = spark.createDataFrame([(1, "good morning all", "goodmorning all"), (2, "a b c", "a x c d"), (3, "", "")], "idx int, ref string, hyp string")
    assert [r.edits for r in E.wer(p).orderBy("idx").collect()] == [0, 2, 0]
    assert [r.edits for r in E.wer_plain(p).orderBy("idx").collect()] == [2, 2, 0]


def test_phonemes_of_normalised_sentences(spark):
    """Numbers, symbols and accents are spoken as their words are."""
    both = [("It cost $20 on May 5.", "It cost twenty dollars on May fifth."), ("Crème brûlée.", "Creme brulee."), ("STOP the mix on page XIV.", "stop the mix on page fourteen.")]
    rows = [(i, j, t) for i, pair in enumerate(both) for j, t in enumerate(pair)]
    gold = spark.createDataFrame([("cost", "kˈɔst"), ("twenty", "twˈɛnti"), ("stop", "stˈɑp"), ("mix", "mˈɪks")], "word string, ipa string")
    phones = spark.createDataFrame([], "word string, phones array<string>")
    got = {(r.doc_id, r.sent_idx): r.phonemes for r in P.phonemize_corpus(spark.createDataFrame(rows, "doc_id long, sent_idx int, text string"), gold, phones).collect()}
    assert all(got[i, 0] == got[i, 1] for i in range(len(both))) and "twˈɛnti" in got[0, 0] and "mˈɪks" in got[2, 0]


def test_possessives_of_any_base(spark):
    gold = spark.createDataFrame([("cat", "kˈæt"), ("fish", "fˈɪʃ")], "word string, ipa string")
    phones = spark.createDataFrame([], "word string, phones array<string>")
    types = spark.createDataFrame([(w,) for w in ("cat's", "cats's", "cat-fish's", "blick's", "blick", "FBI's")], "word string")
    got = {r.word: (r.ipa, r.tier) for r in P.resolve_words(types, gold, phones).collect()}
    assert got["cat's"] == ("kˈæts", "possessive") and got["cats's"] == ("kˈætsɪz", "possessive") and got["cat-fish's"] == ("kˈætfˈɪʃɪz", "possessive")
    assert got["blick's"] == (got["blick"][0] + "s", "possessive") and got["FBI's"][1] == "acronym" and len(got) == 6


def test_word_errors_of_normalised_texts(spark):
    p = spark.createDataFrame([(1, "20 cats on May 5 for $3", "twenty cats on May fifth for three dollars")], "idx int, ref string, hyp string")
    assert E.wer(p).first().edits == 0


def test_edits_by_rows_are_the_plain_table(spark):
    import random

    def table(r, h):
        t = [[0] * (len(h) + 1) for _ in range(len(r) + 1)]
        for i in range(len(r) + 1):
            for j in range(len(h) + 1):
                if i and j:
                    t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (r[i - 1] != h[j - 1]))
                    if i > 1 and r[i - 2] + r[i - 1] == h[j - 1]:
                        t[i][j] = min(t[i][j], t[i - 2][j - 1])
                    if j > 1 and h[j - 2] + h[j - 1] == r[i - 1]:
                        t[i][j] = min(t[i][j], t[i - 1][j - 2])
                else:
                    t[i][j] = i + j
        return t[-1][-1]

    x = random.Random(4)
    for _ in range(300):
        r, h = (x.choices(["a", "b", "ab", "ba", "aa", "aab"], k=x.randrange(7)) for _ in "rh")
        assert E._joins_free(r, h) == table(r, h)


def test_stream_sentences_are_those_of_a_batch(spark, tmp_path):
    from voicegrist.streaming import requests as R

    text = "Mr. Smith paid 3.14 dollars... He left. \n\nNext; she came at 3 p.m. on Monday! Was it so?  e.g. this. End"
    pieces = [(t, i, text[i * 7 : i * 7 + 7], (i + 1) * 7 >= len(text)) for t in (1, 2) for i in range(-(-len(text) // 7))]
    schema = "turn long, seq int, text string, last boolean"
    for n in range(2):  # two files: the text of a turn comes in over two batches
        spark.createDataFrame([p for p in pieces if (p[1] >= 9) == n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = R.stream_sentences(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = {t: [r.sentence for r in spark.table("said").where(f"turn = {t}").orderBy("part", "seq").collect()] for t in (1, 2)}
    want = [r.sentence for r in R.turn_sentences(spark.createDataFrame(pieces, schema)).where("turn = 1").orderBy("seq").collect()]
    assert got[1] == got[2] == want and len(want) == 6


def test_quarantine_and_resume(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "bad"), (2, 0, None)], "doc_id long, chapter_idx int, text string")
    ok, failed, summary = T.quarantine_failures(rows, F.when(F.col("text") == "bad", "refused"))
    assert (ok.count(), failed.first().error, {r.status: r.n for r in summary.collect()}) == (2, "refused", {"rendered": 2, "failed": 1})
    assert T.resume_pending(rows, ok).collect() == [rows.where("text = 'bad'").first()]
