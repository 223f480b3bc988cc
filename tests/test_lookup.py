"""Texts said by a table of words, and texts sifted before the cascade: results do not depend on what is frequent or left out."""

import random

from pyspark.sql import functions as F

from voicegrist.functions import normalize as N
from voicegrist.operators import lookup as L
from voicegrist.operators import pronounce as P
from voicegrist.operators import structure as T
from voicegrist.operators import tokens as K

BOUNDS = (0, 2 * L.EACH + 20, 1 << 25)


def test_whatever_is_frequent(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b c"), (None, "c c d"), (1, None), (2, ""), (3, "b")], "doc_id long, text string")
    table = spark.createDataFrame([("a", 9, "A"), ("b", 5, "B"), ("c", 5, None), ("e", 1, "E")], "word string, n long, answer string")
    say = lambda ts, answers, _: " ".join(f"{t}={x}" for t, x in zip(ts, answers, strict=True))
    for bound in BOUNDS:
        monkeypatch.setattr(L, "FREQUENT", bound)
        said = L.said_by_table(rows, "text", table, lambda t: (t or "").split(), say)
        assert sorted(map(str, map(tuple, said.collect()))) == sorted(map(str, [(1, "a=A b=B c=None"), (None, "c=None c=None d=None"), (1, ""), (2, ""), (3, "b=B")])), bound


def test_corpus_is_said_alike_whatever_is_frequent(spark, monkeypatch):
    texts = ["We read it yesterday, and READ on. Read “this” — now!", "I will read - the bow, zyx's rare-word…", "", None, "Lead on; 12 bows."]
    rows = spark.createDataFrame([(i % 4, i, t) for i, t in enumerate(texts)], "doc_id long, sent_idx int, text string")
    gold = spark.createDataFrame([("it", "ɪt"), ("on", "ɑn"), ("read", "gold"), ("-", "-")], "word string, ipa string")
    phones = spark.createDataFrame([("will", ["W", "IH1", "L"])], "word string, phones array<string>")
    own = spark.createDataFrame([("bow", "own"), ("the", "ðə "), ("and", "")], "word string, ipa string")
    said = set()
    for bound in BOUNDS[::2]:
        monkeypatch.setattr(L, "FREQUENT", bound)
        said.add(tuple(sorted(tuple(r) for r in P.phonemize_corpus(rows, gold, phones, own).collect())))
    (one,) = said
    assert [r[:2] for r in one] == [(0, 0), (0, 4), (1, 1)]
    assert "ɹˈɛd ɪt" in one[0][2] and "ɹˈid - ðə own, " in one[2][2] and "own" not in one[1][2]


def test_said_as_rendered(spark):
    random.seed(4)
    words = {"w": "ˈa", "x": "b c", "-": "", "y": "d ", "z": "e“", "v": "f  g", "u": "\u0000h"}
    lists = [[random.choice([*words, *K.MARKS]) for _ in range(random.randrange(1, 9))] for _ in range(400)]
    rows = [(i, 0, k, "punct" if t in K.MARKS else "word", words.get(t, t)) for i, ts in enumerate(lists) for k, t in enumerate(ts)]
    rendered = {r["doc_id"]: r["phonemes"] for r in K.render_phonemes(spark.createDataFrame(rows, "doc_id long, sent_idx int, tok_idx int, kind string, ipa string")).collect()}
    answers = {w: f" {x}" if x else P.SILENT for w, x in words.items()} | {m: m for m in K.MARKS}
    for i, ts in enumerate(lists):
        assert P.said_tokens(ts, [answers[t] for t in ts], None) == rendered.get(i, ""), ts


def test_tokens_in_python_are_those_of_the_expressions(spark):
    random.seed(5)
    texts = ["".join(random.choice("aZ'’- ,.!?;:“”—…é1\"\n\x1c (K") for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("sent_idx", F.lit(0))
    by_row = {r["doc_id"]: [x["token"] for x in sorted(r["ts"], key=lambda x: x["tok_idx"])] for r in K.tokenize(df).groupBy("doc_id").agg(F.collect_list(F.struct("tok_idx", "token")).alias("ts")).collect()}
    words = {r["doc_id"]: r["ws"] for r in df.select("doc_id", K.words_of("text").alias("ws")).collect()}
    for i, t in enumerate(texts):
        assert K.tokens_of(t) == by_row.get(i, []) and K.spelled_words(t) == words[i], repr(t)


def test_sifted_texts(spark):
    odd = ["Plain (so)!", "Éa àé 'tis", "did", "élan ÉA", "ìì x", "éci", "Dr. No", "ask e.G. him", "see www.x", "at a.com", "x - y", "a1", "q [x]", "3 × 4", "a²", "α", "5♠", "\u0001a", "NASA's", "TO DO it", "mix DE", "ía.ío", "ß.ÇO", "XIV a", "a\u0085b", "", "He is. A"]
    some = spark.createDataFrame([(t,) for t in odd], "text string").unionByName(T.split_sentences(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)).select("text"))
    false = lambda w: F.lit(False)
    rows = N.sifted(some.select("text", F.col("text").alias("was")), "text").select("*", N.touched(F.col("was")).alias("touched"))
    every = N.normalize_corpus(rows.withColumn("all", F.col("was")), "all", is_word=false)
    both = N.normalize_corpus(every.withColumn("some", F.col("was")), "some", is_word=false, rules=N.OF_LETTERS).collect()
    assert {r["__rules"] for r in both} == {0, 1, 2} and len(both) > 500
    for r in both:
        assert r["touched"] == (r["__rules"] > 0), r
        assert r["text"] == (r["was"] if r["__rules"] else r["all"]), r
        assert r["__rules"] == 2 or r["some"] == r["all"], r
    none = spark.createDataFrame([(1, None), (None, "é")], "doc_id long, text string")
    lexicons = spark.createDataFrame([], "word string, ipa string"), spark.createDataFrame([], "word string, phones array<string>")
    assert {tuple(r) for r in N.normalize_with_lexicon(none, ["doc_id"], "text", *lexicons).collect()} == {(1, None), (None, "e")}
