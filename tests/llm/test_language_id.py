"""Language identification against brute-force longest matches, and on held-out rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from voicegrist.llm import language_id


def phrases(text, references):
    """Greedy longest matches, one by one."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and any(text[i:j] in r for r in references):
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def folded(spark, texts):
    d = spark.createDataFrame([*enumerate(texts)], "i int, text string").select("i", language_id.folded(F.col("text")).alias("t"))
    return [r.t for r in d.orderBy("i").collect()]


def test_parse_is_the_longest_match():
    r = random.Random(3)
    for _ in range(60):
        letters = b"abcd"[: r.choice([2, 3, 4])]
        samples = {"q": [bytes(r.choices(letters, k=r.randrange(1, 40))) for _ in range(r.randrange(1, 4))], "r": [b"xyz" + bytes(r.choices(b"abcdefg", k=30))]}
        texts = [bytes(r.choices(b"abcdexQ", k=r.randrange(0, 60))) for _ in range(7)] + [b""]
        got = language_id.CrossParser(samples).phrases(texts)
        assert got.tolist() == [[phrases(t, samples[x]) for x in ("q", "r")] for t in texts]


def test_phrases_cross_words():
    parser = language_id.CrossParser({"aa": [b" the cat sat on "], "bb": [b" sat cat on the "]})
    assert parser.phrases([b" the cat sat on "]).tolist() == [[1, 4]]


def test_folding(spark):
    assert folded(spark, ["Hé, It's  7up!", "½ ²", "", None, "\u0301 1", "e\u0301a", "日本 語"]) == [" hé it s up ", None, None, None, None, " e\u0301a ", " 日本 語 "]


def test_prediction(spark):
    """Odd rows, ties, repeated rows, clashing columns; a text of 20,000 words is parsed whole."""
    long_ = "uno " * 10_000 + "alpha " * 12_000
    texts = {1: "alpha gamma", 2: "Dos, TRES!", 3: "123 !", 4: None, 5: "", 6: "½ ²", 7: "zzz", 8: long_}
    rows = [(i, t, "x", 0.0) for i, t in texts.items()] + [(1, texts[1], "x", 0.0), (None, "tres", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    samples = {"aa": [b" alpha beta gamma delta "], "bb": [b" uno dos tres cuatro "], "cc": [b" uno dos tres cuatro "]}
    got = sorted(map(tuple, language_id.identify(docs, [samples]).collect()), key=str)
    assert len(got) == len(rows)
    of = {g[0]: (g[1], round(g[2], 6)) for g in got}
    assert of[1][0] == "aa" and of[2] == ("bb", 0.5) and of[None] == ("bb", 0.5) and of[8][0] == "aa"
    assert all(of[i] == ("und", 0.0) for i in (3, 4, 5, 6)) and of[7][0] == "bb"
    assert language_id.identify(docs.limit(0), [samples]).count() == 0
    unlearned = list(language_id.sample_blocks(spark.createDataFrame([(None, "a"), ("x", None), ("y", ""), ("z", "1 2")], "lang string, text string")))
    assert {r.lang_pred for r in language_id.identify(docs, unlearned).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """70 languages of their own words: each is found again, with the score that one parser of all gives."""
    r = random.Random(11)
    texts = {f"l{i:02d}": " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)) for i in range(70)}
    labelled = spark.createDataFrame(list(texts.items()), "lang string, text string")
    docs = spark.createDataFrame([*enumerate(texts.values()), (3, texts["l03"]), (None, "1 2"), (90, None)], "doc_id long, text string")
    got = sorted(((g[0], g[1], round(g[2], 9)) for g in language_id.identify(docs, language_id.sample_blocks(labelled)).collect()), key=str)
    samples = {k: [f" {t} ".encode()] for k, t in texts.items()}
    costs = language_id.CrossParser(samples).costs([x[0] for x in samples.values()])
    names, scores = language_id._decided(costs, sorted(samples))
    want = [*zip(range(70), names, np.round(scores, 9).tolist(), strict=True)]
    assert got == sorted([*want, want[3], (None, "und", 0.0), (90, "und", 0.0)], key=str)
    assert names == sorted(texts)


def test_sample_covers_whole_texts(spark):
    """A long text is learned from beyond its opening, in bounded pieces."""
    text = "opening " * 500 + "later " * 500 + "closing " * 500
    (got,) = language_id.sample_blocks(spark.createDataFrame([("aa", text), ("aa", text), ("bb", "short")], "lang string, text string"))
    assert {b"opening", b"later", b"closing"} <= set(b" ".join(got["aa"]).split()) and got["bb"] == [b" short "]
    assert max(map(len, got["aa"])) <= language_id.PIECE_BYTES + 2 and sum(map(len, got["aa"])) <= language_id.SAMPLE_BYTES


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    held = language_id.op10_language_id(spark, d).where("held_out and lang_pred <> 'und'").join(docs, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
