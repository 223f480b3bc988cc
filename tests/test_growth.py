"""Long rows and large tables: work in proportion to the input, results as before."""

import time

from pyspark.sql import functions as F

from voicegrist.functions import normalize as N
from voicegrist.functions.text import integer_words, rewrite, year_words
from voicegrist.operators import pronounce as P
from voicegrist.operators import structure as T
from voicegrist.operators import tokens as K
from voicegrist.plans import registry as G


def seconds(df):
    began = time.time()
    rows = df.collect()
    return rows, time.time() - began


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_long_row_is_rendered_in_linear_time(spark):
    n = 60_000
    tokens = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("sent_idx"), F.col("id").alias("tok_idx"), F.when(F.col("id") % 2 == 0, "word").otherwise("punct").alias("kind"), F.when(F.col("id") % 2 == 0, "abcdefg").otherwise(",").alias("ipa"))
    rows, took = seconds(K.render_phonemes(tokens))
    assert rows[0]["phonemes"] == ", ".join(["abcdefg"] * (n // 2)) + ","
    assert took < 20


def test_silent_tokens_and_open_marks(spark):
    tokens = [("word", ""), ("word", "a"), ("punct", ""), ("word", ""), ("word", ""), ("word", "b"), ("punct", "—"), ("word", ""), ("word", "c"), ("punct", ","), ("word", "")]
    rows = spark.createDataFrame([(1, 0, i, k, p) for i, (k, p) in enumerate(tokens)] + [(2, 0, 0, "word", "x"), (2, 0, 1, "word", None), (3, 0, 0, "word", "")], "doc_id int, sent_idx int, tok_idx int, kind string, ipa string")
    assert [tuple(r) for r in K.render_phonemes(rows).collect()] == [(1, 0, "a b—c, ")]


def test_long_row_of_homographs(spark):
    n = 20_000
    said, took = seconds(P.homograph_senses(spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(0).alias("sent_idx"), F.repeat(F.lit("we read books "), n).alias("text"))).groupBy("word", "sense_ipa").count())
    assert [tuple(r) for r in said] == [("read", "ɹˈid", n)]
    assert took < 20


def test_long_row_asks_once_whether_it_holds_a_url(spark):
    text = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("somewhere quietly, "), 20_000).alias("text"))
    none = spark.createDataFrame([], "word string, ipa string"), spark.createDataFrame([], "word string, phones array<string>")
    rows, took = seconds(N.normalize_with_lexicon(text, ["doc_id"], "text", *none).select(F.char_length("text")))
    assert rows[0][0] == 19 * 20_000
    assert took < 40


def test_rewrite_of_texts_with_its_own_mark(spark):
    for text in ("a1b22c", "\u00061b\u000622", "1", "", "none", "12\u0006"):
        assert one(spark, rewrite(F.col("t"), "[0-9]+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))), t=text) == __import__("re").sub("[0-9]+", lambda m: f"<{m[0]}>", text)


def test_number_words_on_both_sides_of_the_short_way(spark):
    said = {"0": "zero", "": "zero", "000": "zero", "007": "seven", "40": "forty", "110": "one hundred ten", "1000": "one thousand", "1000001": "one million one", "999999999": "nine hundred ninety nine million nine hundred ninety nine thousand nine hundred ninety nine", "1000000000": "one billion", "12000000000345": "twelve trillion three hundred forty five"}
    assert {k: one(spark, integer_words(F.col("t")), t=k) for k in said} == said
    assert [one(spark, year_words(F.col("t")), t=y) for y in ("1000", "1005", "1900", "2000", "2009", "2010", "1996")] == ["ten hundred", "ten oh five", "nineteen hundred", "two thousand", "two thousand nine", "twenty ten", "nineteen ninety six"]


def test_sentences_end_as_before(spark):
    text = "Dr. No e.g. i.e.g. St. 3.14 xmr. end a.M. P.m.   Last \u0085"
    assert one(spark, T.sentence_pieces(F.col("t")), t=text) == ["Dr. No e.g. i.", "e.g. St. 3.14 xmr.", "end a.M. P.m.   Last\u0085"]


def test_small_tables_are_dealt_to_several_tasks_a_core(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert G.read(spark, str(tmp_path), "orders").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_texts_are_split_once_for_lexicon_and_words(spark, monkeypatch):
    calls = []
    split = T.split_sentences
    monkeypatch.setattr(T, "split_sentences", lambda *a, **k: calls.append(1) or split(*a, **k))
    for name in ("v01_dictionary", "v02_emphasis", "v03_coverage"):
        calls.clear()
        G.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == 1, name


def test_conversations_meet_their_totals_without_a_broadcast(spark, tmp_path):
    from voicegrist.plans import live

    query = live.talk(spark, "/root/testdata/sf0.001").writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_words_counted_in_whole_texts_are_those_of_the_sentences(spark):
    texts = ["It’s a - b. - . 5 - 3! -- ?\n\n\n-\n\nIt's", "well-known 'tis '", "a\u0001b \u0002- c.\u0003d", "", None, "... - ...", "- é. -- . x\n- y", "plain words. Plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = K.word_totals(T.split_sentences(docs, no_split=K.lettered(F.col("text"))))
    by_sentence = K.word_index(T.split_sentences(docs)).groupBy("word").count()
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in by_sentence.collect()}


def test_pauses_and_odd_blanks_of_sentences(spark):
    said = {"a.\n\n\n b\tc\t. \x0b\n\n\n\nd": ["a.", "", "b\tc\t.", "", "", "d"], " \t one! \r\n two ": ["one!", "two "], "A.m. e.G. x": ["A.m. e.G. x"], "-\n\n\n-": [""], "": [], "a": ["a"]}
    assert {k: one(spark, T.sentence_pieces(F.col("t")), t=k) for k in said} == said


def test_long_word_is_read_in_linear_time(spark):
    n = 10_000
    rows, took = seconds(spark.range(1).select(F.repeat(F.lit("ba"), F.col("id").cast("int") + n).alias("w")).select(P.letter_to_sound(F.col("w")).alias("ipa")))
    assert rows[0]["ipa"] == "bæ" * (n - 2) + "bˈæbæ" and took < 20


def test_ids_by_a_large_vocabulary(spark):
    from voicegrist.operators import chunks as C

    vocab = spark.range(0xAC00, 0xD7A4).select(F.decode(F.unhex(F.hex("id")), "UTF-16BE").alias("symbol"), F.col("id")).unionByName(spark.createDataFrame([("𝄞", 7), ("ab", 8), ("", 9), ("é", None)], "symbol string, id long"))
    text = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(0).alias("sent_idx"), F.concat(F.repeat(F.lit("힣"), 400_000), F.lit("𝄞ab𝄢é")).alias("phonemes"))
    rows, took = seconds(C.phonemes_to_ids(text, vocab).select(F.size("ids").alias("n"), F.slice("ids", 400_000, 9).alias("last"), "dropped"))
    assert [tuple(r) for r in rows] == [(400_001, [0xD7A3, 7], 4)] and took < 20
    assert {tuple(r) for r in C.unmapped_symbols(text, vocab).collect()} == {("a", 1), ("b", 1), ("𝄢", 1), ("é", 1)}
    none = spark.createDataFrame([(1, 0, ""), (2, 0, None)], "doc_id int, sent_idx int, phonemes string")
    assert [tuple(r) for r in C.phonemes_to_ids(none, vocab).orderBy("doc_id").collect()] == [(1, 0, [], 0), (2, 0, None, None)]


def test_the_cascade_changes_no_text_that_is_left_out_of_it(spark):
    plain = ["Plain words, said (so)!", "Éa àé 'tis \"it\"; mit ß", "a\tb  c ", "", "He is. A"]
    odd = ["did", "élan ÉA", "ìì x", "Dr. No", "ask e.G. him", "see www.x", "at a.com", "x - y", "a1", "“q”", "x × y", "α", "\u0001a", "NASA's", "mix", "ía.ío"]
    df = spark.createDataFrame(list(enumerate(plain + odd)), "i int, text string")
    said = {r["i"]: r["text"] for r in N.normalize_corpus(df, is_word=lambda w: F.lit(False)).collect()}
    for r in df.select("i", "text", N.touched(F.col("text")).alias("touched"), N.fold_diacritics(F.col("text")).alias("folded")).collect():
        assert r["touched"] == (r["i"] >= len(plain)), r["text"]
        assert r["touched"] or said[r["i"]] == r["folded"], r["text"]
