"""Tokens, their rendering, and vocabulary reports."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

TOKEN = r"[A-Za-z'’-]+|[,.!?;:“”—…]"
MARKS = ",.!?;:“”—…"
#: What a word follows without a blank.
OPENING = " ([{“‘—…"


def tokenize(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, tok_idx, kind, token, word_idx) of sentences (doc_id, sent_idx, text). Words are numbered inside the row; punctuation has no word_idx."""
    is_word = lambda x: ~x["t"].isin(*MARKS)
    text = F.replace("text", F.lit("’"), F.lit("'"))
    at = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    row = lambda x, kind, k: F.struct(x["i"].alias("tok_idx"), F.lit(kind).alias("kind"), x["t"].alias("token"), k.alias("word_idx"))
    words = lambda xs: F.transform(F.filter(xs, is_word), lambda x, k: row(x, "word", k))
    marks = lambda xs: F.transform(F.filter(xs, lambda x: ~is_word(x)), lambda x: row(x, "punct", F.lit(None).cast("int")))
    return sentences.select("doc_id", "sent_idx", F.inline(bind(at, lambda xs: F.concat(words(xs), marks(xs)))))


#: What is neither in a word nor a blank; nor a mark.
_NO_WORD, _NO_TOKEN = re.compile(r"[^A-Za-z'\s-]+"), re.compile(rf"[^A-Za-z'\s{re.escape(MARKS)}-]+")


def spelled_words(text: str) -> list[str]:
    """The words of a text in order, in Python: what is cut away is searched for, which takes less time than every word would."""
    return _NO_WORD.sub(" ", text.replace("’", "'")).split()


def tokens_of(text: str | None) -> list[str]:
    """The tokens of a text in order, in Python."""
    text = (text or "").replace("’", "'")
    if _NO_TOKEN.search(text):
        text = _NO_TOKEN.sub(" ", text)
    for m in MARKS:
        if m in text:
            text = text.replace(m, f" {m} ")
    return text.split()


def words_of(text: Column | str) -> Column:
    """The words of a text in order, without the other tokens."""
    return F.regexp_extract_all(F.replace(text, F.lit("’"), F.lit("'")), F.lit("[A-Za-z'-]+"), F.lit(0))


def lettered(text: Column) -> Column:
    """Whether all words of a text hold a letter. They are then the same in the text and in its sentences: no sentence ends inside a word,
    and a sentence is left out only if it has neither letter nor digit."""
    return ~text.rlike("['’-](?<![A-Za-z'’-].)['’-]*(?![A-Za-z'’-])")


def word_index(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, word_idx, word): words only, numbered inside each sentence without a shuffle."""
    return sentences.select("doc_id", "sent_idx", F.posexplode(words_of("text")).alias("word_idx", "word"))


#: Different words that a task counts before it hands them on.
COUNTED = 1 << 17


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = Counter()
    handed_on = lambda: pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])
    for batch in batches:
        n.update(itertools.chain.from_iterable(map(spelled_words, filter(None, batch.column(0).to_pylist()))))
        if len(n) >= COUNTED:
            yield handed_on()
            n.clear()
    yield handed_on()


def word_totals(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of texts (text), by exact spelling. They are counted within each task first: a word by itself never becomes a row."""
    counted = texts.select("text").mapInArrow(_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def render_phonemes(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, phonemes) from (doc_id, sent_idx, tok_idx, kind, ipa): words spaced, punctuation glued. A token needs only the one
    before it, so a row takes time in proportion to its tokens."""
    parts = tokens.groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "kind", "ipa"))).alias("ts"))
    # silent punctuation leaves no trace; after a silent word there is a blank already, or nothing to part from
    heard = F.filter("ts", lambda t: F.coalesce((t["ipa"] != "") | (t["kind"] == "word"), F.lit(True)))

    def whole(ts: Column) -> Column:
        def said(t: Column, i: Column) -> Column:
            before = F.get(ts, i - 1)["ipa"]
            return F.concat(F.when((t["kind"] == "word") & (i > 0) & (before != "") & ~before.rlike(rf"[{re.escape(OPENING)}]$"), " ").otherwise(""), t["ipa"])

        return F.when(~F.exists(ts, lambda t: t["ipa"].isNull()), F.array_join(F.transform(ts, said), ""))

    # not a condition on the column, which would be pushed down and have it all worked out twice
    return parts.select("doc_id", "sent_idx", F.explode(F.filter(F.array(bind(heard, whole)), lambda p: p != "")).alias("phonemes"))


def word_frequencies(words: DataFrame) -> DataFrame:
    """(word, n) of words, whatever their case; rows that were counted before have their number in n."""
    n = F.sum("n") if "n" in words.columns else F.count("*")
    return words.groupBy(F.lower("word").alias("word")).agg(n.alias("n"))


def dictionary_filter(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct words that the lexicon holds."""
    return words.select(F.lower("word").alias("word")).distinct().join(lexicon.select("word").distinct(), "word", "left_semi")


def emphasis_filter(words: DataFrame, gold: DataFrame, phones: DataFrame) -> DataFrame:
    """Distinct words long enough for an all-caps reading: 3 letters in the gold lexicon, 6 in the other."""
    types = words.select(F.lower("word").alias("word")).distinct()
    a = types.where(F.length("word") >= 3).join(gold.select("word"), "word", "left_semi")
    b = types.where(F.length("word") >= 6).join(phones.select("word"), "word", "left_semi")
    return a.union(b).distinct()


def lexicon_coverage(words: DataFrame, gold: DataFrame, phones: DataFrame) -> DataFrame:
    """(tier, types, tokens): which lexicon answers for how many words, first match winning."""
    f = word_frequencies(words)
    joined = f.join(gold.select("word", F.lit(1).alias("g")).distinct(), "word", "left").join(phones.select("word", F.lit(1).alias("p")).distinct(), "word", "left")
    tier = F.when(F.col("g") == 1, "gold").when(F.col("p") == 1, "phones").otherwise("oov")
    return joined.groupBy(tier.alias("tier")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))
