"""Chunk planning under a symbol cap, and encoding to ids."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.shared import stored

CAP = 510


def _halves(parts: Column, cap: int) -> Column:
    """Pieces over the cap cut in the middle of their words; a single word over the cap is dropped."""

    def cut(p: Column) -> Column:
        words = F.split(p, " ")
        mid = (F.size(words) / 2).cast("int")
        over = F.when(F.size(words) == 1, F.array().cast("array<string>")).otherwise(F.array(F.array_join(F.slice(words, F.lit(1), mid), " "), F.array_join(F.slice(words, mid + 1, F.size(words)), " ")))
        return F.when(F.char_length(p) <= cap, F.array(p)).otherwise(over)

    return F.flatten(F.transform(parts, cut))


def enforce_cap(utterances: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc_id, sent_idx, piece_idx, phonemes): a sentence over the cap is cut at commas, then by halves until all pieces fit.

    Each round leaves at most half as many words in a piece, so a row of n words takes log2(n) + 1 rounds, all in the row."""
    pieces = F.filter(F.transform(F.split("phonemes", ","), lambda p: F.trim(p)), lambda p: p != "")
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(F.split("phonemes", " ")))).cast("int"))
    cut = F.aggregate(rounds, pieces, lambda ps, _: _halves(ps, cap))
    parts = F.when(F.char_length("phonemes") <= cap, F.array("phonemes")).otherwise(cut)
    return utterances.select("doc_id", "sent_idx", F.posexplode(parts).alias("piece_idx", "phonemes"))


def cap_text(sentences: DataFrame, speak: Callable[[DataFrame], DataFrame], cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """C1 over text: (pieces, dropped). Pieces are (doc_id, sent_idx, piece_idx, text, phonemes) of sentences (doc_id, sent_idx, text); ``speak`` turns
    rows (doc_id, sent_idx, text) into (doc_id, sent_idx, phonemes), whatever the type of doc_id.

    Only what is over the cap goes on: a sentence is cut at its commas, then each part into halves by words, and every part is
    spoken anew, for its words may sound otherwise beside others. A round halves the words of a piece, so the longest takes
    log2 of its words; the frame of a round shrinks and is written before the next. Single words over the cap are dropped."""
    longer = F.char_length("phonemes") > cap
    at = F.struct("doc_id", "sent_idx", "path")
    rows = sentences.select("doc_id", "sent_idx", F.array(F.lit(0)).alias("path"), "text")
    done, lost = None, None
    for i in itertools.count():
        said = speak(rows.select(at.alias("doc_id"), F.lit(0).alias("sent_idx"), "text")).select(F.col("doc_id").alias("at"), "phonemes")
        said = stored(rows.withColumn("at", at).join(said, "at").where("phonemes <> ''").drop("at"), "spoken")
        fits = said.where(~longer).select("doc_id", "sent_idx", "path", "text", "phonemes")
        words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
        over = said.where(longer).withColumn("words", words)
        single = over.where(F.size("words") <= 1).select("doc_id", "sent_idx", "text", "phonemes")
        done, lost = (fits, single) if done is None else (done.unionByName(fits), lost.unionByName(single))
        mid = F.floor(F.size("words") / 2).cast("int")
        cut = F.array(F.array_join(F.slice("words", F.lit(1), mid), " "), F.array_join(F.slice("words", mid + 1, F.size("words")), " "))
        if i == 0:
            commas = F.filter(F.transform(F.split("text", ","), lambda p: F.trim(p)), lambda p: p != "")
            cut = F.when(F.size(commas) > 1, commas).otherwise(cut)
            over = over.where((F.size("words") > 1) | (F.size(commas) > 1))
            lost = single.join(over.select("doc_id", "sent_idx"), ["doc_id", "sent_idx"], "left_anti")
        else:
            over = over.where(F.size("words") > 1)
        rows = stored(over.select("doc_id", "sent_idx", "path", F.posexplode(cut).alias("i", "text")).select("doc_id", "sent_idx", F.concat("path", F.array("i")).alias("path"), "text"), "over-cap")
        if rows.isEmpty():
            break
    order = Window.partitionBy("doc_id", "sent_idx").orderBy("path")
    return done.select("doc_id", "sent_idx", (F.row_number().over(order) - 1).alias("piece_idx"), "text", "phonemes"), lost


def chunk_stats(utterances: DataFrame, cap: int = CAP) -> DataFrame:
    n = F.char_length("phonemes")
    return utterances.agg(F.count("*").alias("chunks"), F.sum(n).alias("symbols"), F.count_if(n > cap).alias("over_cap"), F.count_if(n == 0).alias("empty"), F.max(n).alias("longest"))


#: Symbols that a vocabulary may have at most: it travels as one literal.
MOST_SYMBOLS = 1 << 16


def _ids(vocab: DataFrame) -> Callable[[Column], Column]:
    """The id of a symbol by the vocabulary (symbol, id), after a check of its size; null for others. A list by code point is asked in one
    step, where a map looks through all its keys; symbols beyond the list's last place are few and stay in a map."""
    rows = vocab.select("symbol", F.col("id").cast("long")).limit(MOST_SYMBOLS + 1).collect()
    if len(rows) > MOST_SYMBOLS:
        raise ValueError(f"more than {MOST_SYMBOLS} symbols")
    known = {ord(k): v for k, v in rows if k is not None and len(k) == 1}
    near = {k: v for k, v in known.items() if k < MOST_SYMBOLS}
    far = {chr(k): v for k, v in known.items() if k >= MOST_SYMBOLS}
    listed = F.from_json(F.lit(json.dumps([near.get(i) for i in range(max(near, default=0) + 1)])), "array<bigint>")
    if not far:
        return lambda c: F.get(listed, F.ascii(c))
    mapped = F.from_json(F.lit(json.dumps(far, ensure_ascii=False)), "map<string,bigint>")
    return lambda c: F.when(F.ascii(c) < MOST_SYMBOLS, F.get(listed, F.ascii(c))).otherwise(F.element_at(mapped, c))


def phonemes_to_ids(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, ids, dropped): symbols without an id are left out and counted. All in the row, no shuffle."""
    known = _ids(vocab)
    symbols = F.when(F.col("phonemes") == "", F.array().cast("array<string>")).otherwise(F.split("phonemes", ""))
    found = pieces.select("doc_id", "sent_idx", bind(F.transform(symbols, known), lambda ids: F.struct(F.size(ids).alias("n"), F.array_compact(ids).alias("ids"))).alias("x"))
    return found.select("doc_id", "sent_idx", F.col("x.ids").alias("ids"), (F.col("x.n") - F.size("x.ids")).cast("long").alias("dropped"))


def unmapped_symbols(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """(symbol, n): only symbols without an id leave their row."""
    known = _ids(vocab)
    strange = F.filter(F.split("phonemes", ""), lambda c: (c != "") & known(c).isNull())
    return pieces.select(F.explode(strange).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def pad_and_check(ids: DataFrame, context: int = 512) -> DataFrame:
    error = F.when(F.size("ids") == 0, "empty").when(F.size("ids") + 2 > context, "too long")
    zero = F.array(F.lit(0).cast("long"))
    return ids.withColumn("error", error).withColumn("padded", F.when(F.col("error").isNull(), F.concat(zero, "ids", zero)))


def select_style_row(utterances: DataFrame, voices: DataFrame) -> DataFrame:
    """The voice row (voice, n, style) of each utterance (voice, n_symbols): that of its length, or the last."""
    last = voices.groupBy("voice").agg(F.max("n").alias("max_n"))
    keyed = utterances.join(last, "voice").withColumn("n", F.least("n_symbols", "max_n")).drop("max_n")
    return keyed.join(voices, ["voice", "n"])
