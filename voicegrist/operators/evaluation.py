"""Scores of references against hypotheses, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.normalize import normalize_corpus, normalize_with_lexicon


def normalized_words(text: Column) -> Column:
    """Lower-cased words with all but letters and digits turned into blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: w != "")


def _joins_free(ref: list[str], hyp: list[str]) -> int:
    """Edit distance of words in which two words against their joined form cost nothing: one vectorised row for each word of ref."""
    number: dict[str, int] = {}
    of = lambda words: np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    h, pairs = of(hyp), of([a + b for a, b in zip(hyp, hyp[1:], strict=False)])
    place = np.arange(len(hyp) + 1)
    before, last = None, place
    for i, word in enumerate(ref):
        row = last + 1
        if len(hyp):
            row[1:] = np.minimum(row[1:], last[:-1] + (h != of([word])[0]))
            if len(hyp) > 1:
                row[2:] = np.where(pairs == number[word], np.minimum(row[2:], last[:-2]), row[2:])
            if before is not None:
                row[1:] = np.where(h == of([ref[i - 1] + word])[0], np.minimum(row[1:], before[:-1]), row[1:])
        row = np.minimum.accumulate(row - place) + place  # words left out of ref
        before, last = last, row
    return int(last[-1])


def _edits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ref, hyp in batches:
        yield pd.Series([_joins_free(list(r), list(h)) for r, h in zip(ref, hyp, strict=True)], dtype="int32")


def word_edit_distance(ref: Column | str, hyp: Column | str) -> Column:
    return F.pandas_udf(_edits, IntegerType())(ref, hyp)


def wer(pairs: DataFrame, lexicons: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(idx, edits, denom, wer) of (idx, ref, hyp), both normalised (with the words of lexicons, where given): edits over the longer side, joins free."""
    p = pairs.select("idx", "ref", "hyp")
    for side in ("ref", "hyp"):
        p = normalize_with_lexicon(p, ["idx"], side, *lexicons) if lexicons else normalize_corpus(p, side)
    w = p.select("idx", normalized_words(F.col("ref")).alias("r"), normalized_words(F.col("hyp")).alias("h"))
    edits = w.select("idx", word_edit_distance("r", "h").alias("edits"), F.greatest(F.size("r"), F.size("h")).alias("denom"))
    return edits.withColumn("wer", F.coalesce(F.try_divide("edits", "denom"), F.lit(0.0)))


def wer_plain(pairs: DataFrame) -> DataFrame:
    """(idx, edits, ref_words, wer): words become code points, so levenshtein counts words."""
    w = pairs.select("idx", normalized_words(F.col("ref")).alias("r"), normalized_words(F.col("hyp")).alias("h"))
    names = F.array_distinct(F.concat("r", "h"))
    # words as code points: from 4E00 up to the surrogates, then from 10000
    point = lambda i: F.when(i < 35_328, i + 19_968).otherwise(i - 35_328 + 65_536)
    coded = lambda ws: F.array_join(F.transform(ws, lambda x: F.decode(F.unhex(F.lpad(F.hex(point(F.array_position("names", x))), 8, "0")), "UTF-32")), "")
    e = w.withColumn("names", names).select("idx", F.levenshtein(coded("r"), coded("h")).alias("edits"), F.size("r").alias("ref_words"), F.size("h").alias("hyp_words"))
    rate = F.when(F.col("ref_words") == 0, (F.col("hyp_words") > 0).cast("double")).otherwise(F.col("edits") / F.col("ref_words"))
    return e.select("idx", "edits", "ref_words", rate.alias("wer"))


def wer_summary(scores: DataFrame) -> DataFrame:
    """One row: micro WER, WER of the defective only, samples, empty ones, total edits."""
    bad = F.col("edits") > 0
    return scores.agg(
        F.count("*").alias("samples"),
        F.sum("edits").alias("edits"),
        F.coalesce(F.try_divide(F.sum("edits"), F.sum("denom")), F.lit(0.0)).alias("micro_wer"),
        F.coalesce(F.try_divide(F.sum(F.when(bad, F.col("edits"))), F.sum(F.when(bad, F.col("denom")))), F.lit(0.0)).alias("defective_wer"),
        F.count_if(F.col("denom") == 0).alias("empty"),
    )


def wer_macro(scores: DataFrame, gate: float = 0.90) -> DataFrame:
    mean = F.avg("wer")
    return scores.agg(mean.alias("mean_wer"), (1 - mean).alias("agreement"), (1 - mean >= gate).alias("passed"))


def select_lines(lines: DataFrame, ranges: DataFrame, cell: int = 1024) -> DataFrame:
    """Lines (idx, text) inside any inclusive range (lo, hi): ranges go to the cells they touch, so lines meet them by an equi join."""
    cells = ranges.where("lo <= hi").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    return lines.join(cells, (F.floor(lines["idx"] / cell) == cells["cell"]) & (lines["idx"] >= cells["lo"]) & (lines["idx"] <= cells["hi"]), "left_semi")


def parse_ranges(spec: str) -> list[tuple[int, int]]:
    """``5,10-20`` -> [(5, 5), (10, 20)]."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, _, hi = part.partition("-")
        out.append((int(lo), int(hi or lo)))
    return out


def ipa_similarity(a: Column, b: Column, byte_lengths: bool = False) -> Column:
    """1 - edits / length of the longer, at least 0. byte_lengths measures length in bytes of UTF-8, edits still in characters."""
    size = F.octet_length if byte_lengths else F.char_length
    x, y = (F.regexp_replace(c, "[\\s_ː]", "") for c in (a, b))
    longest = F.greatest(size(x), size(y))
    return F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / longest))


def similarity_summary(scores: DataFrame, threshold: float = 0.70) -> DataFrame:
    """One row from (idx, score): mean, first case below 1, gate."""
    first = F.min(F.when(F.col("score") < 1, F.col("idx")))
    return scores.agg(F.count("*").alias("total"), F.avg("score").alias("mean_score"), first.alias("first_mismatch"), (F.avg("score") >= threshold).alias("passed"))


def exact_match_summary(pairs: DataFrame, gate: float = 1.0) -> DataFrame:
    """One row from (idx, expected, actual)."""
    same = F.col("expected").eqNullSafe(F.col("actual"))
    return pairs.agg(F.count("*").alias("total"), F.count_if(same).alias("exact"), F.avg(same.cast("double")).alias("accuracy"), F.min(F.when(~same, F.col("idx"))).alias("first_mismatch"), (F.avg(same.cast("double")) >= gate).alias("passed"))


def array_deltas(pairs: DataFrame) -> DataFrame:
    """(idx, max_abs, mean_abs) of numeric arrays a and b."""
    d = F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return pairs.select("idx", d.alias("d")).select("idx", F.array_max("d").alias("max_abs"), (F.aggregate("d", F.lit(0.0), lambda t, x: t + x) / F.size("d")).alias("mean_abs"))


def mismatch_count(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: places that differ or are on one side only."""
    r = right.select(*keys, F.col(value).alias("other"))
    return left.select(*keys, value).join(r, keys, "full_outer").agg(F.count("*").alias("places"), F.count_if(~F.col(value).eqNullSafe(F.col("other"))).alias("mismatches"))
