"""Toxicity by the nearest labelled examples.

Fitting, on a bounded sample of labelled rows (at most PER_CLASS of each class, those of least hash): every word of
every example is a feature. A word's weight is ln((1 + N) / df) * G ** POWER: its inverse document frequency times a power of its G
statistic, which tells how unevenly it falls on the two classes, to whichever side it leans. No word is left out.
An example is its vector of (1 + ln tf) * weight, at unit length. Plain inverse document frequency fails here:
insults are more frequent than most words of a text, so the nearest texts share chance words with it (README).

Index: the postings of the words; for words of more than LONG examples also the largest weight in each block of
BLOCK examples. Examples of the same strongest word lie in the same blocks. Search: the words of a text that may add
most are added up over their postings, until the others together can add little beside the K-th best sum; the largest
weights of these bound the rest block by block, and the examples whose bound reaches the K-th best sum are worked out
in full. The result is exact.

Score: the neighbours vote with the square of their cosine as weight, corrected for how their class was sampled,
and the rate of toxic rows counts as PRIOR further votes. The three nearest are the evidence.

Defined results: null, empty and wordless texts, and those that share no word with an example, get the rate of
toxic rows and no evidence; repeated rows get equal scores; ties go to the examples of least hash, then id; without
labelled rows the score is 0; labels without a toxic value and ids without a document are ignored; an id labelled
twice counts as toxic if one label says so; an id with several texts is learned from the one of least hash; very
long texts are read whole. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, stored, table

PER_CLASS, K, PRIOR, POWER, EVIDENCE = 1000, 10, 0.5, 2, 3
#: Examples of a block, frequency from which a word's largest weights are kept by block, words of the first round, share of the K-th cosine left to bounds.
BLOCK, LONG, FIRST, REST = 32, 64, 24, 0.25
_ODD = re.compile(r"[^\x00-\x7F\w]")  # no letter or digit, beyond ASCII
_ASCII = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, lower-cased, as UTF-8."""
    return _ODD.sub(" ", text.lower()).encode().translate(_ASCII).split() if text else []


@dataclass
class Model:
    """The examples as postings: plain bounded data that can be broadcast."""

    words: list[str]
    weights: np.ndarray  # by word
    starts: np.ndarray  # of each example's part of feats and values
    feats: np.ndarray
    values: np.ndarray
    ids: np.ndarray  # of the examples, in order of hash
    toxic: np.ndarray
    class_weight: tuple[float, float]
    rate: float


def _slices(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the parts ``at`` of a table cut by starts, and their lengths."""
    lengths = starts[at + 1] - starts[at]
    ends = np.cumsum(lengths)
    return np.repeat(starts[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0), lengths


class BlockMaxIndex:
    """Examples (rows of starts, feats, values; unit vectors) for exact searches of the greatest cosines."""

    def __init__(self, starts: np.ndarray, feats: np.ndarray, values: np.ndarray, n_features: int):
        n = len(starts) - 1
        strongest = np.array([feats[a + np.argmax(values[a:b])] if b > a else -1 for a, b in zip(starts[:-1], starts[1:], strict=True)], np.int64)
        self.rank = np.lexsort((np.arange(n), strongest))  # place in the blocks -> example
        places, lengths = _slices(starts, self.rank)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.feats, self.values = feats[places], values[places]
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        example = np.repeat(np.arange(n), lengths)
        order = np.argsort(self.feats, kind="stable")
        df = np.bincount(self.feats, minlength=n_features)
        self.post_starts = np.concatenate([[0], np.cumsum(df)])
        self.post_examples, self.post_values = example[order], self.values[order]
        self.row = np.full(n_features, -1)  # of the long features in largest
        long_ = np.flatnonzero(df > LONG)
        self.row[long_] = np.arange(len(long_))
        self.largest = np.zeros((len(long_), self.blocks))
        rows = self.row[self.feats]
        np.maximum.at(self.largest, (rows[rows >= 0], example[rows >= 0] // BLOCK), self.values[rows >= 0])
        self.greatest = np.zeros(n_features)
        np.maximum.at(self.greatest, self.feats, self.values)
        self.query = np.zeros(n_features)

    def _added(self, feats: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What these words add to each example's cosine."""
        places, lengths = _slices(self.post_starts, feats)
        return np.bincount(self.post_examples[places], np.repeat(q, lengths) * self.post_values[places], self.n).astype(float)

    def search(self, feats: np.ndarray, q: np.ndarray, k: int = K) -> list[tuple[int, float]]:
        """(example, cosine) of the k greatest cosines, ties to the lower example; only cosines above 0."""
        if not self.n or not len(feats):
            return []
        most = q * self.greatest[feats]
        order = np.argsort(-most, kind="stable")
        left = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])  # the most that the words from each place on add
        cosines = self._added(feats[order[:FIRST]], q[order[:FIRST]])
        kth = lambda x: np.partition(x, -k)[-k] if self.n >= k else 0.0
        cut = max(min(FIRST, len(order)), int(np.argmax(left <= kth(cosines) * REST)))
        if cut > FIRST:
            cosines += self._added(feats[order[FIRST:cut]], q[order[FIRST:cut]])
        rest = order[cut:]
        rows = self.row[feats[rest]]
        by_block = q[rest[rows >= 0]] @ self.largest[rows[rows >= 0]] + most[rest[rows < 0]].sum()
        bound = (cosines + np.repeat(by_block, BLOCK)[: self.n]) * (1 + 1e-9) + 1e-12
        at = np.flatnonzero(bound >= max(kth(cosines), 2e-12))
        if not len(at):
            return []
        self.query[feats] = q
        places, lengths = _slices(self.starts, at)
        exact = np.add.reduceat(self.query[self.feats[places]] * self.values[places], np.cumsum(lengths) - lengths)
        self.query[feats] = 0.0
        best = np.lexsort((self.rank[at], -exact))[:k]
        return [(int(self.rank[at[i]]), float(exact[i])) for i in best if exact[i] > 1e-12]


class Scorer:
    """Scores texts with a model."""

    def __init__(self, model: Model):
        self.m = model
        self.number = {w.encode(): i for i, w in enumerate(model.words)}
        self.index = BlockMaxIndex(model.starts, model.feats, model.values, len(model.words))

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features and weights of a text, at unit length."""
        found = np.fromiter(map(self.number.get, words_of(text), repeat(-1)), np.int64)
        feats, tf = np.unique(found[found >= 0], return_counts=True)
        q = (1 + np.log(tf)) * self.m.weights[feats]
        feats, q = feats[q > 0], q[q > 0]
        return feats, q / math.sqrt(float(q @ q)) if len(q) else q

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """(score, neighbours): neighbours are (example, cosine), the nearest first."""
        near = self.index.search(*self.query(text))
        votes = [0.0, 0.0]
        for e, s in near:
            votes[self.m.toxic[e]] += s * s * self.m.class_weight[self.m.toxic[e]]
        return (votes[1] + PRIOR * self.m.rate) / (sum(votes) + PRIOR), near


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [Counter(words_of(t)) for t in b.column(3).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
        words = pa.array([w.decode() for c in counts for w in c], pa.string())
        tf = pa.array([n for c in counts for n in c.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), words, tf], ["h", "id", "y", "word", "tf"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels(doc_id, toxic): the rows that may be learned from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    known = stored(known.join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi"), "toxicity-labels")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):  # two bounded top-k sorts, done by each task on its own rows first
        part = known.where(F.col("y") == y).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(PER_CLASS)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).join(F.broadcast(chosen), "id")  # at most PER_CLASS rows of each class
    texts = texts.groupBy("id", "y", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    terms = stored(map_arrow(texts.select("h", "id", "y", "text"), _terms, "h long, id long, y int, word string, tf long"), "toxicity-terms")
    n0, n1 = (min(totals.get(y, 0), PER_CLASS) for y in (0, 1))
    df = terms.groupBy("word").agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b"))
    share = (F.col("a") + F.col("b")) / max(n0 + n1, 1)
    part = lambda o, e: F.when(o > 0, o * F.ln(o / e)).otherwise(F.lit(0.0))
    g = 2 * sum((part(o, e) for o, e in ((F.col("a"), share * n0), (F.col("b"), share * n1), (n0 - F.col("a"), (1 - share) * n0), (n1 - F.col("b"), (1 - share) * n1))), F.lit(0.0))
    weighted = df.select("word", (F.ln((1 + n0 + n1) / (F.col("a") + F.col("b"))) * F.pow(F.greatest(g, F.lit(0.0)), F.lit(POWER))).alias("weight"))
    vectors = terms.join(weighted, "word").select("h", "id", "y", "word", "weight", ((1 + F.ln("tf")) * F.col("weight")).alias("v"))
    t = vectors.toArrow()  # the distinct words of at most 2 * PER_CLASS texts
    return _arranged(t, totals, (n0, n1))


def _arranged(t: pa.Table, totals: dict[int, int], sampled: tuple[int, int]) -> Model:
    """The vectors (h, id, y, word, weight, v) as a model, examples in order of hash and words in code point order."""
    h, ids, y, weight, v = (t.column(c).to_numpy() for c in ("h", "id", "y", "weight", "v"))
    coded = t.column("word").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    by_name = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[by_name] = np.arange(len(names))
    feats = place[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.empty(0, np.int64)
    weights = np.zeros(len(names))
    weights[feats] = weight
    order = np.lexsort((feats, ids, h))
    h, ids, y, v, feats = h[order], ids[order], y[order], v[order], feats[order]
    new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
    starts = np.r_[new, len(ids)].astype(np.int64)
    norms = np.sqrt(np.add.reduceat(v * v, new)) if len(new) else np.empty(0)
    values = v / np.repeat(np.where(norms > 0, norms, 1.0), np.diff(starts))
    class_weight = tuple(totals.get(c, 0) / n if n else 1.0 for c, n in enumerate(sampled))
    rate = totals.get(1, 0) / max(totals.get(0, 0) + totals.get(1, 0), 1)
    return Model([names[i] for i in by_name], weights, starts, feats, values, ids[new], y[new], class_weight, rate)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, m = Scorer(shared.value), shared.value
        for b in batches:
            got = [scorer.score(t) for t in b.column(1).to_pylist()]
            evidence = pa.array([[{"doc_id": int(m.ids[e]), "toxic": int(m.toxic[e]), "cosine": s} for e, s in near[:EVIDENCE]] for _, near in got], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    out = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, evidence array<struct<doc_id: long, toxic: int, cosine: double>>")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score as a column, for filters that keep all columns of their input."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for s in batches:
            yield pd.Series([scorer.score(t)[0] for t in s], dtype="float64")

    return toxic_score(text)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
