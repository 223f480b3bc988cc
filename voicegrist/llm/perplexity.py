"""Quality rules: simple counts, and the perplexity of a modified Kneser-Ney model of each language.

The model is over characters inside words, of order ORDER: a word is spelled between a mark of its begin and one of its end, and each
character and the end are foretold from up to three characters before. Word n-grams of a corpus are mostly distinct, so counting and
looking them up would shuffle every text several times over; of n-grams inside words, what is shuffled is a row for each
different one of a task.

Counting (all documents, nothing sampled or cut): tasks send (lang, key, n), a key holding four 15-bit hashes of characters (the
character itself below 2^14). Spark adds them up; the counts of the lower orders are continuation counts, how many different
characters precede. Discounts come from the counts of counts of each language and order, and probabilities of an order from
those of the order below, by joins on keys. The result is a table of (lang, key, value).

Scoring: keys and values become sorted arrays, searched by halving. With at most MOST_ENTRIES rows the model goes to all tasks, a
bounded broadcast; a larger one stays in Spark: texts are dealt to blocks, each block asks for the keys that its words need,
the answers and the texts meet in the block's task. Both ways give the same numbers.

Rules: a text fails with fewer than MIN_WORDS words, or with more than 30 % of its words in 8-word windows that recur in it. Of the
others, those whose log perplexity (per character) is outside the band of their language are rejected: the quartiles of all
texts of the language that pass the first rules, FENCE times the distance between the quartiles further out.

Defined results: null text has no words; a null language is one of its own, not equal to the empty one; texts of fewer than
MIN_WORDS words are not kept; repeated rows count each time and are judged alike; very long texts are scored whole; a
language all of whose texts have one perplexity has a band of SLACK around it; an empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, map_arrow, mixed, prefix_sums, run_hashes, small_batches, stored, table

ORDER, BITS = 4, 15
BEGIN, END, NUL = 32, 10, 9  # code points that no word holds
#: n-grams held by a task before it sends its counts on; characters worked on together.
MOST_KEYS, CHUNK = 1 << 20, 1 << 18
#: Rows of a model that is sent to all tasks: 16 bytes each.
MOST_ENTRIES = 1 << 21
#: Texts of a block (on average) where the model is larger.
BLOCK_TEXTS = 20_000
MIN_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30
FENCE, SLACK = 4.0, 0.05
SYMBOLS = "#*$%&|<>"
PROB, BACKOFF, UNSEEN = 0, 1, 2  # kinds of model rows


def language(lang: Column) -> Column:
    """Never null: the language after a mark."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang))


_WHITE = np.array([i == 32 or 9 <= i <= 13 for i in range(34)])


class Spelled:
    """Texts of one language as characters: for each that is foretold (characters of words, and their ends) the key of the longest
    n-gram that ends there, and the number of its text."""

    def __init__(self, texts: list[str]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        code = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        white = _WHITE[np.minimum(code, 33)]
        high = 1 << BITS - 1
        if code.max() >= high:
            code = np.where(code < high, code, high + (code.astype(np.int64) * 2654435761 >> 8) % high)
        self.code, self.white = np.where(code == 0, NUL, code).astype(np.int64), white
        foretold = np.flatnonzero(~(white[1:] & white[:-1])) + 1
        begin = np.maximum.accumulate(np.where(white, np.arange(len(code)), 0))
        place = foretold - begin[foretold - 1]
        before = np.where(white, BEGIN, self.code)
        self.key = np.where(white[foretold], END, self.code[foretold]) + (before[foretold - 1] << BITS)
        for k in range(2, ORDER):
            self.key += np.where(place >= k, before[np.maximum(foretold - k, 0)] << BITS * k, 0)
        #: place of the first character of each text, and behind the last
        self.edges = np.concatenate([[1], 1 + np.cumsum(lengths)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(foretold, self.edges)))

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where those of each text begin and end."""
        starts = np.flatnonzero(~self.white[1:] & self.white[:-1]) + 1
        ends = np.flatnonzero(self.white[1:] & ~self.white[:-1]) + 1
        sums = prefix_sums(mixed(self.code.astype(np.uint64)))
        return run_hashes(sums, starts, ends), np.searchsorted(starts, self.edges)


def chunks(langs: list[str], texts: list[str | None]) -> Iterator[tuple[str, list[int], list[str]]]:
    """(lang, rows, texts): rows of one language, about CHUNK characters of them at a time."""
    held: dict[str, tuple[list[int], list[str]]] = {}
    size: Counter = Counter()
    for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        rows, own = held.setdefault(lang, ([], []))
        rows.append(i)
        own.append(text or "")
        size[lang] += len(own[-1])
        if size[lang] >= CHUNK:
            yield lang, *held.pop(lang)
            del size[lang]
    yield from ((lang, *x) for lang, x in held.items())


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) of the longest n-gram of each character of docs(lang, text), added up within tasks first."""

    def rows(lang: str, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "key", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            new: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}
            for lang, _, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, n = np.unique(Spelled(texts).key, return_counts=True)
                keys, counts = new.setdefault(lang, ([], []))
                keys.append(key)
                counts.append(n)
            for lang, (keys, counts) in new.items():
                key, n = held.get(lang, (np.empty(0, np.int64), np.empty(0, np.int64)))
                held[lang] = _added([key, *keys], [n, *counts])
            if sum(len(key) for key, _ in held.values()) > MOST_KEYS:
                yield from (rows(lang, *x) for lang, x in held.items())
                held = {}
        yield from (rows(lang, *x) for lang, x in held.items())

    return map_arrow(docs.select("lang", "text"), count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _last(k: int) -> Column:
    """The last k characters of a key."""
    return F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1))


def _of_order(k: int) -> Column:
    return (F.col("key") >= F.lit(1 << BITS * (k - 1))) & (F.col("key") < F.lit(1 << BITS * k))


def adjusted_counts(counts: DataFrame) -> DataFrame:
    """(lang, key, size, a): counts of the n-grams of the highest order and of those from the begin of a word; of the others, how many different characters precede."""
    level = counts.where(_of_order(ORDER)).select("lang", "key", F.col("n").alias("a"))
    out = level.withColumn("size", F.lit(ORDER))
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", _last(k).alias("key")).agg(F.count("*").alias("a"))
        if k > 1:
            level = level.unionByName(counts.where(_of_order(k)).select("lang", "key", F.col("n").alias("a")))
        level = stored(level, f"ngrams-{k}")
        out = out.unionByName(level.withColumn("size", F.lit(k)))
    return out


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, kind, key, value): log probabilities, log weights of contexts, and under key 0 the log probability of an unseen character."""
    ones = [F.count_if(F.col("a") == i).alias(f"t{i}") for i in range(1, 5)]
    t = [F.col(f"t{i}").cast("double") for i in range(1, 5)]
    y = F.try_divide(t[0], t[0] + 2 * t[1])
    raw = [F.when((t[i] > 0) & (t[i + 1] > 0), (i + 1) - (i + 2) * y * F.try_divide(t[i + 1], t[i])) for i in range(3)]
    # where too few n-grams are seen to tell, the usual values
    discounts = grams.groupBy("lang", "size").agg(*ones).select("lang", "size", *[F.coalesce(F.when((d > 0) & (d < i + 1), d), F.lit((i + 1) / 2)).alias(f"d{i + 1}") for i, d in enumerate(raw)])
    known = grams.join(discounts, ["lang", "size"])
    d = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    known = stored(known.select("lang", "key", "size", "a", d.alias("d"), F.shiftright("key", BITS).alias("context")), "ngrams")
    # sums of three discounts, each times a number of n-grams: the same in any order
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "n"))))
    by_d = known.groupBy("lang", "size", "context", "d").agg(F.count("*").alias("n"), F.sum("a").alias("a"))
    contexts = by_d.groupBy("lang", "size", "context").agg(F.sum("a").alias("total"), F.aggregate(F.map_entries(parts), F.lit(0.0), lambda s, x: s + x["key"] * x["value"]).alias("taken"))
    contexts = stored(contexts.withColumn("weight", F.col("taken") / F.col("total")), "contexts")
    letters = known.where("size = 1").groupBy("lang").agg((F.count("*") + 1).alias("letters"))
    below = letters.select("lang", (1 / F.col("letters")).alias("p"))
    unseen = contexts.where("size = 1").join(below, "lang").select("lang", F.lit(UNSEEN).alias("kind"), F.lit(0).cast("long").alias("key"), F.log(F.col("weight") * F.col("p")).alias("value"))
    out = contexts.select("lang", F.lit(BACKOFF).alias("kind"), F.col("context").alias("key"), F.log("weight").alias("value")).unionByName(unseen)
    for k in range(1, ORDER + 1):
        own = known.where(F.col("size") == k).join(contexts.where(F.col("size") == k).select("lang", "context", "total", "weight"), ["lang", "context"])
        own = own.withColumn("shorter", _last(k - 1) if k > 1 else F.lit(0).cast("long"))
        lower = below.withColumn("shorter", F.lit(0).cast("long")) if k == 1 else below.withColumnRenamed("key", "shorter")
        p = ((F.col("a") - F.col("d")) / F.col("total") + F.col("weight") * F.col("p")).alias("p")
        below = stored(own.join(lower, ["lang", "shorter"]).select("lang", "key", p), f"model-{k}")
        out = out.unionByName(below.select("lang", F.lit(PROB).alias("kind"), "key", F.log("p").alias("value")))
    return out


class Model:
    """The rows of one language, or those that a block of texts needs, as sorted arrays."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, value: np.ndarray):
        self.arrays = []
        for k in (PROB, BACKOFF):
            own = kind == k
            order = np.argsort(key[own], kind="stable")
            self.arrays.append((key[own][order], value[own][order]))
        self.unseen = float(value[kind == UNSEEN][0]) if (kind == UNSEEN).any() else 0.0

    def find(self, kind: int, key: np.ndarray) -> np.ndarray:
        """Values of keys; not a number where there is none."""
        keys, values = self.arrays[kind]
        if not len(keys):
            return np.full(len(key), np.nan)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], np.nan)

    def logs(self, longest: np.ndarray) -> np.ndarray:
        """Log probability of each character, from its longest n-gram."""
        keys, where = np.unique(longest, return_inverse=True)
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            if not len(left):
                break
            key = keys[left] & ((1 << BITS * k) - 1)
            here = keys[left] >= 1 << BITS * (k - 1)  # else all the context is shorter
            p = np.where(here, self.find(PROB, key), np.nan)
            seen = ~np.isnan(p)
            out[left[seen]] += p[seen]
            left, here, key = left[~seen], here[~seen], key[~seen]
            if len(left):
                out[left] += np.where(here, np.nan_to_num(self.find(BACKOFF, key >> BITS)), 0.0)
        out[left] += self.unseen
        return out[where]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    grams = gram_hashes(hashes, WINDOW)
    s = np.sort(grams)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(grams, again))
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.encode().split(b"\n") if x.strip()] if "\n" in text else []
    return len(lines) - len(set(lines))


_SCORED = "lang string, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _scored(models: dict[str, Model], b: pa.RecordBatch) -> pa.RecordBatch:
    """One batch of (lang, doc_id, text)."""
    texts = b.column(2).to_pylist()
    measures, logs = np.zeros((len(MEASURES), len(texts)), np.int64), np.full(len(texts), np.nan)
    for lang, rows, own in chunks(b.column(0).to_pylist(), texts):
        spelled = Spelled(own)
        hashes, at = spelled.word_hashes()
        n_words, foretold = np.diff(at), np.bincount(spelled.text, minlength=len(own))
        measures[0, rows], measures[1, rows] = n_words, foretold - n_words
        measures[2, rows] = [sum(map(x.count, SYMBOLS)) for x in own]
        measures[3, rows] = list(map(repeated_lines, own))
        measures[4, rows] = [repeated_words(hashes[i:j]) if j - i > WINDOW else 0 for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if len(hashes):
            total = np.bincount(spelled.text, weights=models[lang].logs(spelled.key), minlength=len(own))
            logs[rows] = np.where(n_words > 0, -total / np.maximum(foretold, 1), np.nan)
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, measures), pa.array(logs, from_pandas=True)], ["lang", "doc_id", *MEASURES, "log_perplexity"])


def _models(t: pa.Table) -> dict[str, Model]:
    langs = t.column("lang").to_numpy(zero_copy_only=False)
    kind, key, value = (t.column(c).to_numpy() for c in ("kind", "key", "value"))
    return {lang: Model(*(x[langs == lang] for x in (kind, key, value))) for lang in np.unique(langs).tolist()} if len(langs) else {}


def _with_sent_model(docs: DataFrame, model: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_models(model.toArrow()))  # MOST_ENTRIES rows at most

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _scored(sent.value, b)

    return map_arrow(docs, work, _SCORED)


def _in_blocks(docs: DataFrame, model: DataFrame, blocks: int) -> DataFrame:
    """Each block of texts gets the rows of the model that its words need; neither side is ever whole in one place."""
    small_batches(docs.sparkSession)
    dealt = stored(docs.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "blocks")

    def asks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks_of, langs, texts = (b.column(i).to_pylist() for i in range(3))
            for block in set(blocks_of):
                own = [i for i, x in enumerate(blocks_of) if x == block]
                for lang, _, some in chunks([langs[i] for i in own], [texts[i] for i in own]):
                    key = np.unique(Spelled(some).key)
                    key = np.concatenate([key, key >> BITS])  # what is foretold, and its context
                    key = np.unique(np.concatenate([key & ((1 << BITS * k) - 1) for k in range(ORDER + 1)]))
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(key), pa.int32()), pa.array([lang] * len(key), pa.string()), pa.array(key)], ["block", "lang", "key"])

    asked = map_arrow(dealt.select("block", "lang", "text"), asks, "block int, lang string, key long").distinct()
    got = asked.join(model, ["lang", "key"]).select("block", "lang", "kind", "key", "value")

    def meet(texts: pa.Table, rows: pa.Table) -> pa.Table:
        models = _models(rows)
        return pa.Table.from_batches([_scored(models, b) for b in texts.select(["lang", "doc_id", "text"]).to_batches(max_chunksize=2000)], _RESULT)

    return dealt.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(meet, _SCORED)


_RESULT = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), *[(m, pa.int64()) for m in MEASURES], ("log_perplexity", pa.float64())])


def perplexities(docs: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(lang, doc_id, measures, log_perplexity) for every row of docs(doc_id, text, lang); log_perplexity is null without words."""
    rows = docs.select(language(F.col("lang")).alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = stored(kneser_ney(adjusted_counts(stored(ngram_counts(rows), "counts"))), "model")
    if model.count() <= most_entries:
        return _with_sent_model(rows, model)
    return _in_blocks(rows, model, max(1, -(-rows.count() // BLOCK_TEXTS)))


def quality(docs: DataFrame, fence: float = FENCE, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, least, most) for every row of docs(doc_id, text, lang)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    scored = stored(perplexities(docs, most_entries).withColumn("base_failed", failed), "perplexities")
    # rounded, so that the exact quartiles are worked out from a bounded table of values and counts
    q = F.percentile(F.round("log_perplexity", 3), F.array(F.lit(0.25), F.lit(0.75)))
    quartiles = scored.where(~F.col("base_failed")).groupBy("lang").agg(q.alias("q"))
    reach = fence * (F.col("q")[1] - F.col("q")[0]) + SLACK
    bands = quartiles.select("lang", (F.col("q")[0] - reach).alias("least"), (F.col("q")[1] + reach).alias("most"))
    if bands.count() <= 100_000:  # a checked bound on languages
        bands = F.broadcast(bands)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("least"), F.col("most")), F.lit(False))
    return scored.join(bands, "lang", "left").select("doc_id", *MEASURES, "base_failed", kept.alias("kept"), F.exp("log_perplexity").alias("perplexity"), F.exp("least").alias("least"), F.exp("most").alias("most"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {"op12_quality_rules": op12_quality_rules}
ORACLES: dict[str, str] = {}
