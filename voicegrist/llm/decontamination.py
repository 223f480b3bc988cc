"""Benchmark decontamination by winnowing.

From each run of W = 6 consecutive 8-word hashes the smallest is kept as a fingerprint. Any 13
words hold 6 such hashes, so a 13-word span that a document shares with an item has a common
fingerprint: no shared span is missed. An item of fewer than 13 words is one window of its own
length and its fingerprint is the hash of all its words.

1. The items' fingerprints go into a one-hash Bloom filter of a fixed size, which is broadcast.
   Whatever the benchmark's size, the filter only sifts: the join below decides.
2. Documents are read once. Each of their fingerprints that passes the filter is extended to the
   13-word windows around it, which are emitted as (start, words in them, window hash); short windows are
   emitted where their hash passes.
3. Windows are joined with the items' windows on their whole words, not on hashes. A benchmark
   window carries the class of the items that hold it, so a passage in many items and many documents
   does not multiply; each distinct set of classes is turned into a list of items once.

Defined results: null or wordless texts have no words and no hits; a null or empty item has no window;
items that repeat under one id count once; repeated rows get one result row each; an empty
benchmark hits nothing. An item id that is null is left out of lists of items.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, alnum_words_of, bit_filter, collected_filter, gram_hashes, in_filter, map_arrow, minima, row_key, signed, stored, table

N, K = 13, 8
W = N - K + 1
FILTER_BITS = 1 << 24


def winnowed(grams: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the fingerprints: the first smallest hash of each run of w."""
    if len(grams) < w:
        return np.empty(0, np.int64)
    at = minima(grams, w)
    return at[np.r_[True, at[1:] != at[:-1]]]


def _item_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, n, window, fp): every window of an item; fp only where the window is to be put in the filter."""
    hashes = WordHash()
    for b in batches:
        ids, ns, windows, fps = [], [], [], []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = alnum_words_of(text)
            if not words:
                continue
            n = min(N, len(words))
            h = hashes.array(words)
            kept = np.zeros(len(words) - n + 1, bool)
            if n == N:
                grams = gram_hashes(h, K)
                marks = {int(p): int(grams[p]) for p in winnowed(grams)}
                sifted = [marks.get(i) for i in range(len(grams))]
            else:
                sifted = [int(gram_hashes(h, n)[0])]
            for i in range(len(kept)):
                ids.append(item)
                ns.append(n)
                windows.append(b" ".join(words[i : i + n]).decode())
                fps.append(None)
            for p, f in enumerate(sifted):
                if f is not None:
                    ids.append(item)
                    ns.append(n)
                    windows.append(None)
                    fps.append(np.uint64(f).astype(np.int64).item())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(windows, pa.string()), pa.array(fps, pa.int64())], ["item_id", "n", "window", "fp"])


def item_windows(items: DataFrame) -> DataFrame:
    return stored(map_arrow(items.select(F.col("item_id").cast("long"), "text"), _item_windows, "item_id long, n int, window string, fp long"), "item-windows")


def document_windows(docs: DataFrame, sifted: np.ndarray, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, n_words, hits): hits holds the windows around fingerprints that pass the filter."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sifted)
    short = [n for n in lengths if n < N]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, passed = WordHash(), shared.value
        for b in batches:
            counts, found = [], []
            for text in b.column(1).to_pylist():
                words = alnum_words_of(text)
                counts.append(len(words))
                hits: dict[str, list[int]] = {}
                if words:
                    h = hashes.array(words)
                    spans: list[tuple[int, int]] = []
                    if len(words) >= N:
                        grams = gram_hashes(h, K)
                        at = winnowed(grams)
                        at = at[in_filter(passed, grams[at], FILTER_BITS)]
                        if len(at):
                            starts = np.unique((at[:, None] - np.arange(W)[None, :]).ravel())
                            spans += [(int(s), N) for s in starts[(starts >= 0) & (starts <= len(words) - N)]]
                    for n in short:
                        spans += [(int(s), n) for s in np.flatnonzero(in_filter(passed, gram_hashes(h, n), FILTER_BITS))]
                    for s, n in spans:
                        hits.setdefault(b" ".join(words[s : s + n]).decode(), []).append(s)
                found.append([{"window": w, "starts": s} for w, s in hits.items()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.struct([("window", pa.string()), ("starts", pa.list_(pa.int32()))])))],
                ["doc_id", "text_key", "n_words", "hits"],
            )

    return map_arrow(docs.select("doc_id", "text", row_key().alias("text_key")), find, "doc_id long, text_key long, n_words long, hits array<struct<window: string, starts: array<int>>>")


def decontaminate(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs(doc_id, text)."""
    of_items = item_windows(items)
    sifted = collected_filter(bit_filter(of_items.where("fp is not null").select("fp"), "fp", FILTER_BITS), FILTER_BITS)
    lengths = [r[0] for r in of_items.where("window is not null").select("n").distinct().collect()]  # 1 to 13
    # window -> class of its items: the hash of their sorted ids
    postings = of_items.where("window is not null").groupBy("window", "n").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    postings = stored(postings.withColumn("class", F.md5(F.array_join("items", ","))), "item-postings")
    classes = postings.groupBy("class").agg(F.first("items").alias("items"))

    found = stored(document_windows(docs, sifted, lengths), "document-windows")
    untouched = found.where(F.size("hits") == 0).select("doc_id", "text_key", "n_words")  # most rows: they meet no join
    flat = found.where(F.size("hits") > 0).select("doc_id", "text_key", "n_words", F.posexplode("hits").alias("i", "hit")).select("doc_id", "text_key", "n_words", "i", F.col("hit.window").alias("window"), F.col("hit.starts").alias("starts"))
    known = postings.select("window", "n", "class")
    hit = flat.join(known, "window", "left")
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("n") - 1)))
    by_doc = hit.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum((F.col("i") == 0).cast("int")).alias("copies"),
        F.collect_list(F.when(F.col("n").isNotNull(), covered)).alias("at"),
        F.array_sort(F.collect_set("class")).alias("classes"),
    )
    by_doc = by_doc.select("doc_id", "text_key", "n_words", "copies", F.size(F.array_distinct(F.flatten("at"))).cast("long").alias("n_hit"), F.array_join("classes", ",").alias("of"), "classes")
    by_doc = stored(by_doc, "document-hits")
    # each distinct set of classes is expanded to its items once
    sets = by_doc.select("of", "classes").distinct().where("of <> ''").select("of", F.explode("classes").alias("class"))
    lists = sets.join(classes, "class").select("of", F.explode("items").alias("item")).groupBy("of").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = lists.select("of", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    clean = by_doc.where("of = ''").select("*", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    # a class of items without an id has an empty list: its documents stay, with no items
    listed = by_doc.where("of <> ''").join(lists, "of", "left").withColumns({"n_items": F.coalesce("n_items", F.lit(0).cast("long")), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256))})
    joined = listed.select(clean.columns).unionByName(clean)
    nothing = untouched.select("doc_id", "text_key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    out = joined.select("doc_id", "text_key", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return nothing.unionByName(out.drop("copy"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


OP3_SQL = r"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00]', ' ', 'g'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n_words FROM d0),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, n_words - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n_words AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
ORACLES = {"op3_benchmark_decontamination": OP3_SQL}
