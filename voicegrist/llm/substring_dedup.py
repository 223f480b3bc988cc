"""Substring duplicates by relative Lempel-Ziv parsing against blocks of the whole corpus.

The corpus is its own reference, cut into blocks that can be searched alone. Every window of N = 35 words is
owned by its minimizer, the first smallest hash among its 28 runs of 8 words; the windows that one occurrence of a
minimizer owns, with all their words, are a phrase (at most 28 windows, 62 words). Equal windows always have equal
minimizers at equal places, so hash partitions of minimizers are reference blocks: each stretch of a document is
factored against every block that can hold a match of 35 words, and against no other.

1. Minimizers are counted (with map-side sums). Those that occur once end here. The recurring ones, those with unlike
   phrases and those with more than CROWD occurrences make three one-hash Bloom filters of fixed size, which only sift:
   an unneeded row costs time, not correctness.
2. Documents are read again and emit the phrases of recurring minimizers, those with unlike phrases with
   the hashes of their windows. Equal phrases are counted before the shuffle: the reference holds each once.
3. A phrase that recurs is a whole factor. The others are parsed: a block sorts all suffixes of its phrases, at most
   MOST_WINDOWS windows long, and the longest match of a suffix is with one of its neighbours in that order. The
   parse goes greedily from left to right: a match of at least one window is a factor, and the next factor starts
   at the first window that crosses its end, so the windows over a boundary of factors are checked too; where no window
   matches it moves on by one word.
4. Phrases of a crowded minimizer (a phrase that a third of all documents may hold, each between other words) fit in no
   block. They are cut into pieces of at most PIECE windows, at fixed distances from the minimizer, so that equal windows lie in
   pieces that agree on the words all windows of such a piece share, their key. Keys and pieces are counted over all tasks,
   with map-side sums: a piece that recurs is a factor, one whose key occurs once has none, and only of the others the windows
   are counted one by one, each different piece once. This is exact, at 6 rows and then at most 5 a piece.
5. In each document factors that overlap or touch at a boundary are joined. The words of factors are removed.

A window recurs when its 64-bit hash does, among windows of its minimizer's hash.

Defined results: null or wordless texts have no words, and the hash of the empty string; repeated rows are
occurrences of each other, so of texts of 35 words or more all copies are removed whole; shorter texts are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, bit_filter, collected_filter, gram_hashes, hot_join, in_filter, map_arrow, minima, mixed, prefix_sums, row_key, run_hashes, signed, stored, table, words_of

N, K = 35, 8
#: Windows that one occurrence of a minimizer can own.
MOST_WINDOWS = N - K + 1
FILTER_BITS = 1 << 26
#: Occurrences of a minimizer up to which its phrases are parsed in one block; phrases of a block, about.
CROWD, BLOCK = 1024, 512
#: Windows of a piece of a crowded minimizer's phrase.
PIECE = 5
FACTORS = "array<struct<o: int, n: int>>"
_PIECE = pa.struct([("o", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("part", pa.int64())])


class Phrases:
    """The phrases of one text: minimizer a, phrase hash u, first and last window s0, s1."""

    def __init__(self, words: list[bytes], hashes: WordHash):
        h = hashes.array(words)
        grams = gram_hashes(h, K)
        starts = len(words) - N + 1
        at = minima(grams, N - K + 1)
        self.s0 = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.s1 = np.r_[self.s0[1:] - 1, starts - 1]
        own = at[self.s0]
        self.a = grams[own]
        self.words = h
        self.own, self.sums = own, prefix_sums(h)
        lengths = self.s1 + N - self.s0
        u = run_hashes(self.sums, self.s0, self.s0 + lengths)
        self.u = mixed(u ^ mixed(((own - self.s0) * 64 + lengths).astype(np.uint64)))

    def pieces(self, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of pieces of each phrase of ``at``, and of all pieces the first window in the phrase, windows, key and part.

        Piece g has the windows that begin g * PIECE to g * PIECE + PIECE - 1 words before the minimizer."""
        s0, s1, own = self.s0[at], self.s1[at], self.own[at]
        low = (own - s1) // PIECE
        counts = (own - s0) // PIECE - low + 1
        g = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        s0, s1, own = (np.repeat(x, counts) for x in (s0, s1, own))
        nearest, farthest = g * PIECE, np.minimum((g + 1) * PIECE, MOST_WINDOWS) - 1
        first, last = np.maximum(s0, own - farthest), np.minimum(s1, own - nearest)
        key = mixed(run_hashes(self.sums, own - nearest, own - farthest + N) ^ mixed(g.astype(np.uint64)))
        part = mixed(run_hashes(self.sums, first, last + N) ^ mixed(((own - first) * 64 + last - first).astype(np.uint64)))
        return counts, [first - s0, last - first + 1, signed(key), signed(part)]


def _minimizers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in batches:
        a, u = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for text in b.column(0).to_pylist():
            words = words_of(text)
            if len(words) >= N:
                p = Phrases(words, hashes)
                a.append(p.a)
                u.append(p.u)
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(a))), pa.array(signed(np.concatenate(u)))], ["a", "u"])


def phrases(docs: DataFrame, recurring: np.ndarray, unlike: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """(doc_id, text_key, a, u, s0, n, wins, pieces) of the minimizers that pass the filters; wins of unlike, pieces of crowded ones."""
    sc = docs.sparkSession.sparkContext
    filters = sc.broadcast((recurring, unlike, crowded))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        rec, mix, crowd = filters.value
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            of, wins = [], []
            parts: list[list] = [[np.empty(0, np.int64)] for _ in _PIECE]
            for i, text in enumerate(b.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < N:
                    continue
                p = Phrases(words, hashes)
                keep = np.flatnonzero(in_filter(rec, p.a, FILTER_BITS))
                if not len(keep):
                    continue
                w = None
                mixed_here = in_filter(mix, p.a[keep], FILTER_BITS)
                if mixed_here.any():
                    w = signed(gram_hashes(p.words, N))
                many = in_filter(crowd, p.a[keep], FILTER_BITS)
                counts = np.zeros(len(keep), np.int64)
                if many.any():
                    counts[many], found = p.pieces(keep[many])
                    for col, x in zip(parts, found, strict=True):
                        col.append(x)
                for col, x in zip(rows, (signed(p.a[keep]), signed(p.u[keep]), p.s0[keep], (p.s1 - p.s0 + 1)[keep], counts), strict=True):
                    col.append(x)
                of.append(np.full(len(keep), i))
                wins += [w[p.s0[j] : p.s1[j] + 1] if m else None for j, m in zip(keep, mixed_here, strict=True)]
            if of:
                at = pa.array(np.concatenate(of))
                a, u, s0, n, counts = (np.concatenate(c) for c in rows)
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(parts, _PIECE, strict=True)], fields=list(_PIECE))
                pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(a), pa.array(u), pa.array(s0.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(wins, pa.list_(pa.int64())), pieces],
                    ["doc_id", "text_key", "a", "u", "s0", "n", "wins", "pieces"],
                )

    return map_arrow(docs.select("doc_id", "text", row_key().alias("text_key")), emit, "doc_id long, text_key long, a long, u long, s0 int, n int, wins array<long>, pieces array<struct<o: int, n: int, key: long, part: long>>")


def longest_matches(windows: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each place the most windows, of the ``left`` ones up to its phrase's end, that match those from another place on.

    Suffixes are sorted, so that the longest match of each is with the one before or after it.
    """
    j = np.arange(MOST_WINDOWS)
    at = np.minimum(np.arange(len(windows))[:, None] + j, len(windows) - 1)
    suffixes = np.where(j < left[:, None], windows[at], 0)
    order = np.lexsort(suffixes.T[::-1])
    same = np.logical_and.accumulate(suffixes[order[1:]] == suffixes[order[:-1]], axis=1).sum(axis=1)
    longest = np.zeros(len(windows), np.int64)
    longest[order[1:]] = same
    longest[order[:-1]] = np.maximum(longest[order[:-1]], same)
    return np.minimum(longest, left)


def parse(longest: list[int]) -> list[tuple[int, int]]:
    """Greedy factors (first window, windows) of one phrase; each next one starts at the first window that crosses the end of the one before."""
    out, p = [], 0
    while p < len(longest):
        if longest[p]:
            out.append((p, longest[p]))
        p += max(longest[p], 1)
    return out


def _parse_block(block: pa.Table) -> pa.Table:
    """The factors of each phrase of a block against all phrases of the block."""
    block = block.combine_chunks()
    n = np.diff(block.column("wins").combine_chunks().offsets.to_numpy())
    windows = block.column("wins").combine_chunks().flatten().to_numpy()
    ends = np.cumsum(n)
    longest = longest_matches(windows, np.repeat(ends, n) - np.arange(len(windows))).tolist()
    again = block.column("c").to_numpy() > 1
    found = [[(0, int(k))] if whole else parse(longest[e - k : e]) for k, e, whole in zip(n, ends, again, strict=True)]
    of = pa.array([[{"o": o, "n": m} for o, m in f] for f in found], pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32())])))
    return pa.table({"a": block.column("a"), "u": block.column("u"), "factors": of}).filter(pa.array([bool(f) for f in found]))


def factors(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first word, end) of maximal chains of factors, from their (first window, windows)."""
    out: list[tuple[int, int]] = []
    for s, n in sorted(spans):
        end = s + n - 1 + N
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((s, end))
    return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept, where = [], [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = words_of(text)
            f = factors([(x["s"], x["n"]) for x in spans or ()])
            n_words.append(len(words))
            n_removed.append(sum(e - s for s, e in f))
            at, left = 0, []
            for s, e in f:
                left += words[at:s]
                at = e
            left += words[at:]
            kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            where.append([{"start": s, "end": e} for s, e in f])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"],
        )


def recurring_spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_key, spans): factors of n recurring windows from window s, for documents that have any."""
    counted = map_arrow(docs.select("text"), _minimizers, "a long, u long")
    index = counted.groupBy("a").agg(F.count("*").alias("c"), F.min("u").alias("u0"), F.max("u").alias("u1")).where("c > 1").select("a", (F.col("u0") != F.col("u1")).alias("unlike"), (F.col("c") > crowd).alias("crowded"))
    index = stored(index, "minimizers")
    sifts = [collected_filter(bit_filter(index.where(which), "a", FILTER_BITS), FILTER_BITS) for which in ("true", "unlike", "unlike and crowded")]
    found = stored(phrases(docs, *sifts), "phrases")
    reference = found.groupBy("a", "u").agg(F.count("*").alias("c"), F.first("wins").alias("wins"), F.first("pieces").alias("pieces")).withColumn("crowded", F.size("pieces") > 0)
    reference = stored(reference.where("c > 1 or wins is not null"), "reference")
    known = parsed(reference.where("wins is not null and not crowded")).unionByName(counted_pieces(reference.where("wins is not null and crowded")))
    whole = reference.where("c > 1 and (wins is null or crowded)").select("a", "u", F.lit(None).cast(FACTORS).alias("factors"))
    hits = found.select("doc_id", "text_key", "a", "u", "s0", "n").join(known.unionByName(whole), ["a", "u"])
    spans = F.when(F.col("factors").isNull(), F.array(F.struct(F.col("s0").alias("s"), F.col("n").alias("n")))).otherwise(F.transform("factors", lambda f: F.struct((F.col("s0") + f["o"]).alias("s"), f["n"].alias("n"))))
    return hits.select("doc_id", "text_key", spans.alias("spans")).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def parsed(reference: DataFrame) -> DataFrame:
    """(a, u, factors) of phrases that have any, parsed in blocks of about BLOCK phrases."""
    blocks = max(1, -(-reference.count() // BLOCK))
    dealt = reference.select("a", "u", "c", "wins", F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(_parse_block, f"a long, u long, factors {FACTORS}")


def counted_pieces(reference: DataFrame) -> DataFrame:
    """(a, u, factors) of the phrases of crowded minimizers that occur once: their pieces and windows that occur again."""
    pieces = reference.select("a", "u", "c", "wins", F.explode("pieces").alias("p")).select("a", "u", "c", "p.*", F.expr("slice(wins, p.o + 1, p.n)").alias("wins"))
    pieces = stored(pieces, "pieces")
    parts = pieces.groupBy("key", "part").agg(F.sum("c").alias("c"), F.min(F.struct("a", "u", "o")).alias("of"), F.first("wins").alias("wins"))
    parts = stored(parts, "parts")
    whole = pieces.where("c = 1").select("a", "u", "o", "n", "key", "part").join(parts.where("c > 1").select("key", "part"), ["key", "part"], "left_semi")
    sizes = parts.groupBy("key").agg(F.count("*").alias("parts"))
    windows = hot_join(parts, sizes, "key").where("parts > 1").select("key", "c", "of", F.posexplode("wins").alias("i", "w"))
    again = windows.groupBy("key", "w").agg(F.sum("c").alias("times")).where("times > 1").select("key", "w")
    single = windows.where("c = 1").join(again, ["key", "w"], "left_semi").select("of.a", "of.u", (F.col("of.o") + F.col("i")).alias("o"), F.lit(1).alias("n"))
    return whole.select("a", "u", "o", "n").union(single).groupBy("a", "u").agg(F.collect_list(F.struct("o", "n")).alias("factors"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, factors) for every row of docs(doc_id, text)."""
    spans = stored(recurring_spans(docs).select(F.col("doc_id").alias("id"), F.col("text_key").alias("tk"), "spans"), "spans")
    joined = docs.select("doc_id", "text").join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (row_key() == F.col("tk")), "left").select("doc_id", "text", "spans")
    return map_arrow(joined, _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: int, end: int>>")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("factors")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM s JOIN again USING (g)),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.r, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p WHERE gone.r IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {"op7_substring_dedup": OP7_SQL}
