"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is hashed to L = M * C signature components of 16 bits. Two components are equal
with a probability of the sets' Jaccard similarity. The signature is split into M chunks of C
components. By the pigeonhole principle two signatures that differ in at most M * (E + 1) - 1
components have a chunk with at most E differing ones; enumerating which E components of a
chunk are left out gives keys of which two such signatures share at least one. With M = 16, C = 5
and E = 1 every pair of signatures within 31 of 80 is found, and a pair at the threshold of 0.75
goes unfound with a probability of 1e-7 (0.3672 ** 16), a closer one far more rarely.

1. Rows of equal sets are one class; only classes are joined, so exact copies never pair.
2. Of the classes of a key the smallest is the hub, and each other class is paired with it. No
   other pairs of a key are made.
3. Pairs are confirmed on the full sets, and the confirmed links give components by alternating
   large-star and small-star steps.
4. Classes connected by candidate pairs are a cluster. What is still outside the largest component of its cluster is
   compared with the whole cluster, in blocks, on the full sets; of two blocks' links a spanning forest leaves the task. Pairs inside a
   component can change nothing. This step loses no link, but its time grows with strays times cluster.

Defined results: null or wordless text has an empty set and is linked with nothing; fewer than five
words make one shingle of them all; repeated rows are one class, and each gets a row; the smallest
doc_id of a component names it, and component_key tells apart components of equal doc_ids.
The least non-null doc_id names a component; rows with a null id are kept only if all ids are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, cut, gram_hashes, hot_join, lower_words_of, map_arrow, mixed, row_key, stored, table

SHINGLE, SHARE = 5, 75
M, C, E = 16, 5, 1
GROUP, SLICE = 256, 16384
LEAST_PARTS, PART_LINKS = 12, 50_000
L = M * C
_SEEDS = mixed(np.arange(1, L + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_DELETED = np.array([[j for j in range(C) if j != d] for d in range(C)])


def shingle_set(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = lower_words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes.array(words), min(SHINGLE, len(words))) ^ np.uint64(len(words) if len(words) < SHINGLE else 0))


def signature(shingles: np.ndarray) -> np.ndarray:
    """L components of 16 bits: the low bits of the smallest product with each seed."""
    least = np.full(L, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        x = part[:, None] * _SEEDS[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=0), out=least)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For signatures [n, L] the keys [n, M * C]: each chunk with each component left out, hashed with its place."""
    chunks = signatures.reshape(len(signatures), M, C).astype(np.uint64)
    kept = chunks[:, :, _DELETED]  # n, M, C, C - 1
    packed = (kept << (np.uint64(16) * np.arange(C - 1, dtype=np.uint64))).sum(axis=3, dtype=np.uint64)
    place = mixed(np.arange(M * C, dtype=np.uint64) + np.uint64(77)).reshape(1, M, C)
    return mixed(packed ^ place).reshape(len(signatures), M * C)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    hashes = WordHash()
    for b in batches:
        n, cids, sigs = [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text, hashes)
            n.append(len(s))
            if len(s):
                cids.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)
                sigs.append(signature(s).tobytes())
            else:
                cids.append(None)
                sigs.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(cids, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "n_shingles", "cid", "sig"])


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, L)
            keys = chunk_keys(sigs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), M * C))], ["key", "cid"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, hashes).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["cid", "shingles"])


def linked(a: bytes, b: bytes) -> bool:
    """100 * intersection >= 75 * union, on the full sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    small, large = sorted((len(x), len(y)))
    if 100 * small < SHARE * large:
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum()) if len(x) else 0
    return 100 * both >= SHARE * (small + large - both)


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [linked(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])


def sets_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, shingles): the full sets of the classes that occur in pairs (a, b), each built from the document named in its row."""
    needed = pairs.select("a").union(pairs.select(F.col("b"))).distinct()
    one = classes.join(needed, classes["cid"] == needed["a"], "left_semi").select("cid", F.col("row.doc_id").alias("id"), F.col("row.text_key").alias("tk"))
    texts = docs.select("doc_id", "text").join(one, F.col("doc_id").eqNullSafe(F.col("id")) & (row_key() == F.col("tk"))).select("cid", "text").dropDuplicates(["cid"])
    return stored(map_arrow(texts, _sets, "cid long, shingles binary"), "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    return cut(map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb"), _confirm, "a long, b long"))


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y, as products of 0/1 matrices over SLICE shingles at a time."""
    out = np.zeros((len(x), len(y)), np.float32)
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        hit = both[at] == flat
        return row[hit], at[hit]

    if not len(both):
        return out
    (xr, xc), (yr, yc) = cells(x), cells(y)
    for lo in range(0, len(both), SLICE):
        n = min(SLICE, len(both) - lo)
        p, q = np.zeros((len(x), n), np.float32), np.zeros((len(y), n), np.float32)
        for m, r, c in ((p, xr, xc), (q, yr, yc)):
            on = (c >= lo) & (c < lo + n)
            m[r[on], c[on] - lo] = 1
        out += p @ q.T
    return out


def _across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links between a block of strays and a block of their cluster, as a spanning forest over components: fewer links than components."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    x, y = ([np.frombuffer(s, np.uint64) for s in t] for t in (left["x_shingles"], right["shingles"]))
    both = shared_counts(x, y)
    sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    ok = (100 * both >= SHARE * (sizes - both)) & (left["x_root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :])
    pairs = np.unique(np.stack([left["x_root"].to_numpy()[np.nonzero(ok)[0]], right["root"].to_numpy()[np.nonzero(ok)[1]]], axis=1), axis=0)
    at: dict[int, int] = {}  # a node's way to the root of its tree

    def top(x: int) -> int:
        while (up := at.setdefault(x, x)) != x:
            at[x] = x = at[up]
        return x

    forest = []
    for a, b in pairs.tolist():
        if (p := top(a)) != (q := top(b)):
            at[p] = q
            forest.append((a, b))
    return pd.DataFrame(forest, columns=["a", "b"], dtype=np.int64)


def links_across(clusters: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components, by their roots, that connect what any links of each cluster connect.

    The largest component of a cluster is its core; every other class is a stray. Strays meet all classes of the cluster,
    in blocks of about GROUP classes on either side, so no group holds more than two blocks, and only a spanning forest of their links leaves it."""
    at = clusters.select(F.col("node").alias("cid"), F.col("root").alias("cluster")).join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    by_root = at.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    sizes = by_root.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("core")).where("n > core.n")
    blocks = lambda n: F.ceil(n / GROUP).cast("int")
    sizes = sizes.select("cluster", F.col("core.root").alias("core"), blocks(F.col("n")).alias("cols"), blocks(F.col("n") - F.col("core.n")).alias("rows"))
    known = stored(at.join(sizes, "cluster"), "near-strays").join(sets, "cid")
    dealt = lambda seed, n: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = known.where("root <> core").withColumn("i", dealt(1, "rows")).withColumn("j", every("cols")).select(*[F.col(c).alias(f"x_{c}") for c in ("cluster", "i", "j", "cid", "root", "shingles")])
    all_ = known.withColumn("j", dealt(2, "cols")).withColumn("i", every("rows")).select("cluster", "i", "j", "cid", "root", "shingles")
    return cut(strays.groupBy("x_cluster", "x_i", "x_j").cogroup(all_.groupBy("cluster", "i", "j")).applyInPandas(_across, "a long, b long"))


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (a, b)."""
    ends = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    merged = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).select(F.col("node").alias("old"), F.col("root").alias("new"))
    # a class without a root so far is its own
    every = roots.union(merged.join(roots.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("old").alias("root")))
    return cut(every.join(merged, every["root"] == merged["old"], "left").select("node", F.coalesce("new", "root").alias("root")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node in links (a, b): root is the least node of its component.

    Alternating large-star and small-star; both keep the components and shorten the paths. Each
    round is cut by a checkpoint; no node's neighbours are gathered, only their least. The links are few beside
    the documents, so each step writes as many parts as they need, at PART_LINKS a part, not one for each shuffle partition."""

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut(df)
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, last = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        parts = max(LEAST_PARTS, last[0] // PART_LINKS)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(parts)
        edges, now = settled(small.distinct().coalesce(parts))
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def one_per_class(rows: DataFrame) -> DataFrame:
    """(cid, sig, name, row) of each class of equal sets in rows(doc_id, text_key, cid, sig)."""
    return stored(rows.groupBy("cid").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("name"), F.min(F.struct("doc_id", "text_key")).alias("row")), "near-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept, component_key) for every row of docs(doc_id, text)."""
    rows = stored(map_arrow(docs.select("doc_id", "text", row_key().alias("text_key")), _sign, "doc_id long, text_key long, n_shingles long, cid long, sig binary"), "near-rows")
    members = rows.drop("sig").where("cid is not null")
    # one row a class: its signature, its least id and the document that stands for it; copies are summed up within tasks before they are dealt
    classes = one_per_class(rows.where("cid is not null"))
    keys = map_arrow(classes.select("cid", "sig"), _keys, "key long, cid long")
    # keys of at least two classes, with the hub: partial aggregation makes each task's hot keys one row
    hubs = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last"), F.count("*").alias("n")).where("n > 1")
    hubs = stored(hubs, "near-hubs")
    # keys of two classes are pairs already; only those of more need their members
    crowded = keys.join(hubs.where("n > 2").select("key", "hub"), "key").where("cid <> hub")
    pairs = stored(hubs.where("n = 2").select(F.col("hub").alias("a"), F.col("last").alias("b")).union(crowded.select(F.col("hub").alias("a"), F.col("cid").alias("b"))).distinct(), "near-pairs")
    sets = sets_of(pairs, docs, classes)
    roots = cut(components(confirmed(pairs, sets)))
    roots = joined_roots(roots, links_across(components(pairs), roots, sets))
    # names go class by class: copies are one row here, and a large component meets its name by hot_join
    linked = stored(classes.join(roots, classes["cid"] == roots["node"]).select("cid", "root", "name"), "near-linked")
    named = hot_join(linked.select("cid", "root"), linked.groupBy("root").agg(F.min("name").alias("component_id")), "root")
    facts = stored(classes.select("cid", "name").join(named, "cid", "left").select("cid", F.coalesce("root", "cid").alias("component_key"), F.coalesce("component_id", "name").alias("component_id")), "near-names")
    no_text = rows.where("cid is null").select("doc_id", "text_key", "n_shingles", F.col("cid").alias("component_key"), F.col("doc_id").alias("component_id"))
    out = hot_join(members, facts, "cid").drop("cid").unionByName(no_text)
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component_key")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "component_key")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * shared.n >= 75 * (za.n + zb.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b AS a, r.c FROM reach r JOIN links l ON l.a = r.a),
comp AS (SELECT a, min(c) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM d LEFT JOIN z USING (doc_id) JOIN comp ON comp.a = d.doc_id
"""

QUERIES = {"op6_minhash_near_dedup": op6_minhash_near_dedup}
ORACLES = {"op6_minhash_near_dedup": OP6_SQL}
