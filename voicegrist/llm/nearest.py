"""Approximate nearest neighbours by collision counting over query-centred windows.

Every vector is projected on LINES random lines. A block of vectors keeps, for each line, its projections in sorted
order. A query's window on a line is centred on its own projection and reaches WIDTH radii to both sides; a vector
inside it collides. The radius grows by virtual rehashing: the same sorted arrays, wider windows, of which only the new
ends are counted. A vector with at least THRESHOLD collisions is verified: its exact distance is computed on the
original numbers. Of 128 lines a vector at the radius collides on 87 +- 5.3, one at 1.4 radii on 67 +- 5.7, so 80 collisions
let 92 % of the former pass and 1 % of the latter. A block is done with a query when K verified vectors lie within the radius.

Queries are the stated set (ids divisible by 100); they meet the blocks of vectors as blocks of at most
QUERY_BLOCK, and each meeting sends back its K best only. Rows are dealt to blocks by a hash of their place in a stored
copy of the table, so equal or crowded vectors and repeated ids spread evenly. A block holds about BLOCK vectors: the
number of blocks, not their size, grows with the table.

Defined results: null or zero vectors, and those with null or non-finite parts, take no part, as do vectors of
another length than the query's; rows without an id take no part; rows that repeat an id are rows of their own: each is
a candidate for the others, at distance 0 if their vectors are equal, and each asks for itself, so a repeated query id has
K rows for each of its rows; ties go to the smaller id; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

BLOCK, QUERY_BLOCK, K = 8192, 512, 10
#: Lines, collisions that make a candidate, growth of the radius, half width of a window in radii.
LINES, THRESHOLD, GROWTH, WIDTH = 128, 80, 1.08, 1.0
PILOT = 128


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(20240601).standard_normal((dim, LINES))


def exact_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x from q, added up part by part in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - q[j]
        total += d * d
    return np.sqrt(total)


class Block:
    """The sorted projections of one block of vectors, all of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.x = rows, ids, x
        self.lines = directions(x.shape[1])
        p = np.ascontiguousarray((x @ self.lines).T)
        order = np.argsort(p, axis=1, kind="stable")
        self.order = order.ravel()
        p = np.take_along_axis(p, order, axis=1)
        # all lines in one sorted array, each moved clear of the one before
        self.span = 4 * float(np.abs(p).max()) + 1
        self.sorted = (p + self.span * np.arange(LINES)[:, None]).ravel()
        self.squares = np.einsum("ij,ij->i", x, x)
        self.reach = float(np.sqrt(self.squares.max()))

    def rough(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares[at] + q @ q - 2 * (self.x[at] @ q), 0))

    def _ends(self, at: np.ndarray, radius: float) -> np.ndarray:
        """First and last places of the windows of all lines, in the array of all lines."""
        base, least = self.span * np.arange(LINES), np.arange(LINES) * len(self.ids)
        lo = np.searchsorted(self.sorted, base + np.maximum(at - WIDTH * radius, -self.span / 2), side="left")
        hi = np.searchsorted(self.sorted, base + np.minimum(at + WIDTH * radius, self.span / 2), side="right")
        return np.clip(np.stack([lo, hi]), least, least + len(self.ids))

    def search(self, row: int, q: np.ndarray, k: int) -> tuple[list[tuple[int, float]], int]:
        """The k nearest found (id, distance), and how many vectors were verified."""
        at, n = q @ self.lines, len(self.ids)
        verified = self.rows == row  # the query's own row is no candidate
        own = int(verified.sum())
        count = np.zeros(n, np.int64)
        found, found_d = np.empty(0, np.int64), np.empty(0)
        pilot = self.rough(np.arange(0, n, max(1, n // PILOT)), q)
        whole = self.reach + float(np.sqrt(q @ q))  # no distance is larger
        radius = max(0.5 * float(pilot[pilot > 1e-9 * whole].min(initial=whole)), 1e-9 * whole)
        seen = np.tile(self._ends(at, 0.0)[0], (2, 1))  # empty windows
        while True:
            ends = self._ends(at, radius)
            lo, hi = np.minimum(ends[0], seen[0]), np.maximum(ends[1], seen[1])
            starts, lengths = np.concatenate([lo, seen[1]]), np.concatenate([seen[0] - lo, hi - seen[1]])
            places = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            count += np.bincount(self.order[places], minlength=n)
            seen = np.stack([lo, hi])
            new = np.flatnonzero((count >= THRESHOLD) & ~verified)
            if len(new):
                verified[new] = True
                found = np.concatenate([found, new])
                found_d = np.concatenate([found_d, self.rough(new, q)])
            if (found_d <= radius).sum() >= k or verified.all() or radius > 8 * whole:
                break
            radius *= GROWTH if len(found) else GROWTH * GROWTH
        if len(found) > k:  # the rough distances err by far less than this
            found = found[found_d <= np.partition(found_d, k - 1)[k - 1] + 1e-5 * whole]
        exact = exact_distances(self.x[found], q)
        best = np.lexsort((self.ids[found], exact))[:k]
        return [(int(self.ids[found[i]]), float(exact[i])) for i in best], int(verified.sum()) - own


def _meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(left) and len(right):
        block = Block(left["row"].to_numpy(), left["vec_id"].to_numpy(), np.array(left["v"].tolist(), float))
        for row, qid, q in zip(right["q_row"], right["q_vec_id"], right["q_v"], strict=True):
            near, verified = block.search(int(row), np.asarray(q, float), K)
            out += [(row, qid, i, d, verified) for i, d in near]
    return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score", "verified"]).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64", "verified": "int64"})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): vectors that take part, in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def met(vectors: DataFrame, every: int = 100) -> DataFrame:
    """(row, query_id, vec_id, score, verified): of each query row, the K best of each block, and how many vectors were verified there."""
    good = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = F.col("vec_id") % every == 0
    n, n_asked = good.agg(F.count("*"), F.count_if(asked)).first()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    dealt = good.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    queries = good.where(asked).withColumn("qblock", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(groups)).cast("int"))
    # every block of queries goes to every block of vectors
    a = dealt.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    b = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = b.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "qblock", "dim", "row", "vec_id", "v")])
    return a.groupBy("block", "qblock", "dim").cogroup(b.groupBy("q_block", "q_qblock", "q_dim")).applyInPandas(_meet, "row long, query_id long, vec_id long, score double, verified long")


def nearest(vectors: DataFrame, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the K nearest found of every row whose id is divisible by ``every``."""
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return met(vectors, every).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_nearest_neighbours": op8_nearest_neighbours}
ORACLES: dict[str, str] = {}
