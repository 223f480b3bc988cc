"""Centroid clustering in integers by bisector tournaments.

Components become integers, floor(scale * x). For each pair of centroids a < b the hyperplane between them is worked out
once: the normal 2 (c_b - c_a) and the threshold |c_b|^2 - |c_a|^2. A vector x is nearer to b exactly if normal . x is larger
than the threshold; zero difference favours a, the smaller number. Centroid 0 meets centroid 1, the winner meets 2, and so
on: k - 1 sign tests leave the nearest, and only its distance is worked out. All is exact.

A task adds up the vectors of each cluster among its own rows, so a round shuffles at most k rows a task, and these sums
are added in two steps; the k centroids (k * dim integers) go to the driver and to the tasks. Every round reads the
table again, so a lost executor costs its tasks only. One cluster may hold all vectors: rows are never grouped by cluster.

Defined results: vectors null, of another length than ``dim``, or with null or non-finite components are left out; rows that
repeat an id are vectors of their own, and where ids tie for a first centroid the vector that sorts first is taken;
a null id counts as empty text in the hash and is returned as null; fewer vectors than k give as many centroids; numbers
beyond 2^27 are worked out in Python's integers, and a distance or inertia beyond 64 bits is null; an empty table
gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, stored, table

#: Up to here all sums of 64 products fit in 64 bits.
SAFE = 1 << 27
#: Groups in which the sums of tasks are added before they are added to one row a cluster.
SALTS = 64


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit or else as Python's integers."""
    y = np.floor(x * scale)
    if np.abs(y).max(initial=0.0) <= SAFE:
        return y.astype(np.int64)
    return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()], object)


class Bisectors:
    """The tournament over k centroids."""

    def __init__(self, centroids: list[list[int]]):
        wide = max((abs(v) for c in centroids for v in c), default=0) > SAFE
        self.c = np.array(centroids, object if wide else np.int64)
        squares = (self.c * self.c).sum(1)
        self.normal = 2 * (self.c[None, :] - self.c[:, None])
        self.threshold = squares[None, :] - squares[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and its squared distance."""
        winner = np.zeros(len(x), np.int64)
        for b in range(1, len(self.c)):
            beyond = (self.normal[winner, b] * x).sum(1) - self.threshold[winner, b]
            winner[beyond > 0] = b
        apart = x - self.c[winner]
        return winner, (apart * apart).sum(1)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v): vectors of dim finite components, in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.size("embedding") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(~bad)


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)


def first_centroids(good: DataFrame, k: int, dim: int, scale: int, seed: str) -> list[list[int]]:
    """Of the k vectors with the smallest hashes of seed:id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = good.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return integers(np.array([r.v for r in rows], float).reshape(-1, dim), scale).tolist()


def cluster_sums(good: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, their sums)}: at most k rows."""

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game, sums = Bisectors(centroids), {}
        for b in batches:
            x = _matrix(b.column(0), dim, scale)
            winner, _ = game.nearest(x)
            for c in np.unique(winner).tolist():
                own = x[winner == c]
                n, s = sums.get(c, (0, [0] * dim))
                sums[c] = n + len(own), [p + q for p, q in zip(s, own.sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([[str(v) for v in s] for _, s in sums.values()], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        sums = [sum(map(int, column)) for column in zip(*rows["sums"], strict=True)]
        return pd.DataFrame({"cluster": rows["cluster"].iloc[:1], "n": [rows["n"].sum()], "sums": [[str(v) for v in sums]]})

    schema = "cluster int, n long, sums array<string>"
    parts = map_arrow(good.select("v"), of_task, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    rows = parts.groupBy("cluster", "salt").applyInPandas(add, schema).groupBy("cluster").applyInPandas(add, schema).collect()
    return {r.cluster: (r.n, [int(v) for v in r.sums]) for r in rows}


def fit(good: DataFrame, k: int, rounds: int, dim: int, scale: int, seed: str) -> list[list[int]]:
    centroids = first_centroids(good, k, dim, scale, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in cluster_sums(good, centroids, dim, scale).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def assign(good: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Bisectors(centroids)
        for b in batches:
            winner, apart = game.nearest(_matrix(b.column(1), dim, scale))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(winner.astype(np.int32)), pa.array([d if d < 1 << 63 else None for d in apart.tolist()], pa.int64())], ["vec_id", "cluster", "distance"])

    return map_arrow(good, nearest, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_size, cluster_inertia, inertia, centroid) of every vector of vectors(vec_id, embedding) that takes part.
    centroid: the final components as decimal text, joined by commas."""
    spark = vectors.sparkSession
    good = usable(vectors, dim)
    centroids = fit(good, k, rounds, dim, scale, seed)
    schema = "vec_id long, cluster int, distance long, cluster_size long, cluster_inertia long, inertia long, centroid string"
    if not centroids:
        return spark.createDataFrame([], schema)
    placed = stored(assign(good, centroids, dim, scale), "clusters")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    # k rows at most
    sizes = {r.cluster: (r.n, r.s) for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), whole.alias("s")).collect()}
    fits = lambda v: None if v is None or v >= 1 << 63 else int(v)
    total = None if any(s is None for _, s in sizes.values()) else sum(int(s) for _, s in sizes.values())
    facts = spark.createDataFrame([(c, n, fits(s), fits(total), ",".join(map(str, centroids[c]))) for c, (n, s) in sizes.items()], "cluster int, cluster_size long, cluster_inertia long, inertia long, centroid string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_size", "cluster_inertia", "inertia", "centroid")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).withColumn("centroid_sha256", F.sha2("centroid", 256)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    apart = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    nearest = "SELECT k.r, min(struct_pack(d := {0}, c := c.c)) AS best FROM kept k, c{1} c GROUP BY k.r"
    rounds = "".join(f""",
a{i} AS MATERIALIZED ({nearest.format(apart, i)}),
p{i} AS (SELECT a.best.c AS c, unnest(k.v) AS x, unnest(range(1, 65)) AS j FROM a{i} a JOIN kept k USING (r)),
s{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM p{i} GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))""" for i in range(3))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT c, v FROM (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, v FROM kept) WHERE c < 16){rounds},
a3 AS MATERIALIZED ({nearest.format(apart, 3)}),
placed AS (SELECT k.vec_id, a.best.c AS c, CAST(a.best.d AS BIGINT) AS distance FROM a3 a JOIN kept k USING (r))
SELECT p.vec_id, CAST(p.c AS INTEGER) AS cluster, p.distance,
       CAST(sum(p.distance) OVER (PARTITION BY p.c) AS BIGINT) AS cluster_inertia, CAST(sum(p.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM placed p JOIN c3 c ON c.c = p.c
"""


OP11_SQL = _sql()
QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
ORACLES = {"op11_centroid_clustering": OP11_SQL}


def centroid_digest(components: list[int]) -> str:
    """What centroid_sha256 holds."""
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
