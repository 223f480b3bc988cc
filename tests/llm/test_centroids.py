"""Clustering against plain integer k-means."""

import hashlib
import math
import random

import pytest

from voicegrist.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    """[(id, cluster, distance)] and the centroids of rows [(id, vector)]."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(scale * x) for x in v] for _, v in good]
    order = sorted(range(len(good)), key=lambda j: (hashlib.sha256(f"1:{'' if good[j][0] is None else good[j][0]}".encode()).hexdigest(), good[j][1]))
    c = [ints[j] for j in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), n) for n, y in enumerate(c))

    for _ in range(rounds):
        at = [nearest(x)[1] for x in ints]
        for n in range(len(c)):
            own = [x for x, a in zip(ints, at, strict=True) if a == n]
            if own:
                c[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, n, d) for (i, _), (d, n) in zip(good, map(nearest, ints), strict=True)], c


def held(spark, rows):
    return centroids.cluster(spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], SCHEMA)).collect()


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "few"])
def test_against_brute_force(spark, kind):
    r = random.Random(kind)
    if kind == "spread":
        rows = [(i, [r.gauss(0, 0.2) * 0.5 for _ in range(64)]) for i in range(400)]
    elif kind == "ties":  # a coarse grid: many equal distances and repeated vectors
        rows = [(i, [r.choice([-1 / 64, 0.0, 1 / 64]) if j < 2 else 0.0 for j in range(64)]) for i in range(300)]
    elif kind == "hot":
        rows = [(5, [0.5] * 64)] * 200 + [(i, [r.random() for _ in range(64)]) for i in range(40)]
    else:
        rows = [(i, [r.random() for _ in range(64)]) for i in range(5)]
    rows = [(i, None if v is None else [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    rows += [(1001, None), (1002, [0.1] * 63), (1003, [float("nan")] + [0.0] * 63), (1004, [None] + [0.0] * 63), (1005, [float("-inf")] * 64), (None, [0.25] * 64), (1006, [])]
    want, c = brute(rows)
    got = held(spark, rows)
    assert sorted(((g.vec_id, g.cluster, g.distance) for g in got), key=str) == sorted(want, key=str)
    for g in got:
        assert g.centroid == ",".join(map(str, c[g.cluster]))
        assert g.cluster_inertia == sum(d for _, n, d in want if n == g.cluster) and g.inertia == sum(d for *_, d in want)
        assert g.cluster_size == sum(n == g.cluster for _, n, _ in want)


def test_huge_numbers_and_empty_tables(spark):
    rows = [(i, [float(2 ** (i * 6))] * 64) for i in range(20)]
    want = {i: (n, d) for i, n, d in brute(rows)[0]}
    got = held(spark, rows)
    assert len(got) == 20
    for g in got:
        n, d = want[g.vec_id]
        assert g.cluster == n and g.distance == (d if d < 2**63 else None)
    assert held(spark, []) == [] and held(spark, [(1, None)]) == []
