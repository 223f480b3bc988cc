"""Relative Lempel-Ziv factors against windows compared one by one, with blocks and with crowded minimizers."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicegrist.llm import substring_dedup as op

N = op.N


def brute(texts):
    """(n_words, n_removed, kept words) of each text, from the contract."""
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + N]) for w in lists for i in range(len(w) - N + 1))
    out = []
    for w in lists:
        gone = {p for i in range(len(w) - N + 1) if seen[tuple(w[i : i + N])] > 1 for p in range(i, i + N)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    hot, other = fresh(60), fresh(200)
    out = [" ".join(fresh(r.randrange(30)) + hot + fresh(r.randrange(30))) for _ in range(60)]  # a passage in many texts, unlike at its ends
    for cut in (34, 35, 36, 62, 63, 120):  # passages at and about the bounds of windows and phrases
        for _ in range(2):
            at = r.randrange(len(other) - cut)
            out.append(" ".join(fresh(40) + other[at : at + cut] + fresh(40)))
    out.append(" ".join(other))
    out += [" ".join(other[:70] + ["x"] + other[71:]), " ".join(other[100:] + other[:100])]  # one word changed; halves exchanged
    out += [" ".join(["na"] * 35), " ".join(["ta"] * 36), " ".join(["a", "b", "c"] * 40), "\n".join(fresh(34)), " ".join(hot[:35]), ""]
    out += [" ".join(fresh(20_000) + hot[5:50])]
    return [*out, out[0], out[-3], None]


@pytest.mark.parametrize(("crowd", "block"), [(op.CROWD, op.BLOCK), (op.CROWD, 8), (4, 8), (0, 8)], ids=["one block", "small blocks", "some crowded", "all crowded"])
def test_factors(spark, texts, monkeypatch, crowd, block):
    monkeypatch.setattr(op, "BLOCK", block)
    docs = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, wins string")
    real = op.recurring_spans
    monkeypatch.setattr(op, "recurring_spans", lambda d: real(d, crowd))
    got = {r.doc_id or 0: (r.n_words, r.n_removed, r.kept_sha256) for r in op.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_repeated_rows_and_empty_table(spark):
    words = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (1, words), (None, words), (2, "short " * 34), (2, "short " * 34)], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in op.remove_repeats(docs).collect())
    assert got == [(34, 0), (34, 0), (40, 40), (40, 40), (40, 40)]
    assert op.remove_repeats(docs.where(F.lit(False))).count() == 0


def test_longest_matches_and_parse():
    # phrases 1 2 3 4 | 2 3 9 | 5 | 4
    windows, left = np.array([1, 2, 3, 4, 2, 3, 9, 5, 4]), np.array([4, 3, 2, 1, 3, 2, 1, 1, 1])
    assert op.longest_matches(windows, left).tolist() == [0, 2, 1, 1, 2, 1, 0, 0, 1]
    assert op.parse([0, 2, 1, 1]) == [(1, 2), (3, 1)]
    assert op.parse([3, 2, 1]) == [(0, 3)]
    assert op.parse([]) == []


def test_pieces_hold_all_windows_and_equal_windows_share_keys():
    r = random.Random(5)
    hot = [f"h{i}" for i in range(50)]
    texts = [[f"x{r.randrange(10**9)}" for _ in range(r.randrange(20))] + hot + [f"y{r.randrange(10**9)}" for _ in range(20)] for _ in range(30)]
    keys, words, parts = {}, {}, {}
    for t in texts:
        p = op.Phrases([x.encode() for x in t], op.WordHash())
        at = np.arange(len(p.a))
        counts, (o, n, key, part) = p.pieces(at)
        s0 = np.repeat(p.s0, counts)
        windows = [(i, k, q) for f, m, k, q in zip(s0 + o, n, key, part, strict=True) for i in range(f, f + m)]
        assert sorted(i for i, _, _ in windows) == list(range(len(t) - N + 1))
        assert n.max() <= op.PIECE and counts.max() <= 6
        for i, k, _ in windows:
            assert keys.setdefault(tuple(t[i : i + N]), k) == k
        for f, m, q in zip(s0 + o, n, part, strict=True):
            piece = tuple(t[f : f + m - 1 + N])
            assert words.setdefault(q, piece) == piece and parts.setdefault(piece, q) == q
