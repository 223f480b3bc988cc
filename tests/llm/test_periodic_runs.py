"""Runs against the definition, word by word."""

import hashlib
import random
import zlib

import pytest

from voicegrist.llm import periodic_runs as R

SCHEMA = "doc_id long, text string, runs int, collapsed string"


def brute(words):
    """Every stretch of least period q and at least max(24, 3 q) words that neither neighbour extends."""
    n, out = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any((i, j + q - i, p) in out for p in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def texts():
    r = random.Random(5)
    some = lambda n, v: [f"w{r.randrange(v)}" for _ in range(n)]
    yield []
    yield ["x"] * 23
    yield ["x"] * 24
    yield ["x"] * 500
    yield some(200, 2)
    for _ in range(60):
        p = r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 50])
        unit = some(p, r.choice([2, 3, 100]))
        n = r.choice([23, 24, 25, 3 * p - 1, 3 * p, 3 * p + 1, 5 * p, 70])
        yield some(r.randrange(30), 50) + (unit * (n // p + 1))[:n] + some(r.randrange(30), 50)
    for _ in range(20):  # runs inside runs: periods of which a part is periodic
        inner = (["a", "b"] * 20)[: r.randrange(24, 40)]
        unit = inner + some(r.randrange(1, 9), 3)
        yield unit * r.randrange(2, 5) + inner
    yield (some(4, 9) * 9 + some(5, 9) * 7) * 4
    a, b = ["a"], ["a", "b"]
    for _ in range(12):  # Fibonacci words: runs at many periods
        a, b = b, b + a
    yield b
    t = ["a"]
    for _ in range(9):  # Thue and Morse: no run of exponent above 2
        t += ["b" if w == "a" else "a" for w in t]
    yield t + t[:100] * 3


def test_runs():
    for words in texts():
        words = [w.encode() for w in words]
        runs = R.runs_of(words)
        assert runs == brute(words), words
        drop = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert R.collapsed(words, runs) == b" ".join(w for i, w in enumerate(words) if i not in drop)


def test_one_word_many_times():
    assert R.runs_of([b"x"] * 300_000) == [(0, 300_000, 1)]


@pytest.fixture(scope="module")
def rows():
    some = [(i, " ".join(w)) for i, w in enumerate(texts(), 100)]
    return [*some, (1, None), (2, ""), (3, " \t\n"), (4, "a  b\n" * 30), (4, "a  b\n" * 30), (None, "c d " * 40), (None, None), *((i, f"e{i} f g h") for i in range(2000, 2100)), (5, "é ü " * 20)]


def test_query(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        w = (text or "").encode().split()
        if i is not None and w:
            h = zlib.crc32(str(i).encode())
            g, n = h // 10, len(w)
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        drop = {k for s, n, p in runs for k in range(s + p, s + n)}
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), digest(b" ".join(x for k, x in enumerate(w) if k not in drop))))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 10
    got = R.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(spark):
    assert R.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
