"""The language model and the rules against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from voicegrist.llm import perplexity as P

SCHEMA = "doc_id long, text string, lang string, kept string, least int"


def spelled(text):
    """Words as lists of characters between their marks; NUL counts as a tab."""
    return [[" ", *w.decode().replace("\0", "\t"), "\n"] for w in (text or "").encode().split()]


class Plain:
    """Modified Kneser-Ney from its definition, over dictionaries."""

    def __init__(self, words):
        top = Counter()
        for w in words:
            for i in range(1, len(w)):
                top[tuple(w[max(0, i - 3) : i + 1])] += 1
        self.a = {4: {g: n for g, n in top.items() if len(g) == 4}}
        for k in (3, 2, 1):
            left = defaultdict(set)
            for g in self.a[k + 1]:
                left[g[1:]].add(g[0])
            self.a[k] = {g: len(s) for g, s in left.items()} | {g: n for g, n in top.items() if len(g) == k}
        self.d, self.contexts = {}, {}
        for k, grams in self.a.items():
            t = Counter(grams.values())
            d = [0.5, 1.0, 1.5]
            for i in range(3):
                if t[i + 1] and t[i + 2]:
                    x = (i + 1) - (i + 2) * (t[1] / (t[1] + 2 * t[2]) if t[1] else 0) * t[i + 2] / t[i + 1]
                    d[i] = x if 0 < x < i + 1 else d[i]
            self.d[k] = d
            by = defaultdict(list)
            for g, n in grams.items():
                by[g[:-1]].append(n)
            self.contexts[k] = {c: (sum(ns), sum(d[min(n, 3) - 1] for n in ns) / sum(ns)) for c, ns in by.items()}

    def p(self, g):
        k = len(g)
        lower = self.p(g[1:]) if k > 1 else 1 / (len(self.a[1]) + 1)
        if g[:-1] not in self.contexts[k]:
            return lower
        total, weight = self.contexts[k][g[:-1]]
        n = self.a[k].get(g, 0)
        return (n - self.d[k][min(n, 3) - 1] if n else 0) / total + weight * lower

    def log_perplexity(self, words):
        logs = [math.log(self.p(tuple(w[max(0, i - 3) : i + 1]))) for w in words for i in range(1, len(w))]
        return -sum(logs) / len(logs)


def measures(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randrange(1, 9)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    out = [(i, text("etaoinsh", r.randrange(18, 60)), "en") for i in range(60)] + [(100 + i, text("äöüßnre", r.randrange(18, 60)), "de") for i in range(40)]
    out += [(200, text("QXZ#$", 40), "en"), (201, "a b c d e f g h " * 10, "en"), (202, None, "en"), (203, "", None), (204, " \n\t ", ""), (205, text("abc", 30), None), (206, text("abc", 30), "")]
    out += [(207, "one line here\n" * 3 + "other\n\n\n" + text("abc", 25), "en"), (208, text("漢字文化語", 30) + " \0 x\x01y   ", "ja"), (208, "same " * 30, "en"), (208, "same " * 30, "en"), (None, text("etaoinsh", 25), "en"), (209, text("etaoinsh", 20_000), "en")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 3) for x in rows], SCHEMA)


def test_against_plain_model(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 3000)
    plain = {}
    for lang in {x[2] for x in rows}:
        plain[lang] = Plain([w for _, t, own in rows if own == lang for w in spelled(t)])
    want = []
    for i, t, lang in rows:
        words = spelled(t)
        want.append((i, *measures(t), round(plain[lang].log_perplexity(words), 6) if words else None))
    for most in (P.MOST_ENTRIES, 0):  # both ways of scoring
        monkeypatch.setattr(P, "BLOCK_TEXTS", 30)
        got = [(g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, None if g.log_perplexity is None else round(g.log_perplexity, 6)) for g in P.perplexities(frame(spark, rows), most).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_rules(spark, rows):
    got = {(g.doc_id, g.n_words): g for g in P.quality(frame(spark, rows)).collect()}
    for g in got.values():
        failed = g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words
        assert g.base_failed == failed and not (failed and g.kept)
        assert g.kept == (not failed and g.least <= g.perplexity <= g.most)
    assert not next(g for (i, _), g in got.items() if i == 200).kept, "strange words"
    assert sum(g.kept for g in got.values()) >= 80


def test_empty_table(spark):
    assert P.quality(frame(spark, [])).count() == 0
    assert [tuple(g)[:8] for g in P.quality(frame(spark, [(1, None, None), (2, " ", "x")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, 0, True, False)]
