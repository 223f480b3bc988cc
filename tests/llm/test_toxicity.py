"""Toxicity against brute force: weights, neighbours, score and evidence."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicegrist.llm import toxicity


def brute(labelled, text):
    """(score, [(id, cosine)]) by the definitions, from [(h, id, y, text)] in order of h."""
    words = lambda t: Counter(re.findall(r"[^\W_]+", (t or "").lower()))
    rows = [(i, y, words(t)) for _, i, y, t in sorted(labelled)]
    n = [sum(y == c for _, y, _ in rows) for c in (0, 1)]
    df = {w: [sum(w in c for _, y, c in rows if y == k) for k in (0, 1)] for w in set().union(*[c for _, _, c in rows])}

    def weight(w):
        a, b = df.get(w, (0, 0))
        if not a + b:
            return 0.0
        share = (a + b) / sum(n)
        cells = [(a, share * n[0]), (b, share * n[1]), (n[0] - a, (1 - share) * n[0]), (n[1] - b, (1 - share) * n[1])]
        return math.log((1 + sum(n)) / (a + b)) * max(0.0, 2 * sum(o * math.log(o / e) for o, e in cells if o)) ** toxicity.POWER

    def unit(c):
        v = {w: (1 + math.log(k)) * weight(w) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    q = unit(words(text))
    cosines = [(-sum(x * e.get(w, 0) for w, x in q.items()), place) for place, e in enumerate(unit(c) for _, _, c in rows)]
    near = [(rows[p][0], rows[p][1], -c) for c, p in sorted((round(c, 12), p) for c, p in cosines)[: toxicity.K] if c < -1e-12]
    votes = [sum(c * c for _, y, c in near if y == k) for k in (0, 1)]
    return (votes[1] + toxicity.PRIOR * n[1] / sum(n)) / (sum(votes) + toxicity.PRIOR), near


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        ws = r.choices(vocabulary, k=r.randrange(3, 40)) + (r.choices(["scoundrel", "rotter", "çad"], k=2) if i % 3 == 0 else [])
        r.shuffle(ws)
        texts[i] = " ".join(ws)
    texts[91], texts[94] = texts[3], texts[4]  # ties
    texts |= {200: None, 201: "", 202: "?!", 203: "unknown", 204: "W1 w2, scoundrel", 205: "Çad! " * 3, 206: "w5 " * 30_000 + "rotter"}
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(91, 1), (94, 0), (94, 0), (5, None), (None, 1), (999, 1)]
    rows = [(i, t, "x", 1.0, 7) for i, t in texts.items()] + [(204, texts[204], "x", 1.0, 7), (None, "rotter w1", "y", 0.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, evidence string, score double, predicted int")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), texts


def test_scores_and_evidence(spark, corpus):
    docs, labels, texts = corpus
    model = toxicity.fit(docs, labels)
    h = {r.id: r.h for r in spark.createDataFrame([(i,) for i in texts], "id long").select("id", F.xxhash64("id").alias("h")).collect()}
    known = {r[0]: 0 for r in labels.collect() if r[0] is not None and r[1] is not None and r[0] in texts}
    known = {i: max(r[1] for r in labels.where("toxic is not null").collect() if r[0] == i) for i in known}
    labelled = [(h[i], i, y, texts[i]) for i, y in known.items()]
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and [f for f, _ in toxicity.scored(docs, model).dtypes] == ["doc_id", "score", "predicted", "evidence"]
    for r in got:
        score, near = brute(labelled, texts.get(r.doc_id, "rotter w1"))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.5)
        assert [(e.doc_id, e.toxic) for e in r.evidence] == [(i, y) for i, y, _ in near[: toxicity.EVIDENCE]]
        assert np.allclose([e.cosine for e in r.evidence], [c for _, _, c in near[: toxicity.EVIDENCE]])
    of = {r.doc_id: r for r in got}
    rate = sum(known.values()) / len(known)
    assert all(abs(of[i].score - rate) < 1e-12 and not of[i].evidence for i in (200, 201, 202, 203))
    assert of[205].predicted == of[206].predicted == 1
    kept = {r.doc_id for r in docs.where(toxicity.score_column(spark, model, F.col("text")) < 0.5).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_search_is_exact_on_many_examples():
    """Long postings, blocks and equal examples, with pruning."""
    r = np.random.default_rng(2)
    f, n = 300, 700
    vectors = [np.unique(np.minimum(r.geometric(0.05, r.integers(1, 30)), f) - 1) for _ in range(n)]
    vectors[20:40] = [vectors[7]] * 20
    values = [r.random(len(v)) ** 4 + 1e-3 for v in vectors]
    values[20:40] = [values[7]] * 20
    values = [v / np.linalg.norm(v) for v in values]
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    index = toxicity.BlockMaxIndex(starts, np.concatenate(vectors), np.concatenate(values), f)
    dense = np.zeros((n, f))
    for i, (v, x) in enumerate(zip(vectors, values, strict=True)):
        dense[i, v] = x
    for i in range(0, n, 7):
        q = r.random(len(vectors[i])) ** 4 + 1e-3
        cosines = dense[:, vectors[i]] @ q
        want = sorted((-round(c, 12), e) for e, c in enumerate(cosines) if c > 1e-12)[:10]
        got = index.search(vectors[i], q, 10)
        assert [e for e, _ in got] == [e for _, e in want] and np.allclose([s for _, s in got], [-c for c, _ in want])


def test_empty_tables(spark, corpus):
    docs, labels, _ = corpus
    model = toxicity.fit(docs.limit(0), labels)
    assert toxicity.scored(docs.limit(0), model).count() == 0
    alone = toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert len(alone) == docs.count() and all(r.score == 0 and not r.evidence for r in alone)


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    r = toxicity.op2_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    n = {(x.toxic, x.predicted): x["count"] for x in r.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] + n[0, 0] >= 0.97 * sum(n.values()) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
