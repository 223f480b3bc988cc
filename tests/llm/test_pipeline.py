"""The pipeline on a small table: each stage against a plain decision, and all of them in order."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randrange(10**5)}" for _ in range(n))
    item, copy = words(30), words(60)
    texts = {i: words(40) + (" scoundrel rotter" if i % 4 == 0 else "") for i in range(1, 81)}
    texts |= {101: copy, 102: copy, 103: copy + " more", 104: f"{words(5)} {item}", 105: f"{words(5)} token=abcdef0123456789", 106: None, 107: "", 108: "scoundrel " + words(5), 109: f"{words(300)} {' '.join(item.split()[:12])}"}
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, "clash", 2) for i, t in texts.items()] + [(101, copy, "en", "s1", 1, "clash", 2), (None, "lonely words here", "en", "s1", 1, "clash", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1, 81)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    every = ids(docs)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    bad = {i for i in every if i is not None and (i == 108 or (i <= 80 and i % 4 == 0))}
    assert ids(P.toxicity(spark, docs, sf_dir)) == [i for i in every if i not in bad]
    assert ids(P.near_dedup(spark, docs, sf_dir)) == sorted([i for i in every if i not in (101, 102, 103)] + [101], key=str)
    assert ids(P.decontamination(spark, docs, sf_dir)) == [i for i in every if i != 104]
    assert ids(P.secrets(spark, docs, sf_dir)) == [i for i in every if i != 105]
    mixed = P.mixing(spark, docs, sf_dir)
    assert mixed.columns[: len(docs.columns)] == docs.columns and "mix_size" in mixed.columns
    assert mixed.where("copies < 1").count() == 0 and not {106, 107} & set(ids(mixed))


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir)
    left = set(ids(got))
    assert not left & {102, 103, 104, 105, 106, 107, 108} and not any(i is not None and i <= 80 and i % 4 == 0 for i in left)
    sizes = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("mix_size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in sizes)


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
