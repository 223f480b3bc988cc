"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs; all but the last return
the columns of docs. Further columns of docs pass through whatever they are named. Rows that repeat an id
and its text get the same decision; the near-duplicate stage keeps one of them. Null and empty texts are
kept by all stages up to the mix, which takes no words from them and so leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrist.llm.common import stored, table
from voicegrist.llm.decontamination import decontaminate
from voicegrist.llm.mixing import pareto_mix
from voicegrist.llm.near_dedup import near_duplicates
from voicegrist.llm.secrets import find_secrets
from voicegrist.llm.toxicity import fit, score_column, training_labels

ID, KEY = "__stage_id", "__stage_key"


def _row(doc_id: Column, text_key: Column) -> list[Column]:
    """The join key of a row, free of nulls: its id and the hash of its text."""
    return [F.coalesce(doc_id, F.lit(-(2**63))).alias(ID), text_key.alias(KEY)]


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select("*", *_row(F.col("doc_id"), F.xxhash64("text")))


def _keyed(decisions: DataFrame, *more: Column) -> DataFrame:
    return decisions.select(*_row(F.col("doc_id"), F.col("text_key")), *more)


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    return _with_key(docs).join(_keyed(bad), [ID, KEY], "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return docs.where(score_column(spark, model, F.col("text")) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id."""
    rows = near_duplicates(docs)
    kept = rows.where("kept and n_shingles > 0").dropDuplicates(["component_key"])
    some = _with_key(docs).join(_keyed(kept), [ID, KEY]).dropDuplicates([ID, KEY]).select(docs.columns)
    return some.unionByName(docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    bad = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return _without(docs, bad)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go."""
    bad = find_secrets(docs).where("spans <> ''")
    return _without(docs, bad)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents taken, with their number of copies and the words taken. A column that docs has already is prefixed with mix_."""
    new = ("size", "source_size", "target", "copies", "taken")
    names = {c: f"mix_{c}" if c in docs.columns else c for c in new}
    taken = pareto_mix(docs).where("copies > 0").dropDuplicates(["doc_id", "text_key"])
    return _with_key(docs).join(_keyed(taken, *[F.col(c).alias(n) for c, n in names.items()]), [ID, KEY]).select(*docs.columns, *names.values())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: Toxicity is learned, so SQL cannot express run(); tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
