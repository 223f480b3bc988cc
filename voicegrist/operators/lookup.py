"""Texts that are said word by word out of a table of answers, in the row: all tasks know the frequent words, and only the others of a text
become rows, which meet the table in a join. Which words count as frequent never changes a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Characters of words and answers that all tasks hold, with EACH more a word.
FREQUENT, EACH = 1 << 25, 100

#: The tokens of a text (or of its list of sentences); what is said, of its tokens, their answers (null: none) and the extra of its row.
Tokens = Callable[[Any], list[str]]
Say = Callable[[list[str], list[str | None], Any], str | None]


def frequent(table: DataFrame) -> tuple[dict[str, str], bool]:
    """The answers of table (word, n, answer) with the largest n that fit, words of equal n all or none, and whether these are all."""
    size = F.char_length("word") + F.coalesce(F.char_length("answer"), F.lit(0)) + EACH
    held, least, whole = 0, None, True
    for n, more in table.groupBy("n").agg(F.sum(size)).orderBy(F.desc("n")).collect():  # different counts are few: they add up to the words
        if held + more > FREQUENT:
            whole = False
            break
        held, least = held + more, n
    if least is None:
        return {}, whole
    got = table.where(F.col("n") >= least).select("word", "answer", "n").toArrow().sort_by([("n", "descending")])  # close together what is asked for most
    return dict(zip(got["word"].to_pylist(), got["answer"].to_pylist(), strict=True)), whole


def said_by_table(rows: DataFrame, column: str, table: DataFrame, tokens: Tokens, say: Say, fixed: dict[str, str] | None = None, apart: Column | None = None, extra: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with ``said`` in place of column. fixed: answers to tokens beside the table's (word, n, answer), each word once. Texts with words
    for which apart holds get their row of extra, which makes (id, extra) of their (id, text, asked)."""
    spark, at = rows.sparkSession, rows.columns.index(column)
    known, whole = frequent(table if apart is None else table.where(~apart))
    shared = spark.sparkContext.broadcast(known | (fixed or {}))
    settled = whole and apart is None

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = shared.value
        get = answers.get if settled else answers.__getitem__
        for batch in batches:
            out, asked = [], []
            for text in batch.column(at).to_pylist():
                ts, missing = tokens(text), None
                try:
                    out.append(say(ts, list(map(get, ts)), None))
                except KeyError:
                    out.append(None)
                    missing = list(set(ts).difference(answers))
                asked.append(missing)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(asked, pa.list_(pa.string()))], [*batch.schema.names, "said", "asked"])

    names = [c for c in rows.columns if c != column]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    told = rows.mapInArrow(first, f"{kind}, said string, asked array<string>")
    if settled:
        return told.select(*names, "said")
    # written once, as ids have to stay; a text that is said is not needed any more
    told = stored(told.withColumn(column, F.when(F.col("asked").isNotNull(), F.col(column))).withColumn("id", F.monotonically_increasing_id()), "told")
    left = told.where("asked is not null").drop("said")
    own = left.select("id", F.explode("asked").alias("word")).join(table.select("word", "answer"), "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "answer"))).alias("own"))
    more = extra(left.select("id", F.col(column).alias("text"), "asked")) if extra else left.limit(0).selectExpr("id", "'' AS extra")
    met = left.join(own, "id", "left").join(more, "id", "left").select(*names, column, "own", "extra")
    texts = len(names)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = shared.value
        for batch in batches:
            out = []
            for text, pairs, more in zip(*(batch.column(texts + i).to_pylist() for i in range(3)), strict=True):
                ts, mine = tokens(text), dict(pairs or ())
                out.append(say(ts, [answers[t] if t in answers else mine.get(t) for t in ts], more))
            yield pa.RecordBatch.from_arrays([*batch.columns[:texts], pa.array(out, pa.string())], [*names, "said"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)
    return told.where("asked is null").select(*names, "said").unionByName(met.mapInArrow(second, f"{kind}, said string"))
