"""Registered queries that run as streams over the given tables, and the as-of counts of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import PAD
from ..sources.shared import stored
from ..streaming import live as L
from ..streaming import requests as R
from . import derived

#: A file a batch, so that state is carried from batch to batch wherever a table has several files.
FILES = 1


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    at = f"{d}/{name}.parque[t]"  # a pattern, as the table may be one file or a folder
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).option("maxFilesPerTrigger", FILES).parquet(at)


def requests(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "flush").otherwise("request")
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.coalesce("value", F.lit(0.0)).alias("seconds"))


def finished(events: DataFrame) -> DataFrame:
    done = F.timestamp_micros((F.unix_micros("ts") + F.col("seconds") * 60_000_000).cast("long"))
    return requests(events).where("kind = 'request'").select("session", "request_id", "ts", done.alias("done_ts"))


def generations(spark: SparkSession, d: str) -> DataFrame:
    rows = requests(stream(spark, d, "events"))
    # one file may hold all times, so the delay spans the table
    return L.drained(L.generations(rows, "0 seconds"), "generations").select("session", "request_id", "generation")


def valid(spark: SparkSession, d: str) -> DataFrame:
    flushes = requests(stream(spark, d, "events")).where("kind = 'flush'").select("session", "ts")
    return L.drained(L.valid_requests(finished(stream(spark, d, "events")), flushes, "0 seconds", "1 day"), "valid").select("session", "request_id")


def talk(spark: SparkSession, d: str) -> DataFrame:
    """(turn, seq, total, text, ts) of conversations: each is one turn that comes in pieces, all its pieces at their own time."""
    total = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("turn")).agg((F.max("turn") + 1).cast("int").alias("total"))
    rows = stream(spark, d, "conversations").select(F.col("conv_id").alias("turn"), F.col("turn").cast("int").alias("seq"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ")).alias("text"))
    # by a shuffle: a broadcast would send a row of every conversation through the driver, in every batch
    return rows.join(stored(total, "totals").hint("merge"), "turn").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("seq") * 60))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Pieces as chunks of 100 samples a character."""
    rows = talk(spark, d).select(F.col("turn").alias("utt"), F.col("seq").alias("idx"), "total", (F.char_length("text") * 100).cast("long").alias("samples"), "ts")
    return L.drained(L.ordered_timeline(rows, late="1 day"), "timeline")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = talk(spark, d).select("turn", "seq", "text", (F.col("seq") + 1 == F.col("total")).alias("last"), "ts")
    return L.drained(L.turn_sentences(rows, late="1 day"), "sentences").select("turn", "sentence")


def queue(spark: SparkSession, d: str) -> DataFrame:
    """Every request is started 30 s after it came and done after as many seconds as its value says; errors are flushes."""
    r = requests(spark.read.parquet(f"{d}/events.parquet")).withColumn("us", F.unix_micros("ts"))
    at = lambda kind, us: F.struct(F.lit(kind).alias("kind"), us.cast("long").alias("us"))
    asked = F.array(at("request", F.col("us")), at("start", F.col("us") + 30_000_000), at("done", F.col("us") + 30_000_000 + F.floor(F.col("seconds") * 1_000_000)))
    steps = F.explode(F.when(F.col("kind") == "flush", F.array(at("flush", F.col("us")))).otherwise(asked))
    events = r.select("session", "request_id", steps.alias("e")).select("session", "request_id", "e.kind", F.timestamp_micros("e.us").alias("ts"))
    return R.queue_as_of(events).select("session", "request_id", "kind", "queued", "speaking", "current")


QUERIES = {"r01_turn_sentences_stream": sentences, "r02_generations_stream": generations, "r03_valid_stream": valid, "r06_queue_as_of": queue, "r09_timeline_stream": timeline}

_REQ = "req AS (SELECT user_id AS session, event_id AS request_id, epoch_us(ts) AS us, CASE WHEN event_type = 'error' THEN 'flush' ELSE 'request' END AS kind, coalesce(value, 0.0) AS seconds FROM events)"
# A stream holds back what is not yet below its watermark, of milliseconds.
ORACLES = {
    "r02_generations_stream": f"""
WITH {_REQ}, g AS (
  SELECT session, request_id, us, CAST(coalesce(sum(CAST(kind = 'flush' AS INT)) OVER (PARTITION BY session ORDER BY us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS generation FROM req)
SELECT session, request_id, generation FROM g WHERE us <= (SELECT max(us) FROM req) // 1000 * 1000""",
    "r03_valid_stream": f"""
WITH {_REQ}, r AS (SELECT *, CAST(trunc(us + seconds * 60000000) AS BIGINT) AS done FROM req WHERE kind = 'request'), f AS (SELECT * FROM req WHERE kind = 'flush'),
passed AS (SELECT least((SELECT max(done) FROM r), (SELECT max(us) FROM f)) // 1000 * 1000 AS us)
SELECT r.session, r.request_id FROM r, passed WHERE r.done <= passed.us
  AND NOT EXISTS (SELECT 1 FROM f WHERE f.session = r.session AND f.us >= r.us AND f.us < r.done)""",
    "r06_queue_as_of": f"""
WITH {_REQ}, e AS (
  SELECT session, request_id, 'request' AS kind, us, 1 AS rank FROM req WHERE kind = 'request'
  UNION ALL SELECT session, request_id, 'done', us + 30000000 + CAST(floor(seconds * 1000000) AS BIGINT), 2 FROM req WHERE kind = 'request'
  UNION ALL SELECT session, request_id, 'start', us + 30000000, 3 FROM req WHERE kind = 'request'
  UNION ALL SELECT session, request_id, 'flush', us, 4 FROM req WHERE kind = 'flush'),
flushed AS (
  SELECT e.session, e.us, e.rank, e.request_id, max((f.us, f.request_id)) AS at FROM e
  LEFT JOIN e f ON f.session = e.session AND f.kind = 'flush' AND (f.us, f.rank, f.request_id) <= (e.us, e.rank, e.request_id) GROUP BY ALL),
n AS (
  SELECT e.session, e.us, e.rank, e.request_id,
    count(*) FILTER (WHERE o.kind = 'request' AND (w.at[1] IS NULL OR (o.us, o.rank, o.request_id) > (w.at[1], 4, w.at[2]))) AS asked,
    count(*) FILTER (WHERE o.kind = 'start' AND (w.at[1] IS NULL OR (o.us, o.rank, o.request_id) > (w.at[1], 4, w.at[2]))) AS begun,
    count(*) FILTER (WHERE o.kind = 'start') - count(*) FILTER (WHERE o.kind = 'done') AS open,
    arg_max(o.request_id, (o.us, o.request_id)) FILTER (WHERE o.kind = 'start') AS started
  FROM e JOIN flushed w USING (session, us, rank, request_id) JOIN e o ON o.session = e.session AND (o.us, o.rank, o.request_id) <= (e.us, e.rank, e.request_id)
  GROUP BY ALL)
SELECT e.session, e.request_id, e.kind, n.asked - n.begun AS queued, n.open > 0 AS speaking, CASE WHEN n.open > 0 THEN n.started END AS current
FROM e JOIN n USING (session, us, rank, request_id)""",
    "r09_timeline_stream": f"""
WITH c AS (SELECT conv_id AS utt, CAST(turn AS INT) AS idx, CAST((length(coalesce(text, '')) + 1) * 100 AS BIGINT) AS samples, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
p AS (SELECT *, CAST(CASE WHEN idx = last THEN 0 ELSE {PAD} END AS INT) AS pad FROM c)
SELECT utt, idx, CAST(coalesce(sum(samples + pad) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(samples + pad) OVER w, 0) + samples AS BIGINT) AS "end", pad
FROM p WINDOW w AS (PARTITION BY utt ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "r01_turn_sentences_stream": derived.ORACLES["r01_turn_sentences"].replace("doc_id AS turn, sent_idx AS seq, text AS sentence", "doc_id AS turn, text AS sentence"),
}
