"""The request path: generations, flushes, backlog and receipts; sentence emission from partial text. Event time decides order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.structure import ABBREVIATIONS, sentence_pieces


def assign_generation(requests: DataFrame) -> DataFrame:
    """(…, generation): flushes of the session before each request."""
    by = Window.partitionBy("session").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("generation", F.coalesce(F.sum((F.col("kind") == "flush").cast("long")).over(by), F.lit(0)))


def drop_invalidated(requests: DataFrame, flushes: DataFrame) -> DataFrame:
    """Requests (session, request_id, ts, done_ts) without a flush between arrival and finish: an interval anti join."""
    f = flushes.select(F.col("session").alias("fs"), F.col("ts").alias("ft"))
    return requests.join(f, (F.col("session") == F.col("fs")) & (F.col("ft") >= F.col("ts")) & (F.col("ft") < F.col("done_ts")), "left_anti")


def flush_counts(requests: DataFrame) -> DataFrame:
    return assign_generation(requests).where("kind = 'request'").groupBy("session", "generation").agg(F.count("*").alias("drained"))


def backlog_seconds(requests: DataFrame, warn: float = 30.0, hold: float = 8.0) -> DataFrame:
    """(…, backlog, warn, hold): queued audio after each enqueue, from (session, request_id, at, seconds): Lindley's recursion as windows."""
    by = Window.partitionBy("session").orderBy("at", "request_id")
    cum = requests.withColumn("cum", F.sum("seconds").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    free = cum.withColumn("lag", F.max(F.col("at") - (F.col("cum") - F.col("seconds"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = free.withColumn("backlog", F.col("lag") + F.col("cum") - F.col("at")).drop("cum", "lag")
    return out.withColumn("warn", F.col("backlog") >= warn).withColumn("hold", F.col("backlog") > hold)


def queue_status(events: DataFrame) -> DataFrame:
    """(session, queued, speaking, current) from events (session, request_id, ts, kind in request / start / done)."""
    per = events.groupBy("session", "request_id").agg(F.max((F.col("kind") == "start").cast("int")).alias("s"), F.max((F.col("kind") == "done").cast("int")).alias("d"))
    return per.groupBy("session").agg(F.count_if(F.expr("s = 0 and d = 0")).alias("queued"), F.max(F.expr("s = 1 and d = 0")).alias("speaking"), F.max(F.when(F.expr("s = 1 and d = 0"), F.col("request_id"))).alias("current"))


def queue_as_of(events: DataFrame) -> DataFrame:
    """(session, request_id, kind, ts, queued, speaking, current) after each event (session, request_id, ts, kind in request / start / done / flush).

    A flush empties the queue: what is queued was requested, and not started, since the last one. What is spoken goes on.
    Events of one time are taken in the order request, done, start, flush, then by id."""
    rank = F.array_position(F.array(*map(F.lit, ("request", "done", "start", "flush"))), F.col("kind"))
    line = Window.partitionBy("session").orderBy("ts", "rank", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    rows = events.withColumn("rank", rank)
    rows = rows.withColumn("generation", n("flush").over(line)).withColumn("open", n("start").over(line) - n("done").over(line))
    rows = rows.withColumn("started", F.last(F.when(F.col("kind") == "start", F.col("request_id")), ignorenulls=True).over(line))
    since = Window.partitionBy("session", "generation").orderBy("ts", "rank", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    queued = n("request").over(since) - n("start").over(since)
    return rows.select("session", "request_id", "kind", "ts", queued.alias("queued"), (F.col("open") > 0).alias("speaking"), F.when(F.col("open") > 0, F.col("started")).alias("current"))


def process_receipts(done: DataFrame, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(source, window_start, n, audio_s, mean_latency) of finished requests (source, ts, seconds, latency); batch or stream."""
    marked = done.withWatermark("ts", late) if done.isStreaming else done
    out = marked.groupBy("source", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.sum("seconds").alias("audio_s"), F.avg("latency").alias("mean_latency"))
    return out.select("source", F.col("w.start").alias("window_start"), "n", "audio_s", "mean_latency")


def request_defaults(requests: DataFrame, voice: str = "default") -> DataFrame:
    """Blank phrases and missing voices filled in."""
    return requests.withColumn("text", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("Recognition ready."))).withColumn("voice", F.coalesce("voice", F.lit(voice)))


_BOUNDARY = re.compile(r"[.!?;](?=\s)")
_ABBREVIATION = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})$", re.IGNORECASE)


def settled(text: str) -> int:
    """Length of the part of text that ends with its last certain sentence end: what follows cannot change its sentences."""
    for m in reversed(list(_BOUNDARY.finditer(text))):
        upto = text[: m.end()]
        if not upto.endswith("..") and not _ABBREVIATION.search(upto[-12:]):
            return m.end()
    return 0


def stream_sentences(pieces: DataFrame) -> DataFrame:
    """(turn, part, seq, sentence) from a stream of partial text (turn, seq, text, last): every sentence once it is complete, the rest at
    the end of the turn. The keyed state only finds where text is settled; sentences are split by the same expression as in a batch.

    The state of a turn is its unfinished tail; it expires after ten minutes without text."""

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, n = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            done, tail = tail, ""
            state.remove()
        else:
            ended = False
            for x in pd.concat(batches).sort_values("seq").itertuples():
                tail += x.text or ""
                ended = ended or bool(x.last)
            at = len(tail) if ended else settled(tail)
            done, tail = tail[:at], tail[at:]
            if ended:
                state.remove()
            else:
                state.update((tail, n + 1))
                state.setTimeoutDuration(600_000)
        yield pd.DataFrame({"turn": [key[0]], "part": [n], "text": [done]})

    parts = pieces.groupBy("turn").applyInPandasWithState(emit, "turn long, part int, text string", "tail string, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return parts.select("turn", "part", F.posexplode(sentence_pieces(F.col("text"))).alias("seq", "sentence"))


def turn_sentences(pieces: DataFrame) -> DataFrame:
    """The batch twin: a turn's pieces joined in order, then split."""
    whole = pieces.groupBy("turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "").alias("text"))
    return whole.select("turn", F.posexplode(sentence_pieces(F.col("text"))).alias("seq", "sentence"))
