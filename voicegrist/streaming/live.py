"""The request path on live streams, in event time.

Each function takes streams and gives a stream; what it emits is what its batch twin gives for the same rows, whatever batches
they come in, as long as no row is later than the watermark allows. Later rows are dropped.

State is kept by key and bounded: by the rows of a key within the watermark's delay (generations), by the chunks or pieces that
wait for an earlier one (timelines, sentences), by the time a request may take (invalidation).
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.structure import sentence_pieces
from ..operators.timeline import PAD
from ..sources.shared import shared_dir
from .requests import settled


def _wake(state: GroupState, at_ms: int) -> None:
    """Call the key again once the watermark is beyond at_ms."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def generations(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """(session, request_id, kind, ts, generation) from a stream (session, request_id, ts, kind): flushes of the session before each
    request. Rows wait until the watermark has passed them, and are then counted in the order of time and id."""

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, ids, kinds = state.get if state.exists else (0, [], [], [])
        waiting = list(zip(at, ids, kinds, strict=True))
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip(b["us"].tolist(), b["request_id"].tolist(), b["kind"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda x: x[:2])
        due = bisect.bisect_right(waiting, passed, key=lambda x: x[0])
        out = []
        for us, i, kind in waiting[:due]:
            out.append((key[0], i, kind, us, n))
            n += kind == "flush"
        waiting = waiting[due:]
        state.update((n, [x[0] for x in waiting], [x[1] for x in waiting], [x[2] for x in waiting]))
        if waiting:
            _wake(state, -(-waiting[0][0] // 1000) - 1)
        yield pd.DataFrame(out, columns=["session", "request_id", "kind", "us", "generation"])

    rows = requests.withWatermark("ts", late).select("session", "request_id", "kind", "ts", F.unix_micros("ts").alias("us"))
    state = "n long, at array<long>, ids array<long>, kinds array<string>"
    out = rows.groupBy("session").applyInPandasWithState(emit, "session long, request_id long, kind string, us long, generation long", state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("session", "request_id", "kind", F.timestamp_micros("us").alias("ts"), "generation")


def valid_requests(requests: DataFrame, flushes: DataFrame, late: str = "1 minute", longest: str = "1 hour") -> DataFrame:
    """Finished requests (session, request_id, ts, done_ts) without a flush (session, ts) between arrival and finish: an outer join of two
    streams on a range of time, of which the rows without a partner stay.

    A request is emitted when the watermark has passed its finish, for then no flush that matters can come. Of a request
    that took longer than ``longest`` only the flushes of its last part, so long, count: the bound on what is kept."""
    r = requests.withWatermark("done_ts", late).alias("r")
    f = flushes.select(F.col("session").alias("flush_session"), F.col("ts").alias("flush_ts")).withWatermark("flush_ts", late)
    within = (F.col("session") == F.col("flush_session")) & (F.col("flush_ts") >= F.col("ts")) & (F.col("flush_ts") < F.col("done_ts"))
    kept = F.col("flush_ts") >= F.col("done_ts") - F.expr(f"INTERVAL {longest}")
    return r.join(f, within & kept, "left_outer").where(F.col("flush_session").isNull()).select(*requests.columns)


def ordered_timeline(chunks: DataFrame, pad: int = PAD, patience_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """(utt, idx, start, end, pad) from a stream (utt, idx, total, samples, ts) in any order: chunk i is released after chunk i - 1, and silence
    follows every chunk but the last, number total - 1. Repeated chunks are ignored.

    A chunk that has not come when the watermark is ``patience_ms`` beyond the latest of its utterance is passed over, as one
    without sound is."""

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, at, total, seen, idx, samples = state.get if state.exists else (0, 0, 0, 0, [], [])
        waiting = dict(zip(idx, samples, strict=True))
        if state.hasTimedOut:
            if not waiting:
                state.remove()
                yield pd.DataFrame([], columns=["utt", "idx", "start", "end", "pad"])
                return
            due = min(waiting)
        else:
            for b in batches:
                total, seen = max(total, int(b["total"].max())), max(seen, int(b["ms"].max()))
                for i, n in zip(b["idx"].tolist(), b["samples"].tolist(), strict=True):
                    if i >= due:
                        waiting.setdefault(i, n)
        out = []
        while due in waiting:
            n = waiting.pop(due)
            silence = pad if due + 1 < total else 0
            out.append((key[0], due, at, at + n, silence))
            at, due = at + n + silence, due + 1
        state.update((due, at, total, seen, list(waiting), list(waiting.values())))
        _wake(state, seen + patience_ms)
        yield pd.DataFrame(out, columns=["utt", "idx", "start", "end", "pad"])

    rows = chunks.withWatermark("ts", late).select("utt", "idx", "total", "samples", "ts", F.unix_millis("ts").alias("ms"))
    state = "due int, at long, total int, seen long, idx array<int>, samples array<long>"
    return rows.groupBy("utt").applyInPandasWithState(emit, "utt long, idx int, start long, end long, pad int", state, "append", GroupStateTimeout.EventTimeTimeout)


def turn_sentences(pieces: DataFrame, patience_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """(turn, part, seq, sentence) from a stream (turn, seq, text, last, ts) of partial text: every sentence once it is complete, the rest at the end
    of the turn. Pieces are numbered from 0 and may come in any order and more than once; piece i waits for piece i - 1.

    A turn without an end, or with a piece missing, is given out when the watermark is ``patience_ms`` beyond its latest piece:
    missing pieces are passed over."""

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, part, due, end, seen, seqs, texts = state.get if state.exists else ("", 0, 0, -1, 0, [], [])
        waiting = dict(zip(seqs, texts, strict=True))
        if not state.hasTimedOut:
            for b in batches:
                seen = max(seen, int(b["ms"].max()))
                for i, text, last in zip(b["seq"].tolist(), b["text"].tolist(), b["last"].tolist(), strict=True):
                    if i >= due:
                        waiting.setdefault(i, text or "")
                    if last:
                        end = i
        before = part
        while due in waiting:
            tail, due = tail + waiting.pop(due), due + 1
        if state.hasTimedOut:
            tail = tail + "".join(waiting[i] for i in sorted(waiting))
            done = tail
            state.remove()
        else:
            over = 0 <= end < due
            size = len(tail) if over else settled(tail)
            done, tail = tail[:size], tail[size:]
            part += bool(done)
            state.update((tail, part, due, end, seen, list(waiting), list(waiting.values())))
            _wake(state, seen + patience_ms)
        yield pd.DataFrame([(key[0], before, done)] if done else [], columns=["turn", "part", "text"])

    rows = pieces.withWatermark("ts", late).select("turn", "seq", "text", "last", "ts", F.unix_millis("ts").alias("ms"))
    state = "tail string, part int, due int, end int, seen long, seqs array<int>, texts array<string>"
    parts = rows.groupBy("turn").applyInPandasWithState(emit, "turn long, part int, text string", state, "append", GroupStateTimeout.EventTimeTimeout)
    return parts.select("turn", "part", F.posexplode(sentence_pieces(F.col("text"))).alias("seq", "sentence"))


def sentences_between_silences(pieces: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(source, session_start, seq, sentence) of pieces (source, ts, seq, text) that carry no turn: a turn ends where a source is silent for ``gap``. Batch or stream."""
    marked = pieces.withWatermark("ts", late) if pieces.isStreaming else pieces
    turns = marked.groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "text"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: p["text"]), "")
    return turns.select("source", F.col("w.start").alias("session_start"), F.posexplode(sentence_pieces(text)).alias("seq", "sentence"))


def drained(stream: DataFrame, tag: str, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there now, and return what it appended, from a table in the shared folder.

    progress: called on the driver after each batch with its number and the rows it appended."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/streams/{tag}-{uuid.uuid4().hex}"

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")  # a batch that is run again replaces itself
        if progress:
            progress(number, spark.read.schema(stream.schema).parquet(f"{at}/rows/batch={number}").count())

    with_checkpoint = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True)
    with_checkpoint.foreachBatch(append).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/batch=*")


class ProgressListener(StreamingQueryListener):
    """Calls ``report(query name, batch number, rows read, rows a second)`` after every batch of the session's streams."""

    def __init__(self, report: Callable[[str | None, int, int, float], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def with_progress(stream: DataFrame, write: Callable[[DataFrame, int], None], progress: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Start a stream that hands each batch to ``write`` and then to ``progress``; a failed callback fails the batch, which is then run again."""

    def both(batch: DataFrame, number: int) -> None:
        write(batch, number)
        progress(batch, number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).foreachBatch(both).start()


def queue_now(events: DataFrame) -> DataFrame:
    """(session, queued, speaking, current) by one aggregation over events (session, request_id, ts, kind in request / start / done); a stream of it runs in update mode."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    speaking: Column = n("start") > n("done")
    latest = F.max_by(F.when(F.col("kind") == "start", F.col("request_id")), F.when(F.col("kind") == "start", F.struct("ts", "request_id")))
    return events.groupBy("session").agg((n("request") - n("start")).alias("queued"), speaking.alias("speaking"), F.when(speaking, latest).alias("current"))
