"""Streams over several batches against their batch twins: out of order, repeated and late rows, gaps, timeouts."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voicegrist.operators import timeline as U
from voicegrist.streaming import live as L
from voicegrist.streaming import requests as R

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def stream(spark, tmp_path):
    """Files of rows as a stream of one file a batch."""
    number = iter(range(100))

    def make(batches, schema):
        d = tmp_path / f"in{next(number)}"
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(d))
            import os
            import time

            stamp = time.time() - 1000 + 10 * i  # files are read in the order of their age
            for f in d.iterdir():
                if f.name not in seen:
                    os.utime(f, (stamp, stamp))
                    seen.add(f.name)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(d))

    seen = set()
    return make


REQUEST = "session long, request_id long, ts timestamp, kind string"


def test_generations(spark, stream):
    r = random.Random(1)
    rows = [(r.randrange(3), i, at(r.randrange(600)), "flush" if r.random() < 0.3 else "request") for i in range(200)]
    ordered = sorted(rows, key=lambda x: x[2])
    batches = [ordered[i : i + 50] for i in range(0, 200, 50)]
    for a, b in zip(batches, batches[1:], strict=False):  # rows that come a batch late, within the delay
        a[-5:], b[:5] = b[:5], a[-5:]
    for b in batches:
        r.shuffle(b)
    end = [(9, 1000, at(10_000), "request"), (9, 1001, at(10_001), "request")]
    late = [(0, 2000, at(0), "flush")]
    got = rows_of(L.drained(L.generations(stream([*batches, end, late], REQUEST), "2 minutes"), "g").where("session < 9").select("session", "request_id", "generation"))
    assert got == rows_of(R.assign_generation(spark.createDataFrame(rows, REQUEST)).select("session", "request_id", "generation"))


def test_valid_requests(spark, stream):
    r = random.Random(2)
    asked = [(r.randrange(4), i, at(t := r.randrange(1200)), at(t + r.randrange(1, 60))) for i in range(150)]
    asked += [(0, 900, at(50), at(51)), (1, 901, at(60), at(60))]
    flushes = [(r.randrange(4), at(r.randrange(1200))) for _ in range(40)] + [(0, at(50)), (0, at(51))]
    schema, flush_schema = "session long, request_id long, ts timestamp, done_ts timestamp", "session long, ts timestamp"
    want = rows_of(R.drop_invalidated(spark.createDataFrame(asked, schema), spark.createDataFrame(flushes, flush_schema)))
    asked.sort(key=lambda x: x[3])
    flushes.sort(key=lambda x: x[1])
    end, end_flush = [(9, 999, at(50_000), at(50_001))], [(9, at(50_002))]
    late = [(0, 3000, at(0), at(1))]
    a = stream([asked[:50], asked[50:100], asked[100:], end, late, end], schema)
    b = stream([flushes[:20], flushes[20:], end_flush, end_flush, end_flush, end_flush], flush_schema)
    out = rows_of(L.drained(L.valid_requests(a, b, "20 minutes", "2 minutes"), "v").where("session < 9"))
    assert out == want and not any(x[1] == 3000 for x in out)


CHUNK = "utt long, idx int, total int, samples long, ts timestamp"


def test_ordered_timeline(spark, stream):
    r = random.Random(3)
    rows = [(u, i, n, r.randrange(1, 9999), at(100 * u + i)) for u, n in enumerate([1, 2, 9, 30, 17]) for i in range(n)]
    shuffled = rows + r.sample(rows, 10)  # some come twice
    r.shuffle(shuffled)
    got = L.drained(L.ordered_timeline(stream([shuffled[i : i + 15] for i in range(0, len(shuffled), 15)], CHUNK), late="1 day"), "o")
    twin = U.utterance_timeline(spark.createDataFrame(rows, CHUNK).withColumnRenamed("utt", "doc_id"))
    assert rows_of(got) == rows_of(twin.select("doc_id", "idx", "start", "end", F.col("pad").cast("int")))


def test_missing_chunk_is_passed_over(stream):
    held = [(1, 0, 4, 10, at(0)), (1, 2, 4, 30, at(2)), (1, 3, 4, 40, at(3))]
    end = [(2, 0, 1, 5, at(5000))]
    seen = []
    got = rows_of(L.drained(L.ordered_timeline(stream([held, end, end], CHUNK), 7, 60_000, "1 minute"), "m", lambda n, rows: seen.append(rows)))
    assert got == [(1, 0, 0, 10, 7), (1, 2, 17, 47, 7), (1, 3, 54, 94, 0), (2, 0, 0, 5, 0)]
    assert sum(seen) == 4 and seen[0] == 1  # what waits is not in the first batch


PIECE = "turn long, seq int, text string, last boolean, ts timestamp"


def test_turn_sentences(spark, stream):
    r = random.Random(4)
    text = {t: "".join(r.choice(["Hello there. ", "Dr. Who said so! ", "It is 3.14 of it; ", "wait... ", "and then ", "Is it? "]) for _ in range(20)) for t in range(5)}
    rows = []
    for t, s in text.items():
        cuts = sorted(r.sample(range(1, len(s)), 12))
        parts = [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]
        rows += [(t, i, p, i == len(parts) - 1, at(10 * t + i)) for i, p in enumerate(parts)]
    shuffled = rows + r.sample(rows, 8)
    r.shuffle(shuffled)
    got = L.drained(L.turn_sentences(stream([shuffled[i : i + 25] for i in range(0, len(shuffled), 25)], PIECE), late="1 day"), "t").toPandas().sort_values(["turn", "part", "seq"])
    want = R.turn_sentences(spark.createDataFrame(rows, PIECE)).toPandas().sort_values(["turn", "seq"])
    assert got[["turn", "sentence"]].values.tolist() == want[["turn", "sentence"]].values.tolist()


def test_unfinished_turn_ends_with_time(stream):
    held = [(1, 0, "One. Two", False, at(0)), (1, 2, " four", False, at(1))]
    end = [(2, 0, "End.", True, at(5000))]
    got = L.drained(L.turn_sentences(stream([held, end, end], PIECE), 60_000, "1 minute"), "u").toPandas()
    assert sorted(got[got.turn == 1].sentence) == ["One.", "Two four"]


def test_sentences_between_silences(spark, stream):
    schema = "source string, ts timestamp, seq int, text string"
    rows = [("a", at(0), 0, "One "), ("a", at(5), 1, "two. Three"), ("a", at(20), 2, " four."), ("a", at(100), 0, "Five."), ("b", at(3), 0, "Six! "), ("b", at(8), 1, "Seven.")]
    want = rows_of(L.sentences_between_silences(spark.createDataFrame(rows, schema)))
    assert [x[3] for x in want if x[0] == "a"] == ["One two.", "Three four.", "Five."]
    end = [("z", at(9000), 0, "x")]
    got = rows_of(L.drained(L.sentences_between_silences(stream([rows[1:3] + rows[4:5], rows[:1] + rows[3:4] + rows[5:], end, end], schema)), "s").where("source < 'z'"))
    assert got == want


EVENT = "session long, request_id long, ts timestamp, kind string"


def test_queue_as_of(spark):
    events = [(1, 1, 0, "request"), (1, 1, 1, "start"), (1, 2, 2, "request"), (1, 3, 3, "request"), (1, 1, 4, "done"), (1, 2, 4, "start"), (1, 9, 5, "flush"), (1, 4, 6, "request"), (1, 2, 7, "done"), (1, 4, 8, "start"), (1, 4, 9, "done"), (2, 7, 0, "request")]
    df = spark.createDataFrame([(s, i, at(t), k) for s, i, t, k in events], EVENT)
    got = {(r.session, r.ts, r.kind): (r.queued, r.speaking, r.current) for r in R.queue_as_of(df).collect()}
    want = [(1, False, None), (0, True, 1), (1, True, 1), (2, True, 1), (2, False, None), (1, True, 2), (0, True, 2), (1, True, 2), (1, False, None), (0, True, 4), (0, False, None), (1, False, None)]
    assert [got[(s, at(t), k)] for s, _, t, k in events] == want


def test_queue_now_in_update_mode(spark, stream):
    r = random.Random(6)
    events = []
    for i in range(60):
        t = 10 * i
        events.append((i % 3, i, at(t), "request"))
        if i < 55:
            events.append((i % 3, i, at(t + 3), "start"))
        if i < 52:
            events.append((i % 3, i, at(t + 5), "done"))
    r.shuffle(events)
    latest = {}
    told = []
    L_q = L.queue_now(stream([events[:60], events[60:120], events[120:]], EVENT))
    listener = L.ProgressListener(lambda name, batch, rows, rate: told.append(rows))
    spark.streams.addListener(listener)
    try:
        q = L_q.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(lambda b, n: latest.update({x.session: tuple(x) for x in b.collect()})).start()
        q.awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    want = {x.session: tuple(x) for x in L.queue_now(spark.createDataFrame(events, EVENT)).collect()}
    assert latest == want and {s: (x[1], x[2]) for s, x in want.items()} == {x.session: (x.queued, bool(x.speaking)) for x in R.queue_status(spark.createDataFrame(events, EVENT)).collect()}


def test_progress_callback(spark, stream, tmp_path):
    rows = stream([[(1, 1, at(0), "request")], [(1, 2, at(1), "done")]], EVENT)
    wrote, told = [], []
    q = L.with_progress(rows, lambda b, n: wrote.append(b.count()), lambda b, n: told.append(n), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sum(wrote) == 2 and len(told) == len(wrote)
    assert isinstance(pd.DataFrame(), pd.DataFrame)
