"""Runs of repeated word sequences, found by an online sparse diagonal dynamic program.

The table of matches between the words of a text and its earlier words is walked along its diagonals: a diagonal is a lag, and a
word that equals the one a lag before makes the match length of that lag one longer. When an active lag is not met again its
diagonal ends, and if it is long enough its run is emitted at once: q words and all that match q words later.

What makes the table sparse: a run of at least LEAST words and TIMES periods of q words has at least 16 matches in a row on its
diagonal, and at least 2 q. So an earlier occurrence of a word counts only if the 2^k words that begin there agree, for the
least 2^k >= q (16 at least); and of those the nearest only. Within a run of smallest period q that one lies exactly q before,
for an overlap of q words or more at a smaller lag would make the period smaller. A level k therefore has one active lag a
word, steps on in a line, and looks for lags between 2^(k-1) and 2^k; multiples of the smallest period never become active.
The work is n log n, for a text of one word repeated too, where all pairs of occurrences would be n^2 / 2.

Defined results: null, empty and wordless texts have no runs and an empty collapsed text; repeated rows are treated alike;
a very long text is worked on whole, in memory of about 100 bytes a word; an empty table gives no rows. Words are compared
exactly: hashes only tell the texts in which nothing recurs. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, map_arrow, mixed, table, words_of

LEAST, TIMES = 24, 3
#: Words that agree wherever a diagonal is long enough: at most LEAST * (TIMES - 1) / TIMES.
FIRST = 16

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _recurs(ids: np.ndarray) -> bool:
    """Whether any FIRST words in a row may occur twice."""
    h, held = mixed(ids.astype(np.uint64) + np.uint64(1)), 1
    while held < FIRST:
        h = mixed(h[:-held] * np.uint64(0x9E3779B97F4A7C15) + h[held:])
        held *= 2
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def _ended(ids: np.ndarray, words: int, above: int) -> Iterator[tuple[int, int, int]]:
    """Runs of periods from above + 1 to ``words``; ids tell the sequences of so many words apart."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    lag = np.zeros(n, np.int64)  # to the nearest earlier occurrence
    lag[order[1:][same]] = (order[1:] - order[:-1])[same]
    # a diagonal is active as long as the lag stays the same
    begins = np.concatenate([[0], np.flatnonzero(np.diff(lag)) + 1])
    ends = np.concatenate([begins[1:], [n]])
    lags = lag[begins]
    lengths = ends - begins + words - 1 + lags
    for k in np.flatnonzero((lags > above) & (lags <= words) & (lengths >= np.maximum(LEAST, TIMES * lags))).tolist():
        yield int(begins[k] - lags[k]), int(lengths[k]), int(lags[k])


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(words)
    if n < LEAST:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n or not _recurs(ids):
        return []
    out, held, above = [], 1, 0
    while above < n // TIMES:
        while held < max(FIRST, 2 * above):  # number the pairs of neighbouring sequences
            if len(ids) <= held:
                return sorted(out)
            _, ids = np.unique(ids[:-held] * (n + 1) + ids[held:], return_inverse=True)
            held *= 2
        if ids.max() + 1 == len(ids):  # none recurs, so no longer one does
            break
        out += _ended(ids, held, above)
        above = held
    return sorted(out)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs(doc_id, text): runs are structs of start, length and period in words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, runs, kept = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                found = runs_of(words)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_arrow(docs.select("doc_id", "text"), work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which the texts that a hash of the id picks, about a tenth, go on periodically from some word on. Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({NON_SPACE})"), F.lit(1))).alias("words"))
    n, a = F.size("words"), F.pmod(F.col("g"), F.size("words").cast("long")).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    tail: Column = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.concat_ws(" ", F.slice("words", F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    return picked.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # the quotients of numbers below 2^26 are in the same order as doubles, and equal ones are equal
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("times"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div -best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# Any run holds 16 words in a row that recur one period later, and so all pairs of equal 16-word sequences show all runs; the
# checksum is worked out bit by bit.
OP13_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT) AS h
  FROM documents),
sized AS MATERIALIZED (
  SELECT r, len(w) AS n, coalesce(h % 10 = 0, false) AND len(w) > 0 AS picked, (h // 10) % greatest(len(w), 1) AS a,
         1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM docs),
given AS MATERIALIZED (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
planted AS (SELECT r, a, p, unnest(range(a, n)) AS i FROM sized WHERE picked),
words AS MATERIALIZED (
  SELECT g.r, g.i, g.word FROM given g JOIN sized s USING (r) WHERE NOT s.picked OR g.i < s.a
  UNION ALL
  SELECT t.r, t.i, g.word FROM planted t JOIN given g ON g.r = t.r AND g.i = t.a + (t.i - t.a) % t.p),
grams AS MATERIALIZED (
  SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS gram,
         count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m FROM words),
pairs AS (SELECT x.r, x.i, x.i - y.i AS lag FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND y.i < x.i AND x.m = 16 AND y.m = 16),
diagonals AS (
  SELECT r, lag, min(i) - lag AS start, count(*) + 15 + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS island FROM pairs) GROUP BY r, lag, island),
runs AS MATERIALIZED (
  SELECT r, start, length, min(lag) AS period FROM diagonals WHERE length >= greatest(24, 3 * lag) GROUP BY r, start, length),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words w WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.r = w.r AND d.i = w.i) GROUP BY r),
per_doc AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
best AS (
  SELECT r, start, length, period FROM runs
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1)
SELECT d.doc_id, coalesce(n.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(n.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN per_doc n USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept k USING (r)
"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op13_periodic_runs": OP13_SQL}
