"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Each of its documents is due f = target / size copies:
floor(f) copies are certain, and one more goes to a sample in which every document has the
inclusion probability p = f - floor(f). The sample is drawn by Pareto order sampling: documents
are ranked by (U / (1 - U)) / (p / (1 - p)), with U from a hash of the document id, and the
first ones make the sample. Its size is fixed in words: the prefix of the ranking whose words
come nearest to what is due.

Within a source p is one number, so the ranking is the order of U, and the prefix is found
without sorting a source: words per (source, first 12 bits of U) show the bin in which the
prefix ends, words per next 12 bits show the bin inside that, and only the documents of that
bin are ranked, equal ones (of one id and text) as one row with their number. A source, or a group of equal
rows, with a third of all rows is thus spread over all tasks.

Defined results: null text has size 0; a null source is a source of its own, the last;
rows of size 0 are never taken. U is a hash of id and text, so rows that share an id, or have none, are ranked apart; where the
words due end among equal rows, as many of these are taken as come nearest to what is due: a source is within half a document of
it. Which of them depends on their places in the table, the numbers do not; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, stored, table

BITS = 12
#: With at most so many sources their table of a few numbers each is broadcast.
MOST_SOURCES = 100_000


def uniform52(doc_id: str = "doc_id", text: str = "text", seed: str = "mix") -> Column:
    """52 even bits from a hash of id and text, as a long."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"|{seed}|"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. A target is
    least(cap * size, weight * c); the windows find the c for which the targets add up to
    share * all sizes. The rows here are sources, not documents."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w.cast("long")).withColumn("full", F.col("source_size") * cap)
    line = Window.orderBy((F.col("full") / F.col("w")).asc(), F.col("w"), F.col("source").asc_nulls_last())
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.sum("w").over(after)
    placed = ranked.withColumn("c", c).withColumn("is_open", F.col("c") * F.col("w") <= F.col("full"))
    first_open = F.min(F.when(F.col("is_open"), F.struct((F.col("full") / F.col("w")).alias("k"), F.col("c").alias("c")))).over(everything)
    placed = placed.withColumn("first_open", first_open)
    target = F.when(F.col("first_open").isNull() | (F.col("full") / F.col("w") < F.col("first_open.k")), F.col("full").cast("double")).otherwise(F.least(F.col("w") * F.col("first_open.c"), F.col("full").cast("double")))
    return placed.select("source", "source_size", target.alias("target"))


def _crossing(bins: DataFrame, bin_col: str) -> DataFrame:
    """Of each source, the bin in which the words due end, with the words of the bins before it."""
    line = Window.partitionBy("source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    cum = bins.withColumn("cum", F.col("start") + F.coalesce(F.sum("words").over(line), F.lit(0)))
    return cum.where((F.col("cum") < F.col("due")) & (F.col("due") <= F.col("cum") + F.col("words")))


#: What makes rows of a source equal, beside U.
SAME = ("doc_id", "size", "text_key")


def _first_places(rows: DataFrame, take: str) -> DataFrame:
    """(source, upto): the place of the last of the first ``take`` rows of each source, by counts of the parts of the table and then inside one part."""
    part = F.shiftright("place", 33)  # the task that numbered the row
    parts = rows.groupBy("source", take, part.alias("part")).agg(F.count("*").alias("n"))
    line = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).where((F.col("before") < F.col(take)) & (F.col(take) <= F.col("before") + F.col("n")))
    at = parts.select(F.col("source").alias("s"), "part", (F.col(take) - F.col("before")).alias("nth"))
    own = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (part == F.col("part")))
    order = Window.partitionBy("source").orderBy("place")
    return own.withColumn("i", F.row_number().over(order)).where(F.col("i") == F.col("nth")).select("source", F.col("place").alias("upto"))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, pareto_rank, taken, text_key) for every row of docs(doc_id, text, source)."""
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NON_SPACE)), F.lit(0)).cast("long").alias("size"), uniform52("doc_id", "text", seed).alias("u"), F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("place"))
    base = stored(base, "mix-base")
    b1 = F.shiftright("u", 52 - BITS)
    b2 = F.shiftright("u", 52 - 2 * BITS)
    bins = base.groupBy("source", b1.alias("b1")).agg(F.sum("size").alias("words"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio)).withColumn("due", F.col("target") - F.floor(ratio) * F.col("source_size"))
    targets = stored(targets, "mix-targets")

    few = targets.count() <= MOST_SOURCES

    def of(df: DataFrame, *cols: str | Column) -> DataFrame:
        """The side of a join with a row for each source, its source named s: sent to all tasks if its checked size allows, else joined by AQE."""
        side = df.select(F.col("source").alias("s"), *cols)
        return F.broadcast(side) if few else side

    on = F.col("source").eqNullSafe(F.col("s"))
    first = _crossing(bins.join(of(targets, "due"), on).withColumn("start", F.lit(0)), "b1").select("source", F.col("b1").alias("at1"), "due", F.col("cum").alias("start"))
    inner = base.join(of(first, "at1", "due", "start"), on & (b1 == F.col("at1"))).groupBy("source", b2.alias("b2"), "due", "start").agg(F.sum("size").alias("words"))
    second = stored(_crossing(inner, "b2").select("source", "b2", "due", F.col("cum").alias("start")), "mix-bins")
    last = base.join(of(second, F.col("b2").alias("at2"), "due", "start"), on & (b2 == F.col("at2")))
    # of the last bin of each source, rows of one rank: their number, and how many of them are due
    ranked = last.groupBy("source", "u", *SAME, "due", "start").agg(F.count("*").alias("rows"))
    line = Window.partitionBy("source").orderBy("u", *[F.col(c).asc_nulls_first() for c in SAME]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("cum", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(line), F.lit(0)))
    take = F.when(F.col("size") > 0, F.floor((F.col("due") - F.col("cum") - F.col("size") / 2) / F.col("size")) + 1).otherwise(0)
    ranked = ranked.withColumn("take", F.greatest(F.lit(0), F.least("rows", take)).cast("long"))
    ranked = stored(ranked.where("take > 0 or size = 0"), "mix-ranked")
    # all rows up to the end are taken, but of those at the end only so many
    ends = ranked.where("take > 0").groupBy("source").agg(F.max(F.struct("u", *[F.coalesce(c, F.lit(-(2**63))).alias(c) for c in SAME])).alias("end"), F.max_by(F.struct("take", "rows"), F.struct("u", *[F.coalesce(c, F.lit(-(2**63))).alias(c) for c in SAME])).alias("of"))
    here = F.struct("u", *[F.coalesce(c, F.lit(-(2**63))).alias(c) for c in SAME])
    split = stored(ends.where("of.take < of.rows").select("source", "end", "of.take"), "mix-split")
    tied = base.join(of(split, "end", "take"), on & (here == F.col("end"))).drop("s")
    upto = stored(_first_places(tied, "take"), "mix-places")
    cuts = targets.join(of(second, (F.col("b2") * F.lit(1 << (52 - 2 * BITS))).alias("bin_start")), on, "left").drop("s").join(of(ends, "end"), on, "left").drop("s").join(of(upto, "upto"), on, "left").drop("s")
    joined = base.join(of(cuts, "source_size", "target", "whole", "p", "due", "bin_start", "end", "upto"), on).drop("s")
    within = (here < F.col("end")) | ((here == F.col("end")) & (F.col("upto").isNull() | (F.col("place") <= F.col("upto"))))
    chosen = (F.col("due") > 0) & F.coalesce((F.col("u") < F.col("bin_start")) | (F.col("end").isNotNull() & within), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(chosen, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    odds = (F.col("u") + 0.5) / (F.lit(float(1 << 52)) - F.col("u") - 0.5)
    rank = F.when((F.col("p") > 0), odds * (1 - F.col("p")) / F.col("p"))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), rank.alias("pareto_rank"), (copies * F.col("size")).alias("taken"), "text_key")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS u
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighted AS (
  SELECT source, source_size, 2 * source_size AS full_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM src),
placed AS (
  SELECT *, CAST(full_size AS DOUBLE) / w AS k,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
          - CAST(coalesce(sum(full_size) OVER (ORDER BY CAST(full_size AS DOUBLE) / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(w) OVER (ORDER BY CAST(full_size AS DOUBLE) / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c
  FROM weighted),
opened AS (SELECT min(k) AS k0, arg_min(c, (k, c)) AS c0 FROM placed WHERE c * w <= full_size),
targets AS (
  SELECT source, source_size,
         CASE WHEN k0 IS NULL OR k < k0 THEN CAST(full_size AS DOUBLE) ELSE least(w * c0, CAST(full_size AS DOUBLE)) END AS target
  FROM placed, opened),
due AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS due FROM targets),
ranked AS (
  SELECT b.doc_id, b.size, d.source_size, d.target, d.whole, d.due,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY u, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum
  FROM base b JOIN due d ON b.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN due > 0 AND cum + size / 2.0::DOUBLE <= due THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""

QUERIES = {"op1_source_mixing": op1_source_mixing}
ORACLES = {"op1_source_mixing": OP1_SQL}
