"""Utterance timelines, and tables of sample arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE, PAD = 24_000, 1_920  # fixed values: samples a second, 80 ms of silence


def scale_durations(d: Column, speed: float) -> Column:
    return F.greatest(F.lit(1), F.round(d / speed)).cast("int")


def expand_alignment(durations: DataFrame) -> DataFrame:
    """(utt_id, tok_idx, frame_idx) from (utt_id, tok_idx, n_frames): running starts, then one row a frame; negative is an error."""
    n = F.when(F.col("n_frames") < 0, F.raise_error(F.lit("negative duration")).cast("int")).otherwise(F.col("n_frames"))
    start = F.coalesce(F.sum("n_frames").over(Window.partitionBy("utt_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = durations.select("utt_id", "tok_idx", n.alias("n_frames")).withColumn("start", start).where("n_frames > 0")
    return at.select("utt_id", "tok_idx", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_frames") - 1)).alias("frame_idx"))


def utterance_timeline(chunks: DataFrame, pad: int = PAD) -> DataFrame:
    """(doc_id, idx, start, end, pad) from (doc_id, idx, samples): silence after every chunk but the last."""
    by = Window.partitionBy("doc_id").orderBy("idx")
    padded = chunks.withColumn("pad", F.when(F.lead("idx").over(by).isNull(), 0).otherwise(pad))
    before = F.coalesce(F.sum(F.col("samples") + F.col("pad")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return padded.withColumn("start", before).select("doc_id", "idx", "start", (F.col("start") + F.col("samples")).alias("end"), "pad")


def concat_with_silence(chunks: DataFrame, pad: int = PAD) -> DataFrame:
    """(doc_id, samples) from (doc_id, idx, samples array)."""
    parts = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "samples"))).alias("cs"))
    silence = F.array_repeat(F.lit(0.0).cast("float"), pad)
    return parts.select("doc_id", F.flatten(F.transform("cs", lambda c, i: F.when(i < F.size("cs") - 1, F.concat(c["samples"], silence)).otherwise(c["samples"]))).alias("samples"))


def soft_normalize(samples: Column) -> Column:
    """Struct of samples and scale: scaled to a peak of 1 only if the peak is above it."""
    peak = F.coalesce(F.array_max(F.transform(samples, F.abs)), F.lit(0.0))
    scale = F.when(peak > 1, 1 / peak).otherwise(1.0)
    return F.struct(F.transform(samples, lambda x: x * scale).alias("samples"), scale.alias("scale"))


def quantize_pcm16(samples: Column) -> Column:
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int"))


def resample_linear(samples: Column, rate_in: int, rate_out: int, floor: bool = False) -> Column:
    """Linear interpolation to round(n * out / in) samples, a step of in / out apart; a single sample stays one.
    Under floor to floor(n * out / in) samples over the whole length, n / m apart; fewer than two give none."""
    n = F.size(samples)
    m = (F.floor(n * F.lit(rate_out) / rate_in) if floor else F.greatest(F.lit(1), F.round(n * F.lit(rate_out) / rate_in))).cast("int")
    step = n / m if floor else F.lit(rate_in / rate_out)

    def at(i: Column) -> Column:
        pos = i * step
        k = F.least(F.floor(pos).cast("int"), n - 1)
        a, b = F.get(samples, k), F.get(samples, F.least(k + 1, n - 1))
        return (a + (b - a) * (pos - k)).cast("float")

    many = F.when((m > 0) & (n >= 2), F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), at))
    few = F.array().cast("array<float>") if floor else F.transform(samples, lambda x: x.cast("float"))
    return F.coalesce(many, few)


def resample_24k_16k(samples: Column) -> Column:
    return resample_linear(samples, 24_000, 16_000, floor=True)


def frame_packets(samples: Column, frame: int = 320) -> Column:
    """Array of frames, the last filled with zeros."""
    n = F.ceil(F.size(samples) / frame).cast("int")
    one = lambda i: F.concat(F.slice(samples, i * frame + 1, F.lit(frame)), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), (i + 1) * frame - F.size(samples))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<array<float>>"))


def duration_ms(samples: Column, rate: Column) -> Column:
    return F.when(rate == 0, F.lit(0)).otherwise(F.floor(samples * 1000 / rate)).cast("long")


def realtime_factor(chunks: DataFrame, rate: int = RATE) -> DataFrame:
    """(doc_id, audio_s, elapsed_s, factor) from (doc_id, samples, elapsed)."""
    a = chunks.groupBy("doc_id").agg((F.sum("samples") / rate).alias("audio_s"), F.sum("elapsed").alias("elapsed_s"))
    return a.withColumn("factor", F.try_divide("audio_s", "elapsed_s"))


def prepare_samples(tables: DataFrame, rate_in: int = RATE, rate_out: int = 16_000, frame: int = 320) -> DataFrame:
    """(doc_id, scale, pcm, packets, n_packets, ms) from (doc_id, samples array)."""
    n = tables.select("doc_id", soft_normalize(F.col("samples")).alias("s")).select("doc_id", "s.scale", F.col("s.samples").alias("x"))
    r = n.select("doc_id", "scale", resample_linear(F.col("x"), rate_in, rate_out).alias("x"))
    return r.select("doc_id", "scale", quantize_pcm16(F.col("x")).alias("pcm"), F.size(frame_packets(F.col("x"), frame)).alias("n_packets"), duration_ms(F.size("x"), F.lit(rate_out)).alias("ms"))
