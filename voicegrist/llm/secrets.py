"""Secrets by multipart credential linking, in DataFrame functions only.

A credential has parts: an access identifier, a secret and an endpoint. Base patterns are strong parts and are always
reported. Weak parts (long mixed strings, user names and client ids, addresses of services) say little alone and are
reported only when complementary parts lie within SCOPE code points of them in the same document: a weak secret needs an identifier or an
endpoint, a weak identifier a secret, an endpoint both. Parts that overlap do not complement each other, and a weak secret
within an address needs an identifier: no address, its own or another, makes a piece of a path a secret. Parts meet in an
interval join: each weak part goes to the cells of SCOPE code points it can reach, and is joined with the parts of those cells.

Defined results: null text is empty; texts without parts get empty strings and 0; repeated rows are treated alike; weak parts
that overlap base spans are not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .spans import joined, matches, of_kind, placed, ranked

# Base patterns. A run of 32 or more is the same span as a run that is then measured.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
ASSIGNED = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
# Weak parts.
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/=_-])"
WEAK_ID = r"(?i:client_?id|user(?:_?name)?|login|account(?:_?id)?)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9._@-]++"
ENDPOINT = r"(?i:https?|wss?|s3|ftp|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]++"

SCOPE = 400
KINDS = ("assign", "access", "hex")
WEAK = ("secret", "id", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "secret": "secret", "id": "id", "endpoint": "endpoint"}


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, weak): arrays of struct(start, rank, end, kind)."""
    text = F.col("t")
    kept = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("t"))
    raw = kept.select(
        "doc_id",
        "text_key",
        matches(text, ASSIGN, text.rlike(r"[:=]")).alias("assign"),
        matches(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        matches(text, HEX, text.rlike(HEX)).alias("hex"),
        matches(text, WEAK_SECRET, text.rlike(r"[A-Za-z0-9+/_-]{24}")).alias("secret"),
        matches(text, WEAK_ID, text.rlike(r"[:=]")).alias("id"),
        matches(text, ENDPOINT, F.contains(text, F.lit("://"))).alias("endpoint"),
    )
    at = raw.select("doc_id", "text_key", *[placed(F.col(c)).alias(c) for c in (*KINDS, *WEAK)])
    mixed = lambda s: s.rlike("[a-z]") & s.rlike("[A-Z]") & s.rlike("[0-9]")
    long_enough = F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["s"], ASSIGNED, 1)) >= 8)
    base = F.concat(ranked(long_enough, "assign", 0), ranked(F.col("access"), "access", 1), ranked(F.col("hex"), "hex", 2))
    weak = F.concat(ranked(F.filter("secret", lambda x: mixed(x["s"])), "secret", 3), ranked(F.col("id"), "id", 4), ranked(F.col("endpoint"), "endpoint", 5))
    split = at.select("doc_id", "text_key", base.alias("base"), weak.alias("weak"))
    return split.withColumn("weak", F.filter("weak", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))


def _role(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), kind)


def linked(found: DataFrame) -> DataFrame:
    """(id, tk, linked): the weak parts of each document that have their complements in reach."""
    docs = found.where(F.size("weak") > 0).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("id"), F.col("text_key").alias("tk"), "base", "weak")
    cell = lambda x: F.floor(x / SCOPE).cast("int")
    in_address = lambda w: F.exists("weak", lambda e: (w["kind"] == "secret") & (e["kind"] == "endpoint") & (e["start"] < w["end"]) & (w["start"] < e["end"]))
    each = docs.select("id", "tk", F.explode(F.transform("weak", lambda w: F.struct(w.alias("w"), in_address(w).alias("in_address")))).alias("s"))
    weak = each.select("id", "tk", "s.w", "s.in_address").withColumn("cell", F.explode(F.sequence(cell(F.col("w.start") - SCOPE), cell(F.col("w.end") + SCOPE))))
    every = docs.select(F.col("id").alias("id2"), F.col("tk").alias("tk2"), F.explode(F.concat("base", "weak")).alias("p")).withColumn("cell2", F.explode(F.sequence(cell(F.col("p.start")), cell(F.col("p.end")))))
    near = (F.col("p.start") <= F.col("w.end") + SCOPE) & (F.col("w.start") <= F.col("p.end") + SCOPE) & (_role(F.col("w.kind")) != _role(F.col("p.kind")))
    near = near & ((F.col("p.end") <= F.col("w.start")) | (F.col("w.end") <= F.col("p.start"))) & ~(F.col("in_address") & (F.col("p.kind") == "endpoint"))
    met = weak.join(every, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tk") == F.col("tk2")) & (F.col("cell") == F.col("cell2")) & near)
    has = lambda role: F.max(F.when(_role(F.col("p.kind")) == role, 1).otherwise(0))
    flags = met.groupBy("id", "tk", "w").agg(has("secret").alias("secret"), has("id").alias("ident"), has("endpoint").alias("place"))
    role = _role(F.col("w.kind"))
    whole = flags.where(F.when(role == "secret", F.col("ident") + F.col("place") > 0).when(role == "id", F.col("secret") > 0).otherwise(F.col("ident") + F.col("secret") == 2))
    return whole.groupBy("id", "tk").agg(F.collect_list("w").alias("linked"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs(doc_id, text)."""
    found = stored(parts(docs), "secret-parts")
    more = linked(found)
    all_ = found.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("tk")), "left")
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return all_.select("doc_id", "text_key", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", F.coalesce("linked", empty))).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}
