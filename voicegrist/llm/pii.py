"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the spans of the base patterns that pass their checks, and looser shapes (spelled-out e-mail addresses,
telephone numbers without a plus, card-like numbers that fail the checksum). Five labelers vote on each candidate,
1 for, -1 against, 0 abstaining: strict shape (regular expression), gazetteer (top-level domains, calling codes, issuer digits, address
blocks), words before it (context), clear borders, and variety of its characters. Votes are counted by pattern, at most 3 ** 5 for a kind,
over all documents. Expectation-maximisation on these counts estimates how reliable each labeler is and how likely a candidate of each
pattern is real. These soft labels train the final classifier, naive Bayes over the kind, the shape, the length,
the characters beside the span and the context. Base spans stay in any case; other candidates are added where the classifier gives 0.5 or more
and they overlap no base span. Numbers that fail the card checksum are voted on, as evidence against, but never added.

Defined results: null text is empty; texts without candidates get empty strings and 0; repeated rows are treated alike;
very long runs of digits or letters are walked once. With no candidates in the table nothing is added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .spans import digits, joined, luhn, matches, of_kind, placed

# The base patterns, written with possessive repeats. A match starts at the start of a run or where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser shapes.
SPELLED_EMAIL = r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++"
PLAIN_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# Gazetteers and context words.
DOMAINS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ca au jp br in ru ch at be se no fi dk pl pt example"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
CUES = {"email": "mail|contact|write|reply|correo|courriel", "ip": "ip|host|server|address|login|client", "card": "card|visa|master|amex|credit|pay|tarjeta|carte|karte", "phone": "phone|tel|call|fax|mobile|cell|contact|appel|llama"}
AGAINST = "order|invoice|isbn|issn|version|ticket|serial|part|ref|batch|sku"

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "gazetteer", "context", "border", "variety")
ROUNDS = 25


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> matches() of its base pattern."""
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": matches(text, IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": matches(text, CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
        "phone": matches(text, PHONE, F.contains(text, F.lit("+"))),
    }


def passes(kind: str, s: Column) -> Column:
    n = F.char_length(digits(s))
    if kind == "ip":
        return s.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(s))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def valid(kind: str) -> Callable[[Column], Column]:
    return lambda x: passes(kind, x["s"])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column, before: Column, after: Column) -> list[Column]:
    """The labelers' votes, in the order of LABELERS."""
    d = digits(s)
    shape = {
        "email": _vote(s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), s.rlike(r"\.\.|-@|@-")),
        "ip": _vote(s.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), s.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(F.char_length(d).isin(13, 15, 16) & F.when(F.char_length(d) <= 19, luhn(d)).otherwise(F.lit(False)), F.lit(True)),
        "phone": _vote(s.rlike(r"^\+[0-9]{1,3}[\x20(.-]") | s.rlike(r"^\([0-9]{3}\)"), s.rlike(r"\.\.|--|\x20\x20")),
    }[kind]
    tld = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
    gazetteer = {
        "email": _vote(tld.isin(*DOMAINS.split()), tld.rlike("^[0-9]+$")),
        "ip": _vote(~s.rlike(r"^(?:0|127|25[0-5]|24[0-9]|23[0-9]|22[4-9])\."), F.lit(True)),
        "card": _vote(F.substring(d, 1, 1).isin("3", "4", "5", "6"), F.substring(d, 1, 1).isin("0", "9")),
        "phone": _vote(F.startswith(s, F.lit("+")) & (F.substring(d, 1, 1).isin(*CALLING.split()) | F.substring(d, 1, 2).isin(*CALLING.split())), F.startswith(s, F.lit("+0"))),
    }[kind]
    context = _vote(F.lower(before).rlike(rf"(?<![a-z])(?:{CUES[kind]})"), F.lower(before).rlike(rf"(?<![a-z])(?:{AGAINST})"))
    border = _vote(~F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}_]") & ~F.substring(after, 1, 1).rlike(r"[\p{L}\p{N}_]"), F.lit(True))
    kinds = F.size(F.array_distinct(F.split(F.when(F.lit(kind == "email"), s).otherwise(d), "")))
    variety = _vote(kinds >= 4, kinds <= 2)
    return [shape, gazetteer, context, border, variety]


def _candidates(spans: Column, kind: str, base: bool) -> Column:
    def one(x: Column) -> Column:
        before, after = x["before"], x["after"]
        edge = lambda c: F.when(c == "", 0).when(c.rlike(r"[\p{L}\p{N}]"), 1).when(c.rlike(r"\s"), 2).otherwise(3)
        votes = _votes(kind, x["s"], before, after)
        traits = F.concat_ws("/", *[y.cast("string") for y in (votes[0], votes[2], F.least(F.floor(F.char_length(x["s"]) / 4), F.lit(8)), edge(F.substring(before, -1, 1)), edge(after))])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.concat_ws("/", *[v.cast("string") for v in votes]).alias("votes"), traits.alias("traits"))

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, found): all candidates of each row, with votes and traits."""
    text = F.col("t")
    kept = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("t"))
    more = {"email": matches(text, SPELLED_EMAIL, F.lower(text).rlike(r"[(\[]at[)\]]")), "phone": matches(text, PLAIN_PHONE, text.rlike(r"[0-9]{3}[)\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}"))}
    raw = kept.select("*", *[c.alias(f"b_{k}") for k, c in base_spans(text).items()], *[c.alias(f"m_{k}") for k, c in more.items()])
    at = raw.select("doc_id", "text_key", "t", *[placed(F.col(c)).alias(c) for c in raw.columns if c[:2] in ("b_", "m_")])
    parts = [_candidates(F.filter(f"b_{k}", valid(k)), k, True) for k in KINDS]
    parts += [_candidates(F.col(f"m_{k}"), k, False) for k in more]
    failing = F.filter("b_card", lambda x: F.char_length(digits(x["s"])).isin(15, 16) & ~passes("card", x["s"]))
    parts.append(_candidates(failing, "card", False))
    return at.select("doc_id", "text_key", F.concat(*parts).alias("found"))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """(kind, prior, accuracy): expectation-maximisation on counts of vote patterns (kind, votes, n), all in one expression.

    A labeler that does not abstain is right with its accuracy, whatever the truth; accuracies start at 0.75
    and lean to it as if by ten further votes."""
    lists = patterns.groupBy("kind").agg(F.collect_list(F.struct(F.transform(F.split("votes", "/"), lambda v: v.cast("double")).alias("v"), F.col("n").cast("double").alias("n"))).alias("ps"))
    count = len(LABELERS)
    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.75), count).alias("accuracy"))

    def logit(p: Column) -> Column:
        return F.ln(p / (1 - p))

    def step(state: Column, _: Column) -> Column:
        real = F.transform("ps", lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), (1 / (1 + F.exp(-(logit(state["prior"]) + F.aggregate(F.zip_with(p["v"], state["accuracy"], lambda v, a: v * logit(a)), F.lit(0.0), lambda t, x: t + x))))).alias("r")))
        # bound once for all labelers
        return F.get(
            F.transform(
                F.array(real),
                lambda ps: F.struct(
                    F.greatest(F.lit(0.02), F.least(F.lit(0.98), (F.aggregate(ps, F.lit(1.0), lambda t, p: t + p["n"] * p["r"])) / (F.aggregate(ps, F.lit(2.0), lambda t, p: t + p["n"])))).alias("prior"),
                    F.transform(
                        F.sequence(F.lit(0), F.lit(count - 1)),
                        lambda j: F.greatest(
                            F.lit(0.51),
                            F.least(
                                F.lit(0.98),
                                F.aggregate(ps, F.lit(7.5), lambda t, p: t + p["n"] * F.when(F.get(p["v"], j) > 0, p["r"]).when(F.get(p["v"], j) < 0, 1 - p["r"]).otherwise(F.lit(0.0)))
                                / F.aggregate(ps, F.lit(10.0), lambda t, p: t + p["n"] * F.abs(F.get(p["v"], j))),
                            ),
                        ),
                    ).alias("accuracy"),
                ),
            ),
            F.lit(0),
        )

    fitted = lists.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("f"))
    return fitted.select("kind", "f.prior", "f.accuracy")


def classifier(found: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """('kind|trait|value' -> log odds, the reliabilities). Its entries are bounded by the traits' values."""
    counted = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.traits").agg(F.count("*").alias("n"))
    counted = stored(counted, "vote-patterns")
    fitted = reliabilities(counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    v = F.transform(F.split("votes", "/"), lambda x: x.cast("double"))
    score = F.ln(F.col("prior") / (1 - F.col("prior"))) + F.aggregate(F.zip_with(v, F.col("accuracy"), lambda x, a: x * F.ln(a / (1 - a))), F.lit(0.0), lambda t, x: t + x)
    soft = counted.join(fitted, "kind").withColumn("r", 1 / (1 + F.exp(-score)))
    values = soft.select("kind", "n", "r", F.posexplode(F.concat(F.array(F.lit("all")), F.split("traits", "/"))).alias("i", "x"))
    sums = values.groupBy("kind", "i", "x").agg(F.sum(F.col("n") * F.col("r")).alias("yes"), F.sum(F.col("n") * (1 - F.col("r"))).alias("no"))
    odds: dict[str, float] = {}
    rows = [r.asDict() for r in sums.collect()]
    import math

    base = {r["kind"]: math.log((r["yes"] + 1) / (r["no"] + 1)) for r in rows if r["i"] == 0}
    for r in rows:
        odds[f"{r['kind']}|{r['i']}|{r['x']}"] = base[r["kind"]] if r["i"] == 0 else math.log((r["yes"] + 1) / (r["no"] + 1)) - base[r["kind"]]
    return odds, fitted


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs(doc_id, text)."""
    found = stored(candidates(docs), "pii-candidates")
    odds, _ = classifier(found)
    weights = F.create_map(*[F.lit(x) for kv in sorted(odds.items()) for x in kv]) if odds else F.create_map(F.lit(""), F.lit(0.0))

    def likely(c: Column) -> Column:
        keys = F.transform(F.concat(F.array(F.lit("all")), F.split(c["traits"], "/")), lambda x, i: F.concat_ws("|", c["kind"], i.cast("string"), x))
        return F.aggregate(keys, F.lit(0.0), lambda t, k: t + F.coalesce(F.element_at(weights, k), F.lit(0.0))) >= 0

    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), c["kind"])
    plain = lambda a: F.transform(a, lambda c: F.struct(c["start"].alias("start"), rank(c).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    split = found.select("doc_id", "text_key", F.filter("found", lambda c: c["base"]).alias("b"), F.filter("found", lambda c: ~c["base"]).alias("m"))
    free = F.filter("m", lambda c: (c["kind"] != "card") & ~F.exists("b", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) & likely(c))
    both = split.select("doc_id", "text_key", plain(F.col("b")).alias("b"), plain(free).alias("m"))
    counts = [F.size(F.filter("b", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return both.select("doc_id", "text_key", *counts, F.sha2(joined(F.col("b")), 256).alias("base_sha256"), joined(F.concat("b", "m")).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
