"""Spans of regular expressions as DataFrame expressions: no Python runs on the executors.

``regexp_extract_all`` gives the matches and ``split`` the pieces between them; both walk a text
with the same engine, so lengths of pieces and matches add up to the places of the matches, in code points.
Patterns here use possessive repeats: they take no Java stack and no second look at a long run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,s:string,before:string,after:string>>"
#: Characters of context before a span.
CONTEXT = 39


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Struct of matches and of the pieces between them (length, last characters, first one); empty where guard is not true."""
    none = F.struct(F.array().cast("array<string>").alias("m"), F.array().cast("array<struct<n:int,tail:string,head:string>>").alias("p"))
    piece = lambda x: F.struct(F.char_length(x).alias("n"), F.substring(x, -CONTEXT, CONTEXT).alias("tail"), F.substring(x, 1, 1).alias("head"))
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), piece).alias("p"))
    return F.when(guard, found).otherwise(none)


GROUP = 64


def placed(found: Column) -> Column:
    """Spans from matches(), with the CONTEXT characters before them (not beyond the match before) and the one after. Places are running sums, worked out in groups of GROUP matches: an array copied for each match
    would make a text of n matches cost n * n; here it costs n * (GROUP + n / GROUP ** 2)."""
    m_, p_ = found["m"], found["p"]
    before = lambda i: F.substring(F.concat(F.coalesce(F.get(m_, i - 1), F.lit("")), F.get(p_, i)["tail"]), -CONTEXT, CONTEXT)
    after = lambda i: F.coalesce(F.nullif(F.get(p_, i + 1)["head"], F.lit("")), F.substring(F.get(m_, i + 1), 1, 1), F.lit(""))
    zipped = F.transform(m_, lambda m, i: F.struct(m.alias("m"), F.get(p_, i)["n"].alias("p"), before(i).alias("before"), after(i).alias("after")))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(found["m"]) - 1) / GROUP).cast("int"))), lambda g: F.slice(zipped, g * GROUP + 1, F.lit(GROUP)))

    def spans(xs: Column) -> Column:
        """Spans of a group, from its own start, and its length."""
        step = lambda acc, x: F.struct(
            (acc["at"] + x["p"] + F.char_length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["p"]).alias("start"), (acc["at"] + x["p"] + F.char_length(x["m"])).alias("end"), x["m"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"),
        )
        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)

    def moved(gs: Column) -> Column:
        """All spans, each group's moved by the lengths of the groups before it."""
        starts = F.aggregate(gs, F.array(F.lit(0)), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["at"])))
        by = lambda xs, d: F.transform(xs, lambda x: F.struct((x["start"] + d).alias("start"), (x["end"] + d).alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))
        return bind(starts, lambda at: F.flatten(F.transform(gs, lambda g, i: by(g["out"], F.get(at, i)))))

    return F.when(F.size(found["m"]) == 0, F.array().cast(SPAN)).otherwise(bind(F.transform(groups, spans), moved))


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value worked out once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits of a string of at most 19 pass the Luhn check."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, from an array of struct(start, rank, end, kind) in its natural order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ranked(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == kind
