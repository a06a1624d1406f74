"""Places of regex matches, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, cheap: Column | None = None) -> Column:
    """Array of (start, end exclusive, value) of the leftmost non-overlapping matches; places are code points.

    The pieces between matches and the matches themselves alternate, so their lengths add up to places. cheap is
    a condition that any text with a match meets; without a match no pieces are made.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    begin = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        return F.when(x["1"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["1"].alias("value"))).alias("out")))

    pairs = F.transform(pairs, lambda x: F.struct(x["piece"].alias("0"), x["found"].alias("1")))
    has = F.rlike(text, F.lit(pattern))
    return F.when(has if cheap is None else cheap & has, F.aggregate(pairs, begin, step)["out"]).otherwise(none())


def kinds(named: list[tuple[str, Column]]) -> Column:
    """One array of (start, kind_no, end, kind) of several arrays of spans, by start and then by kind as listed."""

    def tagged(no: int, kind: str, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[tagged(no, kind, found) for no, (kind, found) in enumerate(named)]))


def text_of(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
