"""Column functions over units (tokens or characters) and half-open spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start: int, end: int, type: string>"


def char_level(dataset: Column) -> Column:
    return F.coalesce(dataset == "cmeee", F.lit(False))


def name_units(name: Column, chars: Column) -> Column:
    """A name as units: single characters, or its words between any Unicode white space."""
    words = F.filter(F.split(name, "(?U)\\s+"), lambda x: x != "")
    return F.when(chars, F.filter(F.split(name, ""), lambda x: x != "")).otherwise(words)


def joined(units: Column, start: Column, end: Column, chars: Column) -> Column:
    """Units ``start`` to ``end`` (clipped) as text."""
    a = F.greatest(start, F.lit(0))
    part = F.slice(units, a + 1, F.greatest(F.least(end, F.size(units)) - a, F.lit(0)))
    return F.when(chars, F.array_join(part, "")).otherwise(F.array_join(part, " "))


def occurrences(units: Column, target: Column) -> Column:
    """Start of every window of ``units`` equal to ``target``; none for an empty or too long target."""
    m, n = F.size(target), F.size(units)
    ok = (m > 0) & (m <= n)
    starts = F.filter(F.sequence(F.lit(0), F.when(ok, n - m).otherwise(0)), lambda i: (F.get(units, i) == F.get(target, F.lit(0))) & (F.slice(units, i + 1, F.greatest(m, F.lit(1))) == target))
    return F.when(ok, starts).otherwise(F.array().cast("array<int>"))


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row, though lambda functions after it use them many times.

    The optimizer would copy their expressions into each place of use; it doesn't do so across a generator.
    """
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_once")).select("*", *[F.col(f"_once.{n}").alias(n) for n in cols]).drop("_once")


def resolved(occ: Column, size: Column, etype: Column, anchors: Column) -> Column:
    """Of the occurrences of a name of ``size`` units the first that covers an anchor, else the first of all, as a span; null without any."""
    covering = F.filter(occ, lambda o: F.exists(anchors, lambda a: (a >= o) & (a < o + size)))
    at = F.coalesce(F.get(covering, F.lit(0)), F.get(occ, F.lit(0)))
    return F.when(at.isNotNull(), F.struct(at.cast("int").alias("start"), (at + size).cast("int").alias("end"), F.coalesce(etype, F.lit("")).alias("type")))


def inside(pos: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= pos) & (pos < s["end"]))


def strictly_contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"]) & ((outer["start"] != inner["start"]) | (outer["end"] != inner["end"]))


def bio_tag(tag: Column) -> Column:
    """Integer tags become their strings, unknown ones O."""
    number = tag.try_cast("int")
    return F.when(number.isNull(), tag).when(number == 1, "B-Disease").when(number == 2, "I-Disease").otherwise("O")


def bio_spans(tokens: Column, tags: Column) -> Column:
    """Spans of a tag sequence (already strings).

    One begins at ``B-``, or at ``I-`` that is first or follows exactly ``O``, and absorbs all ``I-`` that follow, of any type.
    """
    n = F.least(F.size(tokens), F.size(tags))
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    begins = F.filter(every, lambda i: F.get(tags, i).startswith("B-") | (F.get(tags, i).startswith("I-") & ((i == 0) | (F.get(tags, i - 1) == "O"))))
    stops = F.filter(every, lambda i: ~F.get(tags, i).startswith("I-"))

    def span(i: Column) -> Column:
        end = F.coalesce(F.array_min(F.filter(stops, lambda j: j > i)), n)
        return F.struct(i.cast("int").alias("start"), end.cast("int").alias("end"), F.regexp_extract(F.get(tags, i), "^[^-]*-(.*)$", 1).alias("type"), F.array_join(F.slice(tokens, i + 1, end - i), " ").alias("surface"))

    return F.transform(begins, span)
