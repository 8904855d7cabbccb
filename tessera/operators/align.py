"""From names back to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.spans import char_level, name_units, occurrences, once


def found_occurrences(records: DataFrame, names: DataFrame) -> DataFrame:
    """``did, name, start, end``: every occurrence of each name (``did, name``) in its record."""
    both = once(names.select("did", "name").join(records.select("dataset", "did", "units"), "did"), target=name_units(F.col("name"), char_level(F.col("dataset"))))
    return both.select("did", "name", F.size("target").alias("m"), F.explode(occurrences(F.col("units"), F.col("target"))).alias("start")).select("did", "name", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("m")).cast("int").alias("end"))


def aligned(records: DataFrame, preds: DataFrame, prefer: tuple[str, str] | None = None) -> DataFrame:
    """``did, emit_ord, name, type, start, end, status, n_candidates`` for each prediction (``did, emit_ord, name, type``).

    Predictions take occurrences in the order they were emitted; an occurrence, whatever its type, is taken once. Only names of equal units
    compete, so the k-th of them takes the k-th occurrence: no loop, one window per record. With ``prefer``, columns of ``preds``
    that hold an interval, occurrences inside it come first.
    """
    extra = list(prefer or ())
    both = preds.select("did", "emit_ord", "name", "type", *extra).join(records.select("dataset", "did", "units"), "did")
    rows = once(once(both, target=name_units(F.col("name"), char_level(F.col("dataset")))), occ=occurrences(F.col("units"), F.col("target")))
    if prefer:
        within = lambda o: (o >= F.col(prefer[0])) & (o + F.size("target") <= F.col(prefer[1]))
        rows = rows.withColumn("occ", F.concat(F.filter("occ", within), F.filter("occ", lambda o: ~F.coalesce(within(o), F.lit(False)))))
    turn = F.row_number().over(W.partitionBy("did", "target").orderBy("emit_ord"))
    at = F.get("occ", F.col("k") - 1).cast("int")
    placed = rows.withColumn("k", turn).withColumn("start", at)
    return placed.select("did", "emit_ord", "name", "type", "start", (F.col("start") + F.size("target")).cast("int").alias("end"), F.when(F.col("start").isNotNull(), "aligned").otherwise("unaligned").alias("status"), F.size("occ").alias("n_candidates"))


def aligned_spans(rows: DataFrame) -> DataFrame:
    """``did, spans``: aligned predictions as distinct spans in emission order; unaligned ones are dropped."""
    kept = rows.where("status = 'aligned'").groupBy("did").agg(F.sort_array(F.collect_list(F.struct("emit_ord", "start", "end", "type"))).alias("x"))
    return kept.select("did", F.array_distinct(F.transform("x", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["type"].alias("type")))).alias("spans"))


def round_trip(records: DataFrame) -> DataFrame:
    """``dataset, did, golds, recovered, complete``: whether aligning a record's own surfaces gives back its spans."""
    preds = records.select("did", F.explode("entities").alias("e")).select("did", F.col("e.ent_ord").alias("emit_ord"), F.coalesce("e.surface", F.lit("")).alias("name"), F.col("e.type").alias("type"))
    got = aligned_spans(aligned(records, preds))
    gold = records.select("dataset", "did", F.array_distinct(F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type")))).alias("gold"))
    n = F.size(F.array_intersect("gold", F.coalesce("spans", F.array().cast("array<struct<start: int, end: int, type: string>>"))))
    return gold.join(got, "did", "left").select("dataset", "did", F.size("gold").alias("golds"), n.alias("recovered"), (n == F.size("gold")).alias("complete"))
