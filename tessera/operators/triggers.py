"""Suspicious units: unseen ones next to entities, likely missed ones, and doubtful span edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.spans import inside
from tessera.operators.stats import with_stats


def covered_units(state: DataFrame) -> DataFrame:
    """``did, pos``: the units of a record that its spans cover, once each."""
    return state.select("did", F.explode(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))).alias("pos"))


def annotated(state: DataFrame, stats: DataFrame) -> DataFrame:
    """``dataset, did, pos, token, covered`` with the token's counts and probabilities; ``state`` has ``dataset, did, units, spans``."""
    every = F.transform("units", lambda u, i: F.struct(u.alias("token"), inside(i, F.col("spans")).alias("covered")))
    units = state.select("dataset", "did", F.posexplode(every).alias("pos", "u")).select("dataset", "did", "pos", F.col("u.token").alias("token"), F.col("u.covered").alias("covered"))
    return with_stats(units, stats)


def unseen_triggers(units: DataFrame, C: int = 2, surround: float = 0.5) -> DataFrame:
    """``did, pos, token``: uncovered units never seen in training, with a seen unit within ``C`` that is mostly entity or context."""
    hot = F.col("seen") & ((F.col("p_e") >= surround) | (F.col("p_c") >= surround))
    near = F.max(F.coalesce(hot, F.lit(False))).over(W.partitionBy("did").orderBy("pos").rowsBetween(-C, C))
    return units.withColumn("near", near).where("near and not seen and not covered").select("did", "pos", "token")


def fn_triggers(units: DataFrame, theta: float = 0.95) -> DataFrame:
    """``did, pos, token``: uncovered seen units whose entity probability exceeds ``theta``."""
    return units.where(F.col("seen") & ~F.col("covered") & (F.col("p_e") > theta)).select("did", "pos", "token")


def boundary_triggers(state: DataFrame, stats: DataFrame, K: int = 2) -> DataFrame:
    """``did, span_ord, pos, token, side``: edge units of each span that look like context, and uncovered units beside it that look like entity."""
    def places(s):
        begin, end = s["start"], s["end"]
        edge = F.filter(F.sequence(begin, end - 1), lambda p: (p < begin + K) | (p >= end - K))
        out = F.filter(F.sequence(begin - K, end + K - 1), lambda p: ((p < begin) | (p >= end)) & (p >= 0) & (p < F.size("units")) & ~inside(p, F.col("spans")))
        tag = lambda ps, side: F.transform(ps, lambda p: F.struct(p.alias("pos"), F.lit(side).alias("side")))
        return F.concat(tag(edge, "inside"), tag(out, "outside"))

    edges = state.select("dataset", "did", "units", "spans", F.posexplode("spans").alias("span_ord", "s")).select("dataset", "did", "span_ord", "units", F.explode(places(F.col("s"))).alias("x"))
    rows = edges.select("dataset", "did", "span_ord", F.col("x.pos").alias("pos"), F.col("x.side").alias("side"), F.get("units", F.col("x.pos")).alias("token"))
    tell = ((F.col("side") == "inside") & (F.col("p_c") > F.col("p_e"))) | ((F.col("side") == "outside") & (F.col("p_e") > F.col("p_c")))
    return with_stats(rows, stats).where(F.col("seen") & tell).select("did", "span_ord", "pos", "token", "side")


def neighbor_examples(units: DataFrame, triggers: DataFrame, library: DataFrame, C: int = 2, M: int = 1) -> DataFrame:
    """``did, pos, neighbor_pos, neighbor, rank, text, name, type``: seen units around each trigger and their first ``M`` entity examples."""
    t = triggers.select("did", F.col("pos").alias("t_pos"))
    near = units.where("seen").join(t, "did").where((F.abs(F.col("pos") - F.col("t_pos")) <= C) & (F.col("pos") != F.col("t_pos")))
    examples = library.where((F.col("cls") == "entity") & (F.col("rank") <= M)).select("dataset", "token", "rank", "text", "name", "type")
    return near.select("dataset", "did", F.col("t_pos").alias("pos"), F.col("pos").alias("neighbor_pos"), "token").join(examples, ["dataset", "token"], "left").select("did", "pos", "neighbor_pos", F.col("token").alias("neighbor"), "rank", "text", "name", "type")


def example_buckets(triggers: DataFrame, library: DataFrame, M: int = 1) -> DataFrame:
    """``did, pos, token, cls, rank, text, name, type``: the first ``M`` examples of each class for each trigger (with ``dataset``)."""
    return triggers.join(library.where(F.col("rank") <= M), ["dataset", "token"]).select("did", "pos", "token", "cls", "rank", "text", "name", "type")
