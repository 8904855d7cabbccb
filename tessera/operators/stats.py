"""Token classes, counts, probabilities and the example library."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.spans import char_level, joined
from tessera.runtime import broadcast_if_small


def classified(records: DataFrame, C: int = 2) -> DataFrame:
    """``dataset, split, did, ord, pos, token, cls, ent``: each unit's class and the mention it belongs to.

    A unit in a span is ``entity`` and belongs to the last mention that covers it; within ``C`` units of one it is ``context`` and belongs to
    the first such mention in list order; else it is ``other``. All of it is computed inside the record: nothing is shuffled.
    """
    def label(i: Column) -> Column:
        over = F.filter("entities", lambda e: (e["start"] <= i) & (i < e["end"]))
        near = F.filter("entities", lambda e: (e["start"] - C <= i) & (i < e["end"] + C))
        cls = F.when(F.size(over) > 0, "entity").when(F.size(near) > 0, "context").otherwise("other")
        return F.struct(cls.alias("cls"), F.coalesce(F.try_element_at(over, F.lit(-1)), F.get(near, F.lit(0))).alias("ent"))

    every = F.transform("units", lambda u, i: F.struct(u.alias("token"), label(i).alias("x")))
    return records.select("dataset", "split", "did", "ord", F.posexplode(every).alias("pos", "u")).select("dataset", "split", "did", "ord", "pos", F.col("u.token").alias("token"), F.col("u.x.cls").alias("cls"), F.col("u.x.ent").alias("ent"))


def token_stats(units: DataFrame) -> DataFrame:
    """``dataset, token, n_e, n_c, n_o`` from classified units: one shuffle, after partial aggregation."""
    return units.groupBy("dataset", "token").agg(*[F.count_if(F.col("cls") == c).alias(n) for c, n in (("entity", "n_e"), ("context", "n_c"), ("other", "n_o"))])


def probabilities(stats: DataFrame) -> DataFrame:
    """Adds ``n, p_e, p_c, p_o``; all 0 where a token has no occurrence."""
    n = F.col("n_e") + F.col("n_c") + F.col("n_o")
    p = lambda c: F.when(n > 0, F.col(c).cast("double") / n).otherwise(F.lit(0.0))
    return stats.select("*", n.alias("n"), p("n_e").alias("p_e"), p("n_c").alias("p_c"), p("n_o").alias("p_o"))


def weighted(stats: DataFrame, w_e: float = 1.0, w_c: float = 1.0, w_o: float = 0.01, scale: int = 1_000_000) -> DataFrame:
    """``dataset, token, w``: the retrieval weight in whole parts of 1 / ``scale``, so that sums don't depend on their order.

    Tokens absent from the table weigh 1, that is ``scale``.
    """
    p = probabilities(stats)
    return p.select("dataset", "token", F.floor((F.col("p_e") * w_e + F.col("p_c") * w_c + F.col("p_o") * w_o) * scale).cast("bigint").alias("w"))


def with_stats(units: DataFrame, stats: DataFrame, max_vocabulary: int = 500_000) -> DataFrame:
    """Units with the counts and probabilities of their token, null where it was never seen; a small vocabulary is broadcast."""
    s = probabilities(stats).select("dataset", "token", "n_e", "n_c", "n_o", "p_e", "p_c", F.lit(True).alias("seen"))
    return units.join(broadcast_if_small(s, max_vocabulary), ["dataset", "token"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def span_library(records: DataFrame, C: int = 2, cap: int = 50) -> DataFrame:
    """``dataset, token, cls, rank, text, name, type``: the first ``cap`` units of each token and class in corpus order.

    ``text`` is the unit's neighbourhood of ``C`` units, name and type those of the mention it belongs to. Only the place of a unit
    is ranked (a group limit in each task first); the text is made after that.
    """
    units = classified(records, C).select("dataset", "did", "ord", "pos", "token", "cls", F.col("ent.surface").alias("name"), F.col("ent.type").alias("type"))
    first = units.withColumn("rank", F.row_number().over(W.partitionBy("dataset", "token", "cls").orderBy("ord", "did", "pos"))).where(F.col("rank") <= cap)
    text = joined(F.col("units"), F.col("pos") - C, F.col("pos") + C + 1, char_level(F.col("dataset")))
    return first.join(records.select("did", "units"), "did").select("dataset", "token", "cls", "rank", text.alias("text"), "name", "type")


def stats_validation(stats: DataFrame, expected: list[tuple[str, int, int, int]], tolerance: float = 0.01) -> DataFrame:
    """``token, worst, ok``: the largest difference of a class probability from the expected counts; absent tokens fail."""
    want = probabilities(stats.sparkSession.createDataFrame(expected, "token string, n_e bigint, n_c bigint, n_o bigint"))
    have = probabilities(stats.groupBy("token").agg(F.sum("n_e").alias("n_e"), F.sum("n_c").alias("n_c"), F.sum("n_o").alias("n_o")))
    both = F.broadcast(want).alias("a").join(have.alias("b"), F.col("a.token") == F.col("b.token"), "left")
    worst = F.greatest(*[F.abs(F.col(f"a.{p}") - F.coalesce(F.col(f"b.{p}"), F.lit(0.0))) for p in ("p_e", "p_c", "p_o")])
    return both.select(F.col("a.token").alias("token"), worst.alias("worst"), (F.col("b.token").isNotNull() & (worst <= tolerance)).alias("ok"))


def save(stats: DataFrame, library: DataFrame, path: str, C: int = 2, cap: int = 50) -> None:
    """Counts and library as Parquet, the two settings beside them; the commit protocol makes each write atomic."""
    stats.write.mode("overwrite").parquet(f"{path}/counts")
    library.write.mode("overwrite").parquet(f"{path}/library")
    stats.sparkSession.createDataFrame([(json.dumps({"C": C, "span_cap": cap}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def json_rows(stats: DataFrame, library: DataFrame) -> DataFrame:
    """One row per token for ``write.json``: its counts by class and, by class, its examples in order."""
    shown = library.groupBy("dataset", "token", "cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "name", "type"))), lambda e: F.struct(e["text"].alias("text"), e["name"].alias("name"), e["type"].alias("type"))).alias("x"))
    spans = shown.groupBy("dataset", "token").agg(F.map_from_entries(F.collect_list(F.struct("cls", "x"))).alias("spans"))
    counts = F.struct(F.col("n_e").alias("entity"), F.col("n_c").alias("context"), F.col("n_o").alias("other"))
    return stats.select("dataset", "token", counts.alias("counts")).join(spans, ["dataset", "token"], "left")


def from_json_rows(rows: DataFrame) -> DataFrame:
    """The count table of what ``json_rows`` gave; missing classes are 0."""
    return rows.select("dataset", "token", *[F.coalesce(F.col(f"counts.{c}"), F.lit(0)).cast("bigint").alias(n) for c, n in (("entity", "n_e"), ("context", "n_c"), ("other", "n_o"))])


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """What ``save`` wrote; missing counts are 0 and a missing cap is 50."""
    counts = spark.read.parquet(f"{path}/counts").fillna(0, ["n_e", "n_c", "n_o"])
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    return counts, spark.read.parquet(f"{path}/library"), {"C": settings.get("C", 2), "span_cap": settings.get("span_cap", 50)}
