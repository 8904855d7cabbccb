"""How well a sample keeps the distribution of types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_counts(records: DataFrame, flag: str) -> DataFrame:
    """``dataset, type, target_count, count``: mentions by type in all records and in those where ``flag`` is true."""
    return records.select("dataset", F.col(flag).alias("_in"), F.explode("entities.type").alias("type")).groupBy("dataset", "type").agg(F.count("*").alias("target_count"), F.count_if("_in").alias("count"))


def distances(records: DataFrame, flag: str) -> DataFrame:
    """``dataset, l1_distance, count_distance``.

    The first is the sum of absolute differences of type shares; the second the same of counts from
    those expected for the sample's size, over the mentions expected in it.
    """
    docs = records.groupBy("dataset").agg(F.count("*").alias("n_docs"), F.count_if(F.col(flag)).alias("n_sample"))
    t = type_counts(records, flag)
    totals = t.groupBy("dataset").agg(F.sum("target_count").alias("all"), F.sum("count").alias("own"))
    x = t.join(totals, "dataset").join(docs, "dataset")
    share = F.abs(F.col("count") / F.nullif(F.col("own"), F.lit(0)) - F.col("target_count") / F.col("all"))
    expected = F.abs(F.col("count") - F.col("target_count") * F.col("n_sample") / F.col("n_docs"))
    return x.groupBy("dataset").agg(F.round(F.sum(share), 9).alias("l1_distance"), F.round(F.sum(expected) / F.nullif(F.first("all") / F.first("n_docs") * F.first("n_sample"), F.lit(0.0)), 9).alias("count_distance"))
