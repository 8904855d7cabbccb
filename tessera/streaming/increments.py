"""Token statistics kept up to date from a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.stats import classified, token_stats
from tessera.sources.corpus import corpus


def merged(*parts: DataFrame) -> DataFrame:
    """The sum of several count tables: counts of disjoint records simply add up."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("dataset", "token").agg(*[F.sum(c).alias(c) for c in ("n_e", "n_c", "n_o")])


def counts_sink(path: str, C: int = 2):
    """For ``writeStream.foreachBatch``: each batch's counts under its number, so a batch run twice counts once.

    A record delivered again within a batch counts once; use a watermark and ``dropDuplicatesWithinWatermark("did")`` before it for
    repetitions across batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        token_stats(classified(corpus(batch), C)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark, path: str) -> DataFrame:
    return merged(spark.read.parquet(path).drop("batch"))
