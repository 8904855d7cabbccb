"""Token vectors from hashes: the default embedder, exact in integers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import path_exists

DIM = 16


def hash_vector(token: Column, dim: int = DIM) -> Column:
    """Byte i of the token's SHA-256, mapped to 2 * byte - 255: the usual byte / 255 - 0.5 times 510, so cosines are the same."""
    h = F.sha2(token, 256)
    return F.array(*[(F.conv(F.substring(h, 2 * (i % 32) + 1, 2), 16, 10).cast("bigint") * 2 - 255) for i in range(dim)])


def hash_embedding(token: Column, dim: int = DIM) -> Column:
    return F.transform(hash_vector(token, dim), lambda x: x / F.lit(510.0))


def encode(texts: DataFrame, column: str, model: Callable[[], Callable[[list[str]], list]], batch: int = 256) -> DataFrame:
    """``text, vec`` of the distinct texts by any encoder; ``model`` is called once in each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = model()
        for pdf in batches:
            own = pdf["text"].tolist()
            vecs = [v for i in range(0, len(own), batch) for v in encoder(own[i : i + batch])]
            yield pd.DataFrame({"text": own, "vec": [[float(x) for x in v] for v in vecs]})

    return texts.select(F.col(column).alias("text")).where("text is not null").distinct().mapInPandas(run, "text string, vec array<double>")


def cached_vectors(texts: DataFrame, column: str, path: str, model: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """``text, vec`` of the distinct texts: those not yet in the table at ``path`` are encoded and appended to it."""
    spark, schema = texts.sparkSession, "text string, vec array<float>"
    asked = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    known = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    encode(asked.join(known, "text", "left_anti"), "text", model).select("text", F.col("vec").cast("array<float>").alias("vec")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).dropDuplicates(["text"]).join(asked, "text", "left_semi")


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))
