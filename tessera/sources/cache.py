"""The answer cache, responders behind it, and result sinks."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut, path_exists


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (``key``) with the cached ``text`` and token counts; ``cached`` tells whether there was one. The last write of a key counts."""
    last = cache.where("key is not null").groupBy("key").agg(F.max_by(F.struct("text", "prompt_tokens", "completion_tokens"), F.struct("written_at", "text")).alias("c"))
    return requests.join(last, "key", "left").select(requests["*"], F.col("c.text").alias("text"), F.col("c.prompt_tokens").alias("prompt_tokens"), F.col("c.completion_tokens").alias("completion_tokens"), F.col("c").isNotNull().alias("cached"))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without an answer, one per key."""
    return requests.dropDuplicates(["key"]).join(cache.select("key").where("key is not null"), "key", "left_anti")


def with_retries(call: Callable[[str], str], attempts: int = 6, base: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call`` tried again after connection errors, with growing, jittered pauses; other errors pass through."""

    def run(prompt: str) -> str:
        for i in range(attempts):
            try:
                return call(prompt)
            except (ConnectionError, TimeoutError):
                if i == attempts - 1:
                    raise
                sleep(base * 2**i + random.random())
        raise AssertionError

    return run


def respond(requests: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``key, text, error``: one answer per request (``key, prompt``); ``client`` is built once in each worker, a failure stays in its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["key"], pdf["prompt"], strict=True):
                try:
                    rows.append((key, call(prompt), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((key, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["key", "text", "error"])

    return requests.select("key", "prompt").mapInPandas(run, "key string, text string, error string")


def http_client(url: str, model: str, api_key: str = "", temperature: float = 0.0, max_tokens: int = 1024, timeout: float = 60.0) -> Callable[[], Callable[[str], str]]:
    """A client factory for ``respond``: chat completions over HTTP, one request a prompt, tried again when the server is busy or away."""

    def make() -> Callable[[str], str]:
        import urllib.error
        import urllib.request

        def ask(prompt: str) -> str:
            body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
            request = urllib.request.Request(url, json.dumps(body).encode(), head)
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if e.code == 429 or e.code >= 500:
                    raise ConnectionError(f"HTTP {e.code}") from e
                raise
            except urllib.error.URLError as e:
                raise ConnectionError(str(e.reason)) from e

        return with_retries(ask)

    return make


def answered(requests: DataFrame, cache_path: str, client: Callable[[], Callable[[str], str]], run_id: int = 0) -> DataFrame:
    """Requests (``key, prompt``) with their answers: misses are asked once each and appended to the cache, then all are read from it.

    A failed request stops the run after the others are stored, so that running again asks only for the rest.
    """
    spark = requests.sparkSession
    schema = "key string, text string, prompt_tokens int, completion_tokens int, run_id int, written_at timestamp"
    known = spark.read.schema(schema).parquet(cache_path) if path_exists(spark, cache_path) else spark.createDataFrame([], schema)
    fresh = cut(respond(misses(requests, known), client))
    done = fresh.where("error is null").select("key", "text", F.lit(None).cast("int").alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"), F.lit(run_id).alias("run_id"), F.current_timestamp().alias("written_at"))
    done.write.mode("append").parquet(cache_path)
    guard(fresh)
    return hits(requests, spark.read.schema(schema).parquet(cache_path))


def guard(answers: DataFrame) -> DataFrame:
    """The answers, or an error if any of them failed: results are evaluated whole or not at all."""
    if failed := answers.where("error is not null").count():
        raise RuntimeError(f"{failed} requests failed; run again, answered ones come from the cache")
    return answers


def usage(cache: DataFrame) -> DataFrame:
    """``run_id, answers, tokens_in, tokens_out, unknown``: usage of each run, each key once; unknown token counts add nothing."""
    one = cache.where("key is not null").groupBy("key").agg(F.min("run_id").alias("run_id"), F.max("prompt_tokens").alias("a"), F.max("completion_tokens").alias("b"))
    return one.groupBy("run_id").agg(F.count("*").alias("answers"), F.coalesce(F.sum("a"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("b"), F.lit(0)).alias("tokens_out"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unknown"))


def document_dump(pairs: DataFrame) -> DataFrame:
    """``did, gold, pred``: distinct spans in order, an empty list where there are none."""
    empty = F.array().cast("array<struct<start: int, end: int, type: string>>")
    return pairs.select("did", *[F.array_sort(F.array_distinct(F.coalesce(c, empty))).alias(c) for c in ("gold", "pred")])


def report_name(dataset: str, method: str, split: str, n: int, seed: int, **changed: object) -> str:
    """File name of a report: the run, then each changed setting."""
    return "_".join([dataset, method, split, f"n{n}", f"seed{seed}", *[f"{k}{v}" for k, v in sorted(changed.items())]]) + ".json"


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)
