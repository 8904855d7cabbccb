"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks (problem 8)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.runtime import bounded_rows, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of that vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fractional part of the golden ratio: the step of the low-discrepancy sequence.
GOLDEN = 0.6180339887498949
_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("blocks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens``: the size of each document; a null or empty text has 0 tokens, a repeated ``doc_id`` counts once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for pdf in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": sizes})

    known = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text").where("doc_id is not null")
    return known.mapInPandas(count, "doc_id bigint, source string, tokens bigint").dropDuplicates(["doc_id"])


def blocks(sizes: DataFrame, block_tokens: int, seed: int = 0, bucket_tokens: int = 20_000_000) -> DataFrame:
    """``source, doc_id, tokens, block``: the documents of each source in shuffled order, cut to blocks of ``block_tokens``.

    A block holds the documents whose first token falls into it. Offsets are summed in two steps, over hash buckets
    and within a bucket, so a source of any size is never in one task. Documents without a source take no part.
    """
    known = sizes.where("source is not null and tokens > 0")
    rank = F.xxhash64(F.lit(seed), "source", "doc_id")
    n = known.groupBy("source").agg(F.sum("tokens").alias("t")).select("source", F.greatest(F.lit(1), F.ceil(F.col("t") / bucket_tokens)).cast("bigint").alias("buckets"))
    placed = known.join(n, "source").select("source", "doc_id", "tokens", rank.alias("r"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("buckets")).alias("bucket"))
    per = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = per.select("source", "bucket", (F.sum("t").over(W.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    within = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("r", "doc_id")) - F.col("tokens")
    return placed.withColumn("o", within).join(before, ["source", "bucket"]).select("source", "doc_id", "tokens", F.floor((F.col("base") + F.col("o")) / block_tokens).alias("block"))


def schedule(plans: DataFrame, slots: int, chunk: int = 65_536, max_plan_rows: int = 100_000) -> DataFrame:
    """``plan_id, slot, source, turn``: which source fills each of ``slots`` slots, and for the how-many-th time.

    Slot k is the point frac(k * golden ratio) on the cumulative weights of its plan, so each stretch
    of slots follows the weights closely. Turns are ranked in chunks whose counts are then summed.
    Lines without a plan, a source or a positive weight take no part; a repeated line counts once.
    """
    spark = plans.sparkSession
    lines: dict = {}
    for r in bounded_rows(plans.where("plan_id is not null and source is not null and weight_pm > 0").dropDuplicates(["plan_id", "source"]), max_plan_rows, "mix plans"):
        lines.setdefault(r.plan_id, []).append((r.source, r.weight_pm))
    if not lines:
        return spark.createDataFrame([], "plan_id int, slot bigint, source string, turn bigint")
    rings = []
    for plan, own in lines.items():
        total, at, bounds = sum(w for _, w in own), 0, []
        own = sorted(own)
        for _, w in own[:-1]:
            at += w
            bounds.append(at / total)
        rings.append(F.struct(F.lit(plan).cast("int").alias("plan_id"), F.array(*map(F.lit, bounds)).cast("array<double>").alias("bounds"), F.array(*[F.lit(x) for x, _ in own]).alias("sources")))
    k = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)").alias("u"), F.floor(F.col("id") / chunk).alias("chunk"))
    each = k.select("slot", "u", "chunk", F.explode(F.array(*rings)).alias("p"))
    hit = each.select("slot", "chunk", "p.plan_id", F.get("p.sources", F.size(F.filter("p.bounds", lambda b: b <= F.col("u")))).alias("source"))
    per = hit.groupBy("plan_id", "source", "chunk").agg(F.count("*").alias("n"))
    before = per.select("plan_id", "source", "chunk", (F.sum("n").over(W.partitionBy("plan_id", "source").orderBy("chunk")) - F.col("n")).alias("base"))
    turn = F.row_number().over(W.partitionBy("plan_id", "source", "chunk").orderBy("slot")) - 1
    return hit.withColumn("t", turn).join(before, ["plan_id", "source", "chunk"]).select("plan_id", "slot", "source", (F.col("base") + F.col("t")).alias("turn"))


def mix(docs: DataFrame, plans: DataFrame, block_tokens: int = 20_000, seed: int = 0, tokenizer: str = TOKENIZER, least_slots: int = 65_536) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(sizes, the blocks of each source, the filled slots ``plan_id, slot, source, block, epoch, tokens``, all tokens).

    A source gives its blocks in turn, again from the first when all are used, but no more than ``max_repeats``
    times; later slots of that source stay unfilled with a null block and 0 tokens. A collection of fewer than ``least_slots`` blocks is
    cut to smaller ones, so that small weights get slots enough.
    """
    sizes = cut(token_sizes(docs, tokenizer))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    block_tokens = max(1, min(block_tokens, total // least_slots))
    cuts = blocks(sizes, block_tokens, seed)
    per_block = cuts.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    number = per_block.groupBy("source").agg((F.max("block") + 1).alias("n_blocks"))
    limits = plans.where("plan_id is not null and source is not null").dropDuplicates(["plan_id", "source"]).select("plan_id", "source", F.coalesce("max_repeats", F.lit(1)).alias("repeats"))
    slots = schedule(plans, -(-total // block_tokens) if total else 0).join(F.broadcast(limits), ["plan_id", "source"]).join(number, "source", "left")
    open_ = F.col("turn") < F.col("repeats") * F.coalesce("n_blocks", F.lit(0))
    placed = slots.select("plan_id", "slot", "source", F.when(open_, F.pmod("turn", "n_blocks")).alias("block"), F.when(open_, F.floor(F.col("turn") / F.col("n_blocks"))).alias("epoch"))
    filled = placed.join(per_block, ["source", "block"], "left").select("plan_id", "slot", "source", "block", "epoch", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return sizes, cuts, filled, total


def mixed_records(cuts: DataFrame, filled: DataFrame) -> DataFrame:
    """``plan_id, slot, epoch, source, doc_id``: the mix itself, the records of each filled slot; a slot is a block, whose records are shuffled."""
    return filled.where("block is not null").select("plan_id", "slot", "epoch", "source", "block").join(cuts.select("source", "block", "doc_id"), ["source", "block"]).select("plan_id", "slot", "epoch", "source", "doc_id")


def report(docs: DataFrame, plans: DataFrame, block_tokens: int = 20_000, seed: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """``plan_id, source, weight_pm, max_repeats, size, total, slots, unfilled, tokens, share, short``: one row per plan line.

    ``share`` is the actual share of the mixed tokens. A line falls ``short`` if slots of its stay unfilled when its source
    has given all blocks as often as it may; ``total`` counts all documents (those without a source or plan line included), and the slots are as
    many as its blocks. A source without documents fills none.
    """
    sizes, _, filled, total = mix(docs, plans, block_tokens, seed, tokenizer)
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("size"))
    got = filled.groupBy("plan_id", "source").agg(F.count("*").alias("slots"), F.count_if(F.col("block").isNull()).alias("unfilled"), F.sum("tokens").alias("tokens"))
    lines = plans.where("plan_id is not null and source is not null").dropDuplicates(["plan_id", "source"]).select("plan_id", "source", F.coalesce("weight_pm", F.lit(0)).alias("weight_pm"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    joined = lines.join(got, ["plan_id", "source"], "left").join(own, "source", "left").withColumn("total", F.lit(total).cast("bigint"))
    none = F.lit(0)
    return joined.select(
        "plan_id", "source", "weight_pm", "max_repeats", F.coalesce("size", none).alias("size"), "total", F.coalesce("slots", none).alias("slots"), F.coalesce("unfilled", none).alias("unfilled"),
        F.coalesce("tokens", none).alias("tokens"), (F.coalesce("tokens", none) / F.nullif(F.sum("tokens").over(W.partitionBy("plan_id")), none)).alias("share"), (F.coalesce("unfilled", none) > 0).alias("short"),
    )
