"""Readers of annotated corpora and the record table all operators work on."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.spans import bio_spans, bio_tag
from tessera.plans.config import CMEEE_DISPLAY, known
from tessera.runtime import broadcast_if_small, path_exists

CMEEE = "text string, entities array<struct<start_idx: int, end_idx: int, type: string, entity: string>>"
GENIA = "tokens array<string>, entities array<struct<start: int, end: int, type: string>>"
NCBI = "tokens array<string>, ner_tags array<string>, tags array<string>"
ENTITIES = "array<struct<start: int, end: int, type: string, surface: string>>"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character that isn't blank; an empty file has no records."""
    head = spark.read.text(path).where("trim(value) <> ''").select(F.ltrim("value").substr(1, 1).alias("c")).limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", head[0].c == "[").json(path)


def _ordered(raw: DataFrame, name: str, split: str) -> DataFrame:
    """File order made a column, counted in two steps, never in one task."""
    tagged = raw.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    per = tagged.groupBy("_p").agg(F.count("*").alias("n"))
    base = per.select("_p", (F.sum("n").over(W.orderBy("_p")) - F.col("n")).alias("_base"))  # one row for each partition
    ord_ = F.col("_base") + F.pmod("_m", F.lit(1 << 33))
    return tagged.join(F.broadcast(base), "_p").withColumn("ord", ord_).withColumn("did", F.concat(F.lit(f"{name}-{split}-"), F.col("ord").cast("string"))).withColumn("dataset", F.lit(name)).withColumn("split", F.lit(split))


def load(spark: SparkSession, name: str, split: str, directory: str) -> DataFrame:
    """``dataset, split, did, ord, units, text, entities`` of one split; unknown names are an error.

    Types are remapped to their display names where the dataset has such a map; ``{split}.json`` is preferred to ``{split}.jsonl``.
    """
    known(name)
    path = next((p for p in (f"{directory}/{split}.json", f"{directory}/{split}.jsonl") if path_exists(spark, p)), f"{directory}/{split}.json")
    none = F.array().cast(ENTITIES)
    if name == "cmeee":
        raw = _ordered(read_records(spark, path, CMEEE), name, split)
        units, text = F.split("text", ""), F.col("text")
        ents = F.transform("entities", lambda e: F.struct(e["start_idx"].alias("start"), e["end_idx"].alias("end"), e["type"].alias("type"), e["entity"].alias("surface")))
        units = F.filter(units, lambda c: c != "")
    elif name == "genia":
        raw = _ordered(read_records(spark, path, GENIA), name, split)
        units, text = F.col("tokens"), F.array_join("tokens", " ")
        ents = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"), F.array_join(F.slice("tokens", e["start"] + 1, e["end"] - e["start"]), " ").alias("surface")))
    else:
        raw = _ordered(read_records(spark, path, NCBI), name, split)
        units, text = F.col("tokens"), F.array_join("tokens", " ")
        ents = bio_spans(F.col("tokens"), F.transform(F.coalesce("ner_tags", "tags"), bio_tag))
    out = raw.select("dataset", "split", "did", "ord", units.alias("units"), text.alias("text"), F.coalesce(ents, none).alias("entities"))
    return remap_types(out, CMEEE_DISPLAY) if name == "cmeee" else out


def remap_types(docs: DataFrame, remap: dict[str, str]) -> DataFrame:
    """Entity types replaced by the map, others as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in remap.items() for x in kv])
    new = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.coalesce(F.try_element_at(pairs, e["type"]), e["type"]).alias("type"), e["surface"].alias("surface")))
    return docs.withColumn("entities", new)


def corpus(docs: DataFrame) -> DataFrame:
    """One row per ``did`` of a delivered record table; only spans inside the record stay, with their place in the list.

    Entities become ``struct<start, end, type, surface, ent_ord>``; a null type is the empty string. Rows without
    ``did`` or ``units`` take no part; records delivered again are the same, so any of them is kept.
    """
    one = docs.where("did is not null and units is not null").select("dataset", "split", "did", "ord", "units", "text", "entities").dropDuplicates(["did"])
    numbered = F.transform(F.coalesce("entities", F.array().cast(ENTITIES)), lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.coalesce(e["type"], F.lit("")).alias("type"), e["surface"].alias("surface"), i.alias("ent_ord")))
    valid = F.filter(numbered, lambda e: (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.size("units")))
    return one.withColumn("entities", valid)


def unit_rows(records: DataFrame, *keep: str) -> DataFrame:
    return records.select("dataset", "split", "did", "ord", *keep, F.posexplode("units").alias("pos", "token"))


def type_names(records: DataFrame, entity_types: DataFrame, max_types: int = 100_000) -> DataFrame:
    """``did, ent_ord, raw, code``: each mention's type as the dataset's code; null where it is none."""

    def key(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.regexp_replace(c, "^\\s+|\\s+$", "")), "[\\s_-]+", "_")

    names = entity_types.select("dataset", "code", F.explode(F.array("code", "full_name")).alias("n")).select("dataset", key(F.col("n")).alias("k"), "code").groupBy("dataset", "k").agg(F.min("code").alias("code"))
    said = records.select("dataset", "did", F.explode("entities").alias("e")).select("dataset", "did", F.col("e.ent_ord").alias("ent_ord"), F.col("e.type").alias("raw"), key(F.col("e.type")).alias("k"))
    return said.join(broadcast_if_small(names, max_types), ["dataset", "k"], "left").select("did", "ent_ord", "raw", "code")


def offset_check(records: DataFrame) -> DataFrame:
    """``dataset, total, mismatch``: mentions, and those whose surface isn't their slice (joined by nothing for characters)."""
    e = records.select("dataset", "units", F.explode("entities").alias("e"))
    part = F.slice("units", F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))
    text = F.when(F.col("dataset") == "cmeee", F.array_join(part, "")).otherwise(F.array_join(part, " "))
    return e.groupBy("dataset").agg(F.count("*").alias("total"), F.count_if(~text.eqNullSafe(F.col("e.surface"))).alias("mismatch"))


def slice_rows(records: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows ``start:end`` of each dataset and split in file order; negative ends count from the back."""
    n = records.groupBy("dataset", "split").agg((F.max("ord") + 1).alias("_n"))
    place = lambda x, default: default if x is None else (F.lit(x) if x >= 0 else F.greatest(F.col("_n") + x, F.lit(0)))
    if (start is None or start >= 0) and (end is None or end >= 0):
        return records.where((F.col("ord") >= (start or 0)) & (F.lit(True) if end is None else F.col("ord") < end))
    return records.join(n, ["dataset", "split"]).where((F.col("ord") >= place(start, F.lit(0))) & (F.col("ord") < place(end, F.col("_n")))).drop("_n")


def parse_slice(text: str) -> tuple[int | None, int | None]:
    if text.count(":") != 1:
        raise ValueError("a slice has the form START:END")
    return tuple(int(x) if x.strip() else None for x in text.split(":"))


def hash_sample(records: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` records (a top-k by a seeded hash, so the same in every run), or all if there are no more."""
    return records.orderBy(F.sha2(F.concat(F.lit(str(seed)), F.col("did")), 256), "did").limit(n)


def indexed_sample(records: DataFrame, n: int, seed: int, total: int) -> DataFrame:
    """The records at ``random.Random(seed).sample(range(total), n)``; all of them if there are no more than ``n``."""
    if total <= n:
        return records
    picks = random.Random(seed).sample(range(total), n)
    order = records.sparkSession.createDataFrame(list(zip(picks, range(n), strict=True)), "ord bigint, sample_ord int")
    return records.join(F.broadcast(order), "ord")
