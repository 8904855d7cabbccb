"""The whole prediction as one plan, and the frames the registered queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.embed import DIM
from tessera.functions.parse import generated_entities
from tessera.functions.prompts import cache_key, entities_json, generation_prompt
from tessera.functions.spans import SPAN
from tessera.operators import align, reflect, retrieval, stats
from tessera.plans.config import SETS, Settings, set_rows
from tessera.runtime import cut
from tessera.sources import cache
from tessera.sources.corpus import corpus

SPANS = f"array<{SPAN}>"


def gold_spans(records: DataFrame) -> DataFrame:
    return records.withColumn("gold", F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"))))


def rule_predictions(records: DataFrame) -> DataFrame:
    """``pred``: gold spans of which a fixed rule drops some, stretches some, retypes some and adds a few."""
    h = lambda e: F.col("ord") * 31 + e["ent_ord"] * 17 + e["start"] * 7
    kept = F.filter("entities", lambda e: h(e) % 5 != 0)
    moved = F.transform(kept, lambda e: F.struct(e["start"].alias("start"), F.when((h(e) % 11 == 1) & (e["end"] < F.size("units")), e["end"] + 1).otherwise(e["end"]).alias("end"), F.when(h(e) % 13 == 2, "X").otherwise(e["type"]).alias("type")))
    extra = F.when((F.col("ord") % 4 == 0) & (F.size("units") > 0), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("X").alias("type")))).otherwise(F.array().cast(SPANS))
    return gold_spans(records).withColumn("pred", F.concat(moved, extra))


def rule_names(records: DataFrame) -> DataFrame:
    """``did, emit_ord, name, type``: names a generator might give: surfaces, the first twice, and one that isn't there."""
    said = F.transform("entities", lambda e: F.struct(F.coalesce(e["surface"], F.lit("")).alias("name"), e["type"].alias("type")))
    one = lambda name, t: F.array(F.struct(name.alias("name"), t.alias("type")))
    none = F.array().cast("array<struct<name: string, type: string>>")
    twice = F.when((F.col("ord") % 3 == 0) & (F.size("entities") > 0), F.slice(said, 1, 1)).otherwise(none)
    ghost = F.when(F.col("ord") % 7 == 0, one(F.lit("no such name"), F.lit("X"))).otherwise(none)
    return records.select("did", F.posexplode(F.concat(said, twice, ghost)).alias("emit_ord", "x")).select("did", "emit_ord", "x.name", "x.type")


def rule_state(records: DataFrame) -> DataFrame:
    """``dataset, did, units, text, types, spans`` of the evaluation splits with the rule's predictions."""
    first = F.coalesce(*[F.when(F.col("dataset") == d, F.array(*[F.lit(t) for t in types])) for d, (types, *_) in SETS.items()], F.array(F.lit("X")))
    return rule_predictions(records.where("split in ('dev', 'test')")).select("dataset", "did", "units", "text", first.alias("types"), F.array_distinct("pred").alias("spans"))


def train(records: DataFrame) -> DataFrame:
    return records.where("split = 'train'")


def train_stats(records: DataFrame, C: int = 2) -> DataFrame:
    return stats.token_stats(stats.classified(train(records), C))


def query_records(records: DataFrame) -> DataFrame:
    """The stated query set of searches: evaluation records whose number is divisible by 20."""
    return records.where("split in ('dev', 'test') and ord % 20 = 0")


def token_picks(records: DataFrame, n: int = 8) -> DataFrame:
    """The picks of the query set by tokens, in blocks, as its pairs are too many to be made; ``records`` are best a table, being read several times."""
    return retrieval.token_nearest(query_records(records), train(records), cut(stats.weighted(train_stats(records))), n)


DEMOS = "array<struct<text: string, ents: array<struct<name: string, type: string>>>>"


def rule_generator(rows: DataFrame, kind: str) -> DataFrame:
    """A deterministic generator: the entities of the demonstrations whose names stand in the text, as fenced JSON."""
    told = F.filter(F.flatten(F.transform("demos", lambda d: d["ents"])), lambda e: F.contains(F.coalesce("text", F.lit("")), e["name"]))
    return rows.withColumn("answer", F.concat(F.lit("```json\n"), entities_json(F.array_distinct(told)), F.lit("\n```")))


def through_cache(path: str, client: Callable[[], Callable[[str], str]], model: str) -> reflect.Responder:
    """A responder that asks a client (``sources.cache.http_client``) what the cache at ``path`` doesn't have; every request is asked and stored once."""

    def respond(rows: DataFrame, kind: str) -> DataFrame:
        keyed = cut(rows.withColumn("_key", cache_key(model, F.col("prompt"))))
        got = cache.answered(keyed.select(F.col("_key").alias("key"), "prompt"), path, client).select(F.col("key").alias("_key"), F.col("text").alias("answer")).dropDuplicates(["_key"])
        return keyed.join(got, "_key", "left").drop("_key")

    return respond


@dataclass(frozen=True)
class Models:
    """What a run asks: a generator and a responder (rows with ``prompt`` to rows with ``answer``), and token vectors (``sentence_vectors``), by default hashes."""

    generate: reflect.Responder = rule_generator
    reflect: reflect.Responder = reflect.mock_responder
    embedder: Callable[[DataFrame], DataFrame] | None = None
    dim: int = DIM


def predict(docs: DataFrame, settings: Settings | None = None, models: Models | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(``dataset, did, gold, spans``, trace) for all evaluation records: demonstrations, an answer to each prompt, spans, and for method m2 reflection."""
    records = cut(corpus(docs))
    return predict_records(records, records.where("split in ('dev', 'test')"), settings or Settings(), models)


def demo_picks(records: DataFrame, queries: DataFrame, weights: DataFrame, settings: Settings, models: Models) -> DataFrame:
    """The ``n_shots`` train records of the highest lambda1 * token score + lambda2 * cosine of sentence vectors; by tokens alone if lambda2 is 0."""
    if not settings.lambda2:
        return retrieval.token_nearest(queries, train(records), weights, settings.n_shots)
    both = queries.select("dataset", "did", "ord", "units").withColumn("asks", F.lit(True)).unionByName(train(records).select("dataset", "did", "ord", "units").withColumn("asks", F.lit(False)))
    vecs = retrieval.sentence_vectors(both.dropDuplicates(["did"]), weights, dim=models.dim, embedder=models.embedder).select("did", "vec")
    sided = cut(both.join(vecs, "did"))
    return retrieval.hybrid_nearest(sided.where("asks"), sided.where("not asks"), weights, settings.n_shots, settings.lambda1, settings.lambda2)


def predict_records(records: DataFrame, queries: DataFrame, settings: Settings, models: Models | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The same for the given query records; demonstrations and statistics come from the train split of ``records``.

    Types and language of the prompts are those of the dataset (an unknown one has the type X and English). Reflection shows counts and examples of the triggers.
    """
    models = models or Models()
    counts = cut(train_stats(records, settings.C))
    picks = cut(demo_picks(records, queries, cut(stats.weighted(counts)), settings, models))
    demos = retrieval.demonstrations(picks, train(records))
    known = set_rows(records.sparkSession).select("dataset", F.col("types").alias("types"), "lang")
    asked = queries.join(F.broadcast(known), "dataset", "left").join(demos, "did", "left").withColumn("demos", F.coalesce("demos", F.array().cast(DEMOS))).withColumn("types", F.coalesce("types", F.array(F.lit("X"))))
    asked = asked.withColumn("prompt", generation_prompt(F.coalesce("text", F.lit("")), F.col("demos"), F.col("types"), F.coalesce("lang", F.lit("en"))))
    answered = cut(models.generate(asked, "generate").select("dataset", "did", "types", "answer"))
    preds = answered.select("did", F.posexplode(generated_entities(F.col("answer"))).alias("emit_ord", "x")).select("did", "emit_ord", "x.name", "x.type")
    spans = align.aligned_spans(align.aligned(queries, preds))
    state = gold_spans(queries).join(spans, "did", "left").join(answered.select("did", "types"), "did", "left").select("dataset", "did", "units", "text", "gold", "types", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    if settings.method == "m1":
        return state.select("dataset", "did", "gold", "spans"), None
    library = None if models.reflect is reflect.mock_responder else cut(stats.span_library(train(records)))
    final, trace = reflect.reflect(state, counts, models.reflect, settings, library=library)
    return final.select("dataset", "did", "gold", "spans"), trace
