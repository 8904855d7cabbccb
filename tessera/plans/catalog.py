"""The registered queries of the core and their SQL counterparts over the delivered ``docs``, ``llm_cache`` and other tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parse, prompts
from tessera.functions.embed import hash_vector
from tessera.functions.spans import bio_spans, char_level, name_units, occurrences, once, resolved
from tessera.operators import align, evaluate, reflect, retrieval, sampling, stats, triggers
from tessera.plans import pipeline as P
from tessera.plans.config import CMEEE_DISPLAY, Settings
from tessera.plans.sql import SQL
from tessera.runtime import cut, table
from tessera.sources import cache, corpus

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}
#: Expected class counts of tokens for the validation query, as a table of reference values would give them.
EXPECTED = [("of", 0, 200, 800), ("disease", 80, 5, 15), ("no such token", 1, 0, 0)]


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _records(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus(table(spark, d, "docs"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.rule_predictions(_records(spark, d).where("split in ('dev', 'test')"))


def _span_cols(c: str) -> list:
    return [F.col(f"{c}.start").alias(f"{c}_start"), F.col(f"{c}.end").alias(f"{c}_end"), F.col(f"{c}.type").alias(f"{c}_type")]


# --- corpus ---------------------------------------------------------------------------------------------------------
@query
def doc_units(spark, d):
    return corpus.unit_rows(_records(spark, d)).select("did", F.col("pos").cast("bigint").alias("pos"), "token")


@query
def gold_entities(spark, d):
    return _records(spark, d).select("did", F.explode("entities").alias("e")).select("did", "e.ent_ord", "e.start", "e.end", "e.type", "e.surface")


@query
def char_units(spark, d):
    t = table(spark, d, "terms").select("term_id", F.posexplode(name_units(F.col("name"), char_level(F.col("dataset")))).alias("pos", "unit"))
    return t.select("term_id", "pos", "unit")


def _tags(records: DataFrame) -> DataFrame:
    """Tags that a tagger with a few flaws might give: some spans begin with I-, some change type inside."""
    def tag(i):
        e = F.get(F.filter("entities", lambda x: (x["start"] <= i) & (i < x["end"])), F.lit(0))
        first = (i == e["start"]) & ((F.col("ord") + i) % 3 != 0)
        return F.when(e.isNull(), "O").when(first, "B-Disease").when((F.col("ord") + i) % 7 == 0, "I-Other").otherwise("I-Disease")

    return records.select("did", "units", F.transform("units", lambda u, i: tag(i)).alias("tags"))


@query
def bio_to_spans(spark, d):
    t = _tags(_records(spark, d).where("dataset = 'ncbi'"))
    return t.select("did", F.explode(bio_spans(F.col("units"), F.col("tags"))).alias("s")).select("did", "s.*")


@query
def type_remap(spark, d):
    r = corpus.remap_types(_records(spark, d).where("dataset = 'cmeee'"), CMEEE_DISPLAY)
    return r.select(F.explode("entities.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query
def type_codes(spark, d):
    return corpus.type_names(_records(spark, d), table(spark, d, "entity_types")).groupBy("raw", "code").agg(F.count("*").alias("n"))


@query
def verify_offsets(spark, d):
    return corpus.offset_check(_records(spark, d))


@query
def slice_select(spark, d):
    return corpus.slice_rows(_records(spark, d), 10, -5).select("dataset", "split", "did", "ord")


@query
def hash_sample(spark, d):
    return corpus.hash_sample(P.train(_records(spark, d)), 50, 13).select("did")


# --- statistics -----------------------------------------------------------------------------------------------------
@query
def token_class(spark, d):
    return stats.classified(_records(spark, d)).groupBy("did", "cls").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query
def token_stats(spark, d):
    return P.train_stats(_records(spark, d))


@query
def token_probs(spark, d):
    return stats.probabilities(P.train_stats(_records(spark, d))).select("dataset", "token", "n", "p_e", "p_c", "p_o")


@query
def token_weights(spark, d):
    return stats.weighted(P.train_stats(_records(spark, d)))


@query
def span_library(spark, d):
    return stats.span_library(P.train(_records(spark, d)))


@query
def unit_association(spark, d):
    return stats.classified(P.train(_records(spark, d))).where("cls <> 'other'").select("did", F.col("pos").cast("bigint").alias("pos"), "cls", F.col("ent.ent_ord").alias("ent_ord"))


@query
def stats_validation(spark, d):
    return stats.stats_validation(P.train_stats(_records(spark, d)), EXPECTED)


@query
def stats_delta(spark, d):
    """Tokens whose saved counts differ from counts made anew."""
    saved = table(spark, d, "token_stats").where("token is not null").dropDuplicates(["dataset", "shard", "token"]).groupBy("dataset", "token").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"s_{c}") for c in ("n_e", "n_c", "n_o")])
    return P.train_stats(_records(spark, d)).join(saved, ["dataset", "token"], "full").where(" or ".join(f"coalesce({c}, 0) <> coalesce(s_{c}, 0)" for c in ("n_e", "n_c", "n_o"))).select("dataset", "token", "n_e", "n_c", "n_o", "s_n_e", "s_n_c", "s_n_o")


# --- retrieval ------------------------------------------------------------------------------------------------------
@query
def vocabulary(spark, d):
    return retrieval.vocabulary(_records(spark, d)).groupBy("dataset").agg(F.count("*").alias("n"))


@query
def inverted_index(spark, d):
    return retrieval.inverted_index(P.train(_records(spark, d))).groupBy("dataset", "token").agg(F.count("*").alias("n_docs"), F.sum("pool_ord").alias("ord_sum"))


@query
def retrieve_token_topk(spark, d):
    return P.token_picks(cut(_records(spark, d).drop("text"))).select("did", "pool_did", "s_token", "rank")


def _vectors(records: DataFrame) -> DataFrame:
    return retrieval.sentence_vectors(records, cut(stats.weighted(P.train_stats(records))))


@query
def token_vectors(spark, d):
    return retrieval.vocabulary(P.query_records(_records(spark, d))).select("dataset", "token", F.posexplode(hash_vector(F.col("token"))).alias("dim", "v"))


@query
def token_vectors_all(spark, d):
    """``token_vectors`` of the whole vocabulary; that query keeps the subset its SQL states."""
    return retrieval.vocabulary(_records(spark, d)).select("dataset", "token", F.posexplode(hash_vector(F.col("token"))).alias("dim", "v"))


@query
def sentence_vectors(spark, d):
    return _vectors(_records(spark, d)).select("did", F.posexplode("vec").alias("dim", "v"))


def _embed_picks(records: DataFrame, n: int) -> DataFrame:
    v = cut(_vectors(records)).join(records.select("did", "split"), "did")
    return retrieval.nearest(P.query_records(v), P.train(v), n)


@query
def retrieve_embed_topk(spark, d):
    return _embed_picks(_records(spark, d), 8).select("did", "pool_did", F.floor(F.col("cos") * 1_000_000).cast("bigint").alias("cos_ppm"))


@query
def retrieve_hybrid_topk(spark, d):
    r = _records(spark, d)
    w = cut(stats.weighted(P.train_stats(r)))
    v = cut(retrieval.sentence_vectors(r, w)).select("did", "vec").join(r.select("dataset", "split", "did", "ord", "units"), "did")
    return retrieval.hybrid_nearest(P.query_records(v), P.train(v), w, 8).select("did", "pool_did", "score")


@query
def embedding_knn(spark, d):
    e = table(spark, d, "embeddings").select(F.lit("all").alias("dataset"), F.col("vec_id").cast("string").alias("did"), F.col("vec_id").alias("ord"), F.transform("embedding", lambda x: F.floor(x * 10_000).cast("bigint")).alias("vec"))
    return retrieval.nearest(e.where("ord % 20 = 0"), e, 5).select(F.col("did").cast("bigint").alias("vec_id"), F.col("pool_ord").alias("near_id"), F.floor(F.col("cos") * 1_000_000).cast("bigint").alias("cos_ppm"))


@query
def demo_lookup(spark, d):
    r = cut(_records(spark, d))
    x = retrieval.demonstrations(P.token_picks(r), P.train(r)).select("did", F.posexplode("demos").alias("place", "demo"))
    return x.select("did", "place", F.col("demo.text").alias("text"), F.size("demo.ents").alias("n_ents"))


# --- parsing --------------------------------------------------------------------------------------------------------
def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_cache").where("key is not null").groupBy("key").agg(F.min("text").alias("text"), F.min("pass").alias("pass"))


@query
def parse_entities(spark, d):
    return _answers(spark, d).select("key", F.posexplode(parse.generated_entities(F.col("text"))).alias("place", "x")).select("key", "place", "x.*")


@query
def parse_reflection(spark, d):
    return _answers(spark, d).select("key", F.posexplode(parse.reflected_entities(F.col("text"))).alias("place", "x")).select("key", "place", "x.*")


@query
def parse_boundary(spark, d):
    return _answers(spark, d).select("key", parse.boundary_decision(F.col("text")).alias("x")).select("key", "x.*")


# --- alignment ------------------------------------------------------------------------------------------------------
@query
def find_occurrences(spark, d):
    r = _records(spark, d)
    return align.found_occurrences(r, P.rule_names(r).select("did", "name").distinct())


@query
def align_greedy(spark, d):
    r = _records(spark, d)
    return align.aligned(r, P.rule_names(r))


@query
def align_prefer_within(spark, d):
    r = _records(spark, d)
    n = P.rule_names(r).join(r.select("did", F.floor(F.size("units") / 2).cast("int").alias("half"), F.size("units").alias("n")), "did")
    return align.aligned(r, n, ("half", "n")).select("did", "emit_ord", "start", "end", "status", "n_candidates")


@query
def resolve_anchor(spark, d):
    r = _records(spark, d)
    n = P.rule_names(r).join(r.select("did", "dataset", "units"), "did")
    half = F.array(F.floor(F.size("units") / 2).cast("int"), F.greatest(F.size("units") - 2, F.lit(0)))
    n = once(once(n, target=name_units(F.col("name"), char_level(F.col("dataset")))), occ=occurrences(F.col("units"), F.col("target")))
    x = n.select("did", "emit_ord", resolved(F.col("occ"), F.size("target"), F.col("type"), half).alias("s"))
    return x.where("s is not null").select("did", "emit_ord", "s.*")


@query
def gold_roundtrip(spark, d):
    return align.round_trip(_records(spark, d))


@query
def pipeline_align_counts(spark, d):
    r = _records(spark, d)
    return align.aligned(r, P.rule_names(r)).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_candidates").alias("candidates"))


# --- triggers -------------------------------------------------------------------------------------------------------
def _state(spark, d):
    r = _records(spark, d)
    return P.rule_state(r), cut(P.train_stats(r))


@query
def covered_units(spark, d):
    return triggers.covered_units(_state(spark, d)[0])


@query
def trigger_unseen(spark, d):
    s, st = _state(spark, d)
    return triggers.unseen_triggers(triggers.annotated(s, st))


@query
def trigger_fn(spark, d):
    s, st = _state(spark, d)
    return triggers.fn_triggers(triggers.annotated(s, st))


@query
def trigger_boundary(spark, d):
    s, st = _state(spark, d)
    return triggers.boundary_triggers(s, st)


@query
def neighbor_examples(spark, d):
    s, st = _state(spark, d)
    u = triggers.annotated(s, st)
    return triggers.neighbor_examples(u, triggers.unseen_triggers(u), stats.span_library(P.train(_records(spark, d))))


@query
def example_buckets(spark, d):
    s, st = _state(spark, d)
    t = triggers.fn_triggers(triggers.annotated(s, st)).join(s.select("did", "dataset"), "did")
    return triggers.example_buckets(t, stats.span_library(P.train(_records(spark, d))))


# --- reflection -----------------------------------------------------------------------------------------------------
def _spans(state: DataFrame) -> DataFrame:
    return state.select("did", F.explode("spans").alias("s")).select("did", "s.*")


@query
def reflect_unseen(spark, d):
    return _spans(reflect.reflect(*_state(spark, d), settings=Settings(passes=("unseen",)))[0])


@query
def reflect_fn(spark, d):
    return _spans(reflect.reflect(*_state(spark, d), settings=Settings(passes=("fn",)))[0])


@query
def reflect_boundary(spark, d):
    return _spans(reflect.reflect(*_state(spark, d), settings=Settings(passes=("boundary",)))[0])


@query
def reflect_full(spark, d):
    return _spans(reflect.reflect(*_state(spark, d))[0])


@query
def reflect_trace(spark, d):
    t = reflect.reflect(*_state(spark, d))[1]
    return t.select("did", "seq", "pass", "action", "token", *_span_cols("span"), *_span_cols("old"), *_span_cols("new"))


def _gold(spark, d):
    return P.gold_spans(_records(spark, d)).select("did", "gold")


@query
def edit_attribution(spark, d):
    return reflect.attribution(reflect.reflect(*_state(spark, d))[1], _gold(spark, d))


@query
def wrong_add_overlap(spark, d):
    return reflect.wrong_adds(reflect.reflect(*_state(spark, d))[1], _gold(spark, d))


# --- evaluation -----------------------------------------------------------------------------------------------------
@query
def strict_micro_prf(spark, d):
    return evaluate.micro_prf(_pairs(spark, d), "dataset")


@query
def per_type_prf(spark, d):
    return evaluate.per_type_prf(_pairs(spark, d), "dataset")


@query
def nesting_roles(spark, d):
    return evaluate.nesting_roles(_pairs(spark, d))


@query
def nested_recall(spark, d):
    return evaluate.nested_recall(_pairs(spark, d), "dataset")


@query
def error_rates(spark, d):
    return evaluate.error_rates(_pairs(spark, d), "dataset")


@query
def depth_recall(spark, d):
    return evaluate.depth_recall(_pairs(spark, d), "dataset")


@query
def span_set_ops(spark, d):
    return evaluate.span_sets(_pairs(spark, d))


# --- sampling, cache, prompts, pipeline -----------------------------------------------------------------------------
@query
def stratified_distance(spark, d):
    return sampling.distances(P.train(_records(spark, d)).withColumn("picked", F.col("ord") % 10 == 0), "picked")


@query
def llm_cache_hits(spark, d):
    c = table(spark, d, "llm_cache")
    asked = c.where("key is not null").select("key").distinct().select(F.when(F.substring("key", 1, 1) == "0", F.concat(F.lit("absent-"), F.col("key"))).otherwise(F.col("key")).alias("key"))
    return cache.hits(asked, c).select("key", "text", "prompt_tokens", "completion_tokens", "cached")


@query
def llm_cache_misses(spark, d):
    c = table(spark, d, "llm_cache").where("key is not null")
    asked = c.select(F.col("key")).unionByName(c.select(F.concat(F.lit("absent-"), F.substring("key", 1, 3)).alias("key")))
    return cache.misses(asked, c)


@query
def usage_counters(spark, d):
    return cache.usage(table(spark, d, "llm_cache"))


@query
def generation_prompt(spark, d):
    r = _records(spark, d)
    demos = r.where("text is not null").select("did", "text", F.array(F.struct(F.col("text"), F.transform("entities", lambda e: F.struct(F.coalesce(e["surface"], F.lit("")).alias("name"), e["type"].alias("type"))).alias("ents"))).alias("demos"))
    p = prompts.generation_prompt(F.col("text"), F.col("demos"), ["Disease", "DNA"])
    return demos.select("did", F.sha2(p, 256).alias("prompt_sha"), prompts.cache_key("model", p).alias("key"))


@query
def token_stat_json(spark, d):
    s = P.train_stats(_records(spark, d))
    return s.select("dataset", "token", prompts.token_stat_json(F.col("n_e"), F.col("n_c"), F.col("n_o")).alias("stat"))


@query
def perdoc_dump(spark, d):
    x = cache.document_dump(_pairs(spark, d))
    side = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["type"])), "|").alias(c)
    return x.select("did", side("gold"), side("pred"))


@query
def pipeline_m1(spark, d):
    s, _ = P.predict(table(spark, d, "docs"), Settings(method="m1"))
    return evaluate.micro_prf(s.withColumnRenamed("spans", "pred"), "dataset")


@query
def pipeline_m2(spark, d):
    s, _ = P.predict(table(spark, d, "docs"), Settings(method="m2"))
    return evaluate.micro_prf(s.withColumnRenamed("spans", "pred"), "dataset")


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _ALL}
