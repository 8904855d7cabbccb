"""Reflection passes: triggers, an answer by a pluggable responder, parsed edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.parse import boundary_decision, reflected_entities
from tessera.functions.prompts import entities_json, example_block, list_repr, quoted, token_stat_json, types_phrase
from tessera.functions.spans import SPAN, char_level, joined, name_units, occurrences, once, resolved
from tessera.operators import triggers as T
from tessera.plans.config import Settings
from tessera.runtime import cut

#: A responder maps rows with ``prompt`` and the pass's own columns to an ``answer`` column.
Responder = Callable[[DataFrame, str], DataFrame]


def mock_responder(rows: DataFrame, kind: str) -> DataFrame:
    """A deterministic answer by rule, all in expressions: each candidate is an entity of type ``mock``; a span loses its last doubtful unit."""
    if kind == "boundary":
        out = F.when(F.col("new_end") <= F.col("start"), "{}").otherwise(F.concat(F.lit('{"name": '), quoted(F.col("new_name")), F.lit(', "type": '), quoted(F.col("type")), F.lit("}")))
        return rows.withColumn("answer", F.concat(F.lit("Updated Predicted Entity: "), out))
    items = F.transform("tokens", lambda t: F.struct(t.alias("name"), F.lit("mock").alias("type")))
    return rows.withColumn("answer", F.concat(F.lit("Final predicted entities: "), entities_json(items)))


#: What each pass asks, and how to answer: parsers look for these markers.
ASK = {
    "en": {
        "unseen": "These words never stood in the training texts. Which of them belong to an entity of the types", "fn": "In the training texts these words mostly belong to entities, but none was found here. Which of them belong to an entity of the types",
        "boundary": "These words at the edges of the entity are doubtful. What is the whole entity, of one of the types", "text": "Text", "words": "Candidates", "entity": "Entity", "end": "?",
        "add": 'Think step by step, then end with one line: Final predicted entities: {"named_entities": [{"name": "...", "type": "..."}]}. Give an empty list if there is none.',
        "edit": 'Think step by step, then end with one line: Updated Predicted Entity: {"name": "...", "type": "..."}. Give {} if it is no entity, and the same name if it is right.',
    },
    "zh": {
        "unseen": "以下词语在训练文本中从未出现。其中哪些属于以下类型的实体：", "fn": "以下词语在训练文本中多属于实体，但这里没有找到。其中哪些属于以下类型的实体：",
        "boundary": "以下位于实体边缘的词语存疑。完整的实体是什么，类型为其中之一：", "text": "文本", "words": "候选", "entity": "实体", "end": "？",
        "add": '请逐步思考，最后一行写：最终预测实体: {"named_entities": [{"name": "...", "type": "..."}]}。没有则给出空列表。',
        "edit": '请逐步思考，最后一行写：修正后的预测实体: {"name": "...", "type": "..."}。不是实体则写 {}，正确则写原来的名称。',
    },
}


def _prompt(kind: str, text: Column, candidates: Column, types: Column, dataset: Column, entity: Column | None = None) -> Column:
    """Sentence, candidates, for an edge the entity, the question of the pass and the form of the answer, in the language of the dataset's texts."""

    def worded(lang: str) -> Column:
        w = ASK[lang]
        parts = [F.concat(F.lit(f"{w['text']}: "), text), F.concat(F.lit(f"{w['words']}: "), F.array_join(F.transform(candidates, quoted), ", "))]
        parts += [] if entity is None else [F.concat(F.lit(f"{w['entity']}: "), entity)]
        return F.concat_ws("\n\n", *parts, F.concat(F.lit(w[kind] + " "), types_phrase(types, lang), F.lit(w["end"])), F.lit(w["edit" if kind == "boundary" else "add"]))

    return F.when(char_level(dataset), worded("zh")).otherwise(worded("en"))


def evidence(hits: DataFrame, units: DataFrame, stats: DataFrame, library: DataFrame, kind: str, settings: Settings, lang: str = "en") -> DataFrame:
    """``did, evidence``: for each trigger of a record its counts and examples, in order of position, as text.

    For unseen triggers these are the entity examples of the seen units around them, for the others the trigger's own examples of each class.
    """
    none = F.lit("X")
    if kind == "unseen":
        near = T.neighbor_examples(units, hits, library, settings.C, settings.M).where("text is not null")
        each = near.groupBy("did", "pos").agg(F.collect_list(F.struct(F.lit("entity").alias("cls"), "rank", "text", "name", "type")).alias("x"), F.array_sort(F.collect_set("neighbor")).alias("around"))
        text = each.select("did", "pos", F.concat(F.lit("Around: "), list_repr(F.col("around")), F.lit("\n"), example_block(F.col("x"), F.get("around", F.lit(0)), none, lang)).alias("t"))
    else:
        own = T.example_buckets(hits.join(units.select("did", "pos", "dataset"), ["did", "pos"]), library, settings.M)
        each = own.groupBy("did", "pos", "token").agg(F.collect_list(F.struct("cls", "rank", "text", "name", "type")).alias("x")).join(units.select("did", "pos", "n_e", "n_c", "n_o"), ["did", "pos"])
        text = each.select("did", "pos", F.concat(token_stat_json(F.col("n_e"), F.col("n_c"), F.col("n_o")), F.lit("\n"), example_block(F.col("x"), F.col("token"), none, lang)).alias("t"))
    return text.groupBy("did").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda r: r["t"]), "\n\n").alias("evidence"))


def add_pass(state: DataFrame, stats: DataFrame, kind: str, responder: Responder, settings: Settings, library: DataFrame | None = None, between: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """(new state, trace) of the unseen or the missed-entity pass: one question per record with triggers; only additions.

    ``state``: ``dataset, did, units, text, types, spans``. A returned name becomes its first occurrence that covers a trigger, else its first; spans already
    there, type included, aren't added again. With a ``library`` the question shows counts and examples of the triggers.
    ``between`` writes the additions once, so each question is asked once and state and trace come from the same answers.
    """
    units = T.annotated(state, stats)
    hits = T.unseen_triggers(units, settings.C, settings.surround) if kind == "unseen" else T.fn_triggers(units, settings.theta_fn)
    asked = hits.groupBy("did").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x")).select("did", F.col("x.pos").alias("anchors"), F.col("x.token").alias("tokens"))
    rows = state.join(asked, "did").withColumn("prompt", _prompt(kind, F.coalesce("text", F.lit("")), F.col("tokens"), F.col("types"), F.col("dataset")))
    if library is not None:
        rows = rows.join(evidence(hits, units, stats, library, kind, settings), "did", "left").withColumn("prompt", F.concat_ws("\n\n", "prompt", "evidence")).drop("evidence")
    items = responder(rows, kind).select("dataset", "did", "units", "types", "spans", "anchors", F.posexplode(reflected_entities(F.col("answer"))).alias("place", "i"))
    named = once(once(items, target=name_units(F.col("i.name"), char_level(F.col("dataset")))), occ=occurrences(F.col("units"), F.col("target")))
    etype = F.when(F.col("i.type") == "", F.get("types", F.lit(0))).otherwise(F.col("i.type"))
    placed = named.select("did", "place", "spans", F.col("i.name").alias("token"), resolved(F.col("occ"), F.size("target"), etype, F.col("anchors")).alias("span"))
    fresh = between(placed.where("span is not null").where(~F.array_contains("spans", F.col("span"))).groupBy("did", "span").agg(F.min("place").alias("seq"), F.min_by("token", "place").alias("token")))
    none = F.array().cast(f"array<{SPAN}>")
    per_doc = fresh.groupBy("did").agg(F.sort_array(F.collect_list(F.struct("seq", "span"))).alias("x")).select("did", F.col("x.span").alias("fresh"))
    new = state.join(per_doc, "did", "left").withColumn("spans", F.array_distinct(F.concat("spans", F.coalesce("fresh", none)))).drop("fresh")
    trace = fresh.select("did", "seq", F.lit(kind).alias("pass"), F.lit("add").alias("action"), "token", "span", F.lit(None).cast(SPAN).alias("old"), F.lit(None).cast(SPAN).alias("new"))
    return new, trace


def boundary_pass(state: DataFrame, stats: DataFrame, responder: Responder, settings: Settings, library: DataFrame | None = None, between: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """(new state, trace) of the edge pass: one question per span with triggers, all computed on the spans that came in.

    An empty object deletes the span; a changed name replaces it by that name's occurrence over the old span, if there is one; the same
    name changes nothing, not even the type. ``between`` writes the edits once, as in ``add_pass``.
    """
    hits = T.boundary_triggers(state, stats, settings.K)
    asked = hits.groupBy("did", "span_ord").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "side"))).alias("x")).select("did", "span_ord", F.col("x.token").alias("tokens"), F.transform(F.filter("x", lambda r: r["side"] == "inside"), lambda r: r["pos"]).alias("doubt"))
    rows = state.join(asked, "did").withColumn("s", F.get("spans", F.col("span_ord"))).select("*", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.type").alias("type"))
    rows = rows.withColumn("name", joined(F.col("units"), F.col("start"), F.col("end"), char_level(F.col("dataset"))))
    rows = rows.withColumn("new_end", F.when(F.array_contains("doubt", F.col("end") - 1), F.col("end") - 1).otherwise(F.col("end")))
    rows = rows.withColumn("new_name", joined(F.col("units"), F.col("start"), F.col("new_end"), char_level(F.col("dataset")))).withColumn("prompt", _prompt("boundary", F.coalesce("text", F.lit("")), F.col("tokens"), F.col("types"), F.col("dataset"), F.concat(quoted(F.col("name")), F.lit(" "), quoted(F.col("type")))))
    if library is not None:
        proof = evidence(hits.select("did", "pos", "token").distinct(), T.annotated(state, stats), stats, library, "boundary", settings)
        rows = rows.join(proof, "did", "left").withColumn("prompt", F.concat_ws("\n\n", "prompt", "evidence")).drop("evidence")
    read = once(responder(rows, "boundary"), d=boundary_decision(F.col("answer")))
    etype = F.when(F.col("d.type") == "", F.col("type")).otherwise(F.col("d.type"))
    read = once(once(read, target=F.coalesce(name_units(F.col("d.name"), char_level(F.col("dataset"))), F.array().cast("array<string>"))), occ=occurrences(F.col("units"), F.col("target")))
    target = resolved(F.col("occ"), F.size("target"), etype, F.sequence(F.col("start"), F.col("end") - 1))
    edits = read.select("did", "span_ord", F.col("s").alias("old"), F.when(F.col("d.action") == "delete", "delete").when((F.col("d.action") == "entity") & (F.col("d.name") != F.col("name")), "trim").alias("action"), target.alias("new")).where("action = 'delete' or (action = 'trim' and new is not null)")
    edits = between(edits)
    by_doc = edits.groupBy("did").agg(F.map_from_entries(F.collect_list(F.struct("span_ord", F.struct(F.when(F.col("action") == "trim", F.col("new")).alias("new"))))).alias("edit"))
    kept = F.filter(F.transform("spans", lambda s, i: F.when(F.try_element_at("edit", i).isNotNull(), F.try_element_at("edit", i)["new"]).otherwise(s)), lambda s: s.isNotNull())
    new = state.join(by_doc, "did", "left").withColumn("spans", F.when(F.col("edit").isNull(), F.col("spans")).otherwise(kept)).drop("edit")
    trim = F.col("action") == "trim"
    trace = edits.select("did", F.col("span_ord").alias("seq"), F.lit("boundary").alias("pass"), "action", F.lit(None).cast("string").alias("token"), F.when(~trim, F.col("old")).alias("span"), F.when(trim, F.col("old")).alias("old"), F.when(trim, F.col("new")).alias("new"))
    return new, trace


def reflect(state: DataFrame, stats: DataFrame, responder: Responder = mock_responder, settings: Settings | None = None, between: Callable[[DataFrame], DataFrame] = cut, library: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(final state, trace): the selected passes in fixed order, each on the spans of the one before; spans end up distinct.

    Each pass uses its state several times, so ``between`` writes it once before the passes and after each of them, and what a
    pass changes once in it: a responder sees each question once, and every edit of the trace is in the state.
    """
    settings = settings or Settings()
    state, stats = between(state), between(stats)
    trace = None
    for kind in settings.ordered():
        state, own = boundary_pass(state, stats, responder, settings, library, between) if kind == "boundary" else add_pass(state, stats, kind, responder, settings, library, between)
        state = between(state)
        trace = own if trace is None else trace.unionByName(own)
    return state.withColumn("spans", F.array_distinct("spans")), trace


def attribution(trace: DataFrame, gold: DataFrame) -> DataFrame:
    """``pass, outcome, n``: edits by whether they helped against the gold spans (``did, gold``)."""
    has = lambda c: F.coalesce(F.array_contains("gold", F.col(c)), F.lit(False))
    outcome = (
        F.when((F.col("action") == "add") & has("span"), "add_correct")
        .when(F.col("action") == "add", "add_wrong")
        .when((F.col("action") == "trim") & has("new") & ~has("old"), "trim_fixed")
        .when((F.col("action") == "trim") & has("old") & ~has("new"), "trim_broke")
        .when(F.col("action") == "trim", "trim_neutral")
        .when(has("span"), "delete_good")
        .otherwise("delete_fp")
    )
    return trace.join(gold, "did", "left").groupBy("pass", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def wrong_adds(trace: DataFrame, gold: DataFrame) -> DataFrame:
    """``did, pass, token, start, end, overlapping, boundary_error``: wrong additions and how many gold spans they overlap."""
    wrong = trace.where("action = 'add'").join(gold, "did", "left").where(~F.coalesce(F.array_contains("gold", F.col("span")), F.lit(False)))
    over = F.size(F.filter(F.coalesce("gold", F.array().cast(f"array<{SPAN}>")), lambda g: (g["start"] < F.col("span.end")) & (g["end"] > F.col("span.start"))))
    return wrong.select("did", "pass", "token", F.col("span.start").alias("start"), F.col("span.end").alias("end"), over.alias("overlapping"), (over > 0).alias("boundary_error"))


def sample_wrong_adds(rows: DataFrame, n: int = 25) -> DataFrame:
    """The first ``n`` wrong additions, for a look at them."""
    return rows.orderBy("did", "pass", "start", "end").limit(n)
