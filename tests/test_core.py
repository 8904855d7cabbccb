"""Hand-sized cases and random comparisons with plain restatements."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import embed, parse, prompts
from tessera.functions.spans import bio_spans, bio_tag
from tessera.operators import align, evaluate, reflect, retrieval, sampling, stats, triggers
from tessera.plans import catalog, config, pipeline
from tessera.plans.config import Settings
from tessera.runtime import cut
from tessera.sources import cache, corpus
from tessera.streaming import increments


def classes(spark, docs):
    rows = stats.classified(corpus.corpus(docs)).orderBy("did", "pos").collect()
    out = {}
    for r in rows:
        out.setdefault(r.did, []).append(r.cls)
    return out


def test_token_classes(spark, make_docs):
    d = make_docs(("a", "The risk of cancer , especially", [(3, 4, "D")]), ("b", "Lionel Messi and Cristiano Ronaldo", [(0, 2, "P"), (3, 5, "P")]), ("c", "no entities here", None), ("d", [], []))
    got = classes(spark, d)
    assert got["a"] == ["other", "context", "context", "entity", "context", "context"]
    assert got["b"] == ["entity", "entity", "context", "entity", "entity"]
    assert got["c"] == ["other"] * 3
    assert "d" not in got


def test_classes_and_association_against_loops(spark, make_docs):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(40):
        n = rng.randint(1, 15)
        spans = []
        for _ in range(rng.randint(0, 4)):
            s = rng.randrange(n)
            spans.append((s, rng.randint(s + 1, n), rng.choice("AB")))
        rows.append((f"d{k}", [f"t{i}" for i in range(n)], spans))
        for i in range(n):
            over = [j for j, (s, e, _) in enumerate(spans) if s <= i < e]
            near = [j for j, (s, e, _) in enumerate(spans) if s - 2 <= i < s or e <= i < e + 2]
            want[f"d{k}", i] = ("entity", over[-1]) if over else ("context", near[0]) if near else ("other", None)
    got = {(r.did, r.pos): (r.cls, r.ent.ent_ord if r.ent else None) for r in stats.classified(corpus.corpus(make_docs(*rows))).collect()}
    assert got == want


def test_probabilities_and_weights(spark, make_docs):
    t = stats.token_stats(stats.classified(corpus.corpus(make_docs(("a", "The risk of cancer , especially", [(3, 4, "D")])))))
    p = {r.token: r for r in stats.probabilities(t).collect()}
    assert p["cancer"].p_e == 1 and p["of"].p_c == 1 and p["The"].p_o == 1
    w = {r.token: r.w for r in stats.weighted(t).collect()}
    assert w["cancer"] == 1_000_000 and w["The"] == 10_000
    lib = stats.span_library(corpus.corpus(make_docs(("a", "The risk of cancer , especially", [(3, 4, "D")]))), cap=1)
    row = lib.where("token = 'cancer'").first()
    assert (row.name, row.type, row.text, row["rank"]) == ("cancer", "D", "risk of cancer , especially", 1)
    ok = {r.token: r.ok for r in stats.stats_validation(t, [("cancer", 5, 0, 0), ("of", 1, 1, 0), ("zzz", 1, 0, 0)]).collect()}
    assert ok == {"cancer": True, "of": False, "zzz": False}


def test_stats_round_trip(spark, make_docs, tmp_path):
    r = corpus.corpus(make_docs(("a", "risk of cancer", [(2, 3, "D")])))
    t = stats.token_stats(stats.classified(r))
    stats.save(t, stats.span_library(r), str(tmp_path / "s"))
    counts, lib, settings = stats.load(spark, str(tmp_path / "s"))
    assert sorted(counts.collect()) == sorted(t.collect()) and lib.count() == 3 and settings == {"C": 2, "span_cap": 50}
    stats.json_rows(t, lib).write.json(str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j"))
    assert sorted(stats.from_json_rows(back).collect()) == sorted(t.collect()) and back.where("token = 'cancer'").first().spans.entity[0].name == "cancer"


def naive_bio(tags):
    out, i = [], 0
    while i < len(tags):
        if tags[i].startswith("B-") or tags[i].startswith("I-") and (i == 0 or tags[i - 1] == "O"):
            j = i + 1
            while j < len(tags) and tags[j].startswith("I-"):
                j += 1
            out.append((i, j, tags[i].split("-", 1)[1]))
            i = j
        else:
            i += 1
    return out


def test_bio(spark):
    rng = random.Random(2)
    cases = [["O", "O", "B-X", "I-X", "O"], []] + [[rng.choice(["O", "B-X", "I-X", "I-Y", "Z"]) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    df = spark.createDataFrame([(i, [f"t{k}" for k in range(len(c))], c) for i, c in enumerate(cases)], "i int, tokens array<string>, tags array<string>")
    for r in df.select("i", bio_spans(F.col("tokens"), F.col("tags")).alias("s")).collect():
        assert [(x.start, x.end, x.type) for x in r.s] == naive_bio(cases[r.i])
    t = spark.createDataFrame([(["0", "0", "1", "2", "0", "9", "B-Q"],)], "t array<string>").select(F.transform("t", bio_tag).alias("t")).first().t
    assert t == ["O", "O", "B-Disease", "I-Disease", "O", "O", "B-Q"]


def test_readers(spark, tmp_path):
    (tmp_path / "train.json").write_text(json.dumps([{"text": "肺炎。", "entities": [{"start_idx": 0, "end_idx": 2, "type": "dis", "entity": "肺炎"}]}, {"text": "无"}]), encoding="utf-8")
    c = corpus.load(spark, "cmeee", "train", str(tmp_path)).orderBy("ord").collect()
    assert [r.did for r in c] == ["cmeee-train-0", "cmeee-train-1"] and c[0].units == ["肺", "炎", "。"] and c[0].entities[0].type == "疾病" and c[1].entities == []
    (tmp_path / "dev.json").write_text(json.dumps([{"tokens": ["IL-2", "gene"], "entities": [{"start": 0, "end": 2, "type": "DNA"}]}]))
    assert corpus.load(spark, "genia", "dev", str(tmp_path)).first().entities[0].surface == "IL-2 gene"
    (tmp_path / "test.jsonl").write_text('{"tokens": ["a", "b"], "ner_tags": [1, 2]}\n\n{"tokens": ["c"], "tags": ["O"]}\n')
    n = corpus.load(spark, "ncbi", "test", str(tmp_path)).orderBy("ord").collect()
    assert [(x.start, x.end, x.type) for x in n[0].entities] == [(0, 2, "Disease")] and n[1].entities == []
    (tmp_path / "train.jsonl").write_text("")
    assert corpus.read_records(spark, str(tmp_path / "train.jsonl"), corpus.NCBI).count() == 0
    with pytest.raises(ValueError):
        corpus.load(spark, "other", "train", str(tmp_path))
    assert config.stored_types(config.CMEEE_DISPLAY)["疾病"] == "dis" and {r.dataset: r.level for r in config.set_rows(spark).collect()} == {"cmeee": "char", "genia": "token", "ncbi": "token"}
    with pytest.raises(ValueError):
        Settings(passes=("nope",))


def test_slices_and_samples(spark, make_docs):
    r = corpus.corpus(make_docs(*[(f"d{i}", "a b", []) for i in range(10)]))
    ords = lambda df: sorted(x.ord for x in df.collect())
    assert ords(corpus.slice_rows(r, 2, 5)) == [2, 3, 4] and ords(corpus.slice_rows(r, -3, None)) == [7, 8, 9] and corpus.parse_slice("2:") == (2, None)
    with pytest.raises(ValueError):
        corpus.parse_slice("2")
    assert corpus.hash_sample(r, 4, 1).count() == 4 and corpus.hash_sample(r, 40, 1).count() == 10
    assert ords(corpus.indexed_sample(r, 3, 7, 10)) == sorted(random.Random(7).sample(range(10), 3))


def naive_align(units, preds):
    taken, out = set(), []
    for name in preds:
        t = name.split()
        occ = [(i, i + len(t)) for i in range(len(units) - len(t) + 1) if t and units[i : i + len(t)] == t]
        free = next((o for o in occ if o not in taken), None)
        if free:
            taken.add(free)
        out.append((free, len(occ)))
    return out


def test_alignment_against_a_loop(spark, make_docs):
    rng = random.Random(3)
    rows, preds, want = [], [], {}
    for k in range(60):
        units = [rng.choice("ab") for _ in range(rng.randint(1, 8))]
        names = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 6))]
        rows.append((f"d{k}", units, []))
        preds += [(f"d{k}", i, n, "T") for i, n in enumerate(names)]
        for i, x in enumerate(naive_align(units, names)):
            want[f"d{k}", i] = x
    p = spark.createDataFrame(preds, "did string, emit_ord int, name string, type string")
    got = {(r.did, r.emit_ord): ((r.start, r.end) if r.start is not None else None, r.n_candidates) for r in align.aligned(corpus.corpus(make_docs(*rows)), p).collect()}
    assert got == want
    one = corpus.corpus(make_docs(("x", "a b a", [])))
    q = spark.createDataFrame([("x", 0, "a", "T", 1, 3), ("x", 1, "a", "U", 1, 3), ("x", 2, "a", "T", 1, 3)], "did string, emit_ord int, name string, type string, lo int, hi int")
    r = align.aligned(one, q, ("lo", "hi")).orderBy("emit_ord").collect()
    assert [x.start for x in r] == [2, 0, None] and r[2].status == "unaligned"


PARSE = [
    ('{"named_entities": [{"name": " a ", "type": "T"}]}', [("a", "T")]), ('```json\n{"named entities": [{"name": "b", "type": "T"}]}\n```', [("b", "T")]), ('so: {"named_entities": [{"name": "c", "type": "T"}]} done', [("c", "T")]),
    ('[{"name": "a", "type": "T"}]', []), ('{"named_entities": [{"name": 1, "type": "T"}, {"name": "d"}, "x", {"name": " ", "type": "T"}, {"name": "e", "type": "U"}]}', [("e", "U")]), ('{"named_entities": {}}', []), ("no json", []), ("", []), (None, []), ('{"named_entities": [', []),
]


def test_generation_parser(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARSE)], "i int, t string")
    for r in df.select("i", parse.generated_entities(F.col("t")).alias("x")).collect():
        assert [(e.name, e.type) for e in r.x] == PARSE[r.i][1], PARSE[r.i]


def test_reflection_and_boundary_parsers(spark):
    cases = [('Final predicted {"named_entities": [{"name": "a", "type": null}, {"name": "b"}]}', [("a", "None"), ("b", "")]), ('{"named_entities": [{"name": "a", "type": "T"}]} Final predicted: {"named_entities": []}', []), ("最终预测实体：{\"named_entities\": [{\"name\": \"肺\", \"type\": \"bod\"}]}", [("肺", "bod")]), ('{"named_entities": []} {"x": 1}', [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    for r in df.select("i", parse.reflected_entities(F.col("t")).alias("x")).collect():
        assert [(e.name, e.type) for e in r.x] == cases[r.i][1]
    b = [('Updated Predicted Entity: {"name": "a", "type": "T"}', ("entity", "a", "T")), ("{}", ("delete", None, None)), ("nothing", ("keep", None, None)), (None, ("keep", None, None)), ('{"name": "a"} then {bad} {}', ("delete", None, None)), ('{} Updated Predicted Entity {"name": "z", "type": "Q"} {oops}', ("entity", "z", "Q"))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(b)], "i int, t string")
    for r in df.select("i", parse.boundary_decision(F.col("t")).alias("x")).collect():
        assert (r.x.action, r.x.name, r.x.type) == b[r.i][1]


def state_of(spark, docs, spans):
    r = corpus.corpus(docs)
    s = spark.createDataFrame(list(spans.items()), "did string, spans array<struct<start: int, end: int, type: string>>")
    return r.join(s, "did").select("dataset", "did", "units", "text", F.array(F.lit("Disease")).alias("types"), "spans")


def test_triggers(spark, make_docs):
    train = corpus.corpus(make_docs(*[(f"t{i}", "a lung cancer case", [(1, 3, "Disease")]) for i in range(3)]))
    st = stats.token_stats(stats.classified(train))
    q = make_docs(("q", "new lung cancer found", []))
    fires = lambda spans: sorted(r.token for r in triggers.fn_triggers(triggers.annotated(state_of(spark, q, {"q": spans}), st), 0.9).collect())
    assert fires([]) == ["cancer", "lung"] and fires([(1, 3, "Disease")]) == []
    un = triggers.unseen_triggers(triggers.annotated(state_of(spark, q, {"q": []}), st))
    assert sorted(r.token for r in un.collect()) == ["found", "new"]
    edge = triggers.boundary_triggers(state_of(spark, make_docs(("q", "a lung cancer case", [])), {"q": [(0, 2, "D")]}), st)
    assert sorted((r.token, r.side) for r in edge.collect()) == [("a", "inside"), ("cancer", "outside")]


def test_reflection_passes(spark, make_docs):
    train = corpus.corpus(make_docs(*[(f"t{i}", "a lung cancer case", [(1, 3, "Disease")]) for i in range(3)]))
    st = stats.token_stats(stats.classified(train))

    def responder(rows, kind):
        text = {"unseen": '{"named_entities": []}', "fn": 'Final predicted {"named_entities": [{"name": "lung cancer", "type": ""}, {"name": "lung cancer", "type": "Disease"}, {"name": "absent", "type": "X"}]}', "boundary": "{}"}[kind]
        return rows.withColumn("answer", F.lit(text))

    s = state_of(spark, make_docs(("q", "new lung cancer found", [])), {"q": []})
    final, trace = reflect.reflect(s, st, responder, Settings(passes=("unseen", "fn")))
    assert [tuple(x) for x in final.first().spans] == [(1, 3, "Disease")]
    assert [(r["pass"], r.action, r.token) for r in trace.collect()] == [("fn", "add", "lung cancer")]
    s = state_of(spark, make_docs(("q", "a lung cancer case", [])), {"q": [(0, 2, "D"), (1, 3, "Disease")]})
    final, trace = reflect.reflect(s, st, responder, Settings(passes=("boundary",)))
    assert [tuple(x) for x in final.first().spans] == [(1, 3, "Disease")]
    gold = spark.createDataFrame([("q", [(1, 3, "Disease")])], "did string, gold array<struct<start: int, end: int, type: string>>")
    assert [(r.outcome, r.n) for r in reflect.attribution(trace, gold).collect()] == [("delete_fp", 1)]


def test_evaluation(spark):
    rows = [("a", [(0, 3, "X"), (1, 2, "Y"), (5, 6, "X")], [(1, 2, "Y"), (5, 6, "Z"), (5, 6, "Z")]), ("b", [], [])]
    t = "array<struct<start: int, end: int, type: string>>"
    p = spark.createDataFrame(rows, f"did string, gold {t}, pred {t}")
    m = evaluate.micro_prf(p).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall) == (1, 1, 2, 0.5, 0.3333)
    types = {r.type: (r.tp, r.fp, r.fn) for r in evaluate.per_type_prf(p).collect()}
    assert types == {"X": (0, 0, 2), "Y": (1, 0, 0), "Z": (0, 1, 0)}
    e = evaluate.error_rates(p).first()
    assert (e.inner_missed, e.inner, e.outer_missed, e.outer, e.pairs, e.pairs_recovered) == (0, 1, 1, 1, 1, 0)
    e = evaluate.error_rates(p, "did").where("did = 'a'").first()
    assert (e.inner, e.outer, e.pairs) == (1, 1, 1)
    assert {r.depth: (r.recovered, r.total) for r in evaluate.depth_recall(p).collect()} == {1: (0, 2), 2: (1, 1)}
    assert {r.subset: (r.recovered, r.total) for r in evaluate.nested_recall(p).collect()} == {"nested": (1, 2), "flat": (0, 1)}
    with pytest.raises(ValueError):
        evaluate.check_documents(p, p.where("did = 'a'"))
    assert evaluate.micro_prf(p.where("did = 'zz'")).first().f1 == 0


def test_sampling_distances(spark, make_docs):
    r = corpus.corpus(make_docs(("a", "x y", [(0, 1, "A"), (1, 2, "B")]), ("b", "x y", [(0, 1, "A"), (1, 2, "B")]))).withColumn("p", F.col("ord") == 0)
    d = sampling.distances(r, "p").first()
    assert d.l1_distance == 0 and d.count_distance == 0


def test_retrieval(spark, make_docs):
    r = corpus.corpus(make_docs(("p0", "a b c", []), ("p1", "a b", []), ("p2", "z", []), ("p3", "y", []), ("q", "a b c", [], "test")))
    q, pool = r.where("did = 'q'"), r.where("split = 'train'")
    w = stats.weighted(stats.token_stats(stats.classified(pool)))
    scores = retrieval.token_scores(q, pool, w)
    top = retrieval.ranked(retrieval.with_zero_scores(scores, q, pool, 3), "s_token", 3).orderBy("rank").collect()
    assert [x.pool_did for x in top] == ["p3", "p1", "p0"]
    assert retrieval.ranked(scores, "s_token", 0).count() == 1
    demos = retrieval.demonstrations(retrieval.ranked(scores, "s_token", 2), pool).first().demos
    assert [x.text for x in demos] == ["a b", "a b c"]
    v = retrieval.sentence_vectors(r, w)
    near = retrieval.nearest(v.where("did = 'q'"), v.where("did <> 'q'"), 1).first()
    assert near.pool_did == "p0" and abs(near.cos - 1) < 1e-12
    both = retrieval.hybrid_nearest(v.join(r.select("did", "units"), "did").where("did = 'q'"), v.join(r.select("did", "units"), "did").where("did <> 'q'"), w, 1).first()
    assert both.pool_did == "p0"
    # Queries in blocks of any size give the same rows.
    full, x = sorted(retrieval.nearest(v, v, 2).collect()), v.join(r.select("did", "units"), "did")
    assert full and sorted(retrieval.nearest(v, v, 2, block=1, step=1).collect()) == full
    assert sorted(retrieval.hybrid_nearest(x, x, w, 2, block=2, step=1).collect()) == sorted(retrieval.hybrid_nearest(x, x, w, 2).collect())


def test_embedding(spark):
    import hashlib

    df = spark.createDataFrame([("token",)], "t string")
    want = [hashlib.sha256(b"token").digest()[i] / 255 - 0.5 for i in range(16)]
    got = df.select(embed.hash_embedding(F.col("t")).alias("v")).first().v
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-12
    enc = embed.encode(df.union(df), "t", lambda: lambda xs: [[len(x)] for x in xs])
    assert [tuple(r) for r in enc.collect()] == [("token", [5.0])]
    assert df.select(embed.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0


def test_prompts(spark):
    df = spark.createDataFrame([("s", [("demo", [("n\"1", "T")])])], "s string, d array<struct<text: string, ents: array<struct<name: string, type: string>>>>")
    p = df.select(prompts.generation_prompt(F.col("s"), F.col("d"), ["T"], hint="short").alias("p"), prompts.list_repr(F.array(F.lit("a"), F.lit("b's"))).alias("r"), prompts.cache_key("m", F.col("s")).alias("k")).first()
    assert p.p.endswith("Input: s\nOutput:") and '{"named_entities": [{"name": "n\\"1", "type": "T"}]}' in p.p and p.r == "['a', \"b's\"]" and len(p.k) == 64


def test_cache_and_responders(spark):
    c = spark.createDataFrame([("k1", "old", 1, 2, 1), ("k1", "new", 3, 4, 2), (None, "x", 1, 1, 1)], "key string, text string, prompt_tokens int, completion_tokens int, written_at int")
    q = spark.createDataFrame([("k1", "p"), ("k2", "p"), ("k2", "p")], "key string, prompt string")
    h = {r.key: (r.text, r.cached) for r in cache.hits(q, c).collect()}
    assert h == {"k1": ("new", True), "k2": (None, False)} and [r.key for r in cache.misses(q, c).collect()] == ["k2"]

    def client():
        def call(prompt):
            if prompt == "bad":
                raise ValueError("no")
            return prompt.upper()

        return call

    a = cache.respond(spark.createDataFrame([("a", "ok"), ("b", "bad")], "key string, prompt string"), client)
    assert sorted((r.key, r.text, r.error) for r in a.collect()) == [("a", "OK", None), ("b", None, "ValueError: no")]
    with pytest.raises(RuntimeError):
        cache.guard(a)
    tries = []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "fine"

    assert cache.with_retries(flaky, sleep=lambda s: None)("x") == "fine" and len(tries) == 3
    assert cache.report_name("ncbi", "m2", "test", 5, 1, theta=0.9) == "ncbi_m2_test_n5_seed1_theta0.9.json"


def test_pipeline_end_to_end(spark, make_docs):
    d = make_docs(("p0", "a cancer here", [(1, 2, "Disease")]), ("p1", "the cancer spread", [(1, 2, "Disease")]), ("p2", "no disease", []), ("q", "the cancer spread", [(1, 2, "Disease")], "test")).withColumn("ord", F.when(F.col("did") == "q", 0).otherwise(F.col("ord")).cast("bigint"))
    for method in ("m1", "m2"):
        s, _ = pipeline.predict(d, Settings(method=method, n_shots=2))
        m = evaluate.micro_prf(s.withColumnRenamed("spans", "pred")).first()
        assert m.f1 == 1.0, method


def test_pipeline_with_models(spark, make_docs, tmp_path):
    d = make_docs(("p0", "a cancer here", [(1, 2, "Disease")]), ("p1", "the tumor spread", [(1, 2, "Disease")]), ("q", "the cancer xyz", [(1, 2, "Disease")], "test"), ("c", list("肺癌很重"), [(0, 2, "疾病")], "test", "cmeee"))
    asked = []

    def model(rows, kind):
        asked.extend((kind, r.prompt) for r in rows.select("prompt").collect())
        said = '{"named_entities": [{"name": "cancer", "type": "Disease"}, {"name": "肺癌", "type": "疾病"}]}' if kind == "generate" else "none"
        return rows.withColumn("answer", F.lit(said))

    vectors = lambda texts: embed.cached_vectors(texts, "text", str(tmp_path / "v"), lambda: lambda xs: [[1.0 + len(t), 2.0] for t in xs])
    for method in ("m1", "m2"):
        s, trace = pipeline.predict(d, Settings(method=method, n_shots=2), pipeline.Models(generate=model, reflect=model, embedder=vectors, dim=2))
        assert {r.did: [tuple(x) for x in r.spans] for r in s.collect()} == {"q": [(1, 2, "Disease")], "c": [(0, 2, "疾病")]}, method
    prompts_ = dict(asked)
    assert any("请找出" in t and "疾病" in t for k, t in asked if k == "generate") and any("Find all" in t and "a cancer here" in t for k, t in asked if k == "generate")
    assert any(k in ("unseen", "fn", "boundary") for k in prompts_)


def test_pipeline_takes_all_evaluation_records(spark, make_docs):
    rows = [("p0", "a cancer here", [(1, 2, "Disease")])] + [(f"q{i}", f"the cancer no {i}", [(1, 2, "Disease")], ("dev", "test")[i % 2]) for i in range(45)]
    for method in ("m1", "m2"):
        s, _ = pipeline.predict(make_docs(*rows), Settings(method=method, n_shots=2))
        assert sorted(r.did for r in s.collect()) == sorted(r[0] for r in rows[1:]), method


@pytest.mark.parametrize("block, step, dense", [(1000, 256, 256), (7, 3, 2), (1000, 5, 1)])
def test_token_nearest(spark, make_docs, block, step, dense):
    rng = random.Random(block + step)
    rows = [(f"r{i}", [] if i % 17 == 0 else [rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(1, 9))], [], ("train", "test")[i % 3 == 0], ("ncbi", "genia")[i % 5 == 0]) for i in range(90)]
    r = corpus.corpus(make_docs(*rows)).withColumn("ord", F.floor(F.col("ord") / 4)).transform(cut)
    w = cut(stats.weighted(pipeline.train_stats(r)))
    for q, pool in ((r.where("split = 'test'"), pipeline.train(r)), (r, r)):
        for n in (1, 4, 60):
            want = retrieval.ranked(retrieval.with_zero_scores(retrieval.token_scores(q, pool, w), q, pool, n), "s_token", n)
            got = retrieval.token_nearest(q, pool, w, n, block, step, dense)
            cols = ["did", "pool_did", "s_token", "rank"]
            assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect()), n


@pytest.fixture
def tables(monkeypatch):
    """Rows of each table that the retrieval writes."""
    rows = []

    def counted(df):
        rows.append((out := cut(df)).count())
        return out

    for module in (pipeline, retrieval, catalog):
        monkeypatch.setattr(module, "cut", counted)
    return rows


def _crowd(make_docs, path):
    """(30 queries, 570 pool records) that all share a token, also as a data set in the folder."""
    rng = random.Random(5)
    rows = [(f"r{i}", ["the"] + [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))], [(0, 1, "T")] * (i % 3), "train" if i % 20 else "test") for i in range(600)]
    make_docs(*rows).write.parquet(f"{path}/docs.parquet")
    return [r for r in rows if r[3] == "test"], [r for r in rows if r[3] == "train"]


def _best(spark, path, queries, pool, n=8):
    """``did``, pool record, score and rank by comparing all pairs."""
    w = {r.token: r.w for r in stats.weighted(pipeline.train_stats(corpus.corpus(spark.read.parquet(f"{path}/docs.parquet")))).collect()}
    for did, units, *_ in queries:
        scored = sorted((sum(w.get(t, 1_000_000) for t in {*units} & {*p[1]}), i) for i, p in enumerate(pool))[-n:]
        yield from ((did, pool[i], s, k + 1) for k, (s, i) in enumerate(scored))


def test_demo_lookup_makes_no_table_of_pairs(spark, make_docs, tmp_path, tables):
    queries, pool = _crowd(make_docs, tmp_path)
    want = sorted((did, rank - 1, " ".join(p[1]), len(p[2])) for did, p, _, rank in _best(spark, tmp_path, queries, pool))
    assert sorted(tuple(r) for r in catalog.demo_lookup(spark, str(tmp_path)).collect()) == want
    assert tables and max(tables) <= len(queries) + len(pool)


def test_retrieve_token_topk_makes_no_table_of_pairs(spark, make_docs, tmp_path, tables):
    queries, pool = _crowd(make_docs, tmp_path)
    want = sorted((did, p[0], s, rank) for did, p, s, rank in _best(spark, tmp_path, queries, pool))
    assert sorted(tuple(r) for r in catalog.retrieve_token_topk(spark, str(tmp_path)).collect()) == want
    assert tables and max(tables) <= len(queries) + len(pool)


def test_token_nearest_in_portions(spark, make_docs, tmp_path):
    _crowd(make_docs, tmp_path)
    r = corpus.corpus(spark.read.parquet(f"{tmp_path}/docs.parquet")).withColumn("ord", F.when(F.col("ord") % 3 > 0, F.col("ord") - 400)).transform(cut)
    q, pool, w = r.where("split = 'test'"), pipeline.train(r), cut(stats.weighted(pipeline.train_stats(r)))
    want = retrieval.ranked(retrieval.with_zero_scores(retrieval.token_scores(q, pool, w), q, pool, 8), "s_token", 8)
    cols = ["did", "pool_did", "s_token", "rank"]
    for block, most in ((1000, 1), (1, 50)):
        assert sorted(retrieval.token_nearest(q, pool, w, 8, block=block, dense=1, most=most).select(cols).collect()) == sorted(want.select(cols).collect()), most


def test_stream_of_records(spark, make_docs, tmp_path):
    a, b = make_docs(("a", "x y", [(0, 1, "T")])), make_docs(("b", "x z", []))
    a.write.parquet(str(tmp_path / "in"))
    b.write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = s.writeStream.foreachBatch(increments.counts_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.token: (r.n_e, r.n_c, r.n_o) for r in increments.current(spark, str(tmp_path / "out")).collect()}
    want = {r.token: (r.n_e, r.n_c, r.n_o) for r in stats.token_stats(stats.classified(corpus.corpus(a.unionByName(b)))).collect()}
    assert got == want


def test_dirty_records(spark, make_docs):
    d = make_docs(("a", "x y", [(0, 9, "T"), (1, 1, "T"), (0, 1, None)]), ("a", "x y", [(0, 9, "T"), (1, 1, "T"), (0, 1, None)]), (None, "x", []))
    r = corpus.corpus(d).collect()
    assert len(r) == 1 and [(e.start, e.end, e.type, e.ent_ord) for e in r[0].entities] == [(0, 1, "", 2)]
    empty = corpus.corpus(d.limit(0))
    assert stats.token_stats(stats.classified(empty)).count() == 0 and align.round_trip(empty).count() == 0


def test_evidence_in_prompts(spark, make_docs):
    train = corpus.corpus(make_docs(*[(f"t{i}", "a lung cancer case", [(1, 3, "Disease")]) for i in range(3)]))
    st, lib, seen = stats.token_stats(stats.classified(train)), stats.span_library(train), []

    def responder(rows, kind):
        seen.extend((kind, r.prompt) for r in rows.select("prompt").collect())
        return reflect.mock_responder(rows, kind)

    s = state_of(spark, make_docs(("q", "new lung cancer found a", [])), {"q": [(3, 5, "D")]})
    plain, _ = reflect.reflect(s, st, reflect.mock_responder)
    shown, _ = reflect.reflect(s, st, responder, library=lib)
    assert sorted(map(tuple, plain.first().spans)) == sorted(map(tuple, shown.first().spans))
    text = dict(seen)
    assert "num_occurrences_as_entity" in text["fn"] and 'Output: {"name": "lung cancer", "type": "Disease"}' in text["fn"] and "Around: ['cancer', 'lung']" in text["unseen"]


def test_each_question_is_asked_once(spark, make_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    train = corpus.corpus(make_docs(*[(f"t{i}", [rng.choice(words) for _ in range(8)], [(rng.randrange(4), 4 + rng.randrange(4), "D")]) for i in range(30)]))
    docs = make_docs(*[(f"q{i}", [rng.choice([*words, "new", "odd"]) for _ in range(8)], []) for i in range(12)])
    s = state_of(spark, docs, {f"q{i}": [(i % 4, 4 + i % 4, "D")] for i in range(0, 12, 2)})
    asked = spark.sparkContext.accumulator(0)

    def answer(name):
        asked.add(1)
        return f'{{"name": "{name}", "type": "T{random.random()}"}}' if name else "{}"

    ask = F.udf(answer, "string").asNondeterministic()

    def responder(rows, kind):
        if kind == "boundary":
            return rows.withColumn("answer", F.concat(F.lit("Updated Predicted Entity: "), ask(F.get("units", F.col("start")))))
        return rows.withColumn("answer", F.concat(F.lit('Final predicted entities: {"named_entities": ['), ask(F.element_at("tokens", 1)), F.lit("]}")))

    for passes in (("unseen",), ("fn",), ("boundary",), ("unseen", "fn", "boundary")):
        asked.value = 0
        final, trace = reflect.reflect(s, stats.token_stats(stats.classified(train)), responder, Settings(theta_fn=0.3, surround=0.1, passes=passes))
        once_asked, rows = asked.value, trace.collect()
        spans = {r.did: {tuple(x) for x in r.spans} for r in final.collect()}
        assert asked.value == once_asked > 0 and rows, passes
        if len(passes) == 1:
            assert all(tuple(r.span) in spans[r.did] for r in rows if r.action == "add") and all(tuple(r.new) in spans[r.did] for r in rows if r.action == "trim"), passes


def test_label_maps():
    ids = config.label_ids(config.CMEEE_TYPES)
    assert ids["O"] == 0 and ids["B-bod"] == 1 and ids["I-sym"] == 18 and config.label_ids(config.GENIA_LABEL_ORDER)["I-cell_type"] == 10
    assert config.type_ids(config.CMEEE_TYPE_ORDER)["dep"] == 8 and config.stored_types(config.CMEEE_DISPLAY)["身体部位"] == "bod"


def test_answers_are_asked_once(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body["messages"][0]["content"])
            self.send_response(503 if len(asked) == 1 else 200)
            self.end_headers()
            if len(asked) > 1:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": "answer to " + asked[-1]}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    q = spark.createDataFrame([("a", "x"), ("a", "x")], "key string, prompt string").coalesce(1)
    for _ in range(2):
        r = cache.answered(q, str(tmp_path / "c"), cache.http_client(f"http://127.0.0.1:{server.server_port}", "m")).collect()
        assert [x.text for x in r] == ["answer to x"] * 2
    server.shutdown()
    assert asked == ["x", "x"]
    v = embed.cached_vectors(q, "prompt", str(tmp_path / "v"), lambda: lambda xs: [[1.0, 2.0] for _ in xs])
    again = embed.cached_vectors(q.select(F.lit("y").alias("prompt")).union(q.select("prompt")), "prompt", str(tmp_path / "v"), lambda: lambda xs: [[3.0, 4.0] for _ in xs])
    assert v.count() == 1 and {r.text: r.vec for r in again.collect()} == {"x": [1.0, 2.0], "y": [3.0, 4.0]}


def test_command_line(spark, tmp_path, make_docs):
    from tessera.__main__ import main

    make_docs(("p0", "a cancer here", [(1, 2, "Disease")]), ("p1", "the cancer spread", [(1, 2, "Disease")]), ("q", "the cancer spread", [(1, 2, "Disease")], "test")).write.parquet(str(tmp_path / "docs"))
    common = [str(tmp_path / "docs"), "--dataset", "ncbi", "--out", str(tmp_path)]
    assert main([*common, "--selfcheck"], spark)["incomplete"] == 0 and main([*common, "--validate-stats"], spark)["cancer"][0] == 1.0
    r = main([*common, "--method", "m2", "--theta-fn", "0.9"], spark)
    assert r["overall"][0]["f1"] == 1.0 and (tmp_path / "ncbi_m2_test_n1_seed13_theta0.9.json").exists()
