"""The training-data operators against brute force, and on odd tables."""

import random
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import calibrate, chars, counts, forms, leaks, mixing, queries, splits, subjects, truncation, vectors

DOCS = "dataset string, split string, did string, ord bigint, units array<string>, text string, entities array<struct<start: int, end: int, type: string, surface: string>>, loaded_at timestamp"


def docs(spark, rows, split="train", dataset="ncbi"):
    """Rows of (did, text[, split[, entities]])."""
    out = [(dataset, r[2] if len(r) > 2 else split, r[0], i, r[1].split() if r[1] else None, r[1], r[3] if len(r) > 3 else None, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, DOCS)


# --- 1 --------------------------------------------------------------------------------------------------------------
def printed(t):
    return unicodedata.normalize("NFC", "".join(chars.printed(c) for c in unicodedata.normalize("NFD", t)))


def test_visual_forms(spark):
    rng = random.Random(1)
    alphabet = "aeoABx,.-  é́̈​­ＡｅﬁⅡаеоΑΖ−‑ ⼩小²①가각"
    texts = ["", "​", "plain", "ẹ́", "ẹ́", "ｆｕｌｌ　ｗｉｄｔｈ", "x" * 20_000 + "é"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "did int, text string")
    got = {r.did: r.form for r in forms.visual_forms(df, ["did"], "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == printed(t), (ascii(t), ascii(got[i]))
    again = spark.createDataFrame([(i, f) for i, f in got.items()], "did int, text string")
    assert {r.did: r.form for r in forms.visual_forms(again, ["did"], "text").collect()} == got
    assert got[3] == got[4] and printed("²") == "²" and printed("а") == "a" and printed("δ") == "δ"


def test_look_alikes(spark):
    d = docs(spark, [("a", "Zeb disease"), ("b", "Zеb disease"), ("b", "Zеb disease"), ("c", "Zeb disease"), ("d", "zeb disease"), ("e", None), (None, "Zeb disease")])
    f = forms.text_forms(d)
    assert sorted((r.key_a, r.key_b) for r in forms.look_alike_texts(f).collect()) == [("a", "b"), ("b", "c")]
    assert {r.did: (r.class_id, r.n_links) for r in forms.look_alike_classes(f).collect()} == {"a": ("a", 1), "b": ("a", 2), "c": ("a", 1)}
    e = [(0, 1, "T", "IL‑2"), (0, 1, "T", "IL-2"), (0, 1, "T", None), (0, 1, "T", "il-2"), (0, 1, "T", "ⅠL-2")]
    d = docs(spark, [("a", "x", "train", e)])
    terms = spark.createDataFrame([(7, "IL-2"), (8, None)], "term_id int, name string")
    assert sorted(tuple(r) for r in forms.disguised_names(d, terms).collect()) == [("a:0", "7"), ("a:4", "7")]
    assert forms.found(d.limit(0), terms.limit(0)).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("longest", [1, 2, 3])
def test_ngrams(spark, longest):
    rng = random.Random(longest)
    rows = [(f"d{i % 35}" if i >= 35 else f"d{i}", [rng.choice(["a", "b", "c", None]) if i % 3 else "a" for _ in range(rng.randint(0, 12))]) for i in range(35)]
    rows += [rows[0], (None, ["a"]), ("z", None)]
    df = spark.createDataFrame([(None if k and k.endswith("1") else "g", k, u) for k, u in rows], "dataset string, did string, units array<string>")
    want: dict = {}
    for k, u in {k: u for k, u in rows if k and u is not None}.items():
        g = None if k.endswith("1") else "g"
        for i in range(len(u)):
            for n in range(1, longest + 1):
                s = tuple(u[i : i + n])
                if len(s) == n and None not in s:
                    want.setdefault((g, s), []).append(k)
    got = {(r.grp, tuple(r.gram)): (r.occurrences, r.records) for r in counts.ngram_counts(df, "dataset", "did", "units", longest).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_marks(spark):
    d = docs(spark, [(f"d{i}", "a b" if i < 3 else "a c") for i in range(20)])
    m = {r.token: (r.records, r.rare, r.common) for r in counts.unit_marks(d).collect()}
    assert m == {"a": (20, False, True), "b": (3, False, False), "c": (17, False, True)}
    t = spark.createDataFrame([("x", 0, "a", 1, None, None), ("x", 0, "a", 1, None, None), ("x", 1, "a", 1, 0, 0), ("x", 0, "b", 500, 0, 0), (None, 0, "b", None, None, None), ("x", 0, None, 1, 1, 1)], "dataset string, shard int, token string, n_e bigint, n_c bigint, n_o bigint")
    s = {(r.dataset, r.token): (r.total, r.rare, r.common) for r in counts.saved_marks(t).collect()}
    assert s == {("x", "a"): (2, True, False), ("x", "b"): (500, False, True), (None, "b"): (0, True, False)}
    assert counts.found(d.limit(0), t.limit(0)).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------
def naive_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_distance_and_prefixes():
    rng = random.Random(4)
    for _ in range(300):
        a, b = [[rng.choice("abc") for _ in range(rng.randint(0, 90))] for _ in range(2)]
        assert splits.distance(a, b) == naive_distance(a, b)
    for n in range(1, 400):
        for q, t in splits.gram_sizes(n, 15, 6).items():
            assert q >= 1 and q * (t + 1) <= n


def test_cross_split_pairs(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 8, 14, 20, 28, 41]))]
        if i % 2 and rows:
            base = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 1 + len(base) // 5)):
                p = rng.randrange(len(base))
                base = base[:p] + rng.choice([[], [rng.choice(vocab)], [rng.choice(vocab), base[p]]]) + base[p + 1 :] or ["w0"]
        rows.append((f"d{i}", " ".join(base), rng.choice(["train", "dev", "test"])))
    rows += [("z1", "肺叶脂肪样病变表现明显。", "train"), ("z2", "肺叶脂肪样病变，表现很明显", "dev"), ("n1", None, "dev"), ("n2", "...", "test"), ("n3", "x", None), rows[0]]
    want = set()
    for a in rows:
        for b in rows:
            if a[1] and b[1] and a[2] == "train" and b[2] in ("dev", "test") and a[0] != b[0] and a[1] != "..." and b[1] != "...":
                u, v = (list(x[1].replace("。", "").replace("，", "")) if x[0].startswith("z") else x[1].split() for x in (a, b))
                if naive_distance(u, v) <= max(len(u), len(v)) * 15 // 100:
                    want.add(tuple(sorted((a[0], b[0]))))
    got = [tuple(r) for r in splits.found(docs(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("z1", "z2") in want
    # Every gram is hot: each is salted, and nothing is lost.
    cls = splits.comparable(docs(spark, rows)).groupBy("cls").agg(*[F.first(c).alias(c) for c in ("chars", "n", "units")], F.max(F.col("side") == "e").alias("in_e"), F.max(F.col("side") == "t").alias("in_t"))
    plain, salted = (sorted(map(tuple, splits.near_pairs(cls, hot=h).collect())) for h in (50_000, 2))
    assert plain == salted
    assert splits.found(docs(spark, rows).limit(0)).count() == 0
    assert {r.dataset for r in splits.overlap_report(docs(spark, rows)).collect()} == {"ncbi"}


def test_pairs_across_kinds_of_datasets(spark):
    zh, en = "关于价格的方案很少提到审计，但账目常被投保。", "After weeks the locus mutated the somatic pedigree near the genome again and again"
    rows = [("cmeee", "train", "a", zh), ("ncbi", "dev", "b", zh.replace("很少", "少")), ("genia", "test", "c", zh), ("cmeee", "dev", "d", en), ("ncbi", "train", "e", en.replace("locus", "loci")), ("cmeee", "train", "f", en.upper()), (None, "train", "g", en)]
    df = spark.createDataFrame(rows, "dataset string, split string, did string, text string")
    assert {tuple(r) for r in splits.found(df).collect()} == {("a", "b"), ("a", "c"), ("d", "e"), ("d", "f"), ("d", "g")}


# --- 4 --------------------------------------------------------------------------------------------------------------
def clustered(n, rng, size=12, dim=16):
    centers = rng.normal(size=(n // size + 1, dim))
    return (centers[np.arange(n) // size] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)


def exact(ids, x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x, ids = clustered(900, rng), np.arange(1, 901)
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame([*rows, rows[3], (2000, None), (2001, [0.0] * 16), (2002, [1.0]), (None, rows[0][1]), (2003, [float("nan")] * 16)], "vec_id bigint, vec array<float>")
    assert vectors.usable(spark.createDataFrame([(1, [1e30] * 16), (2, [1e-30] * 16), (3, [float("inf")] * 16), (4, [-0.0] * 16)], df.schema), 16).count() == 2
    want = exact(ids, x, 5)
    for factor, shard, least in ((1.0, 100_000, 1.0), (1.0, 200, 1.0), (0.3, 200, 0.9)):
        got: dict = {}
        for r in vectors.top_k(df, 5, 16, factor, shard, 32).orderBy("vec_id", "rank").collect():
            got.setdefault(r.vec_id, []).append(r.near_id)
        assert set(got) == set(want)
        recall = np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want])
        assert recall >= least, (factor, shard, recall)


def test_copies_of_vectors(spark):
    rng = np.random.default_rng(7)
    x = clustered(60, rng)
    x[10:40] = x[10]
    rows = [(int(i + 1), [float(y) for y in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<float>")
    got: dict = {}
    for r in vectors.top_k(df, 5, 16, 1.0, 20, 4).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.near_id)
    assert got[11] == [12, 13, 14, 15, 16] and got[40] == [11, 12, 13, 14, 15]
    assert got[1] == exact(np.arange(1, 61), x, 5)[1]
    assert vectors.found(spark.createDataFrame([], "vec_id bigint, vec array<float>")).count() == 0


# --- 5 --------------------------------------------------------------------------------------------------------------
def test_calibrated_sample(spark):
    rng = random.Random(8)
    rows = [(f"d{i}", "x y", "train", [(0, 1, rng.choice(["A", " a", "type-b", "Type_B", "B", "B"]), "x") for _ in range(rng.randint(0, 4))] + ([(0, 1, "C", "x")] if i % 100 == 0 else []) + [(0, 1, None, "x")]) for i in range(3000)]
    d = docs(spark, rows)
    types = spark.createDataFrame([("ncbi", "A", "a"), ("ncbi", "B", "type b"), ("ncbi", "C", "c")], "dataset string, code string, full_name string")
    plans = spark.createDataFrame([(1, "ncbi", "A", 500, 300, 8), (1, "ncbi", "B", 490, 300, 8), (1, "ncbi", "C", 10, 300, 5), (2, "ncbi", "C", 1000, 100, 2), (2, "ncbi", "A", 0, 100, 2), (3, "ncbi", None, 1, 1, 1), (4, "none", "A", 500, 500, 3)], "plan_id int, dataset string, code string, share_pm int, fraction_pm int, min_mentions int")
    chosen, report = calibrate.sample(d, types, plans)
    r = {(x.plan_id, x.code): x for x in report.collect()}
    for c in "AB":
        assert abs(r[1, c].sampled - r[1, c].target) <= 0.08 * r[1, c].target
    assert r[1, "C"].sampled >= 5 and r[1, "C"].reachable and not r[2, "C"].reachable and r[2, "A"].sampled >= 2 and not r[4, "A"].reachable
    assert chosen.count() == chosen.select("plan_id", "did").distinct().count()
    assert calibrate.sample(d.limit(0), types, plans)[1].where("reachable").count() == 0


def test_sample_of_all_there_is(spark):
    rng = random.Random(14)
    rows = [(f"d{i}", "x y", "train", [(0, 1, rng.choice("AAB"), "x") for _ in range(rng.randint(1, 3))]) for i in range(600)]
    types = spark.createDataFrame([("ncbi", "A", "a"), ("ncbi", "B", "b")], "dataset string, code string, full_name string")
    mentions = [e[2] for r in rows for e in r[3]]
    pm = mentions.count("B") * 1000 / len(mentions)
    plans = spark.createDataFrame([(1, "ncbi", "A", 1000, 1000, 1), (2, "ncbi", "A", 1000 - int(pm), 1000, 1), (2, "ncbi", "B", int(pm), 1000, 1), (3, "ncbi", "B", int(pm) + 1, 1000, 1), (3, "ncbi", "A", 100, 1000, 1)], "plan_id int, dataset string, code string, share_pm int, fraction_pm int, min_mentions int")
    chosen, report = calibrate.sample(docs(spark, rows), types, plans)
    r = {(x.plan_id, x.code): x for x in report.collect()}
    assert r[1, "A"].sampled == r[1, "A"].available == mentions.count("A") and not r[1, "A"].reachable and r[1, "A"].converged
    assert r[2, "B"].reachable and not r[2, "A"].reachable and r[2, "A"].sampled == mentions.count("A")
    assert not r[3, "B"].reachable and r[3, "B"].sampled == mentions.count("B") and r[3, "A"].reachable
    for x in r.values():
        assert x.reachable == (x.available * 1_000_000 >= round(x.target * 1_000_000) and x.available >= x.min_mentions)


def test_pivotal():
    n = 4000
    p = np.random.default_rng(9).uniform(0, 1, 40)
    hit = np.zeros(40)
    sizes = set()
    for s in range(n):
        took, held = calibrate._pivotal([(str(i), x) for i, x in enumerate(p)], random.Random(s))
        if held and random.Random(-s).random() < held[1]:
            took.append(held[0])
        hit[[int(i) for i in took]] += 1
        sizes.add(len(took))
    assert max(sizes) - min(sizes) <= 1 and np.abs(hit / n - p).max() < 0.05


# --- 6 --------------------------------------------------------------------------------------------------------------
def test_truncated(spark):
    rng = random.Random(10)
    rows, cut = [], set()
    for i in range(1500):
        t = "I compared \"" + rng.choice("abc") * 3 + "\" with the words and kept it. " * rng.randint(0, 2) + '{"named_entities": [{"name": "' + rng.choice(["lung", "heart", "skin"]) + '", "type": "Disease"}]}'
        if i % 12 == 0:
            t, _ = t[: rng.randint(5, len(t) - 3)], cut.add(f"k{i}")
        rows.append((f"k{i}", 1 + i % 2, t + "\n" * (i % 3)))
    rows += [(None, 1, "x"), ("e", 1, ""), ("b", 1, "  "), ("n", 1, None), rows[0]]
    df = spark.createDataFrame(rows, "key string, run_id int, text string")
    got = {r.key for r in truncation.truncated(df).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.01 * len(rows)
    runs = spark.createDataFrame([(1, "m"), (2, "o")], "run_id int, model string")
    r = {x.model: x for x in truncation.rates(df, runs, truncation.truncated(df)).collect()}
    assert r["m"].truncated + r["o"].truncated == len(got)
    assert truncation.truncated(df.limit(0)).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------
def test_leaks(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [words(60) for _ in range(12)]
    rows, want = [], set()
    for i in range(200):
        body, k = words(80), i % 12
        if i % 4 == 0:  # most of the item, a few words changed, other case and marks
            part = items[k][10:55]
            for _ in range(3):
                part[rng.randrange(len(part))] = rng.choice(vocab)
            body[30:30] = [w.upper() if rng.random() < 0.2 else w + "," for w in part]
            want.add((i, k))
        elif i % 4 == 1:  # too little of it
            body[30:30] = items[k][:18]
        elif i % 4 == 2:  # all of it, but in pieces
            for p in range(0, 60, 6):
                body[p * 2 : p * 2] = items[k][p : p + 6]
        rows.append((i, " ".join(body) if i % 8 else "\n".join(body)))
    rows += [(900, None), (901, ""), (902, "?!"), (None, " ".join(items[0])), rows[0]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    it = spark.createDataFrame([(k, "ncbi", "dev", " ".join(x)) for k, x in enumerate(items)] + [(50, "ncbi", "dev", None), (51, "ncbi", "dev", "a")], "item_id int, dataset string, split string, text string")
    for blocks in (20_000, 5):
        assert {tuple(r) for r in leaks.leaked(d, it, max_items=blocks).collect()} == want
    assert leaks.leaked(d, it.limit(0)).count() == 0 and leaks.leaked(d.limit(0), it).count() == 0
    assert leaks.leak_counts(leaks.leaked(d, it), it).count() == len({k for _, k in want})


def test_leaks_at_ends_of_documents(spark):
    rng = random.Random(12)
    words = lambda c, n: ["".join(rng.choice("abcdefghij") for _ in range(6)) + c for _ in range(n)]
    item = words("x", 60)
    parts = {(a, b): item[a:b] for a, b in ((30, 60), (25, 60), (14, 60), (0, 30), (0, 35), (0, 46))}
    rows = [" ".join(part + words("y", n)) for part in parts.values() for n in (0, 1, 40, 300)]
    rows += [" ".join(words("y", n) + part) for part in parts.values() for n in (1, 40, 300)]
    few = [" ".join(x) for x in (item[35:] + words("y", 90), words("y", 90) + item[:25])]
    d = spark.createDataFrame(list(enumerate(rows + few)), "doc_id bigint, text string")
    it = spark.createDataFrame([(7, "ncbi", "dev", " ".join(item))], "item_id int, dataset string, split string, text string")
    assert {tuple(r) for r in leaks.leaked(d, it).collect()} == {(i, 7) for i in range(len(rows))}


def held(item, doc, shortest, edits):
    """By all beginnings in the item: the fewest edits that make each stretch of it one of the document's."""
    for s in range(len(item)):
        row = [0] * (len(doc) + 1)
        for i in range(s, len(item)):
            before, row = row, [row[0] + 1] + [0] * len(doc)
            for j, w in enumerate(doc, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (w != item[i]))
            if i + 1 - s >= shortest and min(row) <= edits * (i + 1 - s) + 1e-9:
                return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 4, 5, 6, 14])))
    items = [[word() for _ in range(rng.choice([1, 3, 8, 14, 20, 27, 40]))] for _ in range(14)]
    items += [[rng.choice("肺叶脂肪样病变表现明显关于价格的方案") for _ in range(40)], [*"关于价格的方案", "p11204", *"记录列出账目审计"]]
    rows = []
    for i in range(420):
        item = items[i % len(items)]
        size = rng.randint(max(1, len(item) // 2 - 1), len(item))
        at = rng.randint(0, len(item) - size)
        part = item[at : at + size]
        longest = sorted(range(size), key=lambda x: -len(part[x]))
        for x in longest[: rng.randint(0, 1 + size // 5)]:  # the longest words, which spoil most grams
            part[x] = rng.choice([word(), word() + "kkkkkkkkkkkkkkkkkkkkkkkkkk", "", f"{word()} {part[x]}"])
        body = [word() for _ in range(rng.choice([0, 1, 5, 25]))]
        rows.append((i, " ".join([*body, *(w for w in part if w), *(word() for _ in range(rng.choice([0, 2, 30])))])))
    it = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id int, text string")
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(i, k) for i, t in rows for k, x in enumerate(items) if held(x, t.split(), max(1, -(-len(x) // 2)), 0.15)}
    got = {tuple(r) for r in leaks.leaked(d, it).collect()}
    assert got == want and len(want) > 100


# --- 8 --------------------------------------------------------------------------------------------------------------
def test_mixing(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice("aaaaab") if i % 50 else "c", " ".join(["word"] * rng.randint(1, 60))) for i in range(3000)] + [(9000, None, "word"), (9001, "a", None), (None, "a", "x"), (9002, "b", "")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    plans = spark.createDataFrame([(1, "a", 600, 1), (1, "b", 390, 4), (1, "c", 10, 3), (2, "a", 100, 1), (2, "c", 900, 2), (3, None, 5, 1), (4, "zz", 1000, 2)], "plan_id int, source string, weight_pm int, max_repeats int")
    r = {(x.plan_id, x.source): x for x in mixing.report(d, plans, block_tokens=200).collect()}
    assert abs(r[1, "a"].share - 0.6) < 0.02 and abs(r[1, "b"].share - 0.39) < 0.02 and not r[1, "a"].short and r[2, "c"].short and r[4, "zz"].short and r[4, "zz"].tokens == 0
    sizes, cuts, filled, _ = mixing.mix(d, plans, block_tokens=200)
    assert cuts.agg(F.sum("tokens")).first()[0] == sizes.where("source is not null").agg(F.sum("tokens")).first()[0]
    assert cuts.groupBy("doc_id").count().where("count > 1").count() == 0
    use = filled.where("block is not null").groupBy("plan_id", "source", "block").count()
    assert use.join(plans, ["plan_id", "source"]).where("count > max_repeats").count() == 0
    slots = mixing.schedule(plans, 1000, chunk=64).where("plan_id = 1").orderBy("slot").collect()
    assert len(slots) == 1000
    for name, w in (("a", 0.6), ("b", 0.39)):
        own = [s for s in slots if s.source == name]
        assert [s.turn for s in own] == list(range(len(own)))
        assert all(abs(sum(s.source == name for s in slots[:n]) - w * n) < 6 for n in (10, 100, 500, 1000))
    assert mixing.report(d.limit(0), plans).where("tokens > 0").count() == 0


def test_short_sources_by_exact_sizes(spark):
    rng = random.Random(15)
    d = spark.createDataFrame([(i, rng.choice("aaaabbc"), " ".join(["word"] * rng.randint(1, 60))) for i in range(2000)], "doc_id bigint, source string, text string")
    own = {r.source: r.n for r in mixing.token_sizes(d).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(own.values())
    lines = [(k, s, int(own[s] * n * 1000 * room / total), n) for k, room in enumerate((0.5, 0.9, 1.1, 2.0)) for s, n in (("a", 1), ("b", 2), ("c", 3))]
    # A plan's weights are shares of their sum, so each line is a plan of its own with the rest on another source.
    alone = [(100 + i, s, w, n) for i, (_, s, w, n) in enumerate(lines) if w < 1000] + [(100 + i, "other", 1000 - w, 1) for i, (_, s, w, n) in enumerate(lines) if w < 1000]
    plans = spark.createDataFrame(alone, "plan_id int, source string, weight_pm int, max_repeats int")
    for r in mixing.report(d, plans).where("source <> 'other'").collect():
        assert r.short == (r.max_repeats * r.size * 1000 < r.weight_pm * r.total), r
    _, cuts, filled, _ = mixing.mix(d, plans)
    mixed = mixing.mixed_records(cuts, filled)
    assert mixed.groupBy("plan_id", "doc_id", "epoch").count().where("count > 1").count() == 0
    assert mixed.join(plans, ["plan_id", "source"]).where("epoch >= max_repeats").count() == 0 and mixed.count() > 2000


# --- 9 --------------------------------------------------------------------------------------------------------------
def test_subjects(spark):
    law, med = "The court heard the plaintiff and the tribunal upheld the statute.", "The nurse checked the catheter and the surgeon closed the incision."
    rows = [(1, " ".join([law] * 4)), (2, " ".join([law, med, law, med])), (3, " ".join([law] * 9 + [med])), (4, "Page was archived automatically."), (5, "法院的判决与原告有关。被告上诉。"), (6, None), (7, ""), (None, law), (8, "<p>" + law + "</p>\n```\nthe nurse(); catheter; surgeon\n```"), (1, " ".join([law] * 4)), (9, law.replace("court", "cоurt"))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(1, "law"), (2, "clinical"), (2, "law"), (None, "law"), (3, None)], "doc_id bigint, subject string")
    got = {}
    for r in subjects.subjects_of(d, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert got == {1: {"law"}, 2: {"law", "clinical"}, 3: {"law"}, 5: {"law"}, 8: {"law"}, 9: {"law"}}
    assert subjects.composition(subjects.subjects_of(d, labels), d).where("subject = 'law'").first().documents == 6
    assert subjects.subjects_of(d.limit(0), labels.limit(0)).count() == 0


def test_shares_of_subjects(spark):
    law, med = "The court heard the plaintiff and the tribunal upheld the statute.", "The nurse checked the catheter and the surgeon closed the incision."
    both = "The court heard the plaintiff about the catheter of the surgeon."
    plain = [f"The road number {x} went over the old hill beside a lake." for x in "abcdefghijklmno"]
    rows = [(1, " ".join([law, *plain[:9]])), (2, " ".join([both] * 5)), (3, " ".join([law, *plain[9:12]])), (4, f"```\n{law} " + " ".join(plain[12:14])), (5, f"{law}\nPage 1 of all.\nPage 2 of all.\nPage 3 of all.\nPage 4 of all."), (6, "Page 7 of all."), (7, law + "\n    x = court(3)\n"), (8, " ".join([med] * 3)), (9, "A dragon ate the wizard. " * 3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame([("law", "x"), ("clinical", None), ("fantasy", "dragon and wizard tales"), (None, "y")], "subject string, gloss string")
    terms = subjects.terms_of(table)
    assert sorted(terms) == ["clinical", "fantasy", "law"]
    for labels in ([], [(8, "clinical"), (3, "law"), (2, "law"), (2, "clinical"), (9, "fantasy")]):
        got: dict = {}
        for r in subjects.subjects_of(d, spark.createDataFrame(labels, "doc_id bigint, subject string"), terms).collect():
            got.setdefault(r.doc_id, {})[r.subject] = r.share_pm
        assert got == {2: {"law": 1000, "clinical": 1000}, 3: {"law": 250}, 4: {"law": 333}, 5: {"law": 1000}, 7: {"law": 1000}, 8: {"clinical": 1000}, 9: {"fantasy": 1000}}
    assert subjects.subjects_of(d, spark.createDataFrame([], "doc_id bigint, subject string"), {}).count() == 0


# --- all ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import os

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{d}/{f}')")
    a, b = queries.queries()[name](spark, d).toPandas(), con.execute(queries.oracle_sql()[name]).fetch_df()
    plain = lambda df: sorted(tuple(str(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(a) == plain(b)


def test_extra_columns_do_not_clash(spark):
    d = docs(spark, [("a", "Zeb disease x", "train"), ("b", "Zеb disease x", "dev")])
    for c in ("form", "raw", "c", "key", "w", "cls", "side", "x", "grp", "n", "_text"):
        d = d.withColumn(c, F.lit("clash"))
    assert forms.look_alike_texts(forms.text_forms(d)).count() == 1 and splits.found(d).count() == 1 and counts.unit_marks(d).count() == 4
