"""Subject areas of documents by curated terms, a multi-pattern automaton and calibrated thresholds (problem 9)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.chars import fold_codes, folding, slabs
from tessera.llm.subject_terms import TERMS
from tessera.runtime import bounded_rows, broadcast_if_small, cut

_CLOSED = re.compile(r"```.*?```|<(script|style|code|pre)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^<>]*>|```")
_CODE = re.compile(r"(?m)^(?: {4,}|\t)[ \t]*[\w.]+ *(?:=[^\n]*|\([^\n]*\);?) *$")
_HEAD = re.compile(r"(?m)^\s*[A-Z]{4,}:\s*")
#: A score that any term reaches.
ANY = 1e-9
_automata: dict = {}


def term_list(terms: dict = TERMS) -> list[tuple[str, str, int]]:
    """(term, subject, weight) in a fixed order, the terms of a subject together."""
    return [(t, s, w) for s in terms for w in sorted(terms[s]) for t in terms[s][w].split()]


def terms_of(subjects: DataFrame, max_subjects: int = 10_000) -> dict:
    """Terms by subject for the rows of a table ``subject, gloss``: the curated ones, or for a subject without them the words of its name and gloss."""
    out = {}
    for r in sorted(bounded_rows(subjects.where("subject is not null").groupBy("subject").agg(F.max("gloss").alias("gloss")), max_subjects, "subjects"), key=lambda r: r.subject):
        words = re.findall(r"[a-z-]{4,}|[㐀-鿿]{2,}", f"{r.subject} {r.gloss or ''}".lower())
        out[r.subject] = TERMS.get(r.subject) or {1: " ".join(dict.fromkeys(words))}
    return out


def _automaton(terms: tuple):
    if terms not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, (t, _, _) in enumerate(terms):
            key = f" {t} " if t[0].isascii() else t
            a.add_word(key, (len(t), key[0] == " ", (*(a.get(key)[2] if key in a else ()), i)))
        a.make_automaton()
        _automata[terms] = a
    return _automata[terms]


def _prose(text: str) -> str:
    """Without closed fences and code elements, tags, lines of code and headings; a fence or element that isn't closed is only a mark."""
    if "<" in text or "```" in text:
        text = _TAG.sub(" ", _CLOSED.sub("\n\n", text))
    if "    " in text or "\t" in text:
        text = _CODE.sub("\n", text)
    return _HEAD.sub("", text) if ":" in text else text


def _among(codes: np.ndarray, signs: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in signs], np.uint32))


def _hits(line: str, terms: tuple) -> tuple[list[int], list[int]]:
    """(places, terms): where each term stands; of overlapping matches the longest counts."""
    best: list[tuple[int, int, tuple]] = []
    for end, (n, spaced, ids) in _automaton(terms).iter(line) if terms else ():
        end -= spaced
        start = end - n + 1
        while best and best[-1][0] >= start:  # contained in this one
            best.pop()
        if not best or best[-1][1] < start:
            best.append((start, end, ids))
        elif best[-1][1] - best[-1][0] < n - 1:
            best[-1] = (start, end, ids)
    return [s for s, _, ids in best for _ in ids], [i for _, _, ids in best for i in ids]


def scan_texts(texts: list[str], terms: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """All sentences of several texts in a row: (text of each, length in tenths of words, sentence of each hit, term of each hit, wordings without any term by text).

    Ideographs count as half a word. A sentence ends at a full stop, question or exclamation mark before white space (or after an ideograph), at an
    ideographic full stop, or at an empty line.
    """
    codes, text = fold_codes([_prose(t) for t in texts])
    n = len(codes)
    kind = folding().kind[codes]
    han = (kind == 2) & (codes >= 0x3400)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    word = (kind > 0) | (codes == ord("-"))
    # The place after an ender and the quotes and brackets that close with it.
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(_among(codes, "\"')]”’）」"), n, at)[::-1])[::-1] if n else at
    enders = np.flatnonzero(_among(codes, ".!?。！？"))
    follow = np.minimum(np.append(after, n)[np.minimum(enders + 1, n)], n - 1)
    full = _among(codes[enders], "。！？") | space[follow] | ((enders > 0) & han[np.maximum(enders - 1, 0)] & (codes[enders] != ord(".")))
    lines = np.flatnonzero(codes == 10)
    solid = np.concatenate(([0], np.cumsum(~space)))
    empty = lines[1:][solid[lines[1:]] == solid[lines[:-1] + 1]]
    breaks = np.zeros(n, bool)
    breaks[follow[full]] = True
    breaks[empty] = True
    breaks[1:] |= text[1:] != text[:-1]
    sentence = np.cumsum(breaks)
    begins = word.copy()
    begins[1:] &= ~word[:-1] | breaks[1:]
    size = np.bincount(sentence, weights=begins + han / 2, minlength=1)
    real = np.bincount(sentence, weights=kind > 0, minlength=1) > 0
    number = np.cumsum(real) - 1  # of the sentences that have words
    shown = np.where(word, codes, 32).astype("<u4")
    line = " " + shown.tobytes().decode("utf-32-le")
    places, found = _hits(line, terms)
    hit_sentence = sentence[np.array(places, np.int64) - 1] if places else np.zeros(0, np.int64)
    edges = np.searchsorted(sentence, np.arange(len(real) + 1)) if n else np.zeros(1, np.int64)
    bare = np.flatnonzero(real & (np.bincount(hit_sentence, minlength=len(real)) == 0))
    plain: list[list[str]] = [[] for _ in texts]
    for s in bare:
        plain[text[edges[s]]].append(re.sub(r"\d+", "0", " ".join(line[edges[s] + 1 : edges[s + 1] + 1].split())))
    of = text[edges[:-1][real]] if n else np.zeros(0, np.int64)
    return of, np.maximum(1.0, size[real] / 10), number[hit_sentence], np.array(found, np.int32), plain


def sentence_hits(docs: DataFrame, terms: dict = TERMS) -> DataFrame:
    """``doc_id, sizes, hits, plain``: of each sentence its length in tenths of words and the terms in it, and hashes of the sentences without any.

    The only pass over the texts; all that follows reads these numbers, also the choice of one row for each ``doc_id``.
    """
    fixed = tuple(term_list(terms))

    def lists(owner: np.ndarray, number: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(number + 1)), pa.int32()), values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for begin, texts in slabs(batch.column("text").to_pylist()):
                of, sizes, where, term, plain = scan_texts(texts, fixed)
                order = np.argsort(where, kind="stable")
                hits = lists(where[order], len(sizes), pa.array(term[order], pa.int32()))
                bare = pa.array([[xxh3_64_intdigest(w) - (1 << 63) for w in own] for own in plain], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), lists(of, len(texts), pa.array(sizes)), lists(of, len(texts), hits), bare], names=["doc_id", "sizes", "hits", "plain"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(scan, "doc_id bigint, sizes array<double>, hits array<array<int>>, plain array<bigint>").dropDuplicates(["doc_id"])


def term_weights(hits: DataFrame, terms: dict = TERMS) -> dict[int, float]:
    """Term -> curated weight times rarity, the logarithm of sentences per sentence with the term, over all documents.

    Only one count for each curated term reaches the driver.
    """
    each = hits.select(F.explode("hits").alias("h")).select(F.explode(F.concat(F.array(F.lit(-1)), F.array_distinct("h"))).alias("term"))
    got = {r.term: r.n for r in each.groupBy("term").agg(F.count("*").alias("n")).collect()}
    total = got.get(-1, 0)
    return {i: w * math.log(2 + total / (1 + got.get(i, 0))) for i, (_, _, w) in enumerate(term_list(terms))}


def content_sizes(hits: DataFrame, footer_share: float = 0.001) -> DataFrame:
    """``hits`` with ``n``, the number of sentences that are no footers.

    A footer is a sentence without any subject term whose wording, but for numbers, stands in several documents and in at least ``footer_share`` of them.
    """
    bare = hits.select("doc_id", F.explode("plain").alias("h"))
    total = hits.count()
    often = bare.distinct().groupBy("h").agg(F.count("*").alias("d")).where((F.col("d") > 1) & (F.col("d") >= footer_share * total)).select("h")
    footers = bare.join(broadcast_if_small(often, 1_000_000), "h", "left_semi").groupBy("doc_id").agg(F.count("*").alias("footers"))
    return hits.join(footers, "doc_id", "left").select("doc_id", "sizes", "hits", (F.size("sizes") - F.coalesce("footers", F.lit(0))).alias("n"))


def scores(terms: dict, weights: dict[int, float], touched: float = 0.5) -> Column:
    """For each sentence an array of scores in the order of the subjects: the weights of a subject's terms in it over its length.

    A subject with less than ``touched`` times the best score of the sentence is only touched upon and gets 0.
    """
    fixed = term_list(terms)
    table = F.lit([float(weights[i]) for i in range(len(fixed))] or [0.0])

    def total(h: Column, subject: str) -> Column:
        own = [i for i, (_, s, _) in enumerate(fixed) if s == subject]
        if not own:
            return F.lit(0.0)
        return F.aggregate(F.filter(h, lambda t: t.between(own[0], own[-1])), F.lit(0.0), lambda a, t: a + F.get(table, t))

    every = F.zip_with("hits", "sizes", lambda h, z: F.transform(F.array(*[total(h, k) for k in terms]), lambda x: x / z))
    return F.transform(every, lambda s: F.transform(s, lambda x: F.when(x >= touched * F.array_max(s), x).otherwise(0.0)))


def calibrated(content: DataFrame, labels: DataFrame, names: list[str], share: float = 0.25, max_labelled: int = 5000) -> list[float]:
    """For each of the subjects ``names`` the score from which a sentence deals with it, fitted on rated documents (``content``: ``doc_id, n, scores``).

    At most ``max_labelled`` rated documents (the bound of this fit; by hash, so at random) are used. Every subject a rater named
    counts as given. The lowest threshold with the best agreement (F1 of the subject over these documents) is taken; a subject that
    no rater named gets that of all subjects together, and without ratings any term decides.
    """
    rated = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").distinct().groupBy("doc_id").agg(F.collect_set("subject").alias("named"))
    some = rated.orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    rows = content.where("n > 0").join(F.broadcast(some), "doc_id").select("n", "named", "scores").collect()
    # A document gets a subject just where its (share * n)-th best sentence reaches the threshold.
    reach, named = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)), bool)
    for i, r in enumerate(rows):
        k = max(1, math.ceil(share * r.n - 1e-9))
        if len(r.scores) >= k:
            reach[i] = -np.sort(-np.array(r.scores), axis=0)[k - 1]
        named[i] = [x in r.named for x in names]
    grid = np.concatenate(([ANY], np.arange(0.25, 30, 0.25)))

    def best(x: np.ndarray, y: np.ndarray) -> float:
        got = x[None, :] >= grid[:, None]
        f1 = 2 * (got & y).sum(axis=1) / np.maximum(1, got.sum(axis=1) + y.sum())
        return float(grid[np.flatnonzero(f1 >= f1.max() - 1e-9)[0]])

    if not named.any():
        return [ANY] * len(names)
    return [best(reach[:, i], named[:, i]) if named[:, i].any() else best(reach.ravel(), named.ravel()) for i in range(len(names))]


def subjects_of(docs: DataFrame, labels: DataFrame, terms: dict = TERMS, share: float = 0.25) -> DataFrame:
    """``doc_id, subject, share_pm``: each subject that at least ``share`` of a document's sentences deal with.

    A sentence deals with every subject whose score, the weights of its terms by rarity in the whole corpus over the
    sentence's length, reaches the subject's threshold. Footers, code and markup are no part of the whole; all other sentences are, with or without terms.
    Documents without content get no row; null keys and null texts take no part; a repeated ``doc_id`` counts once.
    """
    hits, names = cut(sentence_hits(docs, terms)), list(terms)
    content = cut(content_sizes(hits).select("doc_id", "n", scores(terms, term_weights(hits, terms)).alias("scores")))
    least = calibrated(content, labels, names, share)
    dealt = lambda i: F.size(F.filter("scores", lambda s: F.get(s, F.lit(i)) >= least[i]))
    by = F.array(*[F.struct(F.lit(k).alias("subject"), dealt(i).alias("dealt")) for i, k in enumerate(names)]) if names else F.array().cast("array<struct<subject: string, dealt: int>>")
    each = content.where("n > 0").select("doc_id", "n", F.explode(by).alias("x")).where((F.col("x.dealt") > 0) & (F.col("x.dealt") >= share * F.col("n")))
    return each.select("doc_id", "x.subject", F.floor(F.least(F.lit(1000), 1000 * F.col("x.dealt") / F.col("n"))).cast("int").alias("share_pm"))


def composition(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """``source, subject, documents``: the corpus by source and subject."""
    known = docs.select("doc_id", "source").where("doc_id is not null").dropDuplicates(["doc_id"])
    return assigned.join(known, "doc_id").groupBy("source", "subject").agg(F.count("*").alias("documents"))
