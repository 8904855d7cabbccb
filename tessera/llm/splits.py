"""Records of evaluation splits that stand in the training split too, exactly or almost (problem 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chars import is_ideograph, letters, mixed, slabs
from tessera.runtime import cut

#: Datasets whose texts are compared by characters.
BY_CHARACTERS = ("cmeee",)
#: Gram counters: as many as there are units, within these bounds. They only order the grams, so results don't depend on their number.
FEWEST, MOST = 1 << 16, 1 << 22
_PARTS = 64


def comparable(docs: DataFrame) -> DataFrame:
    """``did, side, cls, chars, n, units``: folded texts of the train (``t``) and evaluation (``e``) splits as hashes of their units, and the class of equal ones.

    Units are characters for the datasets of ``BY_CHARACTERS``, else words (ideographs being words); punctuation and white space are gone. So that texts
    of both kinds of datasets meet, a text with ideographs of another dataset has a second row by characters, and a text by characters
    of which at most 30 % are ideographs, a second row by words: one with more differs from any without by over 15 %. Rows without key, text or split,
    and texts without any letter or digit, take no part.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            ids, sides, kinds = pdf["did"].tolist(), pdf["side"].tolist(), pdf["by"].tolist()
            for begin, texts in slabs(pdf["text"].tolist()):
                t = letters(texts, together=True)
                char_hashes, han = mixed(t.codes.astype(np.uint64)), is_ideograph(t.codes)
                a, b = np.searchsorted(t.text, np.arange(len(texts) + 1)), np.searchsorted(t.word_text, np.arange(len(texts) + 1))
                hans = np.concatenate(([0], np.cumsum(han)))
                for i in range(len(texts)):
                    n, k, by = a[i + 1] - a[i], hans[a[i + 1]] - hans[a[i]], kinds[begin + i]
                    for chars, wanted in ((True, by or k > 0), (False, not by or k <= 0.3 * n)):
                        if wanted and n:
                            units = (char_hashes[a[i] : a[i + 1]] if chars else t.hashes[b[i] : b[i + 1]]).tobytes()
                            out.append((ids[begin + i], sides[begin + i], hashlib.blake2b(units, digest_size=16, salt=b"c" if chars else b"w").digest(), chars, len(units) // 8, units))
            yield pd.DataFrame(out, columns=["did", "side", "cls", "chars", "n", "units"])

    side = F.lower(F.trim("split"))
    named = docs.select("did", F.when(side == "train", "t").when(side.isin("dev", "test"), "e").alias("side"), F.coalesce(F.col("dataset").isin(*BY_CHARACTERS), F.lit(False)).alias("by"), "text")
    return named.where("did is not null and text is not null and side is not null").mapInPandas(fold, "did string, side string, cls binary, chars boolean, n int, units binary")


def allowed(length: int, percent: int) -> int:
    return length * percent // 100


@cache
def gram_sizes(length: int, percent: int, longest: int) -> dict[int, int]:
    """Gram size -> edits to survive, for a text of ``length`` units and all longer partners it can have.

    For a pair whose longer text has M units and t allowed edits, grams of q units with q(t + 1) <= M - t
    leave one gram untouched; the size depends on M alone, so both sides choose the same one.
    """
    out: dict[int, int] = {}
    m = length
    while m - allowed(m, percent) <= length:
        t = allowed(m, percent)
        q = max(1, min(longest, (m - t) // (t + 1)))
        out[q] = max(out.get(q, 0), t)
        m += 1
    return out


def grams(hashes: np.ndarray, q: int) -> np.ndarray:
    """A polynomial of each run of ``q`` hashes."""
    n = max(len(hashes) - q + 1, 0)
    h = np.full(n, q, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return h


def distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, a row of bits at a time."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if not m:
        return len(a)
    peq: dict = {}
    for i, x in enumerate(b):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    for x in a:
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return score


class _Slab:
    """Texts of a batch one after the other, by unit hashes."""

    def __init__(self, pdf: pd.DataFrame):
        self.n = pdf["n"].to_numpy().astype(np.int64)
        self.units = np.frombuffer(b"".join(pdf["units"]), np.uint64)
        self.begin = np.cumsum(self.n) - self.n
        self.chars = pdf["chars"].to_numpy().astype(bool)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sets of the units of each text, by the first seven bits of their hashes."""
        bit = self.units >> np.uint64(57)
        one = np.uint64(1) << (bit & np.uint64(63))
        low = bit < 64
        return tuple(np.bitwise_or.reduceat(np.where(side, one, np.uint64(0)), self.begin).astype(np.int64) for side in (low, ~low))  # type: ignore[return-value]

    def sized(self, percent: int, longest: int) -> dict[int, list[tuple[int, int]]]:
        """Gram size -> (text, edits) of the texts that use it."""
        out: dict = {}
        for i, n in enumerate(self.n.tolist()):
            for q, t in gram_sizes(n, percent, longest).items():
                out.setdefault(q, []).append((i, t))
        return out


def _slabs(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Batches cut to about ``most`` units."""
    for pdf in batches:
        part = (np.cumsum(pdf["n"].to_numpy()) - 1) // most
        for _, own in pdf.groupby(part, sort=False):
            yield own.reset_index(drop=True)


def _of_texts(begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``begin``, position) of ``sizes`` places from each beginning on."""
    owner = np.repeat(np.arange(len(begin)), sizes)
    return owner, begin[owner] + np.arange(int(sizes.sum())) - (np.cumsum(sizes) - sizes)[owner]


def _grams(x: _Slab, q: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``own``, place in the text, hash) of all grams of ``q`` units of the texts ``own``."""
    g = grams(x.units, q)
    owner, at = _of_texts(x.begin[own], np.maximum(x.n[own] - q + 1, 0))
    with np.errstate(over="ignore"):
        h = mixed(g[at] + x.chars[own][owner].astype(np.uint64))
    return owner, at - x.begin[own][owner], h


def _order(texts: DataFrame, percent: int, longest: int, hot: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """(weight of each counter, parts of the hot ones): the logarithm of evaluation times training texts with the gram, 0 if either has none."""
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = FEWEST
    while buckets < min(4 * total, MOST):
        buckets *= 2
    part = buckets // _PARTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, buckets), np.uint32)
        for pdf in _slabs(batches):
            x, sides = _Slab(pdf), (pdf["in_e"].to_numpy().astype(bool), pdf["in_t"].to_numpy().astype(bool))
            for q, users in x.sized(percent, longest).items():
                own = np.array([i for i, _ in users])
                owner, _, h = _grams(x, q, own)
                b = (h & np.uint64(buckets - 1)).astype(np.int64)
                pairs = np.unique(owner * buckets + b)  # a text counts once
                owner, b = pairs // buckets, pairs % buckets
                for k in (0, 1):
                    sums[k] += np.bincount(b[sides[k][own][owner]], minlength=buckets).astype(np.uint32)
        for p in range(_PARTS):
            both = sums[:, p * part : (p + 1) * part]
            if both.any():
                yield pd.DataFrame({"part": [p], "sums": [both.tobytes()]})

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros((2, part), np.int64)
        for s in pdf["sums"]:
            both += np.frombuffer(s, np.uint32).reshape(2, part)
        weight = np.zeros(part, np.uint8)
        shared = (both > 0).all(axis=0)
        weight[shared] = np.minimum(255, 1 + 4 * np.log2(both[:, shared].astype(float)).sum(axis=0))
        many = np.flatnonzero(shared & (both > hot).any(axis=0))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "weight": [weight.tobytes()], "hot": [[[int(b), *(int(-(-both[k, b] // hot)) for k in (0, 1))] for b in many]]})

    weight, salts = np.zeros(buckets, np.uint8), {}
    counted = texts.select("n", "units", "chars", "in_e", "in_t").mapInPandas(count, "part int, sums binary")
    for r in counted.groupBy("part").applyInPandas(weigh, "part int, weight binary, hot array<array<int>>").collect():
        weight[r.part * part : (r.part + 1) * part] = np.frombuffer(r.weight, np.uint8)
        salts |= {r.part * part + b: (e, t) for b, e, t in r.hot}
    return weight, salts


def _spoils(bare: np.ndarray, begin: np.ndarray, end: np.ndarray, q: int, edits: np.ndarray) -> np.ndarray:
    """For each text (grams ``begin`` to ``end``), whether its ``bare`` grams need more than ``edits`` changed units to be spoiled."""
    n = len(bare)
    following = np.full(n + 1, n, np.int64)  # the next bare gram from each place on
    following[:n] = np.where(bare, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    now, used = begin.copy(), np.zeros(len(begin), np.int64)
    for _ in range(int(edits.max(initial=-1)) + 1):
        hit = following[np.minimum(now, n)]
        inside = hit < end
        used += inside
        now = np.where(inside, np.minimum(hit + q, end), end)
    return used > edits


def _rarest(x: _Slab, q: int, own: np.ndarray, edits: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the shared grams in the shortest run of the rarest grams of each text that ``edits`` changes can't spoil altogether.

    The length of the run is found for all texts at once by halving. Texts in which grams of one side are enough give none.
    """
    mask = np.uint64(len(weight) - 1)
    owner, place, h = _grams(x, q, own)
    edges = np.searchsorted(owner, np.arange(len(own) + 1))
    keep = (edges[1:] > edges[:-1]) & ~_spoils(weight[h & mask] == 0, edges[:-1], edges[1:], q, edits)
    of_kept = keep[owner]
    own, edits, place, h = own[keep], edits[keep], place[of_kept], h[of_kept]
    owner = (np.cumsum(keep) - 1)[owner[of_kept]]
    begin, end = np.searchsorted(owner, np.arange(len(own))), np.searchsorted(owner, np.arange(len(own)), "right")
    of = weight[h & mask]
    rank = np.zeros(len(h), np.int64)
    rank[np.lexsort((h, of, owner))] = np.arange(len(h)) - begin[owner]
    lo, hi = np.minimum(edits + 1, end - begin), np.minimum(q * edits + 1, end - begin)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        enough = _spoils(rank < mid[owner], begin, end, q, edits)
        lo, hi = np.where(~enough & (lo < hi), mid + 1, lo), np.where(enough & (lo < hi), mid, hi)
    take = (rank < lo[owner]) & (of > 0)
    return own[owner[take]], place[take], h[take]


def near_pairs(texts: DataFrame, percent: int = 15, longest: int = 6, hot: int = 50_000) -> DataFrame:
    """``e, t``: classes (evaluation, training) of different texts within ``percent`` of the longer one's units in edits.

    ``texts`` has one row per class: ``cls, chars, n, units, in_e, in_t``. Exact: evaluation and training texts are
    joined on the rarest grams of each that the allowed edits cannot all spoil, filtered by length, position and a
    128-bit signature of their units, and verified by edit distance. Rarity is the product of both sides' counts, kept in
    counters of bounded number; grams of one side only come first and join nothing, so a text in which the edits cannot spoil these is done. A
    gram in over ``hot`` texts of a side is split: the rows of that side over parts, those of the other copied to each.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(_order(texts, percent, longest, hot))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, salts = shared.value
        mask = np.uint64(len(weight) - 1)
        for pdf in _slabs(batches):
            x, classes = _Slab(pdf), pdf["cls"].to_numpy()
            in_e, in_t = pdf["in_e"].to_numpy().astype(bool), pdf["in_t"].to_numpy().astype(bool)
            part, (s1, s2) = np.array([c[0] | c[1] << 8 for c in classes], np.int64), x.signatures()
            for q, users in x.sized(percent, longest).items():
                text, place, h = _rarest(x, q, *map(np.array, zip(*users, strict=True)), weight)
                n_e, n_t = np.ones((2, len(h)), np.int64)
                if salts:
                    n_e, n_t = np.array([salts.get(b, (1, 1)) for b in (h & mask).tolist()], np.int64).reshape(-1, 2).T
                for ev, within, mine, other in ((True, in_e, n_e, n_t), (False, in_t, n_t, n_e)):
                    at = np.flatnonzero(within[text])
                    at, copy = np.repeat(at, other[at]), _of_texts(np.zeros(len(at), np.int64), other[at])[1]
                    i, own = text[at], part[text[at]] % mine[at]
                    yield pd.DataFrame({"ev": ev, "key": h[at].astype(np.int64), "part_e": own if ev else copy, "part_t": copy if ev else own, "cls": classes[i], "n": x.n[i], "pos": place[at], "s1": s1[i], "s2": s2[i]})

    posted = cut(texts.mapInPandas(prefixes, "ev boolean, key bigint, part_e int, part_t int, cls binary, n int, pos int, s1 bigint, s2 bigint"))
    side = lambda ev: posted.where(F.col("ev") == ev).select("key", "part_e", "part_t", *[F.col(c).alias(f"{c}_{'e' if ev else 't'}") for c in ("cls", "n", "pos", "s1", "s2")])
    limit = F.expr(f"greatest(n_e, n_t) * {percent} div 100")
    close = (F.abs(F.col("n_e") - F.col("n_t")) <= limit) & (F.abs(F.col("pos_e") - F.col("pos_t")) <= limit) & (F.expr("bit_count(s1_e ^ s1_t) + bit_count(s2_e ^ s2_t)") <= 2 * limit)
    found = side(True).join(side(False), ["key", "part_e", "part_t"]).where(close & (F.col("cls_e") != F.col("cls_t"))).select("cls_e", "cls_t").distinct()

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            u, v = np.frombuffer(x, np.uint64).tolist(), np.frombuffer(y, np.uint64).tolist()
            out.append(distance(u, v) <= allowed(max(len(u), len(v)), percent))
        return pd.Series(out, dtype=bool)

    a, b = texts.select(F.col("cls").alias("cls_e"), F.col("units").alias("u_e"), "chars"), texts.select(F.col("cls").alias("cls_t"), F.col("units").alias("u_t"), F.col("chars").alias("chars_t"))
    return found.join(a, "cls_e").join(b, "cls_t").where("chars = chars_t").where(verified("u_e", "u_t")).select(F.col("cls_e").alias("e"), F.col("cls_t").alias("t"))


def overlaps(docs: DataFrame, percent: int = 15) -> tuple[DataFrame, DataFrame]:
    """(``did, side, cls``, pairs of classes ``e, t``): every overlap between an evaluation and a training text, equal texts being one class.

    A repeated ``did`` counts once.
    """
    folded = cut(comparable(docs))
    rows = folded.select("did", "side", "chars", "cls").dropDuplicates(["did", "chars"])
    flags = rows.groupBy("cls").agg(F.max(F.col("side") == "e").alias("in_e"), F.max(F.col("side") == "t").alias("in_t"))
    texts = cut(folded.groupBy("cls").agg(F.first("chars").alias("chars"), F.first("n").alias("n"), F.first("units").alias("units")).join(flags, "cls"))
    same = texts.where("in_e and in_t").select(F.col("cls").alias("e"), F.col("cls").alias("t"))
    return rows.select("did", "side", "cls"), same.unionByName(near_pairs(texts, percent))


def found(docs: DataFrame) -> DataFrame:
    """``did_a, did_b`` as TESTDATA.md defines them for problem 3: all pairs of documents behind the pairs of classes."""
    rows, pairs = overlaps(docs)
    e, t = rows.where("side = 'e'").select(F.col("cls").alias("e"), F.col("did").alias("x")), rows.where("side = 't'").select(F.col("cls").alias("t"), F.col("did").alias("y"))
    return pairs.join(e, "e").join(t, "t").select(F.least("x", "y").alias("did_a"), F.greatest("x", "y").alias("did_b")).distinct()


def overlap_report(docs: DataFrame) -> DataFrame:
    """``dataset, split, records, overlapping``: evaluation records and how many of them have a partner in the training split."""
    rows, pairs = overlaps(docs)
    hit = rows.where("side = 'e'").join(pairs.select(F.col("e").alias("cls")).distinct(), "cls", "left_semi").select("did", F.lit(1).alias("hit"))
    one = docs.where("did is not null and split in ('dev', 'test')").select("did", "dataset", "split").dropDuplicates(["did"])
    return one.join(hit, "did", "left").groupBy("dataset", "split").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
