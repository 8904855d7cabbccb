"""Held-out passages inside documents, by the q-gram lemma on diagonal bands and banded alignment (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chars import Letters, is_ideograph, letters, mixed, slabs

#: Gram widths, wide to narrow: characters, or ideographs where a gram begins with one. An item takes the first with which the lemma asks for ``LEAST`` grams.
WIDTHS = ((12, 4), (8, 3), (5, 2), (3, 2), (2, 1), (1, 1))
LEAST = 8
_BITS = 22


def gram_hashes(t: Letters, q: int, q_han: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, widths, hashes) of the grams of each text: ``q`` characters without an ideograph, or ``q_han`` that begin with one."""
    base = np.uint64(0x9E3779B97F4A7C15)
    h, power = {1: mixed(t.codes.astype(np.uint64) + np.uint64(77))}, {1: base}
    han = is_ideograph(t.codes)
    so_far = np.concatenate(([0], np.cumsum(han)))
    out = []
    with np.errstate(over="ignore"):
        for width, wants in ((q, False), (q_han, True)):
            ends = max(0, len(han) - width + 1)
            own = np.flatnonzero(han[:ends] if wants else so_far[width : ends + width] == so_far[:ends])
            own = own[t.text[own] == t.text[own + width - 1]]
            if not len(own):
                continue
            done, g = 0, np.full(len(own), width, np.uint64)
            while done < width:  # a polynomial over a few runs, whose lengths are powers of two
                n = 1 << ((width - done).bit_length() - 1)
                k = 1
                while k < n:
                    if 2 * k not in h:
                        h[2 * k], power[2 * k] = h[k][:-k] * power[k] + h[k][k:], power[k] * power[k]
                    k *= 2
                g = g * power[n] + h[n][own + done]
                done += n
            out.append((own, np.full(len(own), width), g))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


class Item(NamedTuple):
    """A folded item: its words as hashes, its grams with the words they begin in, and what the lemma asks for."""

    words: np.ndarray
    grams: np.ndarray
    gram_word: np.ndarray
    shortest: int
    edits: int
    least: int


def item_of(text: str, share: float, edits: float, q: int, q_han: int) -> Item | None:
    """The item, or None without a word.

    ``shortest`` words are ``share`` of it. Of a stretch of M >= ``shortest`` words with floor(``edits`` M) of them changed, dropped or
    followed by an inserted one, all grams stay that touch none of these words; ``least`` is the smallest number over all stretches, with
    the words that spoil most taken as the changed ones.
    """
    t = letters([text])
    m = len(t.hashes)
    if not m:
        return None
    p, width, h = gram_hashes(t, q, q_han)
    first, last = t.word[p], t.word[p + width - 1]
    spoilt = np.zeros(m + 1, np.int64)
    np.add.at(spoilt, first, 1)
    np.add.at(spoilt, last + 1, -1)
    worst = np.concatenate(([0], np.cumsum(np.sort(np.cumsum(spoilt)[:m])[::-1])))
    begun = np.concatenate(([0], np.cumsum(np.bincount(first, minlength=m))))
    cut_at = np.bincount(last, minlength=m)  # grams that end in each word
    ended = np.concatenate(([0], np.cumsum(cut_at)))
    shortest, least = max(1, int(np.ceil(share * m - 1e-9))), None
    for n in range(shortest, m + 1):
        # Inside words a to a + n: all that end there less those that began before.
        a = np.arange(m - n + 1)
        inside = ended[a + n] - begun[a]
        fewest = int(inside.min()) - int(worst[min(m, int(edits * n + 1e-9))])
        least = fewest if least is None else min(least, fewest)
    return Item(t.hashes, h, first, shortest, int(edits * m + 1e-9), int(least or 0))


class Index(NamedTuple):
    """Grams of items in hash order with their places; a table of bits that most other hashes miss."""

    q: int
    q_han: int
    hashes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    word: np.ndarray
    bits: np.ndarray
    ids: list
    items: list[Item]


def item_index(items: list[tuple[int, str]], share: float, edits: float) -> list[Index]:
    """Indexes by gram widths: each item is in that of the widest grams of which the lemma asks for enough.

    With single characters any stretch keeps at least one gram, as fewer words change than it has, so every item has an index.
    """
    out = []
    left = items
    for q, q_han in WIDTHS:
        last = (q, q_han) == WIDTHS[-1]
        made = [(i, item_of(text, share, edits, q, q_han)) for i, text in left]
        own = [(i, x._replace(least=max(x.least, 1)) if last else x) for i, x in made if x is not None and (last or x.least >= LEAST)]
        here = {i for i, _ in own}
        left = [(i, text) for i, text in left if i not in here]
        if not own:
            continue
        h = np.concatenate([x.grams for _, x in own])
        item = np.repeat(np.arange(len(own)), [len(x.grams) for _, x in own])
        word = np.concatenate([x.gram_word for _, x in own])
        order = np.argsort(h, kind="stable")
        uniq, first = np.unique(h[order], return_index=True)
        bits = np.zeros(1 << _BITS, bool)
        bits[uniq & np.uint64((1 << _BITS) - 1)] = True
        out.append(Index(q, q_han, uniq, np.append(first, len(h)), item[order], word[order], bits, [i for i, _ in own], [x for _, x in own]))
    return out


def regions(t: Letters, texts: int, ix: Index) -> list[tuple[int, int, int, int]]:
    """(text, item, lowest, highest diagonal) of each band of a text and an item that holds as many shared grams as the lemma asks for.

    A diagonal is the number of a word of the text less that of the item's; an edit moves it by one. Bands are twice as wide as the edits allowed
    to the item and begin at every multiple of these, so any stretch lies within one of them.
    """
    p, _, h = gram_hashes(t, ix.q, ix.q_han)
    near = ix.bits[h & np.uint64((1 << _BITS) - 1)]
    p, h = p[near], h[near]
    at = np.minimum(np.searchsorted(ix.hashes, h), len(ix.hashes) - 1)
    same = ix.hashes[at] == h
    at, p = at[same], p[same]
    n = ix.starts[at + 1] - ix.starts[at]
    entry = np.repeat(ix.starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    where = np.repeat(p, n)
    item, text = ix.item[entry], t.text[where].astype(np.int64)
    least = np.array([x.least for x in ix.items])
    pair = text * len(ix.items) + item
    enough = np.bincount(pair, minlength=1)[pair] >= least[item]  # bands of a pair have no more grams than it has
    pair, item, where, entry = pair[enough], item[enough], where[enough], entry[enough]
    if not len(pair):
        return []
    base = np.searchsorted(t.word_text, np.arange(texts))
    diagonal = t.word[where] - base[t.text[where]] - ix.word[entry]
    step = np.maximum(1, np.array([x.edits for x in ix.items]))[item]
    out: dict[tuple[int, int, int, int], None] = {}
    for shift in (0, 1):
        key = pair * (1 << 32) + (diagonal // step + shift + (1 << 30)) // 2
        order = np.argsort(key, kind="stable")
        uniq, first, count = np.unique(key[order], return_index=True, return_counts=True)
        pairs = uniq >> 32
        good = np.flatnonzero(count >= least[pairs % len(ix.items)])
        if len(good):
            lo, hi = np.minimum.reduceat(diagonal[order], first), np.maximum.reduceat(diagonal[order], first)
            out |= dict.fromkeys((int(pairs[i]) // len(ix.items), int(pairs[i]) % len(ix.items), int(lo[i]), int(hi[i])) for i in good)
    return list(out)


def holds(item: np.ndarray, doc: np.ndarray, lo: int, hi: int, shortest: int, edits: float) -> bool:
    """Whether a stretch of M >= ``shortest`` words of the item becomes a stretch of ``doc`` by at most ``edits`` * M edits on the diagonals ``lo`` to ``hi``.

    All beginnings of a stretch are aligned at once: a row for each, a column for each diagonal, and a step for each word of the item.
    """
    m, n = len(item), len(doc)
    lo, hi = max(lo, -m), min(hi, n)
    if lo > hi:
        return False
    far = np.int32(1 << 20)
    diagonals = np.arange(lo, hi + 1)
    starts = m - shortest + 1
    cost = np.full((starts, len(diagonals) + 1), far, np.int32)  # the last column is never reached
    ramp = np.arange(len(diagonals), dtype=np.int32)
    j = np.arange(m)[:, None] + diagonals  # the word of doc that a match of each item word takes on each diagonal
    inner = (j >= 0) & (j < n)
    equal = inner & ((doc[np.clip(j, 0, max(n - 1, 0))] if n else np.zeros(j.shape, np.uint64)) == item[:, None])
    # Each word that isn't an edit has its equal on some diagonal: without a stretch of enough such words there is nothing to align.
    sums = np.concatenate(([0.0], np.cumsum(equal.any(axis=1) - (1 - edits))))
    if not (sums[shortest:] - np.minimum.accumulate(sums[: m + 1 - shortest]) >= -1e-6).any():
        return False
    miss = np.where(inner, ~equal, far).astype(np.int32)
    ends = np.where((j + 1 >= 0) & (j + 1 <= n), 0, far).astype(np.int32)
    for i in range(m):
        k = min(i, starts - 1) + 1
        if i < starts:
            cost[i, :-1] = np.where((j[i] >= 0) & (j[i] <= n), 0, far)
        row = np.minimum(cost[:k, :-1] + miss[i], cost[:k, 1:] + 1) + ends[i]
        cost[:k, :-1] = np.minimum.accumulate(row - ramp, axis=1) + ramp
        full = i + 2 - shortest  # beginnings with enough words by now
        if full > 0:
            s = min(full, k)
            if (np.minimum(cost[:s, :-1].min(axis=1), far) <= edits * (i + 1 - np.arange(s)) + 1e-9).any():
                return True
    return False


def leaked(docs: DataFrame, items: DataFrame, share: float = 0.5, edits: float = 0.15, max_items: int = 20_000) -> DataFrame:
    """``doc_id, item_id``: documents with a stretch of words that is one of at least ``share`` of an item's, but for ``edits`` of its words.

    Changed, missing and inserted words are edits. Case, punctuation, white space and hidden differences of characters don't count.
    Every such pair is found: grams are only the filter, by the bound of ``item_of``, and the alignment keeps the same limit of edits. The items, a table of fixed
    size, are indexed and sent to the workers in blocks of at most ``max_items``, so a larger table takes several passes over the documents
    instead of a larger broadcast. Documents are read whole, never gathered or compared with each other. Null keys and
    texts and items without a letter or digit are never found; a repeated row counts once.
    """
    spark = docs.sparkSession
    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").dropDuplicates(["item_id"])
    number = known.count()
    out = None
    for block in range(max(1, -(-number // max_items))):
        own = known if number <= max_items else known.where(F.pmod(F.xxhash64("item_id"), F.lit(-(-number // max_items))) == block)
        index = spark.sparkContext.broadcast(item_index([(r.item_id, r.text) for r in own.collect()], share, edits))
        part = _scan(docs, index, edits)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _scan(docs: DataFrame, index, edits: float) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, rows = pdf["doc_id"].to_numpy(), []
            for begin, texts in slabs(pdf["text"].tolist()):
                t = letters(texts)
                edge = np.searchsorted(t.word_text, np.arange(len(texts) + 1))
                for ix in index.value:
                    held = set()
                    for text, k, lo, hi in regions(t, len(texts), ix):
                        x = ix.items[k]
                        # Words of the document that a path on these diagonals can meet.
                        a, b = edge[text] + max(0, lo - x.edits), min(edge[text + 1], edge[text] + len(x.words) + hi + x.edits)
                        off = a - edge[text]
                        if (text, k) not in held and holds(x.words, t.hashes[a:b], lo - x.edits - off, hi + x.edits - off, x.shortest, edits):
                            held.add((text, k))
                            rows.append((ids[begin + text], ix.ids[k]))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

    texts = docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInPandas(scan, "doc_id bigint, item_id bigint").select("doc_id", F.col("item_id").cast("int").alias("item_id"))


def leak_counts(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, dataset, split, documents``: each leaked item and the number of documents that hold it."""
    n = pairs.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
    return n.join(items.select("item_id", "dataset", "split").dropDuplicates(["item_id"]), "item_id").select("item_id", "dataset", "split", "documents")
