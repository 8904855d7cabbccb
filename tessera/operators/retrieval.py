"""Demonstration retrieval: token overlap weighted by statistics, sentence vectors, and their sum."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.embed import DIM, hash_vector
from tessera.runtime import broadcast_if_small, cut

UNSEEN = 1_000_000  # the weight 1 of tokens without statistics, in parts of a million


def vocabulary(records: DataFrame) -> DataFrame:
    """``dataset, token`` once each."""
    return records.select("dataset", F.explode(F.array_distinct("units")).alias("token")).distinct()


def inverted_index(pool: DataFrame) -> DataFrame:
    """``dataset, token, pool_did, pool_ord``: each distinct token of each pool record."""
    return pool.select("dataset", F.col("did").alias("pool_did"), F.col("ord").alias("pool_ord"), F.explode(F.array_distinct("units")).alias("token"))


def token_scores(queries: DataFrame, pool: DataFrame, weights: DataFrame, max_query_tokens: int = 2_000_000) -> DataFrame:
    """``did, pool_did, pool_ord, s_token``: the summed weight (millionths) of the distinct tokens a query and a pool record share.

    Weights join the query side before the index does, and the query tokens are broadcast only up to
    a counted limit. A record is no candidate of its own. Pairs sharing no token are absent: their score is 0.
    """
    q = queries.select("dataset", "did", F.explode(F.array_distinct("units")).alias("token")).join(weights, ["dataset", "token"], "left").select("dataset", "did", "token", F.coalesce("w", F.lit(UNSEEN)).alias("w"))
    hits = inverted_index(pool).join(broadcast_if_small(q, max_query_tokens), ["dataset", "token"]).where("did <> pool_did")
    return hits.groupBy("did", "pool_did").agg(F.first("pool_ord").alias("pool_ord"), F.sum("w").alias("s_token"))


def ranked(scores: DataFrame, score: str, n: int) -> DataFrame:
    """The ``n`` best pool records of each query (at least one), ties by later order; ``rank`` 1 is the least similar of them.

    A window's group limit cuts each query to ``n`` rows in every task before they meet.
    """
    n = max(n, 1)
    best = scores.withColumn("_r", F.row_number().over(W.partitionBy("did").orderBy(F.desc(score), F.desc("pool_ord"), F.desc("pool_did")))).where(F.col("_r") <= n)
    return best.withColumn("rank", F.count("*").over(W.partitionBy("did")) - F.col("_r") + 1).drop("_r")


def with_zero_scores(scores: DataFrame, queries: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """Scores plus, for queries with fewer than ``n`` of them, the last pool records with score 0: all records are candidates.

    No more than the last ``2n + 1`` records of a dataset can be needed, so no query meets the whole pool.
    """
    few = queries.select("dataset", "did").join(scores.groupBy("did").agg(F.count("*").alias("hits")), "did", "left").where(F.coalesce("hits", F.lit(0)) < n)
    last = pool.select("dataset", F.col("did").alias("pool_did"), F.col("ord").alias("pool_ord")).withColumn("_r", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("pool_ord"), F.desc("pool_did")))).where(F.col("_r") <= 2 * n + 1)
    fill = few.join(last, "dataset").where("did <> pool_did").select("did", "pool_did", "pool_ord", F.lit(0).cast("bigint").alias("s_token")).join(scores, ["did", "pool_did"], "left_anti")
    return scores.unionByName(fill)


def _postings(rows: list) -> tuple:
    """(ids, number of each token, token, query and weight of each entry by query); numbers begin with the most frequent token."""
    at: dict = {}
    token = np.array([at.setdefault(t, len(at)) for r in rows for t in r.tokens], np.int64)
    rank = np.empty(len(at), np.int64)
    rank[np.argsort(-np.bincount(token, minlength=len(at)), kind="stable")] = np.arange(len(at))
    query = np.repeat(np.arange(len(rows)), [len(r.tokens) for r in rows])
    return np.array([r.did for r in rows], object), {t: int(rank[i]) for t, i in at.items()}, rank[token], query, np.array([w for r in rows for w in r.ws], float)


def token_nearest(queries: DataFrame, pool: DataFrame, weights: DataFrame, n: int, block: int = 16_384, step: int = 256, dense: int = 256, most: int = 4_000_000) -> DataFrame:
    """``did, pool_did, pool_ord, s_token, rank``: the picks of ``ranked`` and ``with_zero_scores`` on ``token_scores``, for any number of queries.

    Queries go to the tasks in blocks of about ``block``, or of 64 tokens for each of these, each a pass over the pool, and a task passes on each
    of its batches' best ``n`` a query, so the pairs that share a token are never shuffled. Weights of the ``dense`` most frequent tokens are summed by a
    product of matrices, the others entry by entry, about ``most`` at once; sums of whole millionths are exact in either.
    """
    n, spark = max(n, 1), queries.sparkSession
    known = queries.where("dataset is not null").select("dataset", "did", F.explode_outer(F.array_distinct("units")).alias("token")).join(weights, ["dataset", "token"], "left")
    sides = cut(known.groupBy("dataset", "did").agg(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", F.coalesce("w", F.lit(UNSEEN)).alias("w")))).alias("x")).select("dataset", "did", F.col("x.token").alias("tokens"), F.col("x.w").alias("ws")))
    held = sides.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    blocks = max(1, -(-held.rows // block), -(-held.tokens // (64 * block)))
    rows = pool.where("dataset is not null").select("dataset", "did", F.coalesce("ord", F.lit(-(2**63))).alias("ord"), "units")  # a null is the first
    best = None
    for b in range(blocks):
        by_set: dict = {}
        for r in sides.where(F.pmod(F.xxhash64("did"), F.lit(blocks)) == b).collect():
            by_set.setdefault(r.dataset, []).append(r)
        shared = spark.sparkContext.broadcast({d: _postings(x) for d, x in by_set.items()})
        part = rows.mapInPandas(_token_scan(shared, n, step, dense, most), "did string, pool_did string, pool_ord bigint, s_token bigint")
        best = part if best is None else best.unionByName(part)
    return ranked(best, "s_token", n)


def _token_scan(shared, n: int, step: int, dense: int, most: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("dataset"):
                if name not in shared.value:
                    continue
                ids, number, token, query, weight = shared.value[name]
                part = part.sort_values(["ord", "did"])  # of equal scores the later place wins
                dids, ords, m = part["did"].to_numpy(), part["ord"].to_numpy(), len(part)
                found = [[number[t] for t in set(u) if t in number] if u is not None else [] for u in part["units"]]
                has, place = np.array([t for x in found for t in x], np.int64), np.repeat(np.arange(m), [len(x) for x in found])
                own = {d: i for i, d in enumerate(dids)}
                few = has >= dense
                p = np.zeros((dense, m))
                p[has[~few], place[~few]] = 1
                has, place = has[few], place[few]
                for a in range(0, len(ids), step):
                    e = slice(*np.searchsorted(query, (a, a + step)))
                    t, i, w = token[e], query[e] - a, weight[e]
                    size = min(step, len(ids) - a)
                    q = np.zeros((size, dense))
                    q[i[t < dense], t[t < dense]] = w[t < dense]
                    score = q @ p
                    by = np.argsort(t, kind="stable")
                    first, last = np.searchsorted(t, has, "left", by), np.searchsorted(t, has, "right", by)
                    ends = np.cumsum(last - first)
                    edges = np.unique([0, *np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most)), len(ends)])
                    for x, y in zip(edges[:-1], edges[1:], strict=True):
                        k = (last - first)[x:y]
                        entry = by[np.repeat(first[x:y] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                        np.add.at(score, (i[entry], np.repeat(place[x:y], k)), w[entry])
                    for j, d in enumerate(ids[a : a + size]):
                        if d in own:
                            score[j, own[d]] = -1
                    key = score.astype(np.int64) * m + np.arange(m)
                    top = np.argpartition(key, m - n, axis=1)[:, m - n :] if m > n else np.broadcast_to(np.arange(m), key.shape)
                    s = np.take_along_axis(score, top, 1)
                    keep = s >= 0
                    j = top[keep]
                    yield pd.DataFrame({"did": np.repeat(ids[a : a + size], keep.sum(1)), "pool_did": dids[j], "pool_ord": ords[j], "s_token": s[keep].astype(np.int64)})

    return scan


def sentence_vectors(records: DataFrame, weights: DataFrame, vector: Column | None = None, dim: int = DIM, max_vocabulary: int = 200_000, embedder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``dataset, did, ord, vec``: the weighted sum of token vectors over all occurrences, in integers (weights in thousandths).

    Tokens are counted within the record, and hashed once each, before they meet. Records without units have no vector. An ``embedder`` gives
    ``text, vec`` of ``dim`` numbers for the texts of a one-column frame, in place of the hashes (``functions.embed.cached_vectors`` does with any model).
    """
    counted = records.select("dataset", "did", "ord", F.explode("units").alias("token")).groupBy("dataset", "did", "ord", "token").agg(F.count("*").alias("n"))
    tokens = vocabulary(records).join(weights, ["dataset", "token"], "left").select("dataset", "token", F.floor(F.coalesce("w", F.lit(UNSEEN)) / 1000).cast("bigint").alias("m"), (F.lit(None) if embedder else hash_vector(F.col("token"), dim) if vector is None else vector).alias("v"))
    if embedder:
        tokens = tokens.drop("v").join(embedder(tokens.select(F.col("token").alias("text")).distinct()).select(F.col("text").alias("token"), F.col("vec").alias("v")), "token")
    parts = counted.join(broadcast_if_small(cut(tokens), max_vocabulary), ["dataset", "token"])
    sums = parts.groupBy("dataset", "did", "ord").agg(*[F.sum(F.col("n") * F.col("m") * F.col("v")[i]).alias(f"v{i}") for i in range(dim)])
    return sums.select("dataset", "did", "ord", F.array(*[F.col(f"v{i}") for i in range(dim)]).alias("vec"))


def _in_blocks(queries: DataFrame, most: int, scan: Callable[[list], DataFrame]) -> DataFrame:
    """The union of ``scan`` over the queries' rows in blocks of about ``most``, each a pass over the pool: any number of queries, a bounded broadcast."""
    blocks = max(1, -(-queries.count() // most))
    parts = [scan((queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("did"), F.lit(blocks)) == b)).collect()) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _top(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` largest of each row above minus infinity; of equal ones the later columns."""
    keep = score > -np.inf
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        keep &= score >= least[:, None]
        for i in np.flatnonzero(keep.sum(axis=1) > k):
            tied = np.flatnonzero(keep[i] & (score[i] == least[i]))
            keep[i, tied[: keep[i].sum() - k]] = False
    return np.nonzero(keep)


def _cosines(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """0 where either norm is 0. Integers whose products fit a double are multiplied as such, which is exact."""
    exact = q.dtype.kind == "i" and float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1] >= 2**53
    dot = (q @ p.T).astype(float) if exact else q.astype(float) @ p.astype(float).T
    den = np.sqrt((q * q).sum(1).astype(float))[:, None] * np.sqrt((p * p).sum(1).astype(float))[None, :]
    return np.divide(dot, den, out=np.zeros_like(den), where=den > 0)


def _array(vecs: list) -> np.ndarray:
    return np.array(vecs, np.int64 if isinstance(vecs[0][0], int) else float)


def nearest(queries: DataFrame, pool: DataFrame, k: int, block: int = 100_000, step: int = 512) -> DataFrame:
    """``did, pool_did, pool_ord, cos``: the ``k`` pool vectors most similar to each query, exactly (``dataset, did, ord, vec``).

    Any number of queries: blocks of about ``block`` of them go to every task, a pass over the pool each; a task keeps the best ``k`` a query of each batch,
    and only those are ranked against each other. A zero vector has cosine 0 with all others. Ties go to the later record.
    """
    spark = queries.sparkSession

    def of(rows: list) -> DataFrame:
        by_set: dict = {}
        for r in rows:
            by_set.setdefault(r.dataset, []).append(r)
        shared = spark.sparkContext.broadcast({d: (np.array([r.did for r in x], object), _array([r.vec for r in x])) for d, x in by_set.items()})

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for name, part in pdf.groupby("dataset", dropna=False):
                    if name not in shared.value:
                        continue
                    ids, vecs = shared.value[name]
                    part = part.sort_values(["ord", "did"])
                    p, dids, ords = np.stack(part["vec"].to_numpy()), part["did"].to_numpy(), part["ord"].to_numpy()
                    for a in range(0, len(ids), step):
                        own = ids[a : a + step]
                        cos = _cosines(vecs[a : a + step], p)
                        cos[own[:, None] == dids[None, :]] = -np.inf
                        i, j = _top(cos, k)
                        yield pd.DataFrame({"did": own[i], "pool_did": dids[j], "pool_ord": ords[j], "cos": cos[i, j]})

        return pool.select("dataset", "did", "ord", "vec").mapInPandas(scan, "did string, pool_did string, pool_ord bigint, cos double")

    return ranked(_in_blocks(queries.select("dataset", "did", "vec"), block, of), "cos", k)


def hybrid_nearest(queries: DataFrame, pool: DataFrame, weights: DataFrame, n: int, lambda1: float = 1.0, lambda2: float = 1.0, block: int = 16_384, step: int = 256) -> DataFrame:
    """``did, pool_did, pool_ord, score``: the ``n`` pool records of highest lambda1 * token score + lambda2 * cosine, in millionths.

    Both sides have ``dataset, did, ord, units, vec``. Any number of queries: blocks of about ``block`` go to every task with their
    weighted tokens, a pass over the pool each; a task scores its rows against ``step`` queries at a time and passes on its best ``n`` a query.
    """
    spark = queries.sparkSession
    toks = queries.select("dataset", "did", "vec", F.explode(F.array_distinct("units")).alias("token")).join(weights, ["dataset", "token"], "left").select("dataset", "did", "vec", F.struct("token", F.coalesce("w", F.lit(UNSEEN)).alias("w")).alias("x"))
    sides = cut(toks.groupBy("dataset", "did").agg(F.first("vec").alias("vec"), F.collect_list("x").alias("x")))

    def of(rows: list) -> DataFrame:
        by_set: dict = {}
        for r in rows:
            ids, vecs, token, entry, weight = by_set.setdefault(r.dataset, ([], [], [], [], []))
            for t in r.x:
                token.append(t.token)
                entry.append(len(ids))
                weight.append(t.w)
            ids.append(r.did)
            vecs.append(r.vec)
        made = {}
        for d, (ids, vecs, token, entry, weight) in by_set.items():
            names = {t: i for i, t in enumerate(dict.fromkeys(token))}
            made[d] = np.array(ids, object), _array(vecs), names, np.array([names[t] for t in token]), np.array(entry), np.array(weight, float)
        shared = spark.sparkContext.broadcast(made)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for name, part in pdf.groupby("dataset", dropna=False):
                    if name not in shared.value:
                        continue
                    ids, vecs, names, token, entry, weight = shared.value[name]
                    part = part.sort_values(["ord", "did"])
                    p, dids, ords, m = np.stack(part["vec"].to_numpy()), part["did"].to_numpy(), part["ord"].to_numpy(), len(part)
                    found = [[names[t] for t in set(u) if t in names] for u in part["units"]]
                    has, place = np.array([t for x in found for t in x], np.int64), np.repeat(np.arange(m), [len(x) for x in found])
                    by = np.argsort(has, kind="stable")
                    has, place = has[by], place[by]
                    for a in range(0, len(ids), step):
                        own = ids[a : a + step]
                        e = slice(*np.searchsorted(entry, (a, a + step)))
                        first, last = np.searchsorted(has, token[e], "left"), np.searchsorted(has, token[e], "right")
                        size = last - first
                        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                        tokens = np.bincount(np.repeat(entry[e] - a, size) * m + place[at], np.repeat(weight[e], size), len(own) * m).reshape(len(own), m)
                        score = np.floor(tokens * lambda1 + np.floor(_cosines(vecs[a : a + step], p) * 1_000_000) * lambda2)
                        score[own[:, None] == dids[None, :]] = -np.inf
                        i, j = _top(score, n)
                        yield pd.DataFrame({"did": own[i], "pool_did": dids[j], "pool_ord": ords[j], "score": score[i, j].astype(np.int64)})

        return pool.where("units is not null").select("dataset", "did", "ord", "units", "vec").mapInPandas(scan, "did string, pool_did string, pool_ord bigint, score bigint")

    return ranked(_in_blocks(sides, block, of), "score", n)


def demonstrations(picks: DataFrame, pool: DataFrame) -> DataFrame:
    """``did, demos``: text and entities of each query's picks, the most similar last."""
    shown = pool.select(F.col("did").alias("pool_did"), F.struct(F.col("text"), F.transform("entities", lambda e: F.struct(F.coalesce(e["surface"], F.lit("")).alias("name"), e["type"].alias("type"))).alias("ents")).alias("demo"))
    return picks.join(shown, "pool_did").groupBy("did").agg(F.sort_array(F.collect_list(F.struct("rank", "demo"))).alias("x")).select("did", F.transform("x", lambda r: r["demo"]).alias("demos"))
