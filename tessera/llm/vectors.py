"""The k most similar vectors of every vector, by vantage-point trees over shards (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.runtime import cut, shuffle_width

#: Candidates kept beyond k while single precision ranks them; double precision decides.
SPARE = 3


class VantageTree:
    """Points in cells: each inner node has a vantage point and the median distance that parts its points."""

    def __init__(self, x: np.ndarray, cell: int, seed: int = 0):
        self.nodes: list = []  # (number of the vantage point, radius, inner, outer), or a cell's number
        self.cells: list[np.ndarray] = []
        points: list[np.ndarray] = []
        rng = np.random.default_rng(seed)
        todo = [(np.arange(len(x)), self._new())]
        while todo:
            own, at = todo.pop()
            part = None if len(own) <= cell else self._split(x, own, rng)
            if part is None:
                self.nodes[at] = len(self.cells)
                self.cells.append(own)
            else:
                v, mu, inner, outer = part
                a, b = self._new(), self._new()
                self.nodes[at] = (len(points), mu, a, b)
                points.append(v)
                todo += [(inner, a), (outer, b)]
        self.points = np.array(points, np.float32).reshape(len(points), x.shape[1])

    def _new(self) -> int:
        self.nodes.append(None)
        return len(self.nodes) - 1

    @staticmethod
    def _split(x: np.ndarray, own: np.ndarray, rng: np.random.Generator):
        """The candidate point whose distances spread most; None if no point parts the others."""
        tries, some = rng.choice(own, min(8, len(own)), replace=False), rng.choice(own, min(256, len(own)), replace=False)
        d = distances(x[some], x[tries])
        v = x[tries[int(np.argmax(d.var(axis=0)))]]
        far = distances(x[own], v[None, :])[:, 0]
        mu = float(np.median(far))
        inside = far <= mu
        if inside.all():
            inside = far < mu
        if inside.all() or not inside.any():
            return None
        return v, mu, own[inside], own[~inside]

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Distance of each point of ``q`` to each vantage point, a row for each of those."""
        return distances(self.points, q)

    def home(self, d: np.ndarray) -> np.ndarray:
        """The cell each point falls into, given its distances to the vantage points."""
        out, todo = np.zeros(d.shape[1], np.int64), [(0, np.arange(d.shape[1]))]
        while todo:
            at, own = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[own] = node
            elif len(own):
                inside = d[node[0]][own] <= node[1]
                todo += [(node[2], own[inside]), (node[3], own[~inside])]
        return out

    def reach(self, d: np.ndarray, radius: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) for each cell not ruled out: the triangle inequality with ``factor`` times the radius.

        ``radius`` may shrink while the cells are searched.
        """
        todo = [(0, np.arange(d.shape[1]))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            node = self.nodes[at]
            if isinstance(node, int):
                yield node, own
                continue
            gap, r = d[node[0]][own] - node[1], factor * radius[own] + 1e-3
            todo += [(node[2], own[gap <= r]), (node[3], own[gap >= -r])]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def reach_of(sims: np.ndarray) -> np.ndarray:
    """The distance that belongs to a cosine."""
    return np.sqrt(np.maximum(2 - 2 * sims, 0))


class Nearest:
    """Search for the ``k`` most similar among the points of one shard."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, k: int, factor: float, cell: int):
        self.ids, self.exact, self.k, self.factor = ids, unit(raw), k, factor
        self.x = self.exact.astype(np.float32)
        self.tree = VantageTree(self.x, cell)
        self.blocks = [(own, np.ascontiguousarray(self.x[own].T)) for own in self.tree.cells]
        self.by_id = np.argsort(ids, kind="stable")
        self.cell_of, self.slot_of = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for c, own in enumerate(self.tree.cells):
            self.cell_of[own], self.slot_of[own] = c, np.arange(len(own))

    def search(self, ids: np.ndarray, raw: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, ids, cosines) of up to k neighbours more similar than ``floor``, best first, ties by smaller id."""
        exact = unit(raw)
        q = exact.astype(np.float32)
        keep = self.k + SPARE
        low = floor.astype(np.float32) - 1e-5
        sims, at = np.full((len(q), keep), -3, np.float32), np.zeros((len(q), keep), np.int64)
        worst, radius = low.copy(), reach_of(low)  # of each query: what a candidate must exceed, and how far the k-th may be
        place = np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), len(self.ids) - 1)
        me = self.by_id[place]
        own_cell = np.where(self.ids[me] == ids, self.cell_of[me], -1)

        def take(cell: int, own: np.ndarray) -> None:
            points, block = self.blocks[cell]
            s = q[own] @ block
            selves = np.flatnonzero(own_cell[own] == cell)
            s[selves, self.slot_of[me[own[selves]]]] = -3
            some = np.flatnonzero(s.max(axis=1) > worst[own])
            if len(some):
                rows, s = own[some], s[some]
                n = min(keep, s.shape[1])
                best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), s.shape)
                both_s = np.concatenate([sims[rows], np.take_along_axis(s, best, 1)], axis=1)
                both_at = np.concatenate([at[rows], points[best]], axis=1)
                top = np.argsort(-both_s, axis=1)[:, :keep]
                sims[rows], at[rows] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both_at, top, 1)
                worst[rows] = np.maximum(sims[rows, -1], low[rows])
                radius[rows] = reach_of(np.maximum(sims[rows, self.k - 1], low[rows]))

        d = self.tree.gaps(q)
        home = self.tree.home(d)
        order = np.argsort(home, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if len(own):
                take(int(home[own[0]]), own)
        for cell, own in self.tree.reach(d, radius, self.factor):
            own = own[home[own] != cell]
            if len(own):
                take(cell, own)
        for i in np.flatnonzero(sims[:, 0] > -2):
            near = at[i][sims[i] > -2]
            cos = self.exact[near] @ exact[i]
            rank = np.lexsort((self.ids[near], -cos))
            rank = rank[cos[rank] >= floor[i]][: self.k]
            if len(rank):
                yield int(i), self.ids[near[rank]], cos[rank]


def _raw(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(-1, dim)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """``id, vec``: one row per id with a vector of ``dim`` finite numbers that aren't all 0, as bytes."""
    v = F.col("vec").cast("array<float>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), v.alias("vec")).where("id is not null and vec is not null").where(F.size("vec") == dim)
    fine = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vec": [np.asarray(x, "<f4").tobytes() for x in pdf["vec"]]})

    return fine.mapInPandas(pack, "id bigint, vec binary").dropDuplicates(["id"])


def _scatter(rows: DataFrame, cells: int) -> DataFrame:
    """One partition for each cell, data before queries, in the same order in every attempt."""
    by_id = getattr(rows, "repartitionById", None)
    placed = by_id(cells, F.col("cell")) if by_id else rows.repartition(cells, "cell")
    return placed.sortWithinPartitions("cell", "kind", "id")


def _answer(k: int, factor: float, leaf: int, dim: int):
    """For each cell: its data rows, a tree over them, then its queries batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ids, raw, near = None, [], [], None
        for pdf in batches:
            for c, part in pdf.groupby("cell", sort=True):
                if c != cell:
                    cell, ids, raw, near = c, [], [], None
                data, ask = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(data):
                    ids.append(data["id"].to_numpy())
                    raw.append(_raw(data["vec"], dim))
                if not len(ask) or not ids:
                    continue
                if near is None:
                    near = Nearest(np.concatenate(ids), np.concatenate(raw), k, factor, leaf)
                asked = ask["id"].to_numpy()
                out = [(int(asked[i]), n.tolist(), s.tolist()) for i, n, s in near.search(asked, _raw(ask["vec"], dim), ask["floor"].to_numpy())]
                if out:
                    yield pd.DataFrame(out, columns=["id", "near", "cos"])

    return run


_FOUND = "id bigint, near array<bigint>, cos array<double>"


def neighbours(points: DataFrame, k: int, dim: int, factor: float = 0.3, shard_rows: int = 100_000, leaf: int = 256, fit_rows: int = 20_000) -> DataFrame:
    """``id, near, cos`` rows whose union over an id holds its ``k`` most similar other points of ``points`` (``id, vec``).

    A vantage-point tree fitted on at most ``fit_rows`` points (by hash) parts all points into shards of about
    ``shard_rows``. Each point first searches its own shard's tree; the k-th cosine found there then bounds the search in
    every other shard that the triangle inequality, with its radius times ``factor``, does not rule out. ``factor=1`` is
    exact; smaller factors search less. A shard of too many points (many of the same direction) is split by hash and asked
    in all its parts.
    """
    spark = points.sparkSession
    total = points.count()
    if not total:
        return spark.createDataFrame([], _FOUND)
    n_shards = 1
    while n_shards * shard_rows < total:
        n_shards *= 2
    some = points.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.9 * fit_rows / total)) + 1).limit(fit_rows).select("vec").collect() if n_shards > 1 else points.limit(1).select("vec").collect()
    fit = unit(np.frombuffer(b"".join(r.vec for r in some), "<f4").reshape(-1, dim)).astype(np.float32) if some else np.zeros((0, dim), np.float32)
    router = spark.sparkContext.broadcast(VantageTree(fit, max(1, -(-len(fit) // n_shards))))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(shard=router.value.home(router.value.gaps(unit(_raw(pdf["vec"], dim)).astype(np.float32))))

    placed = cut(points.select("id", "vec").mapInPandas(locate, "id bigint, vec binary, shard bigint"))
    sizes = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # Cells: (shard, part of its points, part of its queries).
    lanes = max(1, -(-2 * shuffle_width(spark) // (3 * len(sizes))))
    first, parts, number = {}, {}, 0
    for s, n in sorted(sizes.items()):
        first[s], parts[s] = number, max(1, n // (2 * shard_rows))
        number += parts[s] * lanes
    home = placed.select("*", F.create_map(*[F.lit(x) for s in first for x in (s, first[s])])[F.col("shard")].alias("base"), F.create_map(*[F.lit(x) for s in parts for x in (s, parts[s])])[F.col("shard")].alias("n"))
    part, lane = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("n")), F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(lanes))
    data = home.select("id", "vec", (F.col("base") + part * lanes).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("x")).select((F.col("c") + F.col("x")).cast("int").alias("cell"), F.lit(0).alias("kind"), "id", "vec", F.lit(0.0).alias("floor"))
    ask = home.select("id", "vec", (F.col("base") + lane).alias("c"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("x")).select((F.col("c") + F.col("x") * lanes).cast("int").alias("cell"), F.lit(1).alias("kind"), "id", "vec", F.lit(-2.0).alias("floor"))
    run = _answer(k, factor, leaf, dim)
    own = cut(_scatter(data.unionByName(ask), number).mapInPandas(run, _FOUND))
    if len(sizes) == 1:
        return own
    # A point asked in several parts of its shard has several rows; the largest k-th cosine is a bound all the same.
    kth = own.groupBy("id").agg(F.max(F.when(F.size("cos") >= k, F.element_at("cos", -1)).otherwise(F.lit(-2.0))).alias("floor"))
    asking = placed.join(kth, "id", "left").select("id", "vec", "shard", F.coalesce("floor", F.lit(-2.0)).alias("floor"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            q = unit(_raw(pdf["vec"], dim)).astype(np.float32)
            r = reach_of(pdf["floor"].to_numpy())
            shard, slot = pdf["shard"].to_numpy(), (pdf["id"].to_numpy() % lanes)
            for s, rows in router.value.reach(router.value.gaps(q), r, factor):
                rows = rows[shard[rows] != s]
                if len(rows) and s in first:
                    for p in range(parts[s]):
                        yield pd.DataFrame({"cell": first[s] + p * lanes + slot[rows], "kind": 1, "id": pdf["id"].to_numpy()[rows], "vec": pdf["vec"].to_numpy()[rows], "floor": pdf["floor"].to_numpy()[rows]})

    visits = asking.mapInPandas(spread, "cell int, kind int, id bigint, vec binary, floor double")
    others = _scatter(data.unionByName(visits), number).mapInPandas(run, _FOUND)
    return own.unionByName(others)


def top_k(vectors: DataFrame, k: int = 5, dim: int = 64, factor: float = 0.3, shard_rows: int = 100_000, leaf: int = 256) -> DataFrame:
    """``vec_id, rank, near_id, cos``: the ``k`` most similar other vectors of every usable vector, ties by smaller id.

    Null vectors, those of another length, with null or infinite numbers or all zeros, and null ids take no part; a
    repeated id counts once. Equal vectors are searched once: each answer lists the ``k + 1`` smallest ids of its
    vector, which is all that ``k`` places can hold, so a group of copies of any size costs one search.
    """
    # Members of a group of copies are limited in each task before they meet (a window's group limit).
    all_ids = cut(usable(vectors, dim))
    least = all_ids.withColumn("place", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("place") <= k + 1)
    least = cut(least)
    points = least.where("place = 1").select("id", "vec")
    hits = neighbours(points, k, dim, factor, shard_rows, leaf).select("id", F.explode(F.arrays_zip("near", "cos")).alias("x")).select(F.col("id").alias("rep"), F.col("x.near").alias("other"), F.col("x.cos").alias("cos"))
    copies = cut(least.join(points.select(F.col("id").alias("rep"), "vec"), "vec").select("rep", "id", "place"))
    best = hits.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("cos"), "other"))).where(F.col("r") <= k).drop("r")
    foreign = best.join(copies.select(F.col("rep").alias("other"), F.col("id").alias("near_id")), "other").select("rep", "near_id", "cos")
    own = copies.select("rep", F.col("id").alias("near_id"), F.lit(1.0).alias("cos"))
    lists = foreign.unionByName(own).withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("cos"), "near_id"))).where(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("r", "near_id", "cos"))).alias("all"))
    rep_of = all_ids.join(points.select(F.col("id").alias("rep"), "vec"), "vec").select("id", "rep")
    asked = rep_of.join(lists, "rep").select("id", F.slice(F.filter("all", lambda x: x["near_id"] != F.col("id")), 1, k).alias("all"))
    return asked.select(F.col("id").alias("vec_id"), F.posexplode("all").alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("rank"), F.col("x.near_id").alias("near_id"), F.col("x.cos").alias("cos"))


def found(vectors: DataFrame) -> DataFrame:
    """``vec_a, vec_b`` as TESTDATA.md defines them for problem 4."""
    near = top_k(vectors)
    return near.select(F.least("vec_id", "near_id").alias("vec_a"), F.greatest("vec_id", "near_id").alias("vec_b")).distinct()
