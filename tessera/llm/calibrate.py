"""Samples whose category shares follow a plan: calibrated probabilities and pivotal sampling (problem 5)."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.runtime import bounded_rows, broadcast_if_small, cut


def type_key(c: Column) -> Column:
    """Types compare without case, outer blanks and the kind of sign between their words."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "^\\s+|\\s+$", "")), "[\\s_-]+", "_")


def mention_counts(docs: DataFrame, entity_types: DataFrame, split: str = "train", max_types: int = 100_000) -> DataFrame:
    """``dataset, did, mentions, code_n``: per record of the split the mentions with a type and, as a map, those of each code.

    Types are given as code or full name; unknown types count as mentions but belong to no code. A repeated ``did``
    counts once; null entities are no mentions; rows without a ``did`` take no part.
    """
    one = docs.where(F.col("split") == split).where("did is not null").select("dataset", "did", "entities").dropDuplicates(["did"])
    names = entity_types.select("dataset", "code", F.explode(F.array("code", "full_name")).alias("name")).where("name is not null").select("dataset", "code", type_key(F.col("name")).alias("tk")).groupBy("dataset", "tk").agg(F.min("code").alias("code"))
    said = one.select("dataset", "did", F.explode("entities").alias("e")).where("e.type is not null").select("dataset", "did", type_key(F.col("e.type")).alias("tk")).groupBy("dataset", "did", "tk").agg(F.count("*").alias("n"))
    coded = said.join(broadcast_if_small(names, max_types), ["dataset", "tk"], "left").groupBy("dataset", "did", "code").agg(F.sum("n").alias("n")).groupBy("dataset", "did").agg(F.sum("n").alias("mentions"), F.map_from_entries(F.filter(F.collect_list(F.struct("code", "n")), lambda x: x["code"].isNotNull())).alias("cn"))
    return one.select("dataset", "did").join(coded.select("did", "mentions", "cn"), "did", "left").select("dataset", "did", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("cn", F.create_map().cast("map<string,bigint>")).alias("code_n"))


def _merged(code_n: Column) -> Column:
    """The map as sorted entries, so that equal maps are equal keys."""
    return F.array_sort(F.map_entries(code_n))


def plan_lines(plans: DataFrame, max_rows: int = 100_000) -> dict:
    """plan -> (dataset, codes, shares, fraction, floors); incomplete lines take no part, a repeated line counts once."""
    out: dict = {}
    rows = bounded_rows(plans.where("plan_id is not null and code is not null and dataset is not null and share_pm is not null and fraction_pm is not null").dropDuplicates(["plan_id", "code"]), max_rows, "sample plans")
    for r in sorted(rows, key=lambda r: (r.plan_id, r.code)):
        p = out.setdefault(r.plan_id, {"dataset": r.dataset, "codes": [], "shares": [], "fraction": r.fraction_pm, "floors": []})
        p["codes"].append(r.code)
        p["shares"].append(r.share_pm)
        p["floors"].append(r.min_mentions or 0)
    return out


#: Exponents above this give a probability of 1 with any base rate; the limit only keeps the exponential finite.
_TOP = 60.0


def _moments(patterns: DataFrame, plans: dict, duals: dict, base: dict, certain: dict) -> dict:
    """plan -> (sum of p x, sum of p x x', value of the dual) over all records; partial sums in numpy, added up by group.

    Records with one of the plan's ``certain`` codes have probability 1.
    """
    spec = {p: (v["dataset"], v["codes"]) for p, v in plans.items()}

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for ds, rows in pdf.groupby("dataset"):
                maps = [dict((e["key"], e["value"]) for e in x) for x in rows["pattern"]]
                w = rows["w"].to_numpy(float)
                for p, (of, codes) in spec.items():
                    if of != ds:
                        continue
                    x = np.array([[m.get(c, 0) for c in codes] for m in maps], float)
                    u = np.minimum(x @ np.array(duals[p]), _TOP)
                    q = base[p] * np.exp(u)
                    sure = x[:, certain[p]].any(axis=1) if certain[p] else np.zeros(len(x), bool)
                    free = (q < 1) & ~sure
                    dual = (w * np.where(sure, x @ np.array(duals[p]), np.where(free, q, 1 + u + np.log(base[p])))).sum()  # convex, its slope is the capped probability
                    q = np.where(sure, 1.0, np.minimum(q, 1))
                    g = (x * (w * q)[:, None]).sum(0)
                    h = (x * (w * q * free)[:, None]).T @ x
                    sums[p] = sums.get(p, 0) + np.concatenate([g, h.ravel(), [dual]])
        for p, v in sums.items():
            yield pd.DataFrame({"plan_id": [p] * len(v), "i": range(len(v)), "v": v})

    got: dict = {p: np.zeros(len(v["codes"]) * (1 + len(v["codes"])) + 1) for p, v in plans.items()}
    for r in patterns.mapInPandas(part, "plan_id int, i int, v double").groupBy("plan_id", "i").agg(F.sum("v").alias("v")).collect():
        got[r.plan_id][r.i] = r.v
    return {p: (v[: len(plans[p]["codes"])], v[len(plans[p]["codes"]) : -1].reshape(len(plans[p]["codes"]), -1), v[-1]) for p, v in got.items()}


def calibrate(patterns: DataFrame, plans: dict, targets: dict, certain: dict, rounds: int = 25, tolerance: float = 1e-3) -> tuple[dict, dict, dict]:
    """Duals, base rate and convergence of each plan: inclusion probability min(1, base * exp(dual . x)) meets the targets.

    Newton steps on the dual of exponential tilting, damped more after a step that doesn't lower it and less after one that does;
    each round is one distributed aggregation of the moments over distinct count patterns. Along a target of all there is or more the dual has no
    minimum: the records of these ``certain`` codes (positions in the plan) are taken for sure, and the others calibrated beside them. A plan has converged if
    the expected mentions of all its other codes are within ``tolerance`` of their targets; where targets exclude each other the best point found stays.
    """
    base = {p: min(max(v["fraction"] / 1000, 1e-6), 1.0) for p, v in plans.items()}
    trial = {p: np.zeros(len(v["codes"])) for p, v in plans.items()}
    best: dict = {}
    met: dict = {}
    damping = dict.fromkeys(plans, 1e-3)
    for _ in range(rounds):
        done = True
        for p, (g, h, value) in _moments(patterns, plans, trial, base, certain).items():
            value -= float(trial[p] @ targets[p])
            if p not in best or value < best[p][0]:
                best[p] = (value, trial[p], g, h)
                damping[p] = max(damping[p] / 4, 1e-6)
            else:
                damping[p] *= 8
            _, at, g, h = best[p]
            gap = targets[p] - g
            gap[certain[p]] = 0.0
            met[p] = bool(np.all(np.abs(gap) <= tolerance * np.maximum(targets[p], 1)))
            if damping[p] > 1e6 or met[p]:
                trial[p] = at
                continue
            done = False
            firm = h + damping[p] * np.diag(np.diag(h)) + 1e-6 * (np.trace(h) / len(gap) + 1) * np.eye(len(gap))
            trial[p] = at + np.clip(np.linalg.solve(firm, gap), -3, 3)  # no step of more than 3, however flat the dual
        if done:
            break
    return {p: best[p][1] for p in plans}, base, met


def _pivotal(rows: list[tuple[str, float]], rng: random.Random) -> tuple[list[str], tuple[str, float] | None]:
    """The sequential pivotal method: (sampled, the one record that may stay undecided)."""
    took, held = [], None
    for did, p in rows:
        if p >= 1 - 1e-12:
            took.append(did)
        elif p <= 1e-12:
            continue
        elif held is None:
            held = (did, p)
        else:
            a, b = held, (did, p)
            s = a[1] + b[1]
            if s <= 1:
                held = (a[0] if rng.random() * s < a[1] else b[0], s)
            else:
                up = a if rng.random() * (2 - s) < 1 - b[1] else b
                took.append(up[0])
                held = (b[0] if up is a else a[0], s - 1)
            if held[1] >= 1 - 1e-12:
                took.append(held[0])
                held = None
            elif held[1] <= 1e-12:
                held = None
    return took, held


def pivotal_sample(probs: DataFrame, seed: int = 0, bucket_rows: int = 20_000) -> DataFrame:
    """``plan_id, did`` drawn with the given probabilities ``p``: buckets are sampled apart, what each leaves undecided is sampled again."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        plan, bucket, level = int(pdf["plan_id"].iloc[0]), int(pdf["bucket"].iloc[0]), int(pdf["level"].iloc[0])
        pdf = pdf.sort_values(["r", "did"])
        took, held = _pivotal(list(zip(pdf["did"], pdf["p"], strict=True)), random.Random(f"{seed}/{plan}/{bucket}/{level}"))
        out = [(plan, d, 1.0, True) for d in took] + ([(plan, held[0], held[1], False)] if held else [])
        return pd.DataFrame(out, columns=["plan_id", "did", "p", "taken"])

    most = probs.groupBy("plan_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    left, taken, level = probs, None, 0
    while True:
        buckets = max(1, -(-most // bucket_rows))
        r = F.xxhash64(F.lit(seed + level), "did")
        drawn = left.select("plan_id", "did", "p", r.alias("r"), F.pmod(F.xxhash64(F.lit(seed - 1 - level), "did"), F.lit(buckets)).alias("bucket"), F.lit(level).alias("level")).groupBy("plan_id", "bucket").applyInPandas(draw, "plan_id int, did string, p double, taken boolean")
        drawn = cut(drawn)
        own = drawn.where("taken").select("plan_id", "did")
        taken = own if taken is None else taken.unionByName(own)
        left = drawn.where("not taken").select("plan_id", "did", "p")
        if buckets == 1:
            last = F.pmod(F.xxhash64(F.lit(seed + 77), "did"), F.lit(1_000_000)) / 1_000_000.0 < F.col("p")
            return taken.unionByName(left.where(last).select("plan_id", "did"))
        most, level = buckets, level + 1


def sample(docs: DataFrame, entity_types: DataFrame, sample_plans: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(``plan_id, did, reason``, the report with one row per plan line).

    The report: ``plan_id, dataset, code, target, available, expected, min_mentions, sampled, gap, met, reachable, converged``; ``target`` is
    the plan's share of its fraction of all typed mentions of the dataset's train records, ``expected`` the mentions of the calibrated probabilities. A line
    is not ``reachable`` if all records of its type have probability 1 and still fall short of the target, or if the finished sample lacks its minimum. After the draw, records are added until each type that can has its
    minimum: no more of them than the minimum asks for.
    """
    spark = docs.sparkSession
    counts = cut(mention_counts(docs, entity_types))
    plans = plan_lines(sample_plans)
    patterns = counts.select("dataset", _merged(F.col("code_n")).alias("pattern")).groupBy("dataset", "pattern").agg(F.count("*").alias("w"))
    totals = {r.dataset: r.n for r in counts.groupBy("dataset").agg(F.sum("mentions").alias("n")).collect()}
    per_code = {(r.dataset, r.code): r.n for r in counts.select("dataset", F.explode("code_n").alias("code", "n")).groupBy("dataset", "code").agg(F.sum("n").alias("n")).collect()}
    exact, targets, certain = {}, {}, {}
    for p, v in plans.items():
        exact[p] = [s * v["fraction"] * totals.get(v["dataset"], 0) for s in v["shares"]]  # millionths of mentions
        known = [per_code.get((v["dataset"], c), 0) for c in v["codes"]]
        certain[p] = [i for i, (t, n) in enumerate(zip(exact[p], known, strict=True)) if t >= n * 1_000_000 and n]
        targets[p] = np.minimum(np.array(exact[p]) / 1e6, known)
    duals, base, done = calibrate(cut(patterns), plans, targets, certain)
    lam = spark.createDataFrame([(p, v["dataset"], v["codes"], [float(x) for x in duals[p]], float(base[p]), [v["codes"][i] for i in certain[p]]) for p, v in plans.items()], "plan_id int, dataset string, codes array<string>, lam array<double>, base double, sure array<string>")
    tilt = F.aggregate(F.zip_with("codes", "lam", lambda c, m: m * F.coalesce(F.try_element_at("code_n", c), F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    p = F.when(F.exists("sure", lambda c: F.coalesce(F.try_element_at("code_n", c), F.lit(0)) > 0), 1.0).otherwise(F.least(F.lit(1.0), F.col("base") * F.exp(F.least(F.lit(_TOP), tilt))))
    each = counts.join(F.broadcast(lam), "dataset").select("plan_id", "did", "code_n", p.alias("p"))
    drawn = pivotal_sample(each.select("plan_id", "did", "p"), seed)
    held = each.select("plan_id", "p", F.explode("code_n").alias("code", "n")).groupBy("plan_id", "code").agg(F.sum("n").alias("available"), F.sum(F.col("p") * F.col("n")).alias("expected"), F.min("p").alias("least_p"))

    lines = spark.createDataFrame(
        [(p, v["dataset"], c, float(t / 1e6), int(t), f, done.get(p, True)) for p, v in plans.items() for c, t, f in zip(v["codes"], exact[p], v["floors"], strict=True)],
        "plan_id int, dataset string, code string, target double, millionths bigint, min_mentions int, converged boolean",
    )
    long_counts = counts.select("did", F.explode("code_n").alias("code", "n"))
    got = drawn.join(long_counts, "did").groupBy("plan_id", "code").agg(F.sum("n").alias("got"))
    low = lines.join(got, ["plan_id", "code"], "left").select("plan_id", "dataset", "code", (F.col("min_mentions") - F.coalesce("got", F.lit(0))).alias("lack")).where("lack > 0")
    spare = counts.select("dataset", "did", F.explode("code_n").alias("code", "n")).join(F.broadcast(low), ["dataset", "code"]).join(drawn, ["plan_id", "did"], "left_anti")
    order = W.partitionBy("plan_id", "code").orderBy(F.xxhash64(F.lit(seed + 5), "did"), "did")
    ranked = spare.withColumn("rank", F.row_number().over(order)).where(f"rank <= {max([0, *(f for v in plans.values() for f in v['floors'])])}")
    added = ranked.withColumn("so_far", F.sum("n").over(order) - F.col("n")).where("so_far < lack").select("plan_id", "did").distinct()
    chosen = cut(drawn.select("plan_id", "did", F.lit("drawn").alias("reason")).unionByName(added.select("plan_id", "did", F.lit("minimum").alias("reason"))))
    final = chosen.join(long_counts, "did").groupBy("plan_id", "code").agg(F.sum("n").alias("sampled"))
    sampled, available = F.coalesce("sampled", F.lit(0)), F.coalesce("available", F.lit(0))
    exhausted = (F.coalesce("least_p", F.lit(1.0)) >= 1) & (available * 1_000_000 < F.col("millionths"))
    out = lines.join(final, ["plan_id", "code"], "left").join(held, ["plan_id", "code"], "left").select(
        "plan_id", "dataset", "code", "target", available.alias("available"), F.coalesce("expected", F.lit(0.0)).alias("expected"), "min_mentions", sampled.alias("sampled"), (F.col("target") - sampled).alias("gap"),
        ((sampled >= F.col("min_mentions")) & (sampled >= F.floor("target"))).alias("met"), (~exhausted & (sampled >= F.col("min_mentions"))).alias("reachable"), "converged",
    )
    return chosen, out
