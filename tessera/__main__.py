"""Command line: run the pipeline over a delivered record table and write a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import align, evaluate, reflect, stats
from tessera.plans import pipeline
from tessera.plans.config import DEFAULTS, PASSES, SETS, Settings
from tessera.sources import cache, corpus


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("docs", help="Parquet table of records")
    p.add_argument("--dataset", choices=sorted(SETS), required=True)
    p.add_argument("--method", choices=("m1", "m2"), default="m1")
    p.add_argument("--passes", default=",".join(PASSES))
    p.add_argument("--split", default="test")
    p.add_argument("--slice", default="")
    p.add_argument("--n-test", type=int, default=0)
    p.add_argument("--seed", type=int, default=13)
    p.add_argument("--n-shots", type=int, default=0)
    p.add_argument("--theta-fn", type=float)
    p.add_argument("--surround", type=float, default=0.5)
    p.add_argument("--selfcheck", action="store_true", help="align the gold names of the records and stop")
    p.add_argument("--validate-stats", action="store_true", help="show token probabilities and stop")
    p.add_argument("--out", default=".")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    records = corpus.corpus(spark.read.parquet(a.docs).where(F.col("dataset") == a.dataset))
    if a.selfcheck:
        r = align.round_trip(records).agg(F.sum("golds"), F.sum("recovered"), F.count_if(~F.col("complete"))).first()
        return {"golds": r[0], "recovered": r[1], "incomplete": r[2]}
    train_stats = pipeline.train_stats(records, int(DEFAULTS["C"]))
    if a.validate_stats:
        return {r.token: [r.p_e, r.p_c, r.p_o] for r in stats.probabilities(train_stats).orderBy(F.desc("n"), "token").limit(25).collect()}
    tests = records.where(F.col("split") == a.split)
    if a.slice:
        tests = corpus.slice_rows(tests, *corpus.parse_slice(a.slice))
    if a.n_test:
        tests = corpus.hash_sample(tests, a.n_test, a.seed)
    settings = Settings(method=a.method, passes=tuple(x for x in a.passes.split(",") if x), n_shots=a.n_shots or int(DEFAULTS["n_shots"]), C=int(DEFAULTS["C"]), K=int(DEFAULTS["K"]), M=int(DEFAULTS["M"]), theta_fn=DEFAULTS["theta_fn"] if a.theta_fn is None else a.theta_fn, surround=a.surround)
    state, trace = pipeline.predict_records(records, tests, settings)
    pairs = state.withColumnRenamed("spans", "pred")
    rows = lambda df: [r.asDict() for r in df.collect()]
    edits = rows(reflect.attribution(trace, state.select("did", "gold"))) if trace is not None else []
    report = {"dataset": a.dataset, "settings": vars(a), "n_test": tests.count(), "overall": rows(evaluate.micro_prf(pairs)), "per_type": rows(evaluate.per_type_prf(pairs).orderBy("type")), "nested": rows(evaluate.nested_recall(pairs)), "errors": rows(evaluate.error_rates(pairs)), "depth": rows(evaluate.depth_recall(pairs).orderBy("depth")), "edits": edits}
    changed = {} if a.theta_fn is None else {"theta": a.theta_fn}
    changed |= {"slice": a.slice.replace(":", "-")} if a.slice else {}
    changed |= {"passes": "-".join(settings.ordered())} if a.method == "m2" and settings.ordered() != list(PASSES) else {}
    changed |= {"surround": a.surround} if a.surround != Settings.surround else {}
    changed |= {"shots": a.n_shots} if a.n_shots else {}
    cache.write_report(report, f"{a.out}/{cache.report_name(a.dataset, a.method, a.split, report['n_test'], a.seed, **changed)}")
    return report


if __name__ == "__main__":
    print(main())
