"""Strict scores and their decompositions. Spans of a record are compared inside the record; only counts are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.spans import strictly_contains


def _ratios(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    def rate(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)

    p, r, f = rate(F.col(tp), F.col(tp) + F.col(fp)), rate(F.col(tp), F.col(tp) + F.col(fn)), rate(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1")]


def check_documents(gold: DataFrame, pred: DataFrame) -> None:
    """Raises unless both sides hold the same records."""
    if gold.select("did").exceptAll(pred.select("did")).limit(1).count() or pred.select("did").exceptAll(gold.select("did")).limit(1).count():
        raise ValueError("gold and predictions differ in their records")


def _sets(pairs: DataFrame) -> DataFrame:
    return pairs.select("*", F.array_distinct("gold").alias("g"), F.array_distinct("pred").alias("p"))


def micro_prf(pairs: DataFrame, *by: str) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` over records with ``gold`` and ``pred`` lists; repeated spans of a record count once."""
    c = _sets(pairs).select(*by, F.size(F.array_intersect("g", "p")).alias("tp"), F.size("g").alias("n_g"), F.size("p").alias("n_p"))
    s = c.groupBy(*by).agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("n_p") - F.col("tp")), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col("n_g") - F.col("tp")), F.lit(0)).alias("fn"))
    return s.select(*by, "tp", "fp", "fn", *_ratios())


def per_type_prf(pairs: DataFrame, *by: str) -> DataFrame:
    """The same by type, for every type in gold or predictions."""
    every = _sets(pairs).select(*by, F.explode(F.transform(F.array_union("g", "p"), lambda s: F.struct(s["type"].alias("type"), F.array_contains("g", s).alias("in_g"), F.array_contains("p", s).alias("in_p")))).alias("x")).select(*by, F.col("x.type").alias("type"), F.col("x.in_g").alias("in_g"), F.col("x.in_p").alias("in_p"))
    s = every.groupBy(*by, "type").agg(F.count_if(F.col("in_g") & F.col("in_p")).alias("tp"), F.count_if(~F.col("in_g")).alias("fp"), F.count_if(~F.col("in_p")).alias("fn"))
    return s.select(*by, "type", "tp", "fp", "fn", *_ratios())


def nesting_roles(pairs: DataFrame, *by: str) -> DataFrame:
    """``did, start, end, type, inner, outer, depth, recovered``: each distinct gold span's role; ``depth`` is 1 plus the listed spans that contain it.

    Repeated gold spans raise the depth of what they contain, as every listed span counts.
    """
    role = F.transform("g", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"),
        F.exists("gold", lambda o: strictly_contains(o, s)).alias("inner"), F.exists("gold", lambda o: strictly_contains(s, o)).alias("outer"),
        (F.size(F.filter("gold", lambda o: strictly_contains(o, s))) + 1).alias("depth"), F.array_contains("p", s).alias("recovered"),
    ))
    return _sets(pairs).select("did", *by, F.explode(role).alias("x")).select("did", *by, "x.*")


def nested_recall(pairs: DataFrame, *by: str) -> DataFrame:
    """``subset, recovered, total``: recall counts of nested and of flat gold spans."""
    r = nesting_roles(pairs, *by)
    return r.groupBy(*by, F.when(F.col("inner") | F.col("outer"), "nested").otherwise("flat").alias("subset")).agg(F.count_if("recovered").alias("recovered"), F.count("*").alias("total"))


def error_rates(pairs: DataFrame, *by: str) -> DataFrame:
    """Misses of inner and outer spans, and containing pairs recovered on both sides, with their totals."""
    one = [] if by else ["_one"]  # without groups both sides are one row, joined by a constant
    if one:
        pairs = pairs.withColumn("_one", F.lit(1))
    keys = (*by, *one)
    sets = _sets(pairs)
    both = F.flatten(F.transform("gold", lambda a: F.transform(F.filter("gold", lambda b: strictly_contains(b, a)), lambda b: F.array_contains("p", a) & F.array_contains("p", b))))
    counted = sets.select(*keys, both.alias("b")).select(*keys, F.size("b").alias("pairs"), F.size(F.filter("b", lambda x: x)).alias("both")).groupBy(*keys).agg(F.sum("pairs").alias("pairs"), F.sum("both").alias("pairs_recovered"))
    roles = nesting_roles(pairs, *keys).groupBy(*keys).agg(F.count_if(F.col("inner") & ~F.col("recovered")).alias("inner_missed"), F.count_if("inner").alias("inner"), F.count_if(F.col("outer") & ~F.col("recovered")).alias("outer_missed"), F.count_if("outer").alias("outer"))
    return roles.join(counted, [*by, *one]).drop(*one)


def depth_recall(pairs: DataFrame, *by: str) -> DataFrame:
    return nesting_roles(pairs, *by).groupBy(*by, "depth").agg(F.count_if("recovered").alias("recovered"), F.count("*").alias("total"))


def span_sets(pairs: DataFrame, *by: str) -> DataFrame:
    """Sizes of the set operations on gold and predicted spans, and whether all gold is recovered."""
    s = _sets(pairs)
    return s.select("did", *by, F.size(F.array_intersect("g", "p")).alias("common"), F.size(F.array_except("g", "p")).alias("only_gold"), F.size(F.array_except("p", "g")).alias("only_pred"), F.size(F.array_union("g", "p")).alias("either"), (F.size(F.array_except("g", "p")) == 0).alias("all_recovered"))
