"""Queries of the training-data problems over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import calibrate, counts, forms, leaks, mixing, splits, subjects, truncation, vectors
from tessera.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.found(table(spark, d, "docs"), table(spark, d, "terms"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return forms.look_alike_classes(forms.text_forms(table(spark, d, "docs")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return counts.found(table(spark, d, "docs"), table(spark, d, "token_stats"))


def p2_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return counts.ngram_counts(table(spark, d, "docs"), "dataset", "did", "units", 3).where("records > 1")


def p2_ngram_marks(spark: SparkSession, d: str) -> DataFrame:
    """All n-grams of up to three units; ``rare`` marks those of at most two records."""
    return counts.ngram_counts(table(spark, d, "docs"), "dataset", "did", "units", 3).withColumn("rare", F.col("records") <= 2)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.found(table(spark, d, "docs"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_report(table(spark, d, "docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.found(table(spark, d, "text_vec"))


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return calibrate.sample(table(spark, d, "docs"), table(spark, d, "entity_types"), table(spark, d, "sample_plans"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].where("not reachable").select("plan_id", "code")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "llm_cache"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "llm_cache")
    return truncation.rates(answers, table(spark, d, "runs"), truncation.truncated(answers))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_counts(p7_found(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).where("short").select("plan_id", "source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_plans"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    _, cuts, filled, _ = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_plans"))
    return mixing.mixed_records(cuts, filled)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects(spark, d).select("doc_id", "subject")


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), subjects.terms_of(table(spark, d, "subjects")))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p9_subjects(spark, d), table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_ngrams, p2_ngram_marks, p3_found, p3_report, p4_found, p5_found, p5_sample, p5_report, p6_found, p6_rates, p7_found, p7_items, p8_found, p8_shares, p8_mix, p9_found, p9_subjects, p9_composition)}


_TYPE_KEY = "regexp_replace(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', '_', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH d AS (SELECT did, any_value(dataset) AS dataset, any_value(units) AS units FROM docs WHERE did IS NOT NULL GROUP BY did),
                 n AS (SELECT dataset, count(*) AS n FROM d GROUP BY dataset),
                 u AS (SELECT dataset, token, count(DISTINCT did) AS r FROM (SELECT dataset, did, unnest(units) AS token FROM d) WHERE token IS NOT NULL GROUP BY dataset, token),
                 s AS (SELECT DISTINCT dataset, shard, token, coalesce(n_e, 0) + coalesce(n_c, 0) + coalesce(n_o, 0) AS n FROM token_stats WHERE token IS NOT NULL),
                 a AS (SELECT dataset, sum(n) AS n FROM s GROUP BY dataset),
                 c AS (SELECT dataset, token, sum(n) AS t FROM s GROUP BY dataset, token)
            SELECT 'units' AS src_field, dataset, token, 'rare' AS mark FROM u WHERE r <= 2
            UNION ALL SELECT 'units', u.dataset, token, 'common' FROM u JOIN n ON u.dataset IS NOT DISTINCT FROM n.dataset WHERE 100 * r > 15 * n.n
            UNION ALL SELECT 'counts', dataset, token, 'rare' FROM c WHERE t <= 2
            UNION ALL SELECT 'counts', c.dataset, token, 'common' FROM c JOIN a ON c.dataset IS NOT DISTINCT FROM a.dataset WHERE 100 * t > a.n""",
        "p2_ngrams": """
            WITH d AS (SELECT did, any_value(dataset) AS dataset, any_value(units) AS units FROM docs WHERE did IS NOT NULL AND units IS NOT NULL GROUP BY did),
                 p AS (SELECT dataset, did, units, unnest(generate_series(1, len(units))) AS i FROM d),
                 g AS (SELECT dataset, did, units[i:i + k - 1] AS gram FROM p, (VALUES (1), (2), (3)) AS w(k) WHERE i + k - 1 <= len(units))
            SELECT dataset AS grp, gram, count(*) AS occurrences, count(DISTINCT did) AS records FROM g GROUP BY dataset, gram HAVING count(DISTINCT did) > 1""",
        "p2_ngram_marks": """
            WITH d AS (SELECT did, any_value(dataset) AS dataset, any_value(units) AS units FROM docs WHERE did IS NOT NULL AND units IS NOT NULL GROUP BY did),
                 p AS (SELECT dataset, did, units, unnest(generate_series(1, len(units))) AS i FROM d),
                 g AS (SELECT dataset, did, units[i:i + k - 1] AS gram FROM p, (VALUES (1), (2), (3)) AS w(k) WHERE i + k - 1 <= len(units))
            SELECT dataset AS grp, gram, count(*) AS occurrences, count(DISTINCT did) AS records, count(DISTINCT did) <= 2 AS rare FROM g GROUP BY dataset, gram""",
        "p5_found": f"""
            WITH d AS (SELECT did, any_value(dataset) AS dataset, any_value(entities) AS entities FROM docs WHERE did IS NOT NULL AND split = 'train' GROUP BY did),
                 m AS (SELECT dataset, {_TYPE_KEY.format('e.type')} AS tk FROM (SELECT dataset, unnest(entities) AS e FROM d) WHERE e.type IS NOT NULL),
                 names AS (SELECT DISTINCT dataset, code, {_TYPE_KEY.format('unnest([code, full_name])')} AS tk FROM entity_types),
                 t AS (SELECT dataset, count(*) AS n FROM m GROUP BY dataset),
                 k AS (SELECT m.dataset, code, count(*) AS n FROM m JOIN names ON m.dataset = names.dataset AND m.tk = names.tk GROUP BY m.dataset, code)
            SELECT DISTINCT p.plan_id, p.code FROM sample_plans p LEFT JOIN t ON p.dataset = t.dataset LEFT JOIN k ON p.dataset = k.dataset AND p.code = k.code
            WHERE coalesce(k.n, 0) * 1000000 < p.share_pm * p.fraction_pm * coalesce(t.n, 0) OR coalesce(k.n, 0) < p.min_mentions""",
    }
