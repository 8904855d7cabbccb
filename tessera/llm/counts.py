"""Counts of every term and n-gram by sorted suffixes (problem 2)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import shuffle_width

_SUFFIX = "grp string, suffix array<string>, known int, n bigint"


def suffixes(records: DataFrame, group: str, key: str, units: str, longest: int) -> DataFrame:
    """``grp, suffix, known, n``: every suffix of every record cut to ``longest`` units, counted within each batch.

    ``known`` is the length of the longest prefix of the suffix that began earlier in
    the same record too. A prefix of length k is thus new to its record just where
    ``k > known``, and record sets become plain sums: no set of records is ever kept.
    Null units end a suffix; records whose key or units are null give nothing; a
    repeated key counts once.
    """
    one = records.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("k"), F.col(units).alias("u")).where("k is not null and u is not null").dropDuplicates(["k"]).drop("k")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for grp, us in zip(pdf["grp"], pdf["u"], strict=True):
                us = list(us)
                if longest == 1:
                    for t, n in Counter(us).items():
                        if t is not None:
                            seen[grp, (t,), 0] += 1
                            if n > 1:
                                seen[grp, (t,), 1] += n - 1
                    continue
                begun: set = set()
                for i in range(len(us)):
                    s = tuple(us[i : i + longest])
                    if None in s:
                        s = s[: s.index(None)]
                    if not s:
                        continue
                    known = 0
                    while known < len(s) and s[: known + 1] in begun:
                        known += 1
                    begun.update(s[:k] for k in range(known + 1, len(s) + 1))
                    seen[grp, s, known] += 1
            if seen:
                yield pd.DataFrame({"grp": [g for g, _, _ in seen], "suffix": [list(s) for _, s, _ in seen], "known": [k for _, _, k in seen], "n": list(seen.values())})

    return one.mapInPandas(emit, _SUFFIX)


def stack_counts(suffix_rows: DataFrame, salts: int = 16) -> DataFrame:
    """``grp, gram, occurrences, records`` of every prefix of the given suffixes.

    Suffixes are routed by their first term, sorted in reverse lexicographic order
    within each partition, and read once with a stack that holds the open prefixes; a
    prefix is complete when a suffix arrives that doesn't begin with it. The second term salts
    the route, so a first term that is in a third of all rows is split; only the counts
    of single terms, one row per route, are then added up. A null group is a group of its own.
    """
    width = max(shuffle_width(suffix_rows.sparkSession), 1)
    routed = (
        suffix_rows.select("*", F.element_at("suffix", 1).alias("t0"), F.pmod(F.xxhash64(F.try_element_at("suffix", F.lit(2))), F.lit(salts)).alias("salt"))
        .repartition(width, "grp", "t0", "salt")
        .sortWithinPartitions("grp", "salt", F.col("suffix").desc())
        .select("grp", "salt", "suffix", "known", "n")
    )

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, path, occ, rec = None, [], [], []  # occ[i], rec[i]: so far, of the prefix path[: i + 1]
        out: list[tuple] = []

        def close(depth: int) -> None:
            while len(path) > depth:
                o, r = occ.pop(), rec.pop()
                out.append((at[0], list(path), o, r))
                path.pop()
                if occ:
                    occ[-1] += o

        for pdf in batches:
            for grp, salt, suffix, known, n in zip(pdf["grp"], pdf["salt"], pdf["suffix"], pdf["known"], pdf["n"], strict=True):
                s = list(suffix)
                if at != (grp, salt):
                    if at is not None:
                        close(0)
                    at = (grp, salt)
                same = 0
                while same < len(path) and same < len(s) and path[same] == s[same]:
                    same += 1
                close(same)
                for t in s[same:]:
                    path.append(t)
                    occ.append(0)
                    rec.append(0)
                occ[-1] += n
                for i in range(known, len(s)):
                    rec[i] += n
            if len(out) > 20_000:
                yield _frame(out)
                out.clear()
        if at is not None:
            close(0)
        if out:
            yield _frame(out)

    parts = routed.mapInPandas(reduce, "grp string, gram array<string>, occurrences bigint, records bigint")
    return parts.groupBy("grp", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["grp", "gram", "occurrences", "records"])


def ngram_counts(records: DataFrame, group: str, key: str, units: str, longest: int) -> DataFrame:
    """Occurrences and records of every n-gram of up to ``longest`` units, by group."""
    return stack_counts(suffixes(records, group, key, units, longest))


def unit_marks(docs: DataFrame, rare_records: int = 2, common_percent: int = 15) -> DataFrame:
    """``dataset, token, occurrences, records, rare, common`` over ``docs.units``.

    Rare: in at most ``rare_records`` records; common: in more than ``common_percent`` of a hundred of the dataset's records.
    """
    counts = ngram_counts(docs, "dataset", "did", "units", 1)
    total = docs.select(F.col("dataset").alias("d"), "did").where("did is not null").distinct().groupBy("d").agg(F.count("*").alias("n"))
    return counts.join(total, F.col("grp").eqNullSafe(F.col("d"))).select(
        F.col("grp").alias("dataset"), F.element_at("gram", 1).alias("token"), "occurrences", "records",
        (F.col("records") <= rare_records).alias("rare"), (F.col("records") * 100 > F.col("n") * common_percent).alias("common"),
    )


def saved_marks(token_stats: DataFrame, rare_total: int = 2, common_percent: int = 1) -> DataFrame:
    """``dataset, token, total, rare, common`` over saved counts; a null count means 0, a row saved twice counts once.

    The saved rows enter the same sorted reduction as suffixes of length one that carry their count.
    Rare: a total of at most ``rare_total``; common: more than ``common_percent`` of a hundred of all the dataset's counts.
    """
    once = token_stats.where("token is not null").dropDuplicates(["dataset", "shard", "token"])
    n = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("n_c", "n_o")), F.coalesce(F.col("n_e"), F.lit(0)))
    rows = once.select(F.col("dataset").alias("grp"), F.array("token").alias("suffix"), F.lit(1).alias("known"), n.cast("bigint").alias("n"))
    counts = stack_counts(rows)
    total = once.select(F.col("dataset").alias("d"), n.alias("n")).groupBy("d").agg(F.sum("n").alias("all"))
    return counts.join(total, F.col("grp").eqNullSafe(F.col("d"))).select(
        F.col("grp").alias("dataset"), F.element_at("gram", 1).alias("token"), F.col("occurrences").alias("total"),
        (F.col("occurrences") <= rare_total).alias("rare"), (F.col("occurrences") * 100 > F.col("all") * common_percent).alias("common"),
    )


def found(docs: DataFrame, token_stats: DataFrame) -> DataFrame:
    """``src_field, dataset, token, mark`` as TESTDATA.md defines them for problem 2."""

    def marked(df: DataFrame, field: str) -> DataFrame:
        kinds = F.array(*[F.when(F.col(m), F.lit(m)) for m in ("rare", "common")])
        return df.select(F.lit(field).alias("src_field"), "dataset", "token", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("mark"))

    return marked(unit_marks(docs), "units").unionByName(marked(saved_marks(token_stats), "counts"))
