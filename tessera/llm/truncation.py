"""Answers that stop before they are complete, found by how their last words end other texts (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut

#: Marks a kind that stands for a word.
_MARK = "\u0001"
#: A word, a number, one ideograph or one sign; white space only separates.
TOKEN = "[\\p{L}&&[^\\p{IsHan}]]+|\\p{N}+|\\p{IsHan}|[^\\s\\p{L}\\p{N}]"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _once(value: Column) -> Column:
    """``value`` evaluated once a row: a generator keeps the optimizer from copying it to each place of use."""
    return F.explode(F.array(value))


def known_words(answers: DataFrame, text: str, share: float) -> list[str]:
    """Tokens that stand, other than at the end, in at least ``share`` of all rows; mean tokens a row / ``share`` bounds their number.

    The rest are names, and words cut off in the middle.
    """
    toks = answers.select(_once(_tokens(F.col(text))).alias("t")).where("size(t) > 1")
    per_row = toks.select(F.explode(F.array_distinct(F.slice("t", F.lit(1), F.size("t") - 1))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = answers.where(F.col(text).isNotNull()).count()
    return sorted(r.w for r in per_row.where(F.col("n") >= F.greatest(F.lit(5), F.lit(share * total))).select("w").collect() if not r.w.isdecimal())


def _kind(t: Column) -> Column:
    """Number, Han or Latin (any other letters) by the first code point; null for signs."""
    c = F.ascii(t)
    han = c.between(0x2E80, 0x2FDF) | c.between(0x3400, 0x9FFF) | c.between(0xF900, 0xFAFF) | (c >= 0x20000)
    sign = (c < 0x41) | c.between(0x5B, 0x60) | c.between(0x7B, 0xA9) | c.between(0x2000, 0x2BFF) | c.between(0x3000, 0x303F) | (c >= 0xFE10)
    return F.when(c.between(0x30, 0x39), "0").when(han, "汉").when(~sign, "w")


def _rows(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``key, lead, t``: the tokens of each answer and, if the first is a sign, that sign: a fenced answer ends in another way than a bare one."""
    toks = answers.where(f"{key} is not null and {text} is not null").select(F.col(key).alias("key"), _once(_tokens(F.col(text))).alias("t")).where("size(t) > 0")
    return toks.select("key", F.when(_kind(F.element_at("t", 1)).isNull(), F.element_at("t", 1)).otherwise("a").alias("lead"), "t")


def _coded(tokens: Column, words: list[str]) -> Column:
    """Known words and signs as they are, other words as a marked kind."""
    return F.transform(tokens, lambda t: F.when(t.isin(words), t).otherwise(F.coalesce(F.concat(F.lit(_MARK), _kind(t)), t)))


def _judged(trigrams: DataFrame) -> DataFrame:
    """Adds ``fine``, a hash of the trigram as coded, ``coarse``, one with every word as its kind, and ``known``: the last token stands for itself."""
    kinds = [F.coalesce(F.concat(F.lit(_MARK), _kind(F.col(c))), F.col(c), F.lit("^")) for c in "xyz"]
    return trigrams.select("*", F.xxhash64("lead", *[F.coalesce(F.col(c), F.lit("^")) for c in "xyz"]).alias("fine"), F.xxhash64("lead", *kinds).alias("coarse"), (~F.col("z").startswith(_MARK)).alias("known"))


def ending_table(rows: DataFrame, words: list[str], max_end_share: float, few: int = 20) -> DataFrame:
    """``fine, ends, inner``: how often each trigram ends a text, and whether it belongs inside texts.

    It does if at most ``max_end_share`` of its occurrences are ends. Trigrams of fewer than ``few`` occurrences, and those
    that end in a word that isn't known, are judged by their kinds instead. Trigrams are counted as they are coded; kinds are made of the counts.
    """
    n = F.size("f") - 1
    each = rows.select("lead", _once(_coded(F.col("t"), words)).alias("f")).select("lead", "f", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    grams = each.select("lead", F.get("f", F.col("i") - 2).alias("x"), F.get("f", F.col("i") - 1).alias("y"), F.get("f", F.col("i")).alias("z"), (F.col("i") == n).alias("end"))
    fine = cut(_judged(grams.groupBy("lead", "x", "y", "z").agg(F.count("*").alias("all"), F.count_if("end").alias("ends"))).select("fine", "coarse", "known", "all", "ends"))
    coarse = fine.groupBy("coarse").agg(F.sum("all").alias("all_c"), F.sum("ends").alias("ends_c"))
    own = F.col("known") & (F.col("all") >= few)
    inner = F.when(own, F.col("ends") <= max_end_share * F.col("all")).otherwise(F.col("ends_c") <= max_end_share * F.col("all_c"))
    return fine.where("ends > 0").join(coarse, "coarse").select("fine", "ends", inner.alias("inner"))


def truncated(answers: DataFrame, key: str = "key", text: str = "text", max_end_share: float = 0.03, word_share: float = 0.002, hot_share: float = 0.01) -> DataFrame:
    """``key`` of every answer whose last trigram is common inside texts but almost never ends one.

    All answers are counted whole; empty, blank and null texts and null keys are never flagged; a key is returned
    once. The few trigrams that end at least ``hot_share`` of all texts (no more than 1 / ``hot_share`` of them) are decided
    by literals, so no join key is hot.
    """
    words = known_words(answers, text, word_share)
    rows = _rows(answers, key, text)
    table = cut(ending_table(rows, words, max_end_share))
    total = table.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    hot = table.where(F.col("ends") >= F.greatest(F.lit(1000), F.lit(hot_share * total))).groupBy("fine").agg(F.max("inner").alias("inner")).collect()
    names, inner = [r.fine for r in hot], [r.fine for r in hot if r.inner]
    tail = rows.select("key", "lead", _once(_coded(F.slice("t", F.greatest(F.size("t") - 2, F.lit(1)), F.lit(3)), words)).alias("f"))
    last = _judged(tail.select("key", "lead", F.get("f", F.size("f") - 3).alias("x"), F.get("f", F.size("f") - 2).alias("y"), F.element_at("f", -1).alias("z"))).select("key", "fine")
    rest = last.where(~F.col("fine").isin(names)).join(table.where("inner").select("fine"), "fine", "left_semi")
    return rest.select("key").unionByName(last.where(F.col("fine").isin(inner)).select("key")).distinct()


def rates(answers: DataFrame, runs: DataFrame, cut_keys: DataFrame) -> DataFrame:
    """``model, answers, truncated, truncated_pm``: distinct keys and per mille truncated, by model; unknown runs under a null model."""
    one = answers.where("key is not null").groupBy("key").agg(F.min("run_id").alias("run_id")).join(cut_keys.withColumn("cut", F.lit(1)), "key", "left")
    per_run = one.groupBy("run_id").agg(F.count("*").alias("answers"), F.count("cut").alias("truncated"))
    named = per_run.join(runs.select("run_id", "model").dropDuplicates(["run_id"]), "run_id", "left")
    return named.groupBy("model").agg(F.sum("answers").alias("answers"), F.sum("truncated").alias("truncated")).withColumn("truncated_pm", F.floor(F.col("truncated") * 1000 / F.col("answers")))
