"""Printed forms: one string for all texts that look the same (problem 1)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chars import needs_form, printed_rows
from tessera.runtime import broadcast_if_small, cut, digest


def _mapping(spark: SparkSession) -> DataFrame:
    """Code point -> printed code points with combining classes; its size is fixed by the Unicode version."""
    return spark.createDataFrame(printed_rows(), "c string, to array<struct<c: string, k: int>>")


def _ordered(points: list[str]) -> list[str]:
    """Code points with each run of marks in the order of their combining classes; marks of one class keep their order."""
    out, run = [], []
    for c in points:
        k = unicodedata.combining(c)
        if k:
            run.append((k, c))
            continue
        out += [x for _, x in sorted(run, key=lambda r: r[0])]
        run = []
        out.append(c)
    return out + [x for _, x in sorted(run, key=lambda r: r[0])]


def _recompose(column: Column) -> Column:
    """Marks ordered by class and joined with their letters where one code point exists for both; nulls stay."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", "".join(_ordered(list(x)))), na_action="ignore")

    return compose(column)


def visual_forms(df: DataFrame, key: list[str], text: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """``key``, the columns of ``keep`` and ``form``, one row for each row of ``df``; ``key`` must be unique.

    Texts that may differ from their printed form, known by one regular expression, are exploded to positioned code
    points and joined with the broadcast table of decompositions and look-alikes; others are one piece, which the table
    doesn't have. The pieces are put together in order; where marks came up, they are ordered by combining class and
    recomposed. Rows whose text is null get a null form; the empty text, and one of hidden characters only, the empty
    form. ``keep`` gives expressions over ``df`` that are carried along (small ones: they travel with each code point).
    If ``df`` is partitioned by ``key``, nothing moves.
    """
    keep = keep or {}
    names = [*key, *keep]
    base = df.select(*key, *[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
    pieces = F.when(needs_form(F.col("_text")), F.split("_text", "")).otherwise(F.array("_text"))
    points = (
        base.select(*names, F.posexplode(pieces).alias("_pos", "c"))
        .join(F.broadcast(_mapping(df.sparkSession)), "c", "left")
        .select(*names, "_pos", "c", F.posexplode_outer("to").alias("_sub", "x"), F.col("to").isNotNull().alias("_mapped"))
        .select(*names, F.struct((F.col("_pos") * 32 + F.coalesce("_sub", F.lit(0))).alias("at"), F.when(F.col("_mapped"), F.coalesce("x.c", F.lit(""))).otherwise(F.col("c")).alias("c")).alias("_p"), F.coalesce("x.k", F.lit(0)).alias("_k"))
    )
    whole = points.groupBy(*key).agg(*[F.first(n).alias(n) for n in keep], F.max("_k").alias("_marks"), F.sort_array(F.collect_list("_p")).alias("_all"))
    joined = whole.select(*names, "_marks", F.when(F.size(F.filter("_all", lambda p: p["c"].isNotNull())) > 0, F.array_join("_all.c", "")).alias("_s"))
    return joined.select(*names, F.coalesce(_recompose(F.when(F.col("_marks") > 0, F.col("_s"))), F.col("_s")).alias("form"))


def text_forms(docs: DataFrame) -> DataFrame:
    """``did, raw, form`` for each document with a key and a text; both are digests, and equal forms mean equal looks.

    A repeated ``did`` counts once (its repetitions are the same record); null keys and null texts take no part. The
    digests are written once, as all that follows reads them several times.
    """
    one = docs.select("did", "text").where("did is not null and text is not null").dropDuplicates(["did"])
    forms = visual_forms(one, ["did"], "text", {"raw": digest(F.col("text"))})
    return cut(forms.select("did", "raw", digest(F.col("form")).alias("form")))


def look_alike_classes(forms: DataFrame) -> DataFrame:
    """``did, class_id, variants, n_links``: one row per document whose printed form occurs in more than one spelling.

    ``class_id`` is the smallest ``did`` of the class, ``n_links`` the number of documents of the class spelled differently.
    Counts are aggregated before anything is joined, so a class of any size is never in one place.
    """
    spelled = forms.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("did").alias("least"))
    classes = spelled.groupBy("form").agg(F.count("*").alias("variants"), F.sum("n").alias("total"), F.min("least").alias("class_id")).where("variants > 1")
    return forms.join(spelled.select("form", "raw", "n"), ["form", "raw"]).join(classes, "form").select("did", "class_id", "variants", (F.col("total") - F.col("n")).alias("n_links"))


def look_alike_texts(forms: DataFrame) -> DataFrame:
    """``key_a, key_b``: all pairs of documents that look the same but are not equal strings.

    Only forms with several spellings reach the join, which is on form and on differing spelling.
    """
    mixed = forms.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    part = forms.join(mixed, "form", "left_semi")
    a, b = part.select("form", F.col("did").alias("key_a"), F.col("raw").alias("raw_a")), part.select("form", F.col("did").alias("key_b"), F.col("raw").alias("raw_b"))
    return a.join(b, "form").where("key_a < key_b and raw_a <> raw_b").select("key_a", "key_b")


def disguised_names(docs: DataFrame, terms: DataFrame, max_terms: int = 100_000) -> DataFrame:
    """``key_a, key_b``: mentions (``did:position``) whose surface prints like a listed name but equals none.

    Null surfaces, null names and mentions of documents without a key take no part; a repeated ``did`` counts once.
    Surfaces are reduced to distinct strings before their forms are made. The names are broadcast only up to ``max_terms``.
    """
    one = docs.select("did", "entities").where("did is not null and entities is not null").dropDuplicates(["did"])
    said = one.select("did", F.posexplode("entities").alias("j", "e")).select("did", "j", F.col("e.surface").alias("surface")).where("surface is not null")
    names = terms.select("term_id", "name").where("name is not null and term_id is not null")
    spelled = names.select("name").distinct()
    listed = visual_forms(spelled, ["name"], "name").join(names, "name").select("form", "term_id").distinct()
    distinct = said.select("surface").distinct().join(broadcast_if_small(spelled, max_terms), F.col("surface") == F.col("name"), "left_anti")
    looked = visual_forms(distinct, ["surface"], "surface").join(broadcast_if_small(listed, max_terms), "form").select("surface", "term_id")
    return said.join(looked, "surface").select(F.concat_ws(":", "did", F.col("j").cast("string")).alias("key_a"), F.col("term_id").cast("string").alias("key_b")).distinct()


def found(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``kind, key_a, key_b`` as TESTDATA.md defines them for problem 1."""
    texts = look_alike_texts(text_forms(docs)).select(F.lit("text").alias("kind"), "key_a", "key_b")
    return texts.unionByName(disguised_names(docs, terms).select(F.lit("surface").alias("kind"), "key_a", "key_b"))
