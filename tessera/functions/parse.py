"""Column functions that read entities out of generated text; they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "array<struct<name: string, type: string>>"
_EDGE = "(?U)^\\s+|\\s+$"
# The markers before a final answer.
FINAL = ("Final predicted", "最终预测实体")
UPDATED = ("Updated Predicted Entity", "修正后的预测实体")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE, "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _json(c: Column) -> Column:
    return F.try_parse_json(F.nullif(c, F.lit("")))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _items(obj: Column) -> Column:
    """The list under ``named_entities``, or under its spelling with a blank if the first is absent; null if it is no list."""
    raw = lambda o: F.coalesce(F.try_variant_get(o, "$.named_entities", "variant"), F.try_variant_get(o, '$["named entities"]', "variant"))
    return _let(obj, lambda o: _let(F.when(_is(o, "OBJECT"), raw(o)), lambda r: F.when(_is(r, "ARRAY"), r.cast("array<variant>"))))


def _text(item: Column, key: str) -> Column:
    """A string member; null if it is missing or no string."""
    return _let(F.try_variant_get(item, f"$.{key}", "variant"), lambda v: F.when(_is(v, "STRING"), v.cast("string")))


def generated_entities(text: Column) -> Column:
    """Entities of a generation answer: without fences, the whole string as JSON, else from the first brace to the last.

    Items that are no objects, lack a string name or type, or have a blank name are dropped; empty and null texts give none.
    """
    bare = strip(F.regexp_replace(strip(F.regexp_replace(strip(text), "^```(?:json)?", "")), "```$", ""))
    obj = _let(bare, lambda b: F.coalesce(_json(b), _json(F.regexp_extract(b, "(?s)\\{.*\\}", 0))))
    items = F.transform(_items(obj), lambda x: F.struct(F.when(_is(x, "OBJECT"), strip(_text(x, "name"))).alias("name"), F.when(_is(x, "OBJECT"), strip(_text(x, "type"))).alias("type")))
    return F.coalesce(F.filter(items, lambda e: e["name"].isNotNull() & (e["name"] != "") & e["type"].isNotNull()), F.array().cast(ITEM))


def _after(text: Column, markers: tuple[str, str]) -> Column:
    """From the last of either marker on; all of it without one."""
    at = F.greatest(*[F.when(F.instr(text, m) > 0, F.length(text) - F.instr(F.reverse(text), m[::-1]) - len(m) + 2).otherwise(0) for m in markers])
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)


def _loose_type(item: Column) -> Column:
    """The type as text: missing gives the empty string, null the word None, others their JSON text."""
    return _let(F.try_variant_get(item, "$.type", "variant"), lambda v: F.when(v.isNull(), "").when(_is(v, "VOID"), "None").otherwise(strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))))


def reflected_entities(text: Column) -> Column:
    """Entities of a reflection answer: one greedy object after the last final marker; names must be strings that aren't blank."""
    obj = _json(F.regexp_extract(_after(text, FINAL), "(?s)\\{.*\\}", 0))
    items = F.transform(_items(obj), lambda x: F.struct(F.when(_is(x, "OBJECT"), strip(_text(x, "name"))).alias("name"), _loose_type(x).alias("type")))
    return F.coalesce(F.filter(items, lambda e: e["name"].isNotNull() & (e["name"] != "")), F.array().cast(ITEM))


def boundary_decision(text: Column) -> Column:
    """``struct<action, name, type>``: the last object after the marker that can be read; keep, delete (an empty object) or entity."""
    blobs = F.reverse(F.regexp_extract_all(_after(text, UPDATED), F.lit("(?s)\\{.*?\\}"), F.lit(0)))

    def decided(o: Column, name: Column) -> Column:
        named = name.isNotNull() & (name != "")
        action = F.when(F.schema_of_variant(o) == "OBJECT<>", "delete").when(named, "entity")
        return F.struct(action.alias("action"), F.when(named, name).alias("name"), F.when(named, _loose_type(o)).alias("type"))

    read = lambda b: _let(_json(b), lambda o: _let(strip(_text(o, "name")), lambda n: decided(o, n)))
    first = F.get(F.filter(F.transform(blobs, read), lambda d: d["action"].isNotNull()), F.lit(0))
    return F.coalesce(first, F.struct(F.lit("keep").alias("action"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type")))
