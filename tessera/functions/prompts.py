"""Prompt texts as column expressions; the wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A JSON string literal; non-ASCII characters stay."""
    s = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))


def entities_json(items: Column) -> Column:
    """``{"named_entities": [{"name": .., "type": ..}]}`` with a blank after each comma and colon."""
    each = F.transform(items, lambda e: F.concat(F.lit('{"name": '), quoted(e["name"]), F.lit(', "type": '), quoted(e["type"]), F.lit("}")))
    return F.concat(F.lit('{"named_entities": ['), F.array_join(each, ", "), F.lit("]}"))


def types_phrase(types: Column, lang: str) -> Column:
    return F.array_join(F.transform(types, quoted), "、" if lang == "zh" else ", ")


# Fixed value: the format in which a token's statistics are shown.
TOKEN_STAT = '{"num_occurrences_as_entity": %d, "num_occurrences_as_context_tokens": %d, "num_occurrences_as_other_tokens": %d, "entity_vs_context_count": "%d vs %d", "entity_vs_non_entity_count": "%d vs %d"}'


def token_stat_json(n_e: Column, n_c: Column, n_o: Column) -> Column:
    """Counts of a token by class, and the two comparisons a reader needs."""
    return F.format_string(TOKEN_STAT, n_e, n_c, n_o, n_e, n_c, n_e, n_c + n_o)


def list_repr(items: Column) -> Column:
    """A list of strings in single quotes, or in double ones where a string holds a single quote only."""
    one = lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))


WORDS = {
    "en": {"task": "Find all entities of the types {types} in the last input and answer with JSON alone.", "in": "Input", "out": "Output", "hint": "Hint"},
    "zh": {"task": "请找出最后一条输入中属于以下类型的全部实体：{types}，只用 JSON 回答。", "in": "输入", "out": "输出", "hint": "提示"},
}


def generation_prompt(sentence: Column, demos: Column, types: list[str] | Column, lang: str | Column = "en", hint: str | None = None) -> Column:
    """Task, demonstrations (``array<struct<text, ents>>``, most similar last) and the sentence, parted by blank lines.

    Types and language may be columns: then each row has its own; an unknown language is English.
    """
    if isinstance(lang, Column):
        return F.when(lang == "zh", generation_prompt(sentence, demos, types, "zh", hint)).otherwise(generation_prompt(sentence, demos, types, "en", hint))
    w = WORDS[lang]
    task, after = w["task"].split("{types}")
    head = F.concat(F.lit(task), types_phrase(types if isinstance(types, Column) else F.array(*[F.lit(t) for t in types]), lang), F.lit(after))
    shown = F.transform(demos, lambda d: F.concat(F.lit(f"{w['in']}: "), d["text"], F.lit(f"\n{w['out']}: "), entities_json(d["ents"])))
    tail = F.concat(F.lit(f"{w['in']}: "), sentence, F.lit(f"\n{w['out']}:"))
    parts = [head, F.lit('{"named_entities": [{"name": "...", "type": "..."}]}')] + ([F.lit(f"{w['hint']}: {hint}")] if hint else [])
    return F.array_join(F.concat(F.array(*parts), shown, F.array(tail)), "\n\n")


EXAMPLES = {
    "en": ("Inside an entity:", "Next to an entity:", "Elsewhere:"),
    "zh": ("在实体之内：", "在实体旁边：", "其他位置："),
}


def example_block(examples: Column, token: Column, default_type: Column, lang: str = "en") -> Column:
    """Examples of a token by class (``array<struct<cls, rank, text, name, type>>``), each text with the entity it is about.

    An example inside an entity without a name is about the token itself; one beside an entity without a name, and one elsewhere, about none.
    """
    w = WORDS[lang]

    def shown(e: Column) -> Column:
        own = F.concat(F.lit('{"name": '), quoted(F.coalesce(e["name"], token)), F.lit(', "type": '), quoted(F.coalesce(F.nullif(e["type"], F.lit("")), default_type)), F.lit("}"))
        out = F.when((e["cls"] == "entity") | ((e["cls"] == "context") & e["name"].isNotNull()), own).otherwise("{}")
        return F.concat(F.lit(f"{w['in']}: "), e["text"], F.lit(f"\n{w['out']}: "), out)

    def of(cls: str) -> Column:
        return F.transform(F.filter(F.array_sort(examples), lambda e: e["cls"] == cls), shown)

    parts = [x for head, cls in zip(EXAMPLES[lang], ("entity", "context", "other"), strict=True) for x in (F.array(F.lit(head)), of(cls))]
    return F.array_join(F.concat(*parts), "\n")


def cache_key(model: str, prompt: Column, temperature: float = 0.0, max_tokens: int = 1024, extra: str = "{}") -> Column:
    """SHA-256 of the canonical request."""
    return F.sha2(F.concat(F.lit(f'{{"extra_body": {extra}, "max_tokens": {max_tokens}, "messages": [{{"content": '), quoted(prompt), F.lit(f', "role": "user"}}], "model": "{model}", "temperature": {temperature}}}')), 256)
