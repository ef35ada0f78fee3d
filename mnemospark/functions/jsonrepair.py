"""Rows from what a language model answered: the list in it, however it is wrapped.

Four readings, each a row of the table below: the whole text, a fenced block, the first bracketed
part (the shortest, or the longest), and lines. They differ in whether an empty list is
accepted, how brackets are matched, and what lines are used for. Only complete JSON
counts; a bare object is no list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import stripped

#: How a list is found in an answer, fenced or by its brackets, the shortest or the longest.
_FENCE = r"(?s)```(?:json)?\s*(\[.*?\])\s*```"
_LAZY, _GREEDY = r"(?s)(\[.*?\])", r"(?s)(\[.*\])"


@dataclass(frozen=True)
class Reading:
    greedy: bool
    empty_fine: bool
    lines: int | None  # lines to fall back to at most; None: no fall-back, -1: all


STRINGS = Reading(greedy=False, empty_fine=True, lines=-1)
POINTS = Reading(greedy=True, empty_fine=True, lines=None)
SUB_QUERIES = Reading(greedy=False, empty_fine=False, lines=4)
STYLES = Reading(greedy=False, empty_fine=True, lines=5)
VARIANTS = Reading(greedy=True, empty_fine=False, lines=None)


def _list(text: Column, kind: str) -> Column:
    t = stripped(text)
    whole = F.get_json_object(t, "$").isNotNull()
    return F.when(t.startswith("[") & t.endswith("]") & whole, F.from_json(t, kind))


def _read(text: Column, reading: Reading, kind: str) -> Column:
    tries = [_list(text, kind), _list(F.regexp_extract(text, _FENCE, 1), kind), _list(F.regexp_extract(text, _GREEDY if reading.greedy else _LAZY, 1), kind)]
    if not reading.empty_fine:
        tries = [F.when(F.size(x) > 0, x) for x in tries]
    return F.coalesce(*tries)


def _lines(text: Column, most: int) -> Column:
    parts = F.transform(F.split(stripped(text), "\n"), lambda x: stripped(F.regexp_replace(stripped(x), r"^[-•*]+|[-•*]+$", "")))
    long = F.filter(parts, lambda x: F.length(x) > 10)
    return long if most < 0 else F.slice(long, 1, most)


def strings(text: str | Column) -> Column:
    """A list of strings; else its lines of more than 10 characters, without bullets."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_read(t, STRINGS, "array<string>"), _lines(t, -1))


def knowledge_points(text: str | Column) -> Column:
    """Objects with all of time, subject, fact and entities_or_values; [] if there is no list."""
    t = F.col(text) if isinstance(text, str) else text
    keys = ["time", "subject", "fact", "entities_or_values"]
    items = F.coalesce(_read(t, POINTS, "array<map<string,string>>"), F.expr("cast(array() as array<map<string,string>>)"))
    full = F.filter(items, lambda m: m.isNotNull() & F.map_contains_key(m, "time") & F.map_contains_key(m, "subject") & F.map_contains_key(m, "fact") & F.map_contains_key(m, "entities_or_values"))
    return F.transform(full, lambda m: F.struct(*(F.coalesce(m[k], F.lit("")).alias(k) for k in keys)))


def sub_queries(text: str | Column, raw_query: str | Column) -> Column:
    """``(query, keywords)`` of items that are strings or objects; else up to four lines; else the raw query."""
    t = F.col(text) if isinstance(text, str) else text
    q = F.col(raw_query) if isinstance(raw_query, str) else raw_query
    pair = lambda a, b: F.struct(a.alias("query"), F.coalesce(b, F.lit("")).alias("keywords"))
    item = lambda x: F.when(x.startswith("{"), pair(F.get_json_object(x, "$.query"), F.get_json_object(x, "$.keywords"))).otherwise(pair(x, F.lit(None).cast("string")))
    read = F.filter(F.transform(_read(t, SUB_QUERIES, "array<string>"), item), lambda s: stripped(s["query"]) != "")
    lines = F.transform(_lines(t, 4), lambda x: pair(x, F.lit(None).cast("string")))
    return F.coalesce(F.when(F.size(read) > 0, read), F.when(F.size(lines) > 0, lines), F.array(pair(q, F.lit(None).cast("string"))))


def styles(text: str | Column, names: list[str]) -> Column:
    """A map from the style names to texts by position; fewer than needed come from lines, missing ones are empty."""
    t = F.col(text) if isinstance(text, str) else text
    n = len(names)
    read = _read(t, STYLES, "array<string>")
    got = F.when(F.size(read) >= n, F.slice(read, 1, n)).otherwise(_lines(t, n))
    padded = F.slice(F.concat(F.coalesce(got, F.array().cast("array<string>")), F.array_repeat(F.lit(""), n)), 1, n)
    return F.map_from_arrays(F.array(*map(F.lit, names)), padded)


def notes(text: str | Column) -> Column:
    """``(title, key_insight, content, tags)`` of objects with title and content; tags always a list."""
    t = F.col(text) if isinstance(text, str) else text
    items = F.coalesce(_read(t, VARIANTS, "array<map<string,string>>"), F.expr("cast(array() as array<map<string,string>>)"))
    fine = F.filter(items, lambda m: m.isNotNull() & (F.coalesce(m["title"], F.lit("")) != "") & (F.coalesce(m["content"], F.lit("")) != ""))
    tags = lambda x: F.when(x.isNull(), F.array().cast("array<string>")).when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    return F.transform(fine, lambda m: F.struct(m["title"].alias("title"), F.coalesce(m["key_insight"], F.lit("")).alias("key_insight"), m["content"].alias("content"), tags(m["tags"]).alias("tags")))


def variants(text: str | Column) -> Column:
    """Non-blank strings of a non-empty list, without blanks around them."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.coalesce(_read(t, VARIANTS, "array<string>"), F.array().cast("array<string>")), lambda x: stripped(x)), lambda x: x != "")
