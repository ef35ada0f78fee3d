"""Splitting, packing and formatting of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def stripped(c: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", "")


def plain_name(c: str | Column) -> Column:
    """In small letters, without white space at both ends: how ids and names of sources are compared."""
    return F.lower(stripped(c))


def windows(text: str | Column, size: int, step: int | None = None) -> Column:
    """Sliding windows over characters: one for texts up to ``size``, else one every ``step`` (half the size) to the end."""
    t = F.col(text) if isinstance(text, str) else text
    step = step or size // 2
    n = F.when(F.length(t) <= size, 0).otherwise(F.ceil((F.length(t) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(t, i * step + 1, F.lit(size)))


def format_turn(turn: Column) -> Column:
    """``speaker: text``; null for a blank text."""
    return F.when(stripped(turn["text"]) != "", F.concat(F.coalesce(turn["speaker"], F.lit("")), F.lit(": "), turn["text"]))


def session_text(turns: str | Column) -> Column:
    """The turns with text, a line each."""
    t = F.col(turns) if isinstance(turns, str) else turns
    return F.array_join(F.filter(F.transform(t, format_turn), lambda x: x.isNotNull()), "\n")


def token_estimate(text: str | Column) -> Column:
    """Three characters a token, rounded down: the default where no tokenizer is given."""
    return F.floor(F.length(F.col(text) if isinstance(text, str) else text) / 3.0).cast("bigint")


def truncate_tokens(text: str | Column, tokens: int) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(token_estimate(t) > tokens, F.concat(F.substring(t, 1, 3 * tokens), F.lit("..."))).otherwise(t)


_TURNS = "array<struct<speaker:string,text:string>>"
_CHUNKS = "array<struct<chunk_index:int,turn_start:int,turn_end:int,text:string>>"


def turn_chunks(turns: str | Column, limit: int = 480) -> Column:
    """Turns packed greedily into chunks of up to ``limit`` tokens, never splitting one: an array of
    ``(chunk_index, turn_start, turn_end, text)``. Turns keep their index in ``turns``, of which blank ones are in no chunk. A line
    break between two turns counts its tokens, none by this estimate. Without turns, a single empty chunk."""
    t = F.col(turns) if isinstance(turns, str) else turns
    some = F.coalesce(t, F.expr("array()").cast(_TURNS))
    lines = F.filter(F.transform(some, lambda x, i: F.struct(i.alias("i"), format_turn(x).alias("line"))), lambda x: x["line"].isNotNull())
    chunk = "struct<turn_start:int,turn_end:int,used:bigint,text:string>"
    state = F.expr(f"cast(array() as array<{chunk}>)")
    between = len("\n") // 3

    def step(done: Column, x: Column) -> Column:
        line, i = x["line"], x["i"]
        cost = token_estimate(line)
        last = F.get(done, F.size(done) - 1)
        fits = last.isNotNull() & (last["used"] + between + cost <= limit)
        grown = F.struct(last["turn_start"].alias("turn_start"), i.alias("turn_end"), (last["used"] + between + cost).alias("used"), F.concat(last["text"], F.lit("\n"), line).alias("text"))
        fresh = F.struct(i.alias("turn_start"), i.alias("turn_end"), cost.alias("used"), line.alias("text"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    packed = F.aggregate(lines, state, step)
    full = F.when(F.size(packed) > 0, packed).otherwise(F.array(F.struct(F.lit(0).alias("turn_start"), F.lit(0).alias("turn_end"), F.lit(0).cast("bigint").alias("used"), F.lit("").alias("text"))))
    return F.transform(full, lambda c, i: F.struct(i.alias("chunk_index"), c["turn_start"].alias("turn_start"), c["turn_end"].alias("turn_end"), c["text"].alias("text")))


def pack_turns(lines: list[tuple[int, str]], count: Callable[[str], int], limit: int) -> list[tuple[int, int, int, str]]:
    """``(chunk_index, turn_start, turn_end, text)`` of turns with text and their index, as in ``turn_chunks``."""
    out: list[tuple[int, int, int, str]] = []
    now: list[tuple[int, str]] = []
    used, between = 0, count("\n")

    def close() -> None:
        if now:
            out.append((len(out), now[0][0], now[-1][0], "\n".join(x for _, x in now)))

    for i, line in lines:
        cost = count(line)
        if now and used + between + cost > limit:
            close()
            now, used = [], 0
        used += cost + (between if now else 0)
        now.append((i, line))
    close()
    return out or [(0, 0, 0, "")]


def turn_chunks_by(tokenizer: Callable[[], object], turns: str | Column, limit: int = 480) -> Column:
    """``turn_chunks`` by the tokens of a tokenizer, which is made once per worker."""

    @F.pandas_udf(_CHUNKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = tokenizer()
        for s in batches:
            rows = [pack_turns([(x["i"], x["line"]) for x in (r if r is not None else [])], tokens.count, limit) for r in s]
            yield pd.Series([[dict(zip(("chunk_index", "turn_start", "turn_end", "text"), c, strict=True)) for c in r] for r in rows], index=s.index)

    t = F.col(turns) if isinstance(turns, str) else turns
    lines = F.filter(F.transform(t, lambda x, i: F.struct(i.alias("i"), format_turn(x).alias("line"))), lambda x: x["line"].isNotNull())
    return run(lines)


# ---------------------------------------------------------------- paragraphs: sequential, so in Python

#: Fixed value: where sentences end.
_SENTENCE = re.compile(r"(?<=[。！？.!?\n])")


def pack_sentences(text: str, least: int = 50, most: int = 500) -> list[str]:
    """Sentences packed greedily up to ``most`` characters; a single longer one is kept whole, pieces under ``least`` are dropped."""
    out, now = [], ""
    for sentence in _SENTENCE.split(text):
        if not sentence.strip():
            continue
        if now and len(now) + len(sentence) > most:
            out.append(now.strip())
            now = ""
        now += sentence
    if now:
        out.append(now.strip())
    return [x for x in out if len(x) >= least]


def paragraphs_of(text: str | None, least: int = 50, most: int = 500) -> list[str]:
    """Paragraphs of a text: short ones wait for the next and go before it, long ones are packed from sentences.

    A waiting paragraph and the next are joined whatever their length together. What still waits at the
    end is added to the last paragraph, or is lost if there is none, unless it has ``least - 1`` characters.
    """
    out: list[str] = []
    waiting = ""
    for part in (x.strip() for x in re.split(r"\n{2,}", text or "")):
        if not part:
            continue
        if len(part) < least and len(waiting) + len(part) + 1 < least:
            waiting = f"{waiting}\n{part}" if waiting else part
        elif waiting:
            out.append(f"{waiting}\n{part}")
            waiting = ""
        elif len(part) > most:
            out += pack_sentences(part, least, most)
        else:
            out.append(part)
    if waiting and out:
        out[-1] = f"{out[-1]}\n{waiting}"
    return out


def paragraphs(text: str | Column, least: int = 50, most: int = 500) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: paragraphs_of(t, least, most))

    return split(F.col(text) if isinstance(text, str) else text)


def sub_query_text(query: str | Column, keywords: str | Column) -> Column:
    """What is embedded of a sub-query: the query, and its keywords if there are any."""
    q, k = (F.col(x) if isinstance(x, str) else x for x in (query, keywords))
    return F.concat_ws(" ", q, F.nullif(stripped(k), F.lit("")))


def note_text(title: str | Column, insight: str | Column, content: str | Column) -> Column:
    """What is embedded of a note: ``title. insight content``; null without a title."""
    t, i, c = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (title, insight, content))
    return F.when(stripped(t) != "", stripped(F.concat(t, F.lit(". "), i, F.lit(" "), c)))


def hash_buckets(text: str | Column, dims: int = 64) -> Column:
    """The bucket of each word: what the default embedder counts."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dims).cast("int"))
