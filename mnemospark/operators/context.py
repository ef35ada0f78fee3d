"""The context from which an answer is written: memories packed under a token budget."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from mnemospark.config import Config
from mnemospark.providers import CharTokenizer, Tokenizer

#: What stands for no memories, and the headings of a memory's parts.
NOTHING = {"en": "(No relevant memories found)", "zh": "(无相关记忆)"}
FACTS = {"en": "Relevant Knowledge Points:", "zh": "相关知识点:"}
HISTORY = {"en": "\n[Version History (chain {0})]:", "zh": "\n[知识演变 (链 {0})]:"}
EXCERPTS = {"en": "\n[Relevant Excerpts]:", "zh": "\n[相关片段]:"}


def _facts(points: list[tuple], tokens: Tokenizer, limit: int, language: str) -> str:
    """The heading and as many lines as fit."""
    lines = [FACTS[language]]
    used = tokens.count(lines[0])
    for time, subject, fact, entities in points:
        line = f"  - [{time or ''}] {subject or ''}: {fact or ''}" + (f" ({entities})" if entities else "")
        used += tokens.count(line)
        if used > limit:
            break
        lines.append(line)
    return "\n".join(lines)


def render(results: list[dict], config: Config = Config(), tokenizer: Tokenizer | None = None, language: str = "en") -> str:
    """One request's context.

    ``results`` in order of rank: ``final_score``, ``points`` (time, subject, fact, entities), ``chains`` (lists of (depth, text)),
    ``paragraphs``. Each memory may use an equal part of the budget, or ``min_context_tokens`` if that is more: fact lines until it is
    full; then the history of its questions, if any result is confident; else excerpts. A memory with none of them is
    left out, but keeps its number. One over the rest of the budget is cut, if more than ``min_tail_tokens`` are left, and ends the
    context. An unknown language is taken for English.
    """
    tokens = tokenizer or CharTokenizer()
    language = language if language in NOTHING else "en"
    if not results:
        return NOTHING[language]
    limit = max(config.max_context_tokens // len(results), config.min_context_tokens)
    sure = [r["final_score"] >= config.fq_confidence_threshold for r in results]
    blocks, used = [], 0
    for i, r in enumerate(results):
        parts = [_facts(r["points"], tokens, limit, language)] if r.get("points") else []
        if any(sure):
            long = [(k, c) for k, c in enumerate(r.get("chains") or [], 1) if len(c) > 1]
            parts += ["\n".join([HISTORY[language].format(k), *(f"  [d{depth}] {text}" for depth, text in c)]) for k, c in long]
        elif r.get("paragraphs"):
            quoted = [x for j, text in enumerate(r["paragraphs"], 1) for x in (f"  --- [{j}] ---", f"  {text}")]
            parts.append("\n".join([EXCERPTS[language], *quoted]))
        if not parts:
            continue
        body = tokens.truncate("\n".join(parts), limit)
        block = f"### Memory {i + 1} (relevance: {r['final_score']:.3f}, confidence: {'HIGH' if sure[i] else 'LOW'})\n{body}"
        left = config.max_context_tokens - used
        if tokens.count(block) > left:
            if left > config.min_tail_tokens:
                blocks.append(tokens.truncate(block, left))
            break
        blocks.append(block)
        used += tokens.count(block)
    return "\n\n".join(blocks)


def contexts(results: DataFrame, points: DataFrame, paragraphs: DataFrame | None = None, config: Config = Config(), language: str = "en", tokenizer: Callable[[], Tokenizer] = CharTokenizer) -> DataFrame:
    """``request, context`` for retrieved results (at most ``top_n`` a request) with the facts of their memories.

    ``points`` (memory_id, kp_index, time, subject, fact, entities_or_values) and ``paragraphs`` (request, memory_id, text, paragraph_rank).
    Results may have ``chains`` (``retrieval.with_chains``). Of a memory only as many facts are read as can fit its part of the budget.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    # a fact line has 8 characters at least, and no tokenizer takes more than a token a character or fewer than one a line
    most = max(config.max_context_tokens, config.min_context_tokens)
    nth = Window.partitionBy("memory_id").orderBy("kp_index")
    entry = F.struct("kp_index", "time", "subject", "fact", "entities_or_values")
    wanted = points.join(results.select("memory_id").distinct(), "memory_id", "left_semi").withColumn("n", F.row_number().over(nth)).where(F.col("n") <= most)
    kept = wanted.groupBy("memory_id").agg(F.array_sort(F.collect_list(entry)).alias("points"))
    some = "array<struct<chain:int,depth:int,text:string>>"  # flat, as Arrow hands no lists of lists to Python
    inner = lambda i: lambda n: F.struct(i.alias("chain"), n["depth"].alias("depth"), n["text"].alias("text"))
    chains = F.flatten(F.transform("chains", lambda c, i: F.transform(c, inner(i)))) if "chains" in results.columns else F.lit(None)
    rows = results.withColumn("chains", F.coalesce(chains.cast(some), F.array().cast(some)))
    rows = rows.select("request", "rank", "memory_id", "final_score", "chains").join(kept, "memory_id", "left")
    if paragraphs is not None:
        texts = paragraphs.groupBy("request", "memory_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_rank", "text"))).alias("paragraphs"))
        rows = rows.join(texts, ["request", "memory_id"], "left")
    else:
        rows = rows.withColumn("paragraphs", F.expr("cast(null as array<struct<paragraph_rank:int,text:string>>)"))
    # lists of one kind each and never null: what Arrow hands to Python
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("points", "paragraphs")})
    listed = lambda x: [] if x is None else list(x)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in pdf.sort_values("rank").itertuples():
            facts = [(p["time"], p["subject"], p["fact"], p["entities_or_values"]) for p in listed(r.points)]
            chains: dict[int, list] = {}
            for n in listed(r.chains):
                chains.setdefault(n["chain"], []).append((n["depth"], n["text"]))
            found.append({"final_score": r.final_score, "points": facts, "chains": list(chains.values()), "paragraphs": [p["text"] for p in listed(r.paragraphs)]})
        return pd.DataFrame({"request": [pdf["request"].iloc[0]], "context": pd.Series([render(found, config, tokenizer(), language)], dtype=object)})

    return rows.groupBy("request").applyInPandas(run, f"request {rows.schema['request'].dataType.simpleString()}, context string")
