"""Building memories: sessions become chunks, paragraphs, generated queries with links, and facts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.config import Config
from mnemospark.functions import jsonrepair, text
from mnemospark.functions.prompts import prompt
from mnemospark.operators.versioning import gather_linked, kp_line, parents, version_hits
from mnemospark.providers import Embedder, ExtractiveGenerator, FactExtractor, HashEmbedder, TextGenerator, embed, generate
from mnemospark.session import cut


def memorize(
    sessions: DataFrame,
    stored_queries: DataFrame,
    stored_points: DataFrame | None = None,
    embedder: Callable[[], Embedder] = HashEmbedder,
    generator: Callable[[], TextGenerator] = ExtractiveGenerator,
    facts: Callable[[], TextGenerator] = FactExtractor,
    window: int = 1_000,
    threshold: float | None = None,
    language: str = "en",
    dims: int = 64,
) -> dict[str, DataFrame]:
    """Tables that a batch of sessions (``memory_id, session_text, metadata, created_at``) becomes.

    Chunks and paragraphs with vectors; generated queries with vectors, linked to those already stored of other memories
    (queries of one batch don't see each other); facts with vectors, extracted with the stored facts that the queries'
    history leads to; and the memories themselves. Prompts hold whole texts. A session for which no query is generated gets
    its chunks and paragraphs, but no facts. Null texts become nothing.

    The same batch gives the same tables, whether its memories are stored already or not.
    """
    config = Config() if threshold is None else replace(Config(), version_threshold=threshold)
    s = sessions.where("memory_id is not null")
    full = s.where("session_text is not null")
    chunks = full.select("memory_id", F.posexplode(text.windows("session_text", window)).alias("chunk_index", "t"))
    paragraphs = s.select("memory_id", F.posexplode(text.paragraphs("session_text", config.paragraph_min_chars, config.paragraph_max_chars)).alias("paragraph_index", "text"))
    answers = full.select("memory_id", jsonrepair.strings(generate(prompt("fake_queries", language, n=config.num_fake_queries, session=F.col("session_text")), generator)).alias("q"))
    fakes = answers.select("memory_id", F.posexplode("q").alias("pos", "text"))
    # read by the links, the facts and the table: generated once
    fakes = cut(fakes.withColumn("query_id", F.substring(F.md5(F.concat_ws("#", "memory_id", "pos")), 1, 12)).withColumn("embedding", embed("text", embedder)))
    new = fakes.select(F.col("query_id").alias("new_id"), "memory_id", "embedding")
    others = stored_queries.join(s.select("memory_id").distinct(), "memory_id", "left_anti")  # the batch replaces its own
    hits = cut(version_hits(new, others, config))
    found = parents(hits.select("new_id", "query_id", "sim"), others, config)
    none = F.array().cast("array<string>")
    fakes = fakes.join(found, fakes["query_id"] == found["new_id"], "left").select(
        "query_id", "memory_id", "pos", "text", F.lit("").alias("answer"), "embedding", F.coalesce("parent_ids", none).alias("parent_ids"), F.coalesce("depth", F.lit(0)).alias("depth")
    )

    asked = full.join(fakes.select("memory_id").distinct(), "memory_id", "left_semi")
    if stored_points is not None:
        points = stored_points.join(s.select("memory_id").distinct(), "memory_id", "left_anti")
        linked = gather_linked(new, hits.select("new_id", "memory_id", "rank"), points, config, dims)
        context = linked.groupBy("memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda e: e["line"]), "; ").alias("context"))  # a few facts
        asked = asked.join(context, "memory_id", "left")
    else:
        asked = asked.withColumn("context", F.lit(None).cast("string"))
    answer = generate(prompt("knowledge", language, session=F.col("session_text"), context=F.regexp_replace("context", r"\s+", " ")), facts)
    points = asked.select("memory_id", F.posexplode(jsonrepair.knowledge_points(answer)).alias("kp_index", "k")).select("memory_id", "kp_index", "k.*")
    return {
        "memories": s, "fake_queries": fakes,
        "content_chunks": chunks.select("memory_id", "chunk_index", embed("t", embedder).alias("embedding")),
        "paragraphs": paragraphs.select("memory_id", "paragraph_index", "text", embed("text", embedder).alias("embedding")),
        "knowledge_points": points.withColumn("embedding", embed(kp_line(), embedder)),
    }
