"""Batch retrieval: query-to-query candidates, content rerank, fusion, ancestors, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import Config
from mnemospark.operators.similarity import best_per_group, knn
from mnemospark.session import cut


def candidates_index(subs: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits grouped by request and memory: best score, first appearance, queries matched.

    ``subs`` (``sub_id, request, sq_index``) and ``hits`` (``sub_id, query_id, memory_id, text_hash,
    score, rank``, scores at least 0). A text that several sub-queries hit counts once, with the
    score of its first hit. Even a hit with score 0 makes its memory a candidate. ``matched`` are the queries of the texts that count,
    best first, ``sub_queries`` the sub-queries they were hit by, in that order.
    """
    # sub-queries in their order, and each one's hits in theirs; a memory has a few hits a sub-query
    h = hits.join(subs.select("sub_id", "request", "sq_index"), "sub_id").select("request", "memory_id", "score", F.struct(F.struct("sq_index", "rank").alias("seq"), "score", "query_id", "text_hash").alias("hit"))
    g = h.groupBy("request", "memory_id").agg(F.max("score").alias("score_q2q"), F.array_sort(F.collect_list("hit")).alias("h"))
    g = g.withColumn("texts", F.transform("h", lambda e: e["text_hash"]))
    once = F.filter("h", lambda e, i: F.array_position(F.col("texts"), e["text_hash"]) == i + 1)
    g = g.withColumn("m", F.array_sort(F.transform(once, lambda e: F.struct((-e["score"]).alias("s"), e["seq"].alias("seq"), e["query_id"].alias("query_id")))))
    return g.select("request", "memory_id", "score_q2q", F.get("h", F.lit(0))["seq"].alias("first_seen"), F.transform("m", lambda e: e["query_id"]).alias("matched"), F.array_distinct(F.transform("m", lambda e: e["seq"]["sq_index"])).alias("sub_queries"))


def best_queries_exact(subs: DataFrame, fake_queries: DataFrame) -> DataFrame:
    """Per sub-query and memory the one best fake query: the exact mode's hits, as for ``candidates_index``.

    Ties go to the lower position. A memory is a candidate only if its best score is above 0. Memories aren't ranked by a
    sub-query here; their own order decides between equal scores.
    """
    # the text's hash travels with the id, so the many hits needn't be joined for it
    both = F.concat("query_id", F.lit("#"), F.xxhash64("text").cast("string"))
    pool = fake_queries.select(both.alias("key"), "memory_id", F.coalesce("pos", F.lit(0)).alias("pos"), "embedding")
    best = best_per_group(subs, "sub_id", pool, "key", "memory_id", "pos").where("sim > 0")
    text_hash = F.substring_index("key", "#", -1)
    query_id = F.expr("left(key, length(key) - length(substring_index(key, '#', -1)) - 1)")
    return best.select("sub_id", query_id.alias("query_id"), "memory_id", text_hash.cast("bigint").alias("text_hash"), F.col("sim").alias("score"), F.lit(0).alias("rank"))


def chunk_scores(candidates: DataFrame, subs: DataFrame, chunks: DataFrame, mode: str, top_k: int, dims: int = 64) -> DataFrame:
    """``request, memory_id, q2c``: only chunks of candidate memories are scored.

    ``index``: the best chunk of any sub-query; ``exact``: the best sub-query's mean over its
    ``top_k`` chunks. Neither is below 0.
    """
    from mnemospark.functions.vectors import cosine

    fine = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).select("memory_id", "chunk_index", F.col("embedding").alias("chunk"))
    if mode == "index":
        pairs = candidates.select("request", "memory_id").join(fine, "memory_id").join(subs.select("request", "sub_id", F.col("embedding").alias("sub")), "request")
        pairs = pairs.withColumn("sim", F.round(cosine("sub", "chunk"), 9))
        return pairs.groupBy("request", "memory_id").agg(F.max(F.greatest("sim", F.lit(0.0))).alias("q2c"))
    # nearly every memory is a candidate: products by block, the best chunks of a memory kept in the task
    keyed = fine.select("memory_id", "chunk_index", F.concat("memory_id", F.lit("#"), "chunk_index").alias("key"), F.col("chunk").alias("embedding"))
    top = best_per_group(subs, "sub_id", keyed, "key", "memory_id", "chunk_index", top_k, dims=dims)
    per = top.groupBy("sub_id", "memory_id").agg(F.greatest(F.avg("sim"), F.lit(0.0)).alias("mean"))
    per = per.join(subs.select("sub_id", "request"), "sub_id").groupBy("request", "memory_id").agg(F.max("mean").alias("q2c"))
    return per.join(candidates.select("request", "memory_id"), ["request", "memory_id"], "left_semi")


def fuse(candidates: DataFrame, chunk: DataFrame, config: Config) -> DataFrame:
    """Final scores and ranks. With no more than ``top_n`` candidates a request isn't reranked: alpha stays unused."""
    few = F.count(F.lit(1)).over(Window.partitionBy("request")) <= config.top_n
    joined = candidates.withColumn("few", few).join(chunk, ["request", "memory_id"], "left")
    q2c = F.coalesce("q2c", F.lit(0.0))
    scored = joined.withColumn("score_q2c", F.when(F.col("few"), 0.0).otherwise(q2c))
    scored = scored.withColumn("final_score", F.round(F.when(F.col("few"), F.col("score_q2q")).otherwise(config.alpha * F.col("score_q2q") + (1 - config.alpha) * q2c), 9))
    order = Window.partitionBy("request").orderBy(F.desc("final_score"), F.desc("score_q2q"), "first_seen", "memory_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_n).drop("few", "q2c")


def retrieve(subs: DataFrame, fake_queries: DataFrame, chunks: DataFrame, config: Config = Config(), mode: str = "index") -> DataFrame:
    """``request, rank, memory_id, score_q2q, score_q2c, final_score, matched, sub_queries``; ``matched`` are query ids.

    ``subs`` (``sub_id, request, sq_index, embedding``) are many requests at once; ``fake_queries``
    has a row per ``query_id``. Results of each request are those of asking it alone.
    """
    if mode == "index":
        near = knn(subs, "sub_id", fake_queries, "query_id", config.top_k_per_sub)
        named = fake_queries.select("query_id", "memory_id", F.xxhash64("text").alias("text_hash"))
        hits = near.join(named, "query_id").withColumn("score", F.greatest("sim", F.lit(0.0)))
    else:
        hits = best_queries_exact(subs, fake_queries)
    found = cut(candidates_index(subs, hits))  # both the scores and the fusion read it; the join below it runs once
    return fuse(found, chunk_scores(found, subs, chunks, mode, config.top_k_q2c), config)


def with_texts(results: DataFrame, fake_queries: DataFrame) -> DataFrame:
    """Results with ``texts``, those of the queries in ``matched``."""
    each = results.select("request", "memory_id", F.posexplode("matched").alias("at", "query_id")).join(fake_queries.select("query_id", "text"), "query_id")
    texts = each.groupBy("request", "memory_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    return results.join(texts.select("request", "memory_id", F.transform("t", lambda e: e["text"]).alias("texts")), ["request", "memory_id"], "left")


def with_chains(results: DataFrame, fake_queries: DataFrame, config: Config = Config()) -> DataFrame:
    """Results with ``chains``: for each matched query that has parents, it and its ancestors (``depth, text``), by depth.

    Chains of a single node are left out; order within a depth is by level, then id.
    """
    results = cut(results)  # read for the hits and for the rows themselves
    hits = results.select("request", "memory_id", F.posexplode("matched").alias("at", "query_id"))
    with_parents = fake_queries.where(F.size("parent_ids") > 0).select("query_id")
    starts = hits.join(with_parents, "query_id", "left_semi")
    nodes = ancestors(fake_queries, starts.select("query_id").distinct(), config.version_chain_depth)
    known = fake_queries.select(F.col("query_id").alias("node_id"), F.coalesce("depth", F.lit(0)).alias("depth"), "text")
    node = F.struct("depth", "level", "node_id", "text")
    chains = nodes.join(known, "node_id").groupBy("start_id").agg(F.array_sort(F.collect_list(node)).alias("chain"))  # a few levels
    own = starts.join(chains, starts["query_id"] == chains["start_id"]).groupBy("request", "memory_id").agg(F.array_sort(F.collect_list(F.struct("at", "chain"))).alias("c"))
    slim = F.transform("c", lambda e: F.transform(e["chain"], lambda n: F.struct(n["depth"].alias("depth"), n["text"].alias("text"), n["node_id"].alias("query_id"))))
    return results.join(own.select("request", "memory_id", slim.alias("chains")), ["request", "memory_id"], "left")


def ancestors(fake_queries: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """``start_id, node_id, level``: each start and its ancestors, ``depth`` levels with the start; the lowest level holds.

    Parents that aren't in the table are dropped, and chains of a single node too. Ids are compared as written.
    """
    edges = fake_queries.select(F.col("query_id").alias("child"), F.explode("parent_ids").alias("parent")).distinct()
    edges = edges.join(fake_queries.select(F.col("query_id").alias("parent")), "parent", "left_semi")
    level = starts.select(F.col("query_id").alias("start_id"), F.col("query_id").alias("node_id"), F.lit(0).alias("level"))
    out = level
    for i in range(1, depth):
        level = level.join(edges, level["node_id"] == edges["child"]).select("start_id", F.col("parent").alias("node_id"), F.lit(i).alias("level")).distinct()
        out = out.unionByName(level)
    nodes = out.groupBy("start_id", "node_id").agg(F.min("level").alias("level"))
    several = nodes.groupBy("start_id").count().where("count > 1").select("start_id")
    return nodes.join(several, "start_id", "left_semi")


def enrich(results: DataFrame, subs: DataFrame, paragraphs: DataFrame, config: Config = Config(), dims: int = 64) -> DataFrame:
    """Paragraphs for requests none of whose results is confident: ``request, rank, memory_id, text, score, paragraph_rank``."""
    from mnemospark.functions.vectors import cosine

    low = F.max("final_score").over(Window.partitionBy("request")) < config.fq_confidence_threshold
    weak = results.withColumn("low", low).where("low").select("request", "rank", "memory_id")
    fine = paragraphs.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).select("memory_id", "paragraph_index", "text", F.col("embedding").alias("para"))
    pairs = weak.join(fine, "memory_id").join(subs.select("request", "sub_id", F.col("embedding").alias("sub")), "request")
    pairs = pairs.withColumn("sim", F.round(F.greatest(cosine("sub", "para"), F.lit(0.0)), 9))
    w = Window.partitionBy("request", "memory_id", "sub_id").orderBy(F.desc("sim"), "paragraph_index")
    top = pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= config.paragraph_top_k)
    best = top.groupBy("request", "rank", "memory_id", "text").agg(F.max("sim").alias("score"))
    order = Window.partitionBy("request", "memory_id").orderBy(F.desc("score"), F.md5("text"))
    return best.withColumn("paragraph_rank", F.row_number().over(order)).where(F.col("paragraph_rank") <= config.paragraph_top_k)


def respond(results: DataFrame, memories: DataFrame) -> DataFrame:
    """What a caller sees: scores rounded to 4 places, the first 200 characters of each memory and, where results have ``chains``, their number; missing memories drop out."""
    texts = memories.select("memory_id", "session_text")
    chains = [F.coalesce(F.size(F.coalesce("chains", F.array())), F.lit(0)).alias("n_chains")] if "chains" in results.columns else []
    return results.join(texts, "memory_id").select(
        "request", "rank", "memory_id", F.round("score_q2q", 4).alias("score_q2q"), F.round("score_q2c", 4).alias("score_q2c"),
        F.round("final_score", 4).alias("final_score"), F.substring("session_text", 1, 200).alias("preview"), F.size("matched").alias("n_matched"), *chains,
    )


def context_budget(results: DataFrame, texts: DataFrame, config: Config = Config()) -> DataFrame:
    """Tokens that each result's text gets in the answer's context: ``request, rank, memory_id, tokens, given``.

    A token is three characters. Of the budget each result may take an equal part, or
    ``min_context_tokens`` if that is more; results come in order of rank until the budget is spent, and
    the last one is cut to what is left, or left out if that is ``min_tail_tokens`` or less.
    """
    one = Window.partitionBy("request")
    upto = one.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    t = results.select("request", "rank", "memory_id").join(texts, "memory_id").withColumn("tokens", F.floor(F.length("session_text") / 3.0))
    share = F.greatest(F.floor(F.lit(config.max_context_tokens) / F.count(F.lit(1)).over(one)), F.lit(config.min_context_tokens))
    t = t.withColumn("asked", F.least("tokens", share))
    left = F.lit(config.max_context_tokens) - F.coalesce(F.sum("asked").over(upto), F.lit(0))
    t = t.withColumn("left", left)
    given = F.when(F.col("asked") <= F.col("left"), F.col("asked")).when(F.col("left") > config.min_tail_tokens, F.col("left")).otherwise(0)
    return t.select("request", "rank", "memory_id", "tokens", given.alias("given")).where("given > 0")
