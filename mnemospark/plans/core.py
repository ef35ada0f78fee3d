"""Queries of the reference operators over the test tables.

Vectors of ``embeddings`` play the stored vectors of five methods (every row, by id) and, a second time, the true queries
and sub-queries (those whose id is divisible by 20) and their paraphrases (the five rows after each); labels are sessions. A
query's own vector doesn't count among those stored.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemospark.config import Config
from mnemospark.functions import jsonrepair, text
from mnemospark.functions.vectors import cosine
from mnemospark.operators import evaluation as ev
from mnemospark.operators import generation as gen
from mnemospark.operators import retrieval as rt
from mnemospark.operators import versioning as vs
from mnemospark.operators.context import contexts
from mnemospark.operators.memory import memorize
from mnemospark.operators.similarity import best_per_group, earlier_similar, knn, similarities, within_threshold
from mnemospark.providers import HashEmbedder, embed
from mnemospark.sources.loaders import temporal_order
from mnemospark.session import checkpoint_folder, cut
from mnemospark.sources.store import MemoryStore, VectorStore, latest

CONFIG = Config()
#: No pair of the test vectors reaches the usual 0.80.
LINK_THRESHOLD = 0.35


def _t(s: SparkSession, sf: str, name: str) -> DataFrame:
    return s.read.parquet(f"{sf}/{name}.parquet")


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _subs(s: SparkSession, sf: str) -> DataFrame:
    e = _t(s, sf, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("sub_id"), F.floor(F.col("vec_id") / 40).cast("int").alias("request"), (F.floor(F.col("vec_id") / 20) % 2).cast("int").alias("sq_index"), "embedding")


def _fake(s: SparkSession, sf: str) -> DataFrame:
    return _t(s, sf, "fake_queries").select("query_id", "memory_id", "pos", "text", "parent_ids", "depth", "embedding").dropDuplicates(["query_id"])


def _chunks(s: SparkSession, sf: str) -> DataFrame:
    return _t(s, sf, "content_chunks").dropDuplicates(["memory_id", "chunk_index"])


def _paragraphs(s: SparkSession, sf: str) -> DataFrame:
    return _t(s, sf, "paragraphs").dropDuplicates(["memory_id", "paragraph_index"])


def _memories(s: SparkSession, sf: str) -> DataFrame:
    return latest(_t(s, sf, "memories"), ["memory_id"], "ingested_at")


# ---------------------------------------------------------------- vectors and searches


def cosine_pairs(s, sf):
    e = _t(s, sf, "embeddings").select("vec_id", "embedding")
    return similarities(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query"), "query", e, "vec_id").select("query", "vec_id", F.round("sim", 6).alias("sim"))


def cosine_variants(s, sf):
    e = _t(s, sf, "embeddings")
    a, b = e.where("vec_id % 20 = 0").select(F.col("label").alias("la"), F.col("embedding").alias("a"), F.col("vec_id").alias("query")), e.select((F.col("vec_id") - 1).alias("query"), F.col("embedding").alias("b"))
    return a.join(b, "query").select("query", *[F.round(cosine("a", "b", x), 6).alias(x) for x in ("guard", "prod", "each")])


def knn_top20(s, sf):
    return _r(knn(_subs(s, sf), "sub_id", _fake(s, sf), "query_id", 20).select("sub_id", "query_id", F.greatest("sim", F.lit(0.0)).alias("score"), "rank"), "score")


def content_topk(s, sf):
    c = _chunks(s, sf).withColumn("key", F.concat("memory_id", F.lit("#"), "chunk_index"))
    return _r(knn(_subs(s, sf), "sub_id", c, "key", 10).select("sub_id", "key", "sim", "rank"), "sim")


def best_chunk_per_memory(s, sf):
    c = _chunks(s, sf).withColumn("key", F.concat("memory_id", F.lit("#"), "chunk_index"))
    near = best_per_group(_subs(s, sf), "sub_id", c, "key", "memory_id", "chunk_index")
    return near.join(_subs(s, sf).select("sub_id", "request"), "sub_id").groupBy("request", "memory_id").agg(F.round(F.max(F.greatest("sim", F.lit(0.0))), 6).alias("score"))


def paragraph_topk(s, sf):
    p = _paragraphs(s, sf).withColumn("key", F.concat("memory_id", F.lit("#"), "paragraph_index"))
    return _r(best_per_group(_subs(s, sf), "sub_id", p, "key", "memory_id", "paragraph_index", 3).select("sub_id", "key", "sim", "rank"), "sim")


def threshold_search(s, sf):
    return _r(within_threshold(_subs(s, sf), "sub_id", _fake(s, sf), "query_id", LINK_THRESHOLD).select("sub_id", "query_id", "sim", "rank"), "sim")


def multiget(s, sf):
    f = _fake(s, sf)
    wanted = f.select(F.explode("parent_ids").alias("query_id")).where("query_id is not null").distinct()
    return f.join(wanted, "query_id", "left_semi").select("query_id", "memory_id", F.md5("text").alias("text_md5"), F.coalesce("depth", F.lit(-1)).alias("depth"))


# ---------------------------------------------------------------- retrieval


def _result(df: DataFrame) -> DataFrame:
    return _r(df.select("request", "rank", "memory_id", "score_q2q", "score_q2c", "final_score", F.size("matched").alias("n_matched"), F.array_join(F.transform("sub_queries", lambda x: x.cast("string")), ",").alias("sub_queries")), "score_q2q", "score_q2c", "final_score")


def retrieve_index(s, sf):
    return _result(rt.retrieve(_subs(s, sf), _fake(s, sf), _chunks(s, sf), CONFIG))


def retrieve_exact(s, sf):
    return _result(rt.retrieve(_subs(s, sf), _fake(s, sf), _chunks(s, sf), CONFIG, "exact"))


def rerank_shortcircuit(s, sf):
    return _result(rt.retrieve(_subs(s, sf), _fake(s, sf), _chunks(s, sf), replace(CONFIG, top_n=100)))


def dag_chains(s, sf):
    f = _fake(s, sf)
    return rt.ancestors(f, f.where(F.size("parent_ids") > 0).select("query_id"), CONFIG.version_chain_depth)


def low_conf_enrich(s, sf):
    found = rt.retrieve(_subs(s, sf), _fake(s, sf), _chunks(s, sf), CONFIG)
    e = rt.enrich(found, _subs(s, sf), _paragraphs(s, sf), CONFIG)
    return _r(e.select("request", "rank", "memory_id", F.md5("text").alias("text_md5"), "score", "paragraph_rank"), "score")


def responses(s, sf):
    f = _fake(s, sf)
    found = rt.with_chains(rt.retrieve(_subs(s, sf), f, _chunks(s, sf), CONFIG), f)
    return rt.respond(found, _memories(s, sf).where("session_text is not null"))


def version_chains(s, sf):
    """The version history of each result: per chain its nodes from the oldest."""
    f = _fake(s, sf)
    found = rt.with_chains(rt.retrieve(_subs(s, sf), f, _chunks(s, sf), CONFIG), f)
    each = found.select("request", "rank", F.posexplode("chains").alias("chain", "nodes"))
    return each.select("request", "rank", "chain", F.array_join(F.transform("nodes", lambda n: n["query_id"]), ",").alias("nodes"))


def matched_texts(s, sf):
    """The texts of the queries matched by each result, best first."""
    f = _fake(s, sf)
    found = rt.with_texts(rt.retrieve(_subs(s, sf), f, _chunks(s, sf), CONFIG), f)
    return found.select("request", "rank", F.posexplode("texts").alias("position", "text")).select("request", "rank", "position", F.md5("text").alias("text_md5"))


def context_budget(s, sf):
    return rt.context_budget(rt.retrieve(_subs(s, sf), _fake(s, sf), _chunks(s, sf), CONFIG), _memories(s, sf).where("session_text is not null").select("memory_id", "session_text"), replace(CONFIG, max_context_tokens=2_000, min_context_tokens=300))


# ---------------------------------------------------------------- versions


def _new(s, sf):
    return _subs(s, sf).select(F.col("sub_id").alias("new_id"), "embedding")


def version_parents(s, sf):
    out = vs.link_new(_new(s, sf), _fake(s, sf), replace(CONFIG, version_threshold=LINK_THRESHOLD))
    return out.select("new_id", F.array_join("parent_ids", ",").alias("parent_ids"), F.col("depth").cast("int").alias("depth"), F.col("n_hits").cast("int").alias("n_hits"))


def version_graph(s, sf):
    f = _t(s, sf, "fake_queries").select("query_id", "memory_id", "embedding", "created_at", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    hits = cut(earlier_similar(f, "query_id", "older_id", "at", "memory_id", 0.80, CONFIG.max_hits))
    return vs.version_graph(f.where("query_id is not null").groupBy("query_id").agg(F.min("created_at").alias("arrival")), hits)


def linked_kps(s, sf):
    hits = within_threshold(_new(s, sf), "new_id", _fake(s, sf), "query_id", LINK_THRESHOLD).join(_fake(s, sf).select("query_id", "memory_id"), "query_id")
    points = _t(s, sf, "knowledge_points").dropDuplicates(["memory_id", "kp_index"])
    return vs.linked_knowledge(hits.select("new_id", "memory_id", "rank"), points).select("new_id", "rank", "memory_id", "kp_index", F.md5("line").alias("line_md5"))


# ---------------------------------------------------------------- texts


def sliding_chunks(s, sf):
    d = _t(s, sf, "documents").where("text is not null").select("doc_id", F.posexplode(text.windows("text", 1000, 500)).alias("chunk_index", "chunk"))
    return d.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def paragraph_split(s, sf):
    d = _memories(s, sf).where("session_text is not null").select("memory_id", F.posexplode(text.paragraphs("session_text")).alias("paragraph_index", "paragraph"))
    return d.select("memory_id", "paragraph_index", F.length("paragraph").alias("n_chars"), "paragraph")


def session_text(s, sf):
    d = _t(s, sf, "sessions").where("session_id is not null").dropDuplicates(["session_id"]).where(F.size("turns") >= 3)
    return d.select("session_id", F.size("turns").alias("n_turns"), F.md5(text.session_text("turns")).alias("text_md5"))


def turn_chunks(s, sf):
    d = _t(s, sf, "sessions").where("session_id is not null").dropDuplicates(["session_id"])
    c = d.select("session_id", F.explode(text.turn_chunks("turns", 120)).alias("c")).select("session_id", "c.*")
    return c.select("session_id", "chunk_index", "turn_start", "turn_end", F.md5("text").alias("text_md5"))


def token_counts(s, sf):
    d = _t(s, sf, "documents")
    return d.select("doc_id", text.token_estimate("text").alias("tokens"), F.md5(text.truncate_tokens("text", 500)).alias("cut_md5"))


def session_order(s, sf):
    d = _t(s, sf, "sessions").where("session_id is not null").dropDuplicates(["session_id"])
    return temporal_order(d, "sample_id", "date", "session_id").select("sample_id", "session_id", F.coalesce(F.date_format("date_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("undated")).alias("date_ts"), "seq")


def json_repair_strings(s, sf):
    d = _t(s, sf, "sessions").where("session_id is not null").dropDuplicates(["session_id"])
    raw = F.to_json(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))))
    fenced = F.concat(F.lit("Sure:\n```json\n"), raw, F.lit("\n```"))
    d = d.where(F.size("turns") > 0).select("session_id", F.when(F.length("session_id") % 2 == 0, raw).otherwise(fenced).alias("raw"))
    return d.select("session_id", F.posexplode(jsonrepair.strings("raw")).alias("pos", "text")).select("session_id", "pos", F.md5("text").alias("text_md5"))


def json_repair_points(s, sf):
    text_of = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    d = _t(s, sf, "knowledge_points").dropDuplicates(["memory_id", "kp_index"])
    items = d.groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("kp_index", F.struct(*map(text_of, ("time", "subject", "fact", "entities_or_values"))).alias("kp")))).alias("l"))  # a memory's facts
    raw = F.concat(F.lit("The facts: "), F.to_json(F.transform("l", lambda e: e["kp"])), F.lit(" That is all."))
    return items.select("memory_id", F.posexplode(jsonrepair.knowledge_points(raw)).alias("pos", "k")).select("memory_id", "pos", F.md5(F.concat_ws("|", "k.time", "k.subject", "k.fact", "k.entities_or_values")).alias("line_md5"))


def json_repair_subqueries(s, sf):
    f = _fake(s, sf).where("text is not null").groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("pos", "query_id", "text"))).alias("l"))  # a memory's queries
    raw = F.to_json(F.transform("l", lambda e: F.struct(e["text"].alias("query"), e["query_id"].alias("keywords"))))
    return f.select("memory_id", F.posexplode(jsonrepair.sub_queries(raw, F.lit("raw"))).alias("pos", "q")).select("memory_id", "pos", F.md5("q.query").alias("query_md5"), "q.keywords")


def json_repair_notes(s, sf):
    f = _fake(s, sf).where("text is not null").groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("pos", "query_id", "text"))).alias("l"))
    raw = F.concat(F.lit("Notes: "), F.to_json(F.transform("l", lambda e: F.struct(e["query_id"].alias("title"), e["text"].alias("content"), F.array(e["query_id"], F.lit("x")).alias("tags")))))
    return f.select("memory_id", F.posexplode(jsonrepair.notes(raw)).alias("pos", "n")).select("memory_id", "pos", "n.title", F.md5("n.content").alias("content_md5"), F.array_join("n.tags", ",").alias("tags"))


def hash_embedding(s, sf):
    d = _t(s, sf, "knowledge_points").dropDuplicates(["memory_id", "kp_index"]).select("memory_id", "kp_index", F.explode(text.hash_buckets("fact")).alias("bucket"))
    counts = d.groupBy("memory_id", "kp_index", "bucket").agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("memory_id", "kp_index")))
    return counts.select("memory_id", "kp_index", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


def kp_topk(s, sf):
    points = _t(s, sf, "knowledge_points").where("memory_id is not null and fact is not null").dropDuplicates(["memory_id", "kp_index"]).select("memory_id", "kp_index", embed("fact").alias("v"))
    q = _fake(s, sf).where("text is not null").select("query_id", "memory_id", embed("text").alias("q"))
    near = q.join(points, "memory_id").select("query_id", "kp_index", F.round(cosine("q", "v"), 9).alias("sim"))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "kp_index")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def answer_contexts(s, sf):
    found = rt.retrieve(_subs(s, sf), _fake(s, sf), _chunks(s, sf), CONFIG)
    points = _t(s, sf, "knowledge_points").dropDuplicates(["memory_id", "kp_index"])
    found = rt.with_chains(found, _fake(s, sf), CONFIG)
    return contexts(found, points, rt.enrich(found, _subs(s, sf), _paragraphs(s, sf), CONFIG), CONFIG)


def _requests(s, sf):
    """Every question of the first position, as a request."""
    return _fake(s, sf).where("pos = 0").select(F.col("query_id").alias("request"), F.col("text").alias("query"))


def decomposed(s, sf):
    """Requests split into sub-queries with vectors."""
    return gen.decompose(_requests(s, sf)).select("sub_id", "request", "sq_index", "text", "keywords", F.size("embedding").alias("dims"))


def answers(s, sf):
    """Answers to the requests that have results, written from their contexts."""
    c = answer_contexts(s, sf)
    asked = c.select("request", F.concat(F.lit("What about "), F.col("request").cast("string"), F.lit("?")).alias("query"), F.lit(True).alias("wanted"))
    return gen.answer(asked, c)


def paraphrased(s, sf):
    """Every question of the first position in five indirect ways."""
    q = _fake(s, sf).where("pos = 0 and text is not null").select("query_id", "text", F.lit("").alias("answer"), F.lit("").alias("context"))
    return gen.paraphrases(q)


def variant_texts(s, sf):
    """Propositions of every session text."""
    m = _memories(s, sf).where("session_text is not null").select(F.col("memory_id").alias("session_id"), F.col("session_text").alias("text"))
    return gen.variants(m, "propositions")


def memorized(s, sf):
    """How many chunks, paragraphs, queries, links and facts each memory gets when all are ingested again beside what is stored."""
    m = _memories(s, sf).select("memory_id", "sample_id", "session_id", "session_text", "metadata", "created_at")
    points = _t(s, sf, "knowledge_points").dropDuplicates(["memory_id", "kp_index"]).withColumn("embedding", F.lit(None).cast("array<float>"))
    made = memorize(m, _fake(s, sf), points)
    n = lambda name, what=F.lit(1): made[name].groupBy("memory_id").agg(F.count(what).alias(f"n_{name}"))
    out = m.select("memory_id")
    for name in ("content_chunks", "paragraphs", "fake_queries", "knowledge_points"):
        out = out.join(n(name), "memory_id", "left")
    return out.na.fill(0)


def memory_chunks(s, sf):
    """The chunks that each memory's text is embedded in, through the memory builder's window."""
    m = _memories(s, sf).where("session_text is not null").select("memory_id", F.posexplode(text.windows("session_text", 1_000)).alias("chunk_index", "t"))
    return m.select("memory_id", "chunk_index", F.md5("t").alias("chunk_md5"))


def _stored(s, sf) -> MemoryStore:
    store = MemoryStore(s, f"{checkpoint_folder(s)}/store-{uuid.uuid4().hex}", buckets=16)
    fakes = _fake(s, sf).withColumn("answer", F.lit(""))
    store.save(memories=_memories(s, sf), fake_queries=fakes, content_chunks=_chunks(s, sf), paragraphs=_paragraphs(s, sf), knowledge_points=_t(s, sf, "knowledge_points").dropDuplicates(["memory_id", "kp_index"]))
    return store


def stored_documents(s, sf):
    """Nested documents put together from the stored tables: what each holds."""
    d = _stored(s, sf).documents()
    sizes = [F.size(c).alias(f"n_{c}") for c in ("content_embeddings", "fake_queries", "knowledge_points", "paragraphs")]
    return d.select("memory_id", F.md5("session_text").alias("text_md5"), *sizes)


def store_search(s, sf):
    """The searches of the store: the 20 nearest fake queries of each sub-query."""
    return _r(_stored(s, sf).search_fake_queries(_subs(s, sf), 20).select("sub_id", "query_id", "score", "rank"), "score")


def vector_tables(s, sf):
    """Vectors of questions and paragraphs by session, embedded in two steps of which the second adds only what is missing."""
    store = VectorStore(s, f"{checkpoint_folder(s)}/vectors-{uuid.uuid4().hex}", buckets=8)
    f = _fake(s, sf).where("text is not null").select(F.lit("q2q").alias("method"), F.col("memory_id").alias("session_id"), "pos", "text")
    p = _paragraphs(s, sf).where("text is not null").select(F.lit("q2c").alias("method"), F.col("memory_id").alias("session_id"), F.col("paragraph_index").alias("pos"), "text")
    store.add("vectors", f, HashEmbedder)
    store.add("vectors", f.unionByName(p), HashEmbedder)
    return store.load("vectors").groupBy("method", "session_id").agg(F.count("embedding").alias("n"))


# ---------------------------------------------------------------- analyses


def _true(s, sf):
    return _t(s, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding", "label")


def _vectors(s, sf):
    e = _t(s, sf, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), F.col("label").alias("session"), F.element_at(F.array(*map(F.lit, ev.METHODS)), (F.col("vec_id") % 5 + 1).cast("int")).alias("method"), "embedding")


def _evidence(s, sf):
    q = _true(s, sf)
    return q.select("query", F.posexplode(F.array(F.col("label"), (F.col("label") + 3) % 10)).alias("ev_pos", "session"))


def _sims(s, sf):
    v = _vectors(s, sf)
    return similarities(_true(s, sf), "query", v, "pos").where("query <> pos").join(v.drop("embedding"), "pos")


def _aligned(s, sf):
    return ev.alignment(_sims(s, sf), _evidence(s, sf))


def max_sim_by_method(s, sf):
    return _r(ev.max_sims(_sims(s, sf), ["query", "method"]), "best")


def alignment_best_session(s, sf):
    return _r(_aligned(s, sf), *ev.METHODS, "gap")


_STATS = ("mean_a", "mean_b", "std_a", "std_b", "gap_mean", "gap_std", "gap_median", "t", "cohens_d", "p")


def paired_stats(s, sf):
    return _r(ev.paired(_aligned(s, sf), "q2q", "q2c"), *_STATS)


def category_breakdown(s, sf):
    c = _true(s, sf).select("query", F.when(F.col("label") % 3 == 0, "even").when(F.col("label") % 3 == 1, "odd").alias("category"))
    return _r(ev.paired(_aligned(s, sf).join(c, "query"), "q2q", "q2c", "category"), *_STATS)


def pairwise_method_stats(s, sf):
    return _r(ev.pairwise(_aligned(s, sf)), *_STATS)


def method_summary(s, sf):
    return _r(ev.describe_methods(_aligned(s, sf)), "mean", "std", "median")


def distance_matrix(s, sf):
    return _r(ev.distances(_true(s, sf), _vectors(s, sf), _evidence(s, sf)), "mean", "std", "median")


def directional_alignment(s, sf):
    return _r(ev.directional(_true(s, sf), _vectors(s, sf), _sims(s, sf), _evidence(s, sf)), "mean", "std", "median")


def discriminability(s, sf):
    sessions = _vectors(s, sf).select("session").distinct()
    return _r(ev.discriminability(_sims(s, sf), _evidence(s, sf), sessions), "mean", "std", "median", "positive_rate")


def hit_at_k(s, sf):
    return _r(ev.hit_at_k(_sims(s, sf), _evidence(s, sf)), "hit_1", "hit_5", "hit_10")


def _styled(s, sf):
    p = _t(s, sf, "embeddings").where("vec_id % 20 between 1 and 5").select("vec_id", "embedding")
    v = _vectors(s, sf)
    home = _aligned(s, sf).select("query", "session")
    sims = similarities(p.withColumnRenamed("vec_id", "para"), "para", v, "pos").where("para <> pos").join(v.drop("embedding"), "pos")
    sims = sims.select((F.col("para") - F.col("para") % 20).alias("query"), (F.col("para") % 20 - 1).cast("int").alias("style"), "pos", "session", "method", "sim").join(home, ["query", "session"])
    styled = ev.max_sims(sims, ["query", "method", "style"]).select("query", "method", "style", F.col("best").alias("sim"))
    a = _aligned(s, sf)
    original = a.select("query", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("orig")) for m in ev.METHODS])).alias("x")).select("query", "x.*")
    return original, styled


def robustness(s, sf):
    return _r(ev.robustness(*_styled(s, sf)), "orig", "var", "robustness")


def robustness_overall(s, sf):
    return _r(ev.robustness_summary(ev.robustness(*_styled(s, sf))), "mean_var", "mean_robustness", "std_robustness", "q2c_over_q2q")


def style_drop(s, sf):
    original, styled = _styled(s, sf)
    drops = ev.style_drops(original, styled, styled.select("style")).withColumn("style", F.coalesce("style", F.lit(-1)))  # -1: all styles
    return _r(drops, "mean_sim", "mean_drop", "drop_rate")


def friedman_chi2(s, sf):
    return _r(ev.friedman(_styled(s, sf)[1]), "chi2", "p")


def drift_checkpoints(s, sf):
    sessions = _vectors(s, sf).select("session").distinct()
    arrival = sessions.select("session", (F.col("session") + 1).alias("seq"))
    return _r(ev.drift(_sims(s, sf), _evidence(s, sf), _vectors(s, sf).select("method", "session"), arrival, ev.checkpoints(10)), "mean_rank", "median_rank", "mrr", "recall_1", "recall_5", "recall_10", "rank_drift")


def usage_stats(s, sf):
    e = _t(s, sf, "events")
    return _r(ev.usage(e.select(F.when(F.col("event_type") == "signup", "memorize").otherwise(F.col("event_type")).alias("phase"), F.floor("value").alias("input_tokens"), F.floor(F.col("value") / 2).alias("output_tokens"), F.col("value").alias("latency"))), "mean_latency")


def ari_nmi(s, sf):
    d = _t(s, sf, "documents").select(F.lower(F.trim("lang")).alias("lang"), F.lower(F.trim("source")).alias("source")).where("lang is not null and source is not null")
    return _r(ev.agreement(d, "lang", "source"), "ari", "nmi")


def kmeans_labels(s, sf):
    return ev.kmeans_agreement(_t(s, sf, "embeddings"), "embedding", "label", 10)


# ---------------------------------------------------------------- tables


def upsert_delete(s, sf):
    """Memories after an upsert (late arrivals replace what is there) and the deletion of those without text, through the store."""
    m = _t(s, sf, "memories").where("memory_id is not null").withColumn("created_at", F.unix_micros("ingested_at").cast("string"))
    first = m.groupBy("memory_id").agg(F.min("ingested_at").alias("first"))
    early = m.join(first, "memory_id").where("ingested_at <=> first").drop("first")
    store = MemoryStore(s, f"{checkpoint_folder(s)}/store-{uuid.uuid4().hex}", buckets=16)
    store.save(memories=early)
    store.save(memories=m.join(early.select("memory_id", "created_at"), ["memory_id", "created_at"], "left_anti"))
    store.change(cut(store.load().where("session_text is null or session_text = ''").select("memory_id")), {})
    return store.load().select("memory_id", "session_id", F.col("created_at").cast("bigint").alias("ingested_us"))


def incremental_missing(s, sf):
    """Memories with no chunk among the first of their chunks that came with a vector: what is left to embed."""
    chunks = _t(s, sf, "content_chunks").where("chunk_index > 0 and embedding is not null")
    return _memories(s, sf).select("memory_id").join(chunks.select("memory_id"), "memory_id", "left_anti")


def stored_sessions(s, sf):
    return _t(s, sf, "fake_queries").where("embedding is not null").groupBy("memory_id").agg(F.countDistinct("query_id").alias("n_queries"))


QUERIES = {f.__name__: f for f in (
    cosine_pairs, cosine_variants, knn_top20, content_topk, best_chunk_per_memory, paragraph_topk, threshold_search, multiget,
    retrieve_index, retrieve_exact, rerank_shortcircuit, dag_chains, version_chains, matched_texts, decomposed, answers, paraphrased, variant_texts, memorized, memory_chunks, stored_documents, store_search, vector_tables, low_conf_enrich, responses, context_budget,
    version_parents, version_graph, linked_kps, sliding_chunks, paragraph_split, session_text, turn_chunks, token_counts, session_order, json_repair_strings, json_repair_points, json_repair_subqueries, json_repair_notes, hash_embedding, kp_topk, answer_contexts,
    max_sim_by_method, alignment_best_session, paired_stats, category_breakdown, pairwise_method_stats, method_summary, distance_matrix, directional_alignment, discriminability, hit_at_k,
    robustness, robustness_overall, style_drop, friedman_chi2, drift_checkpoints, usage_stats, ari_nmi, kmeans_labels, upsert_delete, incremental_missing, stored_sessions,
)}
