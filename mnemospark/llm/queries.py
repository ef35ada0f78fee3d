"""Queries of problems 1, 3, 4, 6, 7 and 8 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import plain_name
from mnemospark.llm.abuse import score_abuse
from mnemospark.llm.ann import exact_neighbours, measured_queries, similar_vectors
from mnemospark.llm.chunking import split_oversized
from mnemospark.llm.mixing import mix
from mnemospark.llm.packing import pack
from mnemospark.llm.pii import redact
from mnemospark.llm.sql import ORACLES as ORACLES

TEXT_LIMIT, TEXT_OVERLAP = 4_000, 200
PARAGRAPH_LIMIT, PARAGRAPH_OVERLAP = 500, 50
CONTAINER_TOKENS = 2_048
NEIGHBOURS, LEAST_SIMILARITY, DIMENSIONS = 10, 0.90, 64
#: Lists searched for each vector: with a least similarity, and without one.
NEAR_PROBES, ALL_PROBES = 3, 16
#: Queries per collection for which the loss is measured by brute force.
MEASURED = 500


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- problem 1


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Session texts and facts with placeholders for personal information, and where it was."""
    speakers = _table(spark, sf, "samples").select(F.explode(F.array("speaker_a", "speaker_b")).alias("name")).distinct()
    given = sorted(r["name"] for r in speakers.where("name is not null").collect())  # samples doesn't grow
    texts = _table(spark, sf, "memories").select(F.lit("session_text").alias("field_name"), F.col("memory_id").alias("record_key"), F.col("session_text").alias("text"))
    facts = _table(spark, sf, "knowledge_points").select(F.lit("fact").alias("field_name"), F.concat("memory_id", F.lit("#"), "kp_index").alias("record_key"), F.col("fact").alias("text"))
    return redact(texts.unionByName(facts), ["field_name", "record_key"], "text", given)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each record and kind of personal information in it."""
    return p1_redacted(spark, sf).where("record_key is not null").select("field_name", "record_key", F.explode("kinds").alias("kind")).distinct()


# ---------------------------------------------------------------- problem 3


def _collections(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    child = lambda t, i: _table(spark, sf, t).select(F.concat("memory_id", F.lit("#"), i).alias("key"), "embedding")
    return {
        "fake_queries": _table(spark, sf, "fake_queries").select(F.col("query_id").alias("key"), "embedding"),
        "content_chunks": child("content_chunks", "chunk_index"),
        "paragraphs": child("paragraphs", "paragraph_index"),
    }


def _neighbours(spark: SparkSession, sf: str, probes: int, least: float | None = None) -> DataFrame:
    each = [similar_vectors(df, "key", "embedding", NEIGHBOURS, DIMENSIONS, least, probes=probes).withColumn("collection", F.lit(name)) for name, df in _collections(spark, sf).items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar vectors for every vector of the three collections."""
    return _neighbours(spark, sf, ALL_PROBES)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of which one is among the 10 most similar of the other, with a cosine of at least 0.90."""
    near = _neighbours(spark, sf, NEAR_PROBES, LEAST_SIMILARITY).where(F.col("similarity") >= LEAST_SIMILARITY)
    return near.select("collection", F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Per collection, the share of the exact 10 most similar that p3_neighbours finds, over some queries."""
    out = None
    for name, df in _collections(spark, sf).items():
        queries = measured_queries(df, "key", "embedding", MEASURED, DIMENSIONS)
        exact = exact_neighbours(df, "key", "embedding", queries, NEIGHBOURS, DIMENSIONS)
        found = similar_vectors(df, "key", "embedding", NEIGHBOURS, DIMENSIONS, probes=ALL_PROBES).select("key", "neighbour", F.lit(1).alias("hit"))
        one = exact.join(found, ["key", "neighbour"], "left").agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"))
        one = one.select(F.lit(name).alias("collection"), "exact", "found", (F.col("found") / F.col("exact")).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- problem 4


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every session text over 4 000 and every paragraph over 500 characters."""
    texts = _table(spark, sf, "memories").select(F.col("memory_id").alias("record_key"), "session_text")
    paragraphs = _table(spark, sf, "paragraphs").select(F.concat("memory_id", F.lit("#"), "paragraph_index").alias("record_key"), "text")
    a = split_oversized(texts, ["record_key"], "session_text", TEXT_LIMIT, TEXT_OVERLAP).withColumn("field_name", F.lit("session_text"))
    b = split_oversized(paragraphs, ["record_key"], "text", PARAGRAPH_LIMIT, PARAGRAPH_OVERLAP).withColumn("field_name", F.lit("paragraph"))
    return a.unionByName(b)


def p4_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Each item put together again from its pieces, without what they share: its digest, and whether all pieces keep to the limit and the overlap."""
    p = p4_pieces(spark, sf)
    session = F.col("field_name") == "session_text"
    limit, overlap = F.when(session, TEXT_LIMIT).otherwise(PARAGRAPH_LIMIT), F.when(session, TEXT_OVERLAP).otherwise(PARAGRAPH_OVERLAP)
    own = F.struct("piece_no", F.substr("piece", F.col("shared_chars") + 1).alias("own"))
    kept = F.min((F.length("piece") <= limit) & (F.col("shared_chars") <= overlap) & (F.length("piece") > 0))
    whole = p.groupBy("field_name", "record_key").agg(F.array_sort(F.collect_list(own)).alias("l"), kept.alias("within_limits"))  # an item's pieces
    return whole.select("field_name", "record_key", F.md5(F.array_join(F.transform("l", lambda e: e["own"]), "")).alias("text_md5"), "within_limits")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every item over its limit, and whether a forced cut was needed."""
    forced = F.max(F.col("boundary") == "forced")
    return p4_pieces(spark, sf).groupBy("field_name", "record_key").agg(F.when(forced, "forced").otherwise("natural").alias("cut"))


# ---------------------------------------------------------------- problem 6


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, or part of one, with its container of 2 048 tokens."""
    return pack(_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", CONTAINER_TOKENS)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that lie in more than one container."""
    lies = p6_containers(spark, sf).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return lies.where("a <> b").select("doc_id")


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and containers of each document, from the containers it lies in."""
    parts = p6_containers(spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("container").alias("n_containers"))
    return parts.select("doc_id", "n_tokens", "n_containers")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How many containers are used, how many are needed at least, and how full they are."""
    each = p6_containers(spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    least = F.ceil(F.sum("n") / CONTAINER_TOKENS)
    return each.agg(F.count(F.lit(1)).alias("containers"), least.alias("at_least"), (F.sum("n") / (F.count(F.lit(1)) * CONTAINER_TOKENS)).alias("fill"), F.max("n").alias("fullest"))


# ---------------------------------------------------------------- problem 7


def _mix(spark: SparkSession, sf: str):
    return mix(_table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text", _table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, sf).documents


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf).report


def p7_reached(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source has its share in the mix, or all that its repeats allow, to some documents or a thousandth of all tokens."""
    r = p7_shares(spark, sf)
    due = F.least("target_share", F.col("max_repeats") * F.col("available_tokens") * F.col("size_share") / F.greatest("used_tokens", F.lit(1)))
    return r.select("source", "available_tokens", (F.abs(F.col("size_share") - due) < 0.001 + 5 * F.col("size_share") / F.greatest("used_documents", F.lit(1))).alias("met"), "reachable", (F.col("used_tokens") <= F.col("max_repeats") * F.col("available_tokens")).alias("within_repeats"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that the mix uses up without reaching their share."""
    return p7_shares(spark, sf).where("not reachable").select("source")


# ---------------------------------------------------------------- problem 8


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score, probability and worst window of every document."""
    documents = _table(spark, sf, "documents").select("doc_id", "text", "case_no")
    return score_abuse(documents, "doc_id", "text", _table(spark, sf, "review_labels").select("doc_id", "abusive"), case="case_no")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with abusive content."""
    return p8_scores(spark, sf).where("flagged and doc_id is not null").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, the share of documents with abusive content and the mean probability."""
    scores = p8_scores(spark, sf).groupBy("doc_id").agg(F.max("probability").alias("probability"), F.max("flagged").alias("flagged"))
    sources = _table(spark, sf, "documents").select("doc_id", plain_name("source").alias("source")).groupBy("doc_id").agg(F.min("source").alias("source"))
    flagged = F.sum(F.col("flagged").cast("int"))
    return sources.join(scores, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), flagged.alias("flagged"), (flagged / F.count(F.lit(1))).alias("rate"), F.avg("probability").alias("mean_probability"))


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted,
    "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
    "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rebuilt": p4_rebuilt,
    "p6_found": p6_found, "p6_containers": p6_containers, "p6_documents": p6_documents, "p6_fill": p6_fill,
    "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_reached": p7_reached,
}
