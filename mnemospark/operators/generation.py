"""Model-dependent steps around retrieval: sub-queries, answers, and texts for the analyses.

Each is a prompt column, a generator and a repairing parser, so a real model only replaces the generator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import jsonrepair, text
from mnemospark.functions.prompts import prompt
from mnemospark.providers import Embedder, ExtractiveGenerator, HashEmbedder, TextGenerator, embed, generate

#: Ways of asking indirectly, in the order that the prompt asks for them.
STYLES = ["implication", "scenario", "consequence", "periphery", "negation"]


def decompose(requests: DataFrame, generator: Callable[[], TextGenerator] = ExtractiveGenerator, embedder: Callable[[], Embedder] = HashEmbedder, language: str = "en") -> DataFrame:
    """``sub_id, request, sq_index, text, keywords, embedding`` of ``requests`` (``request, query`` and perhaps ``history``): what ``retrieve`` takes.

    What the generator doesn't split is one sub-query, the request itself. Null requests are left out.
    """
    history = F.col("history") if "history" in requests.columns else F.lit(None).cast("string")
    r = requests.where("query is not null").select("request", "query", generate(prompt("decompose", language, query=F.col("query"), history=F.regexp_replace(history, r"\s+", " ")), generator).alias("raw"))
    each = r.select("request", F.posexplode(jsonrepair.sub_queries("raw", "query")).alias("sq_index", "q")).select("request", "sq_index", F.col("q.query").alias("text"), "q.keywords")
    sub_id = F.concat_ws("#", F.col("request").cast("string"), "sq_index")
    return each.select(sub_id.alias("sub_id"), "request", "sq_index", "text", "keywords", embed(text.sub_query_text("text", "keywords"), embedder).alias("embedding"))


def answer(requests: DataFrame, contexts: DataFrame, generator: Callable[[], TextGenerator] = ExtractiveGenerator, language: str = "en") -> DataFrame:
    """``request, answer`` for requests (``request, query`` and perhaps ``wanted``) that have a context (``request, context``).

    A request with no results has none, and isn't answered; nor is one whose ``wanted`` isn't true.
    """
    asked = requests.where("wanted") if "wanted" in requests.columns else requests
    rows = asked.select("request", "query").join(contexts, "request")
    return rows.select("request", generate(prompt("answer", language, context=F.col("context"), query=F.col("query")), generator).alias("answer"))


def paraphrases(queries: DataFrame, generator: Callable[[], TextGenerator] = ExtractiveGenerator, language: str = "en") -> DataFrame:
    """``query_id, style, text`` of ``queries`` (``query_id, text, answer, context``): the same question asked in five indirect ways; what is missing is empty."""
    raw = generate(prompt("paraphrases", language, query=F.col("text"), answer=F.col("answer"), context=F.col("context")), generator)
    styled = queries.select("query_id", F.posexplode(F.map_entries(jsonrepair.styles(raw, STYLES))).alias("n", "e"))
    return styled.select("query_id", F.col("e.key").alias("style"), F.col("e.value").alias("text"))


def notes(sessions: DataFrame, generator: Callable[[], TextGenerator] = ExtractiveGenerator, language: str = "en") -> DataFrame:
    """``session_id, pos, title, key_insight, content, tags, text`` of ``sessions`` (``session_id, text``); ``text`` is what is embedded."""
    raw = generate(prompt("notes", language, session=F.col("text")), generator)
    n = sessions.where("text is not null").select("session_id", F.posexplode(jsonrepair.notes(raw)).alias("pos", "n")).select("session_id", "pos", "n.*")
    return n.withColumn("text", text.note_text("title", "key_insight", "content")).where("text is not null")


def variants(sessions: DataFrame, kind: str, generator: Callable[[], TextGenerator] = ExtractiveGenerator, language: str = "en") -> DataFrame:
    """``session_id, pos, text``: ``fake_queries``, ``propositions`` or ``reflections`` of ``sessions`` (``session_id, text``)."""
    raw = generate(prompt(kind, language, session=F.col("text"), n=10), generator)
    read = jsonrepair.strings if kind == "fake_queries" else jsonrepair.variants
    return sessions.where("text is not null").select("session_id", F.posexplode(read(raw)).alias("pos", "text"))


def resume(spark: SparkSession, path: str, wanted: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Append ``make`` of those ``wanted`` whose ``key`` isn't in the table at ``path`` yet; how many keys were pending.

    What was written stays if a later run fails. A key for which nothing is made is marked as done by a row with nulls.
    """
    try:
        done = spark.read.parquet(path).select(key).distinct()
        pending = wanted.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        pending = wanted
    pending = pending.persist()
    try:
        n = pending.select(key).distinct().count()
        if n:
            made = make(pending)
            rows = pending.select(key).distinct().join(made, key, "left").select(*made.columns)
            rows.write.mode("append").parquet(path)
        return n
    finally:
        pending.unpersist()


def write_result(summary: DataFrame, path: str) -> None:
    """A summary as one JSON file, nulls kept; it has a row or a few."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
