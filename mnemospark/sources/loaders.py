"""Loaders of conversation data sets: sessions, true queries and the evidence for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.functions.text import session_text, stripped

#: Date patterns, tried in this order.
PATTERNS = ("h:mm a 'on' d MMMM, yyyy", "yyyy-M-d", "yyyy-M-d'T'H:m:s", "M/d/yyyy")
_TURNS = "array<struct<speaker:string,role:string,text:string,content:string>>"


@dataclass
class Dataset:
    """``sessions`` (session_id, sample_id, date, turns, text), ``queries`` (query_id, text, answer, category) and ``evidence`` (query_id, ev_pos, session_id)."""

    sessions: DataFrame
    queries: DataFrame
    evidence: DataFrame

    def answer_sessions(self) -> DataFrame:
        """The sessions that hold evidence for some question."""
        return self.sessions.join(self.evidence.select("session_id").distinct(), "session_id", "left_semi")

    def session(self, session_id: str) -> DataFrame:
        """A session by its id."""
        return self.sessions.where(F.col("session_id") == session_id)

    def session_texts(self) -> DataFrame:
        """``session_id, text``: what is embedded and what questions are generated from."""
        return self.sessions.select("session_id", "text")

    def query_texts(self) -> DataFrame:
        """``query_id, text, answer``: what is paraphrased."""
        return self.queries.select("query_id", "text", "answer")

    def summary(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self.sessions.agg(n.alias("sessions")).crossJoin(self.queries.agg(n.alias("queries")))


def parse_date(c: str):
    """The first pattern that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(p)) for p in PATTERNS])


def temporal_order(sessions: DataFrame, group: str, date: str, tie: str) -> DataFrame:
    """Adds ``date_ts`` and ``seq``: dated sessions of a group by time, then undated ones, ties by ``tie``.

    A group is ranked month by month, and each month begins where those before it end, so a large group
    is sorted by many tasks. Undated sessions are ranked by the beginnings of ``tie``, if that is a string.
    """
    undated = F.concat(F.lit("undated"), F.substring(tie, 1, 5)) if sessions.schema[tie].dataType.typeName() == "string" else F.lit("undated")
    dated = sessions.withColumn("date_ts", parse_date(date)).withColumn("__month", F.coalesce(F.date_format("date_ts", "yyyy-MM"), undated, F.lit("undated")))
    counts = dated.groupBy(F.col(group).alias("__g"), "__month").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__g").orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__g", F.col("__month").alias("__m"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(group, "__month").orderBy("date_ts", tie))
    ranked = dated.withColumn("__within", within).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__month") == F.col("__m")))
    return ranked.withColumn("seq", (F.col("__within") + F.col("__before")).cast("int")).drop("__month", "__g", "__m", "__within", "__before")


def load_samples(spark: SparkSession, path: str, min_turns: int = 3, categories: list[int] | None = None) -> Dataset:
    """A list of samples with numbered sessions and questions.

    Sessions run from 1 to the first gap; those with fewer turns are left out. A question whose evidence
    names no session that is left is dropped.
    """
    raw = spark.read.schema(schemas.SAMPLE_DOCUMENT).option("multiLine", True).json(path)
    all_ = raw.select("sample_id", F.explode("conversation").alias("key", "value"), "conversation")
    n = F.regexp_extract("key", r"^session_(\d+)$", 1)
    numbered = all_.where(n != "").withColumn("n", n.cast("int"))
    gapless = F.row_number().over(Window.partitionBy("sample_id").orderBy("n")) == F.col("n")
    turns = F.from_json("value", _TURNS)
    turns = F.transform(turns, lambda t: F.struct(F.coalesce(F.nullif(t["speaker"], F.lit("")), t["role"]).alias("speaker"), F.coalesce(F.nullif(t["text"], F.lit("")), t["content"]).alias("text")))
    s = numbered.withColumn("ok", gapless).where("ok").withColumn("turns", turns).where(F.size("turns") >= min_turns)
    s = s.select(F.concat("sample_id", F.lit("_s"), "n").alias("session_id"), "sample_id", F.col("conversation")[F.concat(F.lit("session_"), "n", F.lit("_date_time"))].alias("date"), "turns", session_text("turns").alias("text"))
    q = raw.select("sample_id", F.posexplode("qa").alias("i", "q"))
    if categories:
        q = q.where(F.col("q.category").isin(categories))
    q = q.withColumn("query_id", F.concat("sample_id", F.lit("_q"), "i"))
    named = q.select("query_id", "sample_id", F.explode("q.evidence").alias("e")).select("query_id", F.concat("sample_id", F.lit("_s"), F.regexp_extract(stripped("e"), r"^D(\d+):(\d+)", 1)).alias("session_id")).distinct()
    named = named.join(s.select("session_id"), "session_id", "left_semi")
    evidence = named.withColumn("ev_pos", F.row_number().over(Window.partitionBy("query_id").orderBy("session_id")) - 1)
    queries = q.join(evidence.select("query_id"), "query_id", "left_semi").select("query_id", F.col("q.question").alias("text"), F.col("q.answer").alias("answer"), F.col("q.category").cast("string").alias("category"))
    return Dataset(s, queries, evidence)


def load_haystacks(spark: SparkSession, path: str, min_turns: int = 2) -> Dataset:
    """Entries that each bring their own sessions; a session that several bring is taken from the first.

    Evidence are the answer's sessions among an entry's own, even if they are too short to be kept.
    """
    raw = spark.read.schema(schemas.HAYSTACK_DOCUMENT).option("multiLine", True).json(path).withColumn("entry", F.monotonically_increasing_id())
    zipped = raw.select("entry", "question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_sessions", "haystack_dates")).alias("i", "z"))
    first = F.row_number().over(Window.partitionBy("z.haystack_session_ids").orderBy("entry", "i")) == 1
    turns = F.transform("z.haystack_sessions", lambda t: F.struct(t["role"].alias("speaker"), t["content"].alias("text")))
    s = zipped.withColumn("first", first).where("first").withColumn("turns", turns).where(F.size("turns") >= min_turns)
    s = s.select(F.col("z.haystack_session_ids").alias("session_id"), F.col("question_id").alias("sample_id"), F.col("z.haystack_dates").alias("date"), "turns", session_text("turns").alias("text"))
    own = raw.select(F.col("question_id").alias("query_id"), F.posexplode(F.filter("answer_session_ids", lambda a: F.array_contains("haystack_session_ids", a))).alias("ev_pos", "session_id"))
    queries = raw.join(own.select(F.col("query_id").alias("question_id")), "question_id", "left_semi").select(F.col("question_id").alias("query_id"), F.col("question").alias("text"), "answer", F.col("question_type").alias("category"))
    return Dataset(s, queries, own.select("query_id", "ev_pos", "session_id"))


LOADERS = {"samples": load_samples, "haystacks": load_haystacks}


def load(spark: SparkSession, name: str, path: str, **options) -> Dataset:
    return LOADERS[name.lower()](spark, path, **options)
