"""Queries of problem 2 over sessions, memories and knowledge points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.timestamps import normalise_moments
from mnemospark.session import cut


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Every date string of the three tables with its moment or the reason why it has none."""
    zones = _table(spark, sf, "samples").groupBy("sample_id").agg(F.max("home_tz").alias("home_tz"))
    memories = _table(spark, sf, "memories")
    owners = memories.select("memory_id", "sample_id").where("memory_id is not null").groupBy("memory_id").agg(F.max("sample_id").alias("sample_id"))
    points = _table(spark, sf, "knowledge_points").select("memory_id", "kp_index", "time")
    strings = (
        _table(spark, sf, "sessions").select(F.lit("date").alias("field_name"), F.col("session_id").alias("record_key"), "sample_id", F.col("date").alias("raw_value"))
        .unionByName(memories.select(F.lit("created_at").alias("field_name"), F.col("memory_id").alias("record_key"), "sample_id", F.col("created_at").alias("raw_value")))
        .unionByName(points.join(owners, "memory_id", "left").select(F.lit("time").alias("field_name"), F.concat("memory_id", F.lit("#"), "kp_index").alias("record_key"), "sample_id", F.col("time").alias("raw_value")))
        .join(zones, "sample_id", "left")
    )
    return normalise_moments(strings, "raw_value", "home_tz", ["field_name", "record_key", "sample_id", "raw_value"])


def p2_status(spark: SparkSession, sf: str) -> DataFrame:
    """How many strings of each field denote a moment, and why the others don't."""
    return p2_moments(spark, sf).groupBy("field_name", "moment_status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw_value").alias("n_distinct"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records of a sample and field that denote the same moment; repeated rows count once."""
    at = ["field_name", "sample_id", "moment"]
    moments = p2_moments(spark, sf).where("moment_status = 'moment' and record_key is not null and sample_id is not null").select(*at, "record_key").distinct()
    moments = cut(moments)  # both sides of the join read it
    a, b = moments.withColumnRenamed("record_key", "key_a"), moments.withColumnRenamed("record_key", "key_b")
    return a.join(b, at).where("key_a < key_b").select("field_name", "key_a", "key_b").distinct()


QUERIES = {"p2_found": p2_found, "p2_moments": p2_moments, "p2_status": p2_status}
