"""The engine's input tables, derived from the test tables of a folder.

Every frame here is a plain projection or one equi-join of whole tables, so a
query over it grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge.functions.embedding import Embedder, HashedWords
from topicgauge.operators.transcripts import pair_turns
from topicgauge.session import spread

SIGN_DIMS = 5
EPOCH_START = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scores(spark: SparkSession, folder: str, by_user: bool = False) -> DataFrame:
    """Events as scores over time, clustered by user, or user and event type."""
    user = F.col("user_id")
    cluster = user if by_user else user * 10 + F.length("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("response_id"),
        cluster.alias("cluster_id"),
        F.col("ts").alias("created_at"),
        (1.0 / (1.0 + F.col("value") / 50.0)).alias("quality_score"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with an id, a time that grows with it, and their label."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.col("label").cast("string").alias("label"),
        "embedding",
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id")).alias("created_at"),
    )


def sign_group(vector: Column) -> Column:
    """Cluster key of a vector: the signs of its first components."""
    return F.concat(
        *[F.when(F.get(vector, F.lit(i)) > 0, "1").otherwise("0") for i in range(SIGN_DIMS)]
    )


def grouped_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).withColumn("cluster_id", sign_group(F.col("embedding")))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as clustered responses, one cluster per label."""
    return vectors(spark, folder).select(
        F.col("vec_id").cast("string").alias("response_id"),
        F.col("label").alias("cluster_id"),
        "created_at",
        F.col("embedding").alias("request_embedding"),
        F.col("embedding").alias("response_embedding"),
        F.concat(F.lit("text "), F.col("vec_id")).alias("response_text"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pair_turns(spread(table(spark, folder, "conversations")))


def embedded_documents(
    spark: SparkSession, folder: str, embedder: Embedder = HashedWords(64)
) -> DataFrame:
    """Documents as responses to cluster; the topic hint is language and source."""
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).select(
        F.col("doc_id").cast("string").alias("response_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("created_at"),
        F.concat_ws("|", "lang", "source").alias("group"),
        embedder.column(F.col("text")).alias("request_embedding"),
    )


# A model name per event type, so that routing has work to do.
MODELS = {
    "click": "gpt-4o",
    "error": "claude-3-5-sonnet",
    "purchase": "o1-preview",
    "signup": "o3-mini",
    "view": "mistral-large",
}


def model_of(event_type: Column) -> Column:
    out = None
    for kind, model in MODELS.items():
        out = F.when(event_type == kind, model) if out is None else out.when(event_type == kind, model)
    return out.otherwise("other")


def logged_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Events as logged calls: model, stream flag, latency, time."""
    return table(spark, folder, "events").select(
        "event_id",
        model_of(F.col("event_type")).alias("model"),
        (F.col("event_id") % 2 == 0).alias("stream"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        F.col("ts").alias("created_at"),
    )
