"""Golden sets: up to a cap of reference responses per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicgauge.functions.embedding import Embedder
from topicgauge.schemas import TABLES


def golden_id(natural_key: Column) -> Column:
    return F.sha2(F.concat(F.lit("golden|"), natural_key), 256).substr(1, 32)


def admit(
    candidates: DataFrame, goldens: DataFrame, clusters: DataFrame, cap: int
) -> DataFrame:
    """New goldens from `candidates`, earliest first, up to `cap` per live cluster.

    `candidates`: response_id, cluster_id, created_at, response_text,
    response_embedding, request_embedding. Ranking runs on the three narrow
    columns, and its literal bound keeps at most `cap` rows per cluster and
    input partition before the shuffle; texts and vectors join in afterwards
    for the admitted rows only.
    """
    held = goldens.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("held"))
    earliest = Window.partitionBy("cluster_id").orderBy("created_at", "response_id")
    ranked = (
        candidates.select("cluster_id", "created_at", "response_id")
        .withColumn("rank", F.row_number().over(earliest))
        .where(F.col("rank") <= F.lit(cap))
    )
    admitted = (
        ranked.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
        .join(held, "cluster_id", "left")
        .where(F.col("rank") <= F.lit(cap) - F.coalesce("held", F.lit(0)))
        .select("response_id")
    )
    return candidates.join(admitted, "response_id").select(
        golden_id(F.col("response_id")).alias("golden_id"),
        "response_text",
        F.col("response_embedding").alias("expected_embedding"),
        "request_embedding",
        F.lit("auto").alias("description"),
        "cluster_id",
        "created_at",
    )


def manual_goldens(entries: DataFrame, embedder: Embedder, now: Column) -> DataFrame:
    """Goldens from given (response_text, description) rows, no cluster yet."""
    return entries.select(
        golden_id(F.concat_ws("|", "description", "response_text")).alias("golden_id"),
        "response_text",
        embedder.column(F.col("response_text")).alias("expected_embedding"),
        F.lit(None).cast("array<float>").alias("request_embedding"),
        "description",
        F.lit(None).cast("string").alias("cluster_id"),
        now.alias("created_at"),
    )


def insert(goldens: DataFrame, rows: DataFrame) -> DataFrame:
    return goldens.unionByName(rows.select(*goldens.columns))


def listing(goldens: DataFrame) -> DataFrame:
    return goldens.select("golden_id", "description", "created_at").orderBy("created_at", "golden_id")


def cleared(goldens: DataFrame) -> tuple[DataFrame, int]:
    """(empty snapshot, number of goldens it drops)."""
    empty = goldens.sparkSession.createDataFrame([], TABLES["goldens"])
    return empty, goldens.count()


def of_cluster(goldens: DataFrame, cluster_id: str | None = None) -> DataFrame:
    """Golden embeddings, of one cluster or of all."""
    rows = goldens if cluster_id is None else goldens.where(F.col("cluster_id") == cluster_id)
    return rows.select("golden_id", "cluster_id", "expected_embedding")


def counts(goldens: DataFrame) -> DataFrame:
    return goldens.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("goldens"))
