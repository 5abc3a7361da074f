"""Operational numbers as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.functions.vectors import cf_centroid, cf_radius, dot
from topicgauge.params import LATENCY_BUCKETS_MS


def requests_by_model(responses: DataFrame) -> DataFrame:
    return responses.groupBy("model", "stream").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(
    responses: DataFrame, bounds: tuple[int, ...] = LATENCY_BUCKETS_MS
) -> DataFrame:
    """Cumulative buckets (le, bucket_count), with the total sum and count on
    every row. All buckets come from one pass; only their totals are unpivoted."""
    latency = F.col("latency_ms")
    totals = responses.agg(
        *[
            F.coalesce(F.sum(F.when(latency <= b, 1)), F.lit(0)).alias(f"le_{b}") for b in bounds
        ],
        F.count(latency).alias("le_inf"),
        F.coalesce(F.sum(latency.cast("bigint")), F.lit(0)).alias("latency_sum"),
    )
    buckets = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{b}").alias("bucket_count")) for b in bounds
    ]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("bucket_count")))
    return totals.select(
        F.explode(F.array(*buckets)).alias("b"), "latency_sum", F.col("le_inf").alias("latency_count")
    ).select("b.le", "b.bucket_count", "latency_sum", "latency_count")


def delivered_alerts(deliveries: DataFrame) -> DataFrame:
    return deliveries.where("sent").groupBy("channel").agg(F.count(F.lit(1)).alias("alerts"))


def latest_score(scores: DataFrame) -> DataFrame:
    """The score evaluated last, over all clusters.

    `scores` needs quality_score and what orders evaluations: epoch, created_at,
    response_id.
    """
    return scores.where(F.col("quality_score").isNotNull()).agg(
        F.max_by("quality_score", F.struct("epoch", "created_at", "response_id")).alias("quality_score")
    )


def golden_sizes(goldens: DataFrame) -> DataFrame:
    """Golden-set size per cluster, and in total (is_total), in one pass."""
    return goldens.rollup("cluster_id").agg(
        F.count(F.lit(1)).alias("goldens"), (F.grouping("cluster_id") == 1).alias("is_total")
    )


def cluster_report(clusters: DataFrame) -> DataFrame:
    ls = F.col("ls")
    return clusters.where(F.col("n") > 0).select(
        "cluster_id",
        "n",
        cf_radius(F.col("n"), dot(ls, ls), F.col("ss")).alias("radius"),
        cf_centroid(F.col("n"), ls).alias("centroid"),
    )
