"""Drift detection: last scores per topic, older half against newer half."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicgauge.params import MIN_SCORES, SCORE_WINDOW


def recent_scores(scores: DataFrame, window: int = SCORE_WINDOW, *more: str) -> DataFrame:
    """The newest `window` non-null scores per cluster.

    Adds `newest_rank` (1 = newest). The literal rank bound lets Spark keep
    only `window` rows per cluster and input partition before the shuffle, so
    one cluster holding most scores costs no more than any other.
    """
    newest_first = Window.partitionBy("cluster_id").orderBy(
        F.col("created_at").desc(), F.col("response_id").desc()
    )
    return (
        scores.select("cluster_id", "response_id", "created_at", "quality_score", *more)
        .where(F.col("quality_score").isNotNull() & F.col("cluster_id").isNotNull())
        .withColumn("newest_rank", F.row_number().over(newest_first))
        .where(F.col("newest_rank") <= F.lit(window))
    )


def merge_recent(scores: DataFrame, window: int = SCORE_WINDOW) -> DataFrame:
    """The newest `window` scores per cluster of a base and of what came since.

    `scores`: cluster_id, response_id, created_at, quality_score, evaluated. Of
    one response the latest evaluation counts. The result is bounded by the
    clusters and merges again: newest of (newest of a, b) is newest of a and b.
    """
    latest = Window.partitionBy("cluster_id", "response_id").orderBy(F.col("evaluated").desc())
    once = scores.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    kept = recent_scores(once, window, "evaluated").drop("newest_rank")
    return kept.select("cluster_id", "response_id", "created_at", "quality_score", "evaluated")


def half_means(
    scores: DataFrame, window: int = SCORE_WINDOW, min_scores: int = MIN_SCORES
) -> DataFrame:
    """Per cluster: n_scores, baseline (older half) and current (newer half).

    With an odd count the middle score belongs to the newer half.
    """
    whole = Window.partitionBy("cluster_id")
    ranked = recent_scores(scores, window).withColumn("n_scores", F.count(F.lit(1)).over(whole))
    newer = F.col("newest_rank") <= F.col("n_scores") - F.expr("n_scores div 2")
    return (
        ranked.where(F.col("n_scores") >= min_scores)
        .groupBy("cluster_id")
        .agg(
            F.max("n_scores").alias("n_scores"),
            F.avg(F.when(~newer, F.col("quality_score"))).alias("baseline_score"),
            F.avg(F.when(newer, F.col("quality_score"))).alias("current_score"),
        )
    )


def relative_drop(baseline: Column, current: Column) -> Column:
    return F.when(baseline > 0, F.try_divide(baseline - current, baseline)).otherwise(F.lit(0.0))


def detect(
    scores: DataFrame,
    threshold: float,
    window: int = SCORE_WINDOW,
    min_scores: int = MIN_SCORES,
) -> DataFrame:
    """One row per cluster with enough scores: delta and whether it alerts.

    `scores` needs cluster_id, response_id, created_at, quality_score. All
    clusters are handled by one shuffle on cluster_id.
    """
    return (
        half_means(scores, window, min_scores)
        .withColumn("delta", relative_drop(F.col("baseline_score"), F.col("current_score")))
        .withColumn("threshold", F.lit(float(threshold)))
        .withColumn("alert_triggered", F.col("delta") > F.col("threshold"))
    )


def coverage(scores: DataFrame, min_scores: int = MIN_SCORES) -> DataFrame:
    """How many clusters have enough scores to be watched, and how many not."""
    per_cluster = (
        scores.where(F.col("quality_score").isNotNull() & F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("n_scores"))
    )
    return per_cluster.groupBy((F.col("n_scores") >= min_scores).alias("covered")).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n_scores").alias("scores")
    )


def drift_events(detections: DataFrame, run_ts: Column, channel: str) -> DataFrame:
    """Event rows of the alerting clusters.

    The id hashes cluster and run time, so writing the same run twice gives
    the same events.
    """
    return detections.where("alert_triggered").select(
        F.sha2(F.concat_ws("|", "cluster_id", run_ts.cast("string")), 256).substr(1, 32).alias("event_id"),
        run_ts.alias("detected_at"),
        "cluster_id",
        F.col("current_score").alias("similarity_score"),
        "baseline_score",
        "delta",
        F.lit(channel).alias("alert_channel"),
    )


def with_current_cluster(scores: DataFrame, current: DataFrame) -> DataFrame:
    """Scores joined to the cluster their response belongs to now."""
    return scores.join(current.select("response_id", "cluster_id", "created_at"), "response_id")
