"""Quality scores: mean cosine of a response against its cluster's goldens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions.embedding import Embedder
from topicgauge.functions.vectors import along_kernel, once, sq_norm_kernel, unit_kernel, vec_sum
from topicgauge.operators.golden import golden_id
from topicgauge.params import Params
from topicgauge.session import broadcast_if_small

ROUNDING = 1e-6


def golden_directions(goldens: DataFrame) -> DataFrame:
    """Per cluster: how many goldens, and the sum of their unit vectors.

    The mean cosine of v against a set is unit(v) · mean(unit(g)), so one
    vector per cluster stands for the whole set: O(responses + goldens), and
    a golden without length counts as 0 in the mean.
    """
    return (
        goldens.where(F.col("expected_embedding").isNotNull() & F.col("cluster_id").isNotNull())
        .withColumn("direction", unit_kernel("expected_embedding"))
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("goldens"), vec_sum(F.col("direction")).alias("direction"))
    )


def mean_similarity(responses: DataFrame, goldens: DataFrame, params: Params) -> DataFrame:
    """`responses` (response_id, cluster_id, response_embedding) plus mean_sim.

    Rows without a cluster, or whose cluster has no golden, drop out. With
    `exclude_self` the response's own golden (same response) is taken out of
    its mean.
    """
    sets = broadcast_if_small(golden_directions(goldens), params.broadcast_limit_bytes, "direction")
    joined = responses.join(sets, "cluster_id").withColumn(
        "total", once(along_kernel)("response_embedding", "direction")
    )
    count = F.col("goldens").cast("double")
    total = F.col("total")
    if params.exclude_self:
        own = goldens.select("golden_id", F.lit(True).alias("own"))
        joined = joined.join(own, golden_id(F.col("response_id")) == F.col("golden_id"), "left")
        mine = F.coalesce("own", F.lit(False))
        # A vector's cosine with itself is 1, or 0 when it has no length.
        itself = F.when(sq_norm_kernel("response_embedding") > 0, 1.0).otherwise(0.0)
        total = F.when(mine, total - itself).otherwise(total)
        count = F.when(mine, count - 1).otherwise(count)
        joined = joined.where(~mine | (F.col("goldens") > 1))
    return joined.withColumn("mean_sim", F.try_divide(total, count)).select(
        *responses.columns, "mean_sim"
    )


def stored_score(mean_sim: Column) -> Column:
    """The score kept: within [0, 1], rounding overshoot cut, else NULL."""
    over = (mean_sim > 1) & (mean_sim <= 1 + ROUNDING)
    return F.when(over, F.lit(1.0)).when((mean_sim >= 0) & (mean_sim <= 1), mean_sim)


def evaluate(responses: DataFrame, goldens: DataFrame, params: Params) -> DataFrame:
    """(response_id, quality_score, reject_reason) of the given responses."""
    score = stored_score(F.col("mean_sim"))
    return mean_similarity(
        responses.select("response_id", "cluster_id", "response_embedding"), goldens, params
    ).select(
        "response_id",
        score.alias("quality_score"),
        F.when(score.isNull(), F.lit("out_of_range")).alias("reject_reason"),
    )


def fill_embeddings(responses: DataFrame, embedder: Embedder) -> DataFrame:
    """Responses stored without a vector are embedded from their text; the
    model runs only over those."""
    has = F.col("response_embedding").isNotNull()
    fresh = responses.where(~has).withColumn(
        "response_embedding", embedder.column(F.col("raw_content"))
    )
    return responses.where(has).unionByName(fresh)


def pending_evaluations(
    responses: DataFrame, current: DataFrame, scores: DataFrame
) -> DataFrame:
    """Sampled responses with a cluster and no score yet.

    `current`: response_id, cluster_id. "Flag cleared" is an anti-join with
    what has been scored or rejected.
    """
    return (
        responses.where(F.col("sampled"))
        .join(current, "response_id")
        .where(F.col("cluster_id").isNotNull())
        .join(scores.select("response_id"), "response_id", "left_anti")
    )


def flagged_in_batch(batch: DataFrame, responses: DataFrame) -> DataFrame:
    """Ids of the batch whose response is marked for evaluation."""
    flagged = responses.where(F.col("sampled")).select("response_id")
    return batch.select("response_id").join(flagged, "response_id", "left_semi")
