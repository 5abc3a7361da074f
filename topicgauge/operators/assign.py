"""Cluster assignment of a batch against a snapshot of the clusters.

Every row is tested against the snapshot, absorbed rows are merged into their
clusters as summed deltas (nothing is lost to races), and rows nothing absorbs
grow new clusters. With one row per batch this is the online algorithm.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions.vectors import cf_centroid, group_features, vec_add
from topicgauge.operators.grow import grow_clusters
from topicgauge.operators.knn import top_candidates
from topicgauge.params import Params
from topicgauge.session import materialize


def as_points(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Rows with the item_id and vector `v` the search looks at."""
    return rows.withColumn("item_id", F.col(id_column).cast("string")).withColumn("v", F.col(vector))


def nearest_clusters(
    rows: DataFrame, id_column: str, vector: str, clusters: DataFrame, params: Params
) -> DataFrame:
    """Long form of the top-K search: (id, rank, cluster_id, sim), rank from 1."""
    found = top_candidates(
        as_points(rows.select(id_column, vector), id_column, vector), clusters, params
    )
    return found.select(
        id_column, F.posexplode("candidates").alias("pos", "c")
    ).select(
        id_column,
        (F.col("pos") + 1).alias("rank"),
        F.col("c.cluster_id").alias("cluster_id"),
        F.col("c.sim").alias("sim"),
    )


def best_absorbing(candidates: Column) -> Column:
    """The nearest candidate that absorbs; an exactly opposite one never does."""
    return F.try_element_at(
        F.filter(candidates, lambda c: c["absorbs"] & (c["sim"] > -1.0)), F.lit(1)
    )


def snapshot_assign(
    rows: DataFrame, id_column: str, vector: str, clusters: DataFrame, params: Params
) -> DataFrame:
    """`rows` plus cluster_id and sim of the absorbing cluster (NULL: a miss)."""
    found = top_candidates(as_points(rows, id_column, vector), clusters, params)
    return (
        found.withColumn("hit", best_absorbing(F.col("candidates")))
        .select(*rows.columns, F.col("hit.cluster_id").alias("cluster_id"), F.col("hit.sim").alias("sim"))
    )


def merge_deltas(clusters: DataFrame, deltas: DataFrame, updated_at: Column) -> DataFrame:
    """Clusters with the CFs in `deltas` (cluster_id, n, ls, ss) added."""
    d = deltas.select(
        "cluster_id", F.col("n").alias("dn"), F.col("ls").alias("dls"), F.col("ss").alias("dss")
    )
    touched = F.col("dn").isNotNull()
    summed = clusters.join(d, "cluster_id", "left").select(
        "cluster_id",
        (F.col("n") + F.coalesce("dn", F.lit(0))).alias("n"),
        F.when(touched, vec_add(F.col("ls"), F.col("dls"))).otherwise(F.col("ls")).alias("ls"),
        (F.col("ss") + F.coalesce("dss", F.lit(0.0))).alias("ss"),
        "created_at",
        F.when(touched, updated_at).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    # A step of its own: inside a lambda, `n` would mean the new column of the
    # same projection.
    centroid = cf_centroid(F.col("n"), F.col("ls")).alias("centroid")
    return summed.select("cluster_id", "n", "ls", "ss", centroid, "created_at", "updated_at")


def backfill_centroids(clusters: DataFrame) -> DataFrame:
    """Centroids recomputed from the CFs of all clusters that have members."""
    fresh = F.when(F.col("n") > 0, cf_centroid(F.col("n"), F.col("ls")))
    return clusters.withColumn("centroid", F.coalesce(fresh, F.col("centroid")))


@dataclass
class Assigned:
    rows: DataFrame  # the batch plus cluster_id, never NULL
    clusters: DataFrame  # the next snapshot
    deltas: DataFrame  # what the batch adds to clusters, and the clusters it founds


def assign_batch(
    batch: DataFrame, clusters: DataFrame, params: Params, now: Column
) -> Assigned:
    """Assign every row of `batch` (response_id, created_at, request_embedding, …)."""
    scored = materialize(
        snapshot_assign(batch, "response_id", "request_embedding", clusters, params).drop("sim")
    )
    hits = scored.where(F.col("cluster_id").isNotNull())
    misses = scored.where(F.col("cluster_id").isNull()).drop("cluster_id")
    grown = grow_clusters(misses, params)
    times = [now.alias("created_at"), now.alias("updated_at")]
    founded = grown.clusters.select("cluster_id", "n", "ls", "ss", *times)
    fresh = founded.withColumn("centroid", cf_centroid(F.col("n"), F.col("ls")))
    deltas = group_features(hits, ["cluster_id"], "request_embedding")
    rows = hits.unionByName(misses.join(grown.members, "response_id").select(*hits.columns))
    return Assigned(
        rows,
        merge_deltas(clusters, deltas, now).unionByName(fresh),
        deltas.select("cluster_id", "n", "ls", "ss", *times).unionByName(founded),
    )


def assign_goldens(goldens: DataFrame, clusters: DataFrame, params: Params) -> DataFrame:
    """Give goldens without a cluster the nearest one, so that manual goldens
    take part in evaluation."""
    loose = goldens.where(F.col("cluster_id").isNull()).drop("cluster_id").withColumn(
        "pivot", F.coalesce("request_embedding", "expected_embedding")
    )
    found = top_candidates(
        as_points(loose, "golden_id", "pivot"), clusters, replace(params, ann_candidates=1)
    )
    placed = found.withColumn("cluster_id", F.try_element_at("candidates", F.lit(1))["cluster_id"])
    return goldens.where(F.col("cluster_id").isNotNull()).unionByName(
        placed.select(*goldens.columns)
    )
