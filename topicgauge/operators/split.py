"""Splitting clusters that have grown too wide: 2-means over all at once.

Per pass, each task reduces its rows to one partial row per cluster in numpy
(a sum, or one extreme point), and only those partials are shuffled, so a
cluster holding most rows is no hotter than the rest. The two centres of every
cluster under split live on the driver between passes, as k-means centres do;
clusters are taken in waves so that this state keeps under the broadcast limit.
The input is read once, whatever the number of waves: the rows under split are
written narrow, dealt by wave, and a wave's passes read its own folder only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicgauge.functions.vectors import (
    as_list_array,
    as_matrix,
    cf_centroid,
    cf_radius,
    cosine_kernel,
    dot,
    group_features,
    unit_rows,
    vec_sum,
)
from topicgauge.params import SPLIT_MIN_N, SPLIT_ROUNDS, Params
from topicgauge.session import broadcast_if_small, materialize

STILL = 1e-12
# Hash buckets in which the clusters under split are numbered.
BUCKETS = 1024
# Rows of a wave that one task writes, about.
WAVE_ROWS = 1 << 17


def oversized(clusters: DataFrame, threshold: float) -> DataFrame:
    """Clusters of at least four rows whose radius exceeds the threshold."""
    ls = F.col("ls")
    return clusters.where(
        ls.isNotNull()
        & (F.col("n") >= SPLIT_MIN_N)
        & (cf_radius(F.col("n"), dot(ls, ls), F.col("ss")) > F.lit(float(threshold)))
    )


@dataclass
class Split:
    members: DataFrame  # response_id, cluster_id (old), label, new_cluster_id
    parts: DataFrame  # cluster_id (old), label, new_cluster_id, n, ls, ss, centroid


def split_clusters(
    members: DataFrame, wide: DataFrame, params: Params, epoch: int = 0, rounds: int = SPLIT_ROUNDS
) -> Split:
    """Split every cluster of `wide` (cluster_id) once.

    `members`: response_id, cluster_id, created_at, request_embedding. The seed
    is the earliest row, the second centre the row farthest from it; a round
    moves centre 0 before it looks for centre 1's rows; ties go to label 0.
    Clusters that end with one label only are left out of the result.
    """
    spark = members.sparkSession
    ids = materialize(_numbered(wide.select("cluster_id").distinct()))
    rows = members.where(F.col("request_embedding").isNotNull()).select(
        "response_id", "cluster_id", "created_at", "request_embedding"
    )
    held = materialize(rows.join(broadcast_if_small(ids, params.broadcast_limit_bytes), "cluster_id"))
    count = ids.count()
    one = held.select(F.size("request_embedding").alias("dims")).first()
    dims = one["dims"] if one else 1
    size = max(1, params.broadcast_limit_bytes // (2 * dims * 8))
    waves = math.ceil(count / size)
    dealt = _dealt(held, size, waves)
    labelled = []
    for wave in range(waves):
        slots = min(size, count - wave * size)
        here = dealt.where(F.col("wave") == wave)
        centres = spark.sparkContext.broadcast(_two_means(here, slots, rounds))
        done = here.withColumn("label", _labels(centres)("slot", "request_embedding"))
        # Written wave by wave, so no more than one wave's centres are out at a time.
        labelled.append(
            materialize(
                done.where(F.col("label").isNotNull()).select(
                    "response_id", "cluster_id", "request_embedding", "label"
                )
            )
        )
        centres.destroy()
    none = held.limit(0).select("response_id", "cluster_id", "request_embedding", F.lit(0).alias("label"))
    labelled = reduce(DataFrame.unionByName, labelled, none)
    parts = group_features(labelled, ["cluster_id", "label"], "request_embedding")
    both = parts.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("labels")).where("labels = 2")
    parts = parts.join(both.select("cluster_id"), "cluster_id", "left_semi").select(
        "cluster_id",
        "label",
        new_cluster_id(epoch).alias("new_cluster_id"),
        "n",
        "ls",
        "ss",
        cf_centroid(F.col("n"), F.col("ls")).alias("centroid"),
    )
    parts = materialize(parts)
    # One cluster may hold most rows, so its key must not be shuffled on if the
    # two rows it meets can be sent instead.
    names = parts.select("cluster_id", "label", "new_cluster_id")
    moved = labelled.select("response_id", "cluster_id", "label").join(
        broadcast_if_small(names, params.broadcast_limit_bytes), ["cluster_id", "label"]
    )
    return Split(moved, parts)


def _numbered(ids: DataFrame) -> DataFrame:
    """`ids` with `number`, 0 and up without gaps: counted in hash buckets, whose sizes are added up."""
    inside = Window.partitionBy("bucket").orderBy("cluster_id")
    own = ids.where(F.col("cluster_id").isNotNull()).withColumn(
        "bucket", F.pmod(F.xxhash64("cluster_id"), F.lit(BUCKETS))
    ).withColumn("at", F.row_number().over(inside) - 1)
    # At most BUCKETS rows.
    sizes = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return own.join(F.broadcast(starts), "bucket").select(
        "cluster_id", (F.col("start") + F.col("at")).alias("number")
    )


def _dealt(held: DataFrame, size: int, waves: int) -> DataFrame:
    """Rows with the `wave` of their cluster and its `slot` there, `size` clusters a wave."""
    wave = F.floor(F.col("number") / size).cast("int")
    slot = F.pmod("number", F.lit(size)).cast("int")
    rows = held.withColumn("wave", wave).withColumn("slot", slot).drop("number")
    if waves <= 1:
        return rows
    # A wave is many clusters, or one that holds most rows: tasks share it by row.
    tasks = math.ceil(held.count() / waves / WAVE_ROWS)
    salt = F.pmod(F.xxhash64("response_id"), F.lit(tasks))
    return materialize(rows.repartition("wave", salt), "wave")


def new_cluster_id(epoch: int) -> Column:
    return F.sha2(
        F.concat_ws("|", F.lit("split"), "cluster_id", F.col("label").cast("string"), F.lit(str(epoch))),
        256,
    ).substr(1, 32)


def replace_clusters(clusters: DataFrame, parts: DataFrame, now: Column) -> DataFrame:
    """The snapshot with split clusters taken out and their parts put in."""
    fresh = parts.select(
        F.col("new_cluster_id").alias("cluster_id"),
        "n", "ls", "ss", "centroid",
        now.alias("created_at"), now.alias("updated_at"),
    )
    kept = clusters.join(parts.select("cluster_id").distinct(), "cluster_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def remap_goldens(goldens: DataFrame, parts: DataFrame) -> DataFrame:
    """Goldens of split clusters move to the nearer part, ties to label 0."""
    pair = parts.groupBy("cluster_id").agg(
        F.max(F.when(F.col("label") == 0, F.struct("new_cluster_id", "centroid"))).alias("p0"),
        F.max(F.when(F.col("label") == 1, F.struct("new_cluster_id", "centroid"))).alias("p1"),
    )
    pivot = F.coalesce("request_embedding", "expected_embedding")
    to0 = cosine_kernel(pivot, F.col("p0.centroid"))
    to1 = cosine_kernel(pivot, F.col("p1.centroid"))
    return (
        goldens.join(pair, "cluster_id", "left")
        .withColumn(
            "moved",
            F.when(F.col("p0").isNull(), F.col("cluster_id"))
            .when(F.round(to0, 12) >= F.round(to1, 12), F.col("p0.new_cluster_id"))
            .otherwise(F.col("p1.new_cluster_id")),
        )
        .withColumn("cluster_id", F.col("moved"))
        .select(*goldens.columns)
    )


# ---- the passes -------------------------------------------------------------


def _two_means(held: DataFrame, slots: int, rounds: int) -> np.ndarray:
    """(2, slots, dims) centres; NaN where a cluster cannot be split."""
    seed = _extremes(held, None)
    if not seed:
        return np.full((2, slots, 0), np.nan)
    dims = len(next(iter(seed.values())))
    centres = np.full((2, slots, dims), np.nan)
    for slot, vector in seed.items():
        centres[0, slot] = vector
    for slot, vector in _extremes(held, centres[0]).items():
        if not np.array_equal(vector, centres[0, slot]):
            centres[1, slot] = vector
    # Clusters whose two first centres coincide drop out here.
    centres[0, np.isnan(centres[1]).any(axis=1)] = np.nan
    moving = ~np.isnan(centres[0]).any(axis=1)
    for _ in range(rounds):
        if not moving.any():
            break
        before = centres.copy()
        for side in (0, 1):
            for slot, mean in _means(held, centres, moving, side).items():
                centres[side, slot] = mean
        # Centres that stayed put in a whole round stay put for good.
        shift = np.nanmax(np.abs(centres - before), axis=(0, 2), initial=0.0)
        moving &= shift > STILL
    return centres


def _side(centres: np.ndarray, slots: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """0/1 by nearer centre (cosine), ties to 0; -1 where there are no centres."""
    rows, _ = unit_rows(matrix)
    near = [
        np.round(np.einsum("ij,ij->i", rows, unit_rows(np.nan_to_num(c))[0][slots]), 12)
        for c in centres
    ]
    label = np.where(near[0] >= near[1], 0, 1)
    label[np.isnan(centres[0]).any(axis=1)[slots]] = -1
    return label


def _labels(shared):
    @F.arrow_udf("int")
    def label(slot: pa.Array, v: pa.Array) -> pa.Array:
        matrix, _ = as_matrix(v)
        if shared.value.shape[2] == 0:
            return pa.nulls(len(v), pa.int32())
        out = _side(shared.value, np.asarray(slot), matrix)
        return pa.array(out.astype(np.int32), mask=out < 0)

    return label


def _means(held: DataFrame, centres: np.ndarray, moving: np.ndarray, side: int) -> dict:
    """Mean of the rows on `side`, per slot still moving."""
    shared = held.sparkSession.sparkContext.broadcast((centres, moving))

    def partial(batches):
        at, active = shared.value
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            slots = np.asarray(batch["slot"])
            matrix, _ = as_matrix(batch["request_embedding"])
            if not len(slots):
                continue
            take = active[slots] & (_side(at, slots, matrix) == side)
            _add_up(slots[take], matrix[take], sums, counts)
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, type=pa.int32()),
                    pa.array([counts[s] for s in keys], type=pa.int64()),
                    as_list_array(np.vstack([sums[s] for s in keys])),
                ],
                ["slot", "n", "ls"],
            )

    parts = held.select("slot", "request_embedding").mapInArrow(
        partial, "slot int, n bigint, ls array<double>"
    )
    totals = parts.groupBy("slot").agg(F.sum("n").alias("n"), vec_sum(F.col("ls")).alias("ls")).toArrow()
    matrix, _ = as_matrix(totals["ls"])
    counts = np.asarray(totals["n"], dtype=np.float64)
    return {
        int(slot): matrix[i] / counts[i] for i, slot in enumerate(totals["slot"].to_pylist())
    }


def _add_up(keys: np.ndarray, matrix: np.ndarray, sums: dict, counts: dict) -> None:
    """Add the rows of `matrix` into `sums` and `counts` by key."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    found, starts, sizes = np.unique(keys[order], return_index=True, return_counts=True)
    added = np.add.reduceat(matrix[order], starts, axis=0)
    for key, total, size in zip(found.tolist(), added, sizes.tolist()):
        sums[key] = sums[key] + total if key in sums else total
        counts[key] = counts.get(key, 0) + size


def _extremes(held: DataFrame, seeds: np.ndarray | None) -> dict:
    """Per slot the earliest row's vector, or the vector farthest from its seed
    (ties to the earliest row)."""
    shared = held.sparkSession.sparkContext.broadcast(seeds)

    def partial(batches):
        best: dict[int, tuple] = {}
        vectors: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.asarray(batch["slot"])
            if not len(slots):
                continue
            matrix, _ = as_matrix(batch["request_embedding"])
            far = np.zeros(len(slots))
            if shared.value is not None:
                rows, _ = unit_rows(matrix)
                far = np.round(
                    np.einsum("ij,ij->i", rows, unit_rows(shared.value)[0][slots]), 12
                )
            times = np.asarray(batch["micros"])
            ids = batch["response_id"].to_pylist()
            order = np.lexsort((times, far, slots))
            found, starts = np.unique(slots[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            for slot, lo, hi in zip(found.tolist(), starts, ends):
                first = order[lo]
                # Equal distance and time: the smaller id decides.
                same = order[lo:hi]
                same = same[(far[same] == far[first]) & (times[same] == times[first])]
                i = min(same, key=lambda r: ids[r])
                rank = (float(far[i]), int(times[i]), ids[i])
                if slot not in best or rank < best[slot]:
                    best[slot], vectors[slot] = rank, matrix[i]
        if best:
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, type=pa.int32()),
                    pa.array([best[s][0] for s in keys]),
                    pa.array([best[s][1] for s in keys], type=pa.int64()),
                    pa.array([best[s][2] for s in keys]),
                    as_list_array(np.vstack([vectors[s] for s in keys])),
                ],
                ["slot", "far", "micros", "response_id", "v"],
            )

    parts = held.select(
        "slot", F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"),
        F.col("response_id").cast("string").alias("response_id"), "request_embedding",
    ).mapInArrow(partial, "slot int, far double, micros bigint, response_id string, v array<double>")
    picked = parts.groupBy("slot").agg(
        F.min_by("v", F.struct("far", "micros", "response_id")).alias("v")
    ).toArrow()
    matrix, _ = as_matrix(picked["v"])
    return {int(s): matrix[i] for i, s in enumerate(picked["slot"].to_pylist())}
