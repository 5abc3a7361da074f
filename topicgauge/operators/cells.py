"""Approximate search for the nearest clusters, over coarse cells.

For more clusters than every query should be compared with; `knn` stays the
exact way. The cells are the directions of a bounded sample of the clusters:
those with the smallest MD5 of their id, about the square root of all, and no
more than the broadcast limit holds. Every cluster is indexed under the cell
nearest to it, and a query meets all clusters of its nearest cells. `recall`
measures what that misses.

A cell may hold a third of all clusters and be near to most queries. So its
clusters are dealt into blocks and its queries into parts of about `group_rows`
each, and a task compares one part with one block: it gives at most K candidates
a query, and its size does not grow with the cell.

Vectors that are null or without components take no part: such a query finds nothing. A vector of
length zero is equally far from everything. Ties go to the smaller cluster_id;
clusters of one vector lie in one cell. Without clusters nothing is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicgauge.functions.vectors import as_matrix, once, unit_rows
from topicgauge.operators.knn import PRODUCT_CELLS, TIE_DIGITS, loaded, nearest_columns, top_of
from topicgauge.params import Params
from topicgauge.schemas import CANDIDATES
from topicgauge.session import materialize

# Cells a query looks into.
PROBES = 12
FOUND = "cluster_id string, sim double, absorbs boolean"


@dataclass
class CellIndex:
    centres: np.ndarray  # a direction per cell, under the broadcast limit
    clusters: DataFrame  # cluster_id, n, ls, ss, cell, block
    sizes: DataFrame  # cell, blocks: one row per cell that holds clusters


def build(clusters: DataFrame, params: Params, cells: int | None = None) -> CellIndex:
    """Index `clusters` (cluster_id, n, ls, ss); `cells` bounds the sample."""
    live = clusters.where(F.col("ls").isNotNull() & (F.col("n") > 0)).select("cluster_id", "n", "ls", "ss")
    size = live.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("ls")).alias("dims")).first()
    room = params.broadcast_limit_bytes // (((size["dims"] or 0) + 4) * 8)
    wanted = max(1, min(cells or math.ceil(math.sqrt(size["rows"])), room))
    sample = live.orderBy(F.md5("cluster_id"), "cluster_id").limit(wanted).select("cluster_id", "ls").toArrow()
    matrix, _ = as_matrix(sample.sort_by("cluster_id")["ls"])
    centres, _ = unit_rows(matrix)
    homed = materialize(live.withColumn("cell", F.get(_cells_near(live, centres, 1)("ls"), F.lit(0))))
    counts = homed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    sizes = materialize(counts.select("cell", F.ceil(F.col("rows") / params.group_rows).cast("int").alias("blocks")))
    # At most a row per cell.
    dealt = homed.join(F.broadcast(sizes), "cell").withColumn(
        "block", F.pmod(F.xxhash64("cluster_id"), F.col("blocks")).cast("int")
    )
    return CellIndex(centres, dealt.drop("blocks"), sizes)


def nearest(queries: DataFrame, index: CellIndex, params: Params, probes: int = PROBES) -> DataFrame:
    """(item_id, candidates): up to K clusters of the `probes` nearest cells, nearest first.

    `queries` needs a unique `item_id` and a vector `v`; candidates are as in `knn.top_candidates`.
    """
    asked = queries.select("item_id", "v")
    probed = materialize(asked.withColumn("cells", _cells_near(asked, index.centres, probes)("v")))
    each = probed.where(F.col("v").isNotNull()).withColumn("cell", F.explode("cells")).drop("cells")
    # The cells that are asked for, with the tasks each takes: at most a row per cell.
    met = each.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    plan = materialize(
        index.sizes.join(met, "cell").select(
            "cell", "blocks", F.ceil(F.col("rows") / params.group_rows).cast("int").alias("parts")
        )
    )
    left = (
        each.join(F.broadcast(plan), "cell")
        .withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", "block", "part", "item_id", "v")
    )
    right = (
        index.clusters.join(F.broadcast(plan.select("cell", "parts")), "cell")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts")
    )
    task = ["cell", "block", "part"]
    kind = queries.schema["item_id"].dataType.simpleString()
    found = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(
        _compared(params.ann_candidates, params.birch_threshold), f"item_id {kind}, {FOUND}"
    )
    order = Window.partitionBy("item_id").orderBy(F.col("sim").desc(), "cluster_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.ann_candidates)
    lists = best.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "cluster_id", "sim", "absorbs"))).alias("ranked")
    )
    bare = F.transform("ranked", lambda c: F.struct(c.cluster_id, c.sim, c.absorbs))
    return probed.select("item_id").join(lists, "item_id", "left").select(
        "item_id", F.coalesce(bare, F.array()).cast(CANDIDATES).alias("candidates")
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(item_id, hits, wanted): how many of the exact candidates were found."""
    ids = lambda c: F.transform(c, lambda x: x.cluster_id)
    both = exact.select("item_id", ids("candidates").alias("true")).join(
        found.select("item_id", ids("candidates").alias("seen")), "item_id", "left"
    )
    hits = F.coalesce(F.size(F.array_intersect("true", "seen")), F.lit(0))
    return both.select("item_id", hits.cast("bigint").alias("hits"), F.size("true").cast("bigint").alias("wanted"))


# ---- in the tasks ------------------------------------------------------------


def _cells_near(rows: DataFrame, centres: np.ndarray, count: int):
    """The `count` nearest cells of every vector, ties to the cell of the smaller cluster_id."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("array<int>")
    def cells(v: pa.Array) -> pa.Array:
        matrix, _ = as_matrix(v)
        directions, _ = unit_rows(matrix)
        at = shared.value
        if matrix.shape[1] == 0 or not len(at):
            return pa.array([[] for _ in range(len(v))], type=pa.list_(pa.int32()))
        keep, step = min(count, len(at)), max(1, PRODUCT_CELLS // len(at))
        columns = [
            nearest_columns(np.round(directions[i : i + step] @ at.T, TIE_DIGITS), keep)
            for i in range(0, len(directions), step)
        ]
        flat = np.vstack(columns).astype(np.int32).ravel()
        offsets = np.arange(0, len(flat) + 1, keep, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return once(cells)


def _compared(k: int, threshold: float):
    """Top K of a part of the queries among one block of clusters."""

    def compare(queries: pa.Table, clusters: pa.Table) -> pa.Table:
        kind = queries.schema.field("item_id").type
        schema = pa.schema(
            [("item_id", kind), ("cluster_id", pa.string()), ("sim", pa.float64()), ("absorbs", pa.bool_())]
        )
        if not queries.num_rows or not clusters.num_rows:
            return schema.empty_table()
        block = loaded(clusters.select(["cluster_id", "n", "ls", "ss"]))
        matrix, _ = as_matrix(queries["v"])
        position, sim, absorbs = top_of(block, matrix, k, threshold)
        rows = np.repeat(np.arange(len(matrix)), position.shape[1])
        columns = [
            queries["item_id"].take(pa.array(rows)),
            block["ids"].take(pa.array(position.ravel())),
            pa.array(sim.ravel()),
            pa.array(absorbs.ravel()),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return compare
