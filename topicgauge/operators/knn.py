"""Exact top-K nearest clusters by cosine, with the absorb test attached.

Two ways with the same answer:

* the cluster matrix fits the broadcast limit: every executor gets it once and
  each Arrow batch of queries is one matrix product; nothing shuffles;
* it does not: the queries are dealt into parts and the clusters into blocks, and
  a task compares one part with one block. A part meets every block in one shuffle,
  so no cluster passes through the driver, and a task holds a part and a block of at
  most `TILE_BYTES`, whatever the number of either.

The grower's search always goes the second way, since it is repeated every round.
Pairs are never emitted: a query carries at most K candidates from each block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions.vectors import as_matrix, once, unit_rows
from topicgauge.params import Params
from topicgauge.schemas import CANDIDATES
from topicgauge.session import materialize

TIE_DIGITS = 12
# Similarity cells one matrix product may hold at a time (32 MB of doubles).
PRODUCT_CELLS = 4 << 20
# Largest matrix that every executor gets whole through the driver, and the largest
# part or block of one task.
BROADCAST_BYTES = 16 << 20
TILE_BYTES = 16 << 20
# Columns of a product whose one maximum stands for them in the bound of the K-th.
SET = 64
# Below any cosine: marks clusters that a query must not find.
APART = -2.0


def top_candidates(queries: DataFrame, clusters: DataFrame, params: Params) -> DataFrame:
    """`queries` plus `candidates`: up to K clusters, nearest first.

    `queries` needs a unique `item_id` and a vector `v`; `clusters` needs
    cluster_id, n, ls, ss. Ties go to the smaller cluster_id. `absorbs` says
    whether the cluster with `v` added keeps its radius within birch_threshold.
    """
    live = clusters.where(F.col("ls").isNotNull() & (F.col("n") > 0)).select(
        "cluster_id", "n", "ls", "ss"
    )
    size = _size(live)
    if size["rows"] == 0:
        return queries.withColumn("candidates", F.array().cast(CANDIDATES))
    if size["bytes"] <= min(params.broadcast_limit_bytes, BROADCAST_BYTES):
        return _by_broadcast(queries, live, params)
    numbered = _numbered(queries)
    found = _by_tiles(numbered.select("_row", F.col("v").alias("ls")), live, params, size["bytes"])
    lists = F.coalesce("found", F.array().cast(CANDIDATES))
    return numbered.join(found, "_row", "left").withColumn("candidates", lists).drop("found", "_row")


def _numbered(queries: DataFrame) -> DataFrame:
    """`queries` with a number for each row, written so that it stays: ids may repeat."""
    return materialize(queries.withColumn("_row", F.monotonically_increasing_id()))


def _size(rows: DataFrame, dims: int | None = None) -> dict[str, int]:
    """Rows, and the bytes of their matrix; where `dims` is known, no vector is read."""
    if dims is None:
        size = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("ls")).alias("dims")).first()
        return {"rows": size["rows"], "bytes": matrix_bytes(size["rows"], size["dims"] or 0)}
    count = rows.count()
    return {"rows": count, "bytes": matrix_bytes(count, dims)}


def matrix_bytes(rows: int, dims: int) -> int:
    return rows * (max(dims, 0) + 4) * 8


def joinable(
    queries: DataFrame, clusters: DataFrame, params: Params, dims: int | None = None, rows: int | None = None
) -> DataFrame:
    """`queries` with their `candidates` joined by the nearest of `clusters`, K in all.

    Both are clusters: queries with item_id, n, ls, ss, block and the candidates
    held so far, clusters with cluster_id, n, ls, ss, block. Clusters of a
    query's own block are not found. `absorbs` says whether the two together
    keep their radius within birch_threshold. Callers that know them give the size
    of the vectors, the number of clusters, and a `_row` of their own that stays.
    """
    live = clusters.select("cluster_id", "n", "ls", "ss", "block")
    size = _size(live, dims) if rows is None else {"rows": rows, "bytes": matrix_bytes(rows, dims or 0)}
    if size["rows"] == 0:
        return queries
    numbered = queries if "_row" in queries.columns else _numbered(queries)
    found = _by_tiles(numbered.select("_row", "ls", "n", "ss", "block"), live, params, size["bytes"], dims)
    held = F.flatten(F.array("candidates", F.coalesce("found", F.array().cast(CANDIDATES))))
    listed = numbered.join(found, "_row", "left").withColumn("candidates", _first(held, params))
    return listed.select(queries.columns)


def renewed(queries: DataFrame, changed: pa.Table, touched: pa.Array, params: Params) -> DataFrame:
    """`queries` with the `candidates` they hold once some clusters have changed, and `frontier`.

    `queries` as in `joinable`, each with its K nearest clusters of other blocks or
    all of them; `changed` the clusters as they now are, with the columns of the
    clusters there; `touched` the ids that are no longer what they were. Changed
    clusters that are near enough take their place. Whoever held a touched one may
    now have others among its nearest: it is in the `frontier`, with no candidates.
    """
    k, threshold = params.ann_candidates, params.birch_threshold
    block = queries.sparkSession.sparkContext.broadcast((loaded(changed), touched))

    @F.arrow_udf(f"struct<lost:boolean,found:{CANDIDATES}>")
    def look(ls: pa.Array, n: pa.Array, ss: pa.Array, own: pa.Array, candidates: pa.Array) -> pa.Array:
        fresh, ids = block.value
        matrix, _ = as_matrix(ls)
        n, ss, own = (np.asarray(c, dtype=kind) for c, kind in ((n, float), (ss, float), (own, np.int64)))
        held = candidates.flatten()
        counts = np.asarray(candidates.value_lengths().fill_null(0))
        sims = np.asarray(pc.struct_field(held, "sim"))
        row = np.repeat(np.arange(len(counts)), counts)
        lost = np.zeros(len(counts), bool)
        lost[row[np.asarray(pc.is_in(pc.struct_field(held, "cluster_id"), value_set=ids))]] = True
        # A changed cluster must be as near as the last of a full list.
        floor = np.full(len(counts), APART)
        full = counts >= k
        floor[full] = sims[np.cumsum(counts)[full] - 1]
        rows = np.flatnonzero(~lost & (matrix.shape[1] > 0))
        rows = rows[_reached(matrix[rows], fresh, own[rows], floor[rows])] if len(rows) else rows
        found = pa.array([], type=_CANDIDATES_ARROW)
        if len(rows):
            found = candidate_array(fresh, top_of(fresh, matrix[rows], k, threshold, n[rows], ss[rows], own[rows]))
        place = np.full(len(counts), -1)
        place[rows] = np.arange(len(rows))
        return pa.StructArray.from_arrays(
            [pa.array(lost), found.take(pa.array(place, mask=place < 0))], ["lost", "found"]
        )

    seen = queries.withColumn("_seen", once(look)("ls", "n", "ss", "block", "candidates"))
    none = F.array().cast(CANDIDATES)
    joined = F.when(F.size("_seen.found") > 0, _first(F.flatten(F.array("candidates", "_seen.found")), params))
    return seen.withColumn(
        "candidates", F.when(F.col("_seen.lost"), none).otherwise(F.coalesce(joined, F.col("candidates")))
    ).withColumn("frontier", F.col("_seen.lost")).drop("_seen")


def _reached(points: np.ndarray, block: dict, own: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which points may have a cluster of other blocks as near as their `floor`: none is missed."""
    directions, _ = unit_rows(points)
    step = max(1, PRODUCT_CELLS // len(block["n"]))
    out = np.zeros(len(points), bool)
    for at in range(0, len(points), step):
        part = slice(at, at + step)
        rough = directions[part].astype(np.float32) @ block["rough"].T
        leave_out(rough, block, own[part])
        out[part] = rough.max(axis=1) >= np.maximum(floor[part] - slack(points.shape[1]), APART / 2 - 0.5)
    return out


def _first(candidates: Column, params: Params) -> Column:
    """The K nearest of a list, nearest first, ties to the smaller id."""
    far, name = (lambda c: (-c["sim"]).alias("far")), (lambda c: c["cluster_id"].alias("cluster_id"))
    order = F.transform(
        candidates, lambda c: F.struct(far(c), c["cluster_id"].isNull().alias("unnamed"), name(c), c["absorbs"].alias("absorbs"))
    )
    best = F.slice(F.array_sort(order), 1, params.ann_candidates)
    return F.transform(best, lambda c: F.struct(name(c), (-c["far"]).alias("sim"), c["absorbs"].alias("absorbs"))).cast(CANDIDATES)


# ---- the search itself, on one batch of queries and one set of clusters ------


def loaded(table: pa.Table) -> dict:
    """Cluster rows as arrays, ordered by id so that ties are settled by position."""
    table = table.combine_chunks().sort_by("cluster_id")
    matrix, _ = as_matrix(table["ls"])
    directions, lengths = unit_rows(matrix)
    own = {"columns": by_block(np.asarray(table["block"]))} if "block" in table.column_names else {}
    return own | {
        "ids": table["cluster_id"].combine_chunks(),
        "unit": directions,
        "rough": directions.astype(np.float32),
        "length": lengths,
        "n": np.asarray(table["n"], dtype=np.float64),
        "ss": np.asarray(table["ss"], dtype=np.float64),
    }


def by_block(blocks: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each block's clusters."""
    order = np.argsort(blocks, kind="stable")
    names, starts = np.unique(blocks[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))


def nearest_columns(sim: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the `keep` greatest of each row, greatest first, ties to the first column."""
    columns = sim.shape[1]
    if keep < columns:
        # Everything at least as near as the K-th, then the K first of those.
        edge = np.partition(sim, columns - keep, axis=1)[:, columns - keep]
        over = sim > edge[:, None]
        level = sim == edge[:, None]
        room = keep - over.sum(axis=1)
        chosen = over | (level & (np.cumsum(level, axis=1) <= room[:, None]))
        cols = np.nonzero(chosen)[1].reshape(len(sim), keep)
    else:
        cols = np.tile(np.arange(columns), (len(sim), 1))
    order = np.argsort(-np.take_along_axis(sim, cols, axis=1), axis=1, kind="stable")
    return np.take_along_axis(cols, order, axis=1)


def nearest_rows(directions: np.ndarray, block: dict, keep: int, own: np.ndarray | None):
    """(positions, sims) of the `keep` nearest clusters of each direction.

    A product in single precision leaves out what cannot be among them, whatever its
    error; what is left is measured in full. The bound is the `keep`-th of the maxima
    of sets of columns: as many columns reach it.
    """
    rows, clusters = len(directions), len(block["n"])
    size = min(SET, clusters // (4 * keep))
    if size >= 2:
        rough = directions.astype(np.float32) @ block["rough"].T
        if own is not None:
            leave_out(rough, block, own)
        sets = clusters // size
        peaks = rough[:, : sets * size].reshape(rows, size, sets).max(axis=1)
        bound = np.partition(peaks, sets - keep, axis=1)[:, sets - keep]
        row, column = np.divmod(np.flatnonzero(rough >= (bound - np.float32(slack(directions.shape[1])))[:, None]), clusters)
        if len(row) <= rough.size // 8 and bound.min() > APART / 2 and not np.isnan(peaks).any():
            exact = np.empty(len(row))
            for at in range(0, len(row), 1 << 15):
                r, c = row[at : at + (1 << 15)], column[at : at + (1 << 15)]
                exact[at : at + (1 << 15)] = np.einsum("ij,ij->i", directions[r], block["unit"][c])
            exact = np.round(exact, TIE_DIGITS)
            order = np.lexsort((column, -exact, row))
            first = np.searchsorted(row, np.arange(rows))
            best = order[first[:, None] + np.arange(keep)[None, :]]
            return column[best], exact[best]
    sim = np.round(directions @ block["unit"].T, TIE_DIGITS)
    if own is not None:
        leave_out(sim, block, own)
    columns = nearest_columns(sim, keep)
    return columns, np.take_along_axis(sim, columns, axis=1)


def slack(dims: int) -> float:
    """Twice the error of a cosine in single precision, and ties after rounding."""
    return (dims + 8) * 2.0**-23 + 10.0 ** (1 - TIE_DIGITS)


def leave_out(sim: np.ndarray, block: dict, own: np.ndarray) -> None:
    """Marks the clusters of each row's own block, and those that are gone."""
    if "gone" in block:
        sim[:, block["gone"]] = APART
    for name in np.unique(own):
        mine = block["columns"].get(name)
        if mine is not None:
            sim[np.ix_(np.flatnonzero(own == name), mine)] = APART


def joined_radius(sim, a_n, a_ss, a_length, b_n, b_ss, b_length) -> np.ndarray:
    """Radius of two clustering features together, from their cosine."""
    joined = a_length**2 + 2 * sim * a_length * b_length + b_length**2
    variance = (a_ss + b_ss) / (a_n + b_n) - joined / (a_n + b_n) ** 2
    return np.sqrt(np.maximum(0.0, variance))


def top_of(block: dict, points: np.ndarray, k: int, threshold: float, n=None, ss=None, own=None):
    """(cluster positions, sims, absorbs) of the top K of every point.

    `n` and `ss` make the points clusters themselves; clusters of a point's
    `own` block are not found: their sims are APART.
    """
    directions, lengths = unit_rows(points)
    clusters = len(block["n"])
    keep = min(k, clusters)
    step = max(1, PRODUCT_CELLS // clusters)
    # Points of one block next to each other, so that few blocks are left out of a product.
    order = np.arange(len(points)) if own is None else np.argsort(own, kind="stable")
    position = np.empty((len(points), keep), np.int64)
    sim = np.empty((len(points), keep))
    for at in range(0, len(points), step):
        rows = order[at : at + step]
        position[rows], sim[rows] = nearest_rows(directions[rows], block, keep, None if own is None else own[rows])
    n = np.ones(len(points)) if n is None else n
    ss = lengths**2 if ss is None else ss
    radius = joined_radius(
        sim, block["n"][position], block["ss"][position], block["length"][position],
        n[:, None], ss[:, None], lengths[:, None],
    )
    return position, sim, radius <= threshold


def candidate_array(block: dict, found) -> pa.Array:
    position, sim, absorbs = found
    there = sim > APART
    offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets),
        pa.StructArray.from_arrays(
            [
                block["ids"].take(pa.array(position[there])),
                pa.array(sim[there]),
                pa.array(absorbs[there]),
            ],
            ["cluster_id", "sim", "absorbs"],
        ),
    )


# ---- whole matrix on every executor -----------------------------------------


def _by_broadcast(queries: DataFrame, live: DataFrame, params: Params) -> DataFrame:
    block = queries.sparkSession.sparkContext.broadcast(loaded(live.toArrow()))
    k, threshold = params.ann_candidates, params.birch_threshold

    @F.arrow_udf(CANDIDATES)
    def candidates(v: pa.Array) -> pa.Array:
        matrix, _ = as_matrix(v)
        if matrix.shape[1] == 0:
            return pa.array([[] for _ in range(len(v))], type=_CANDIDATES_ARROW)
        return candidate_array(block.value, top_of(block.value, matrix, k, threshold))

    return queries.withColumn("candidates", once(candidates)("v"))


_CANDIDATES_ARROW = pa.list_(
    pa.struct([("cluster_id", pa.string()), ("sim", pa.float64()), ("absorbs", pa.bool_())])
)


# ---- parts of the queries against blocks of the clusters ------------------------


def _by_tiles(
    queries: DataFrame, clusters: DataFrame, params: Params, cluster_bytes: int, dims: int | None = None
) -> DataFrame:
    """(_row, found): up to K clusters of each query.

    `queries`: _row, ls, and n, ss, block where they are clusters themselves.
    """
    tile_bytes = min(params.broadcast_limit_bytes, TILE_BYTES)
    blocks = max(1, math.ceil(cluster_bytes / tile_bytes))
    size = _size(queries, dims)
    # At least as many tasks as there are cores, if the queries are many enough.
    spare = queries.sparkSession.sparkContext.defaultParallelism // blocks
    parts = max(1, math.ceil(size["bytes"] / tile_bytes), min(spare, math.ceil(size["rows"] / params.group_rows)))
    left = queries.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = clusters.withColumn("_block", F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)).cast("int")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    found = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(
        _compared(params.ann_candidates, params.birch_threshold), f"_row bigint, found {CANDIDATES}"
    )
    if blocks == 1:
        return found
    lists = found.groupBy("_row").agg(F.flatten(F.collect_list("found")).alias("found"))
    return lists.select("_row", _first(F.col("found"), params).alias("found"))


def _compared(k: int, threshold: float):
    """Top K of a part of the queries among one block of clusters."""

    def compare(queries: pa.Table, clusters: pa.Table) -> pa.Table:
        matrix, _ = as_matrix(queries["ls"])
        if not queries.num_rows or not clusters.num_rows or matrix.shape[1] == 0:
            nothing = pa.array([[] for _ in range(queries.num_rows)], type=_CANDIDATES_ARROW)
            return pa.table({"_row": queries["_row"], "found": nothing})
        names = [c for c in ("cluster_id", "n", "ls", "ss", "block") if c in clusters.column_names]
        block = loaded(clusters.select(names))
        clustered = {}
        if "ss" in queries.column_names:
            clustered = {c: np.asarray(queries[c], dtype=np.float64) for c in ("n", "ss")}
            clustered["own"] = np.asarray(queries["block"])
        found = candidate_array(block, top_of(block, matrix, k, threshold, **clustered))
        return pa.table({"_row": queries["_row"], "found": found})

    return compare
