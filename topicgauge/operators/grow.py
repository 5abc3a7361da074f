"""New clusters from the rows no existing cluster absorbs.

Rows in time order are cut into blocks of `group_rows`; a block passes its rows
through the sequential absorb-or-create step. Clusters of different blocks are
then merged in rounds: each cluster looks among its `ann_candidates` nearest
clusters of other blocks for the first it can join within the radius, and a pair
merges into the earlier founder's cluster if neither end is in a nearer pair. A
merged cluster belongs to the earlier one's block. The rounds end when no
cluster finds a partner.

The rounds run twice by that one rule: first inside groups of `group_rows`
clusters in time order, all in one task, then over all clusters. There only the
frontier searches anew: clusters that have changed, and those that held a
changed one among their candidates; the others only add the changed clusters to
what they hold, in the pass that writes the clusters of the next round. Once a
round is little work and the clusters are under the broadcast limit, one task ends
the rounds: often only a hub is left, which takes its partners one by one. Nothing but `group_rows` and the rows themselves decides,
whatever their number or layout. Rows of one block are exactly the online
algorithm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.functions.vectors import as_list_array, as_matrix, doubles, sq_norm_kernel, unit_rows, vec_add
from topicgauge.operators.knn import (
    APART, BROADCAST_BYTES, PRODUCT_CELLS, TIE_DIGITS, by_block, joinable, joined_radius, matrix_bytes, nearest_columns,
    nearest_rows, renewed, slack,
)
from topicgauge.operators.sampling import arrival_positions
from topicgauge.params import Params
from topicgauge.schemas import CANDIDATES
from topicgauge.session import broadcast_if_small, materialize

# Below APART: marks clusters that have gone into another.
GONE = -3.0
# Rounds whose moves are kept in files of their own.
MOVES = 16
# What an edge between two clusters takes, with its two ids.
EDGE_BYTES = 128
# Cosines of a round that one task may take on for the others.
LAST_CELLS = 1 << 31
# A list that is looked for in the last rounds holds so many times the candidates.
SPARE = 3

GROWN = "item_id string, founder_id string, created_at timestamp, n bigint, ls array<double>, ss double"
CLUSTERS = "item_id string, top string, created_at timestamp, n bigint, ls array<double>, ss double, block bigint"


@dataclass
class Grown:
    members: DataFrame  # response_id, cluster_id
    clusters: DataFrame  # cluster_id, n, ls, ss


def cluster_id_of(founder: str):
    """A cluster is named after the row that founded it."""
    return F.sha2(F.concat(F.lit("cluster|"), F.col(founder)), 256).substr(1, 32)


def grow_clusters(misses: DataFrame, params: Params) -> Grown:
    """`misses`: response_id, created_at, request_embedding (not NULL)."""
    items = misses.select(
        F.col("response_id").alias("item_id"),
        "created_at",
        F.lit(1).cast("bigint").alias("n"),
        doubles(F.col("request_embedding")).alias("ls"),
        sq_norm_kernel("request_embedding").alias("ss"),
    )
    blocks = _groups(items, params).withColumnRenamed("group", "block")
    passed = materialize(_pass(items.join(blocks, "item_id"), params))
    founder = passed.select("item_id", "founder_id")
    clusters = passed.where(F.col("n").isNotNull()).drop("founder_id").join(blocks, "item_id")
    clusters, tops = merge_clusters(materialize(clusters), params)
    tops = broadcast_if_small(tops.withColumnRenamed("item_id", "founder_id"), params.broadcast_limit_bytes)
    named = founder.join(tops, "founder_id")
    return Grown(
        named.select(F.col("item_id").alias("response_id"), cluster_id_of("top").alias("cluster_id")),
        clusters.select(cluster_id_of("item_id").alias("cluster_id"), "n", "ls", "ss"),
    )


def _groups(rows: DataFrame, params: Params) -> DataFrame:
    """(item_id, group): runs of `group_rows` in the order of time."""
    places = arrival_positions(rows.select("created_at", "item_id"), ["created_at", "item_id"])
    group = F.floor((F.col("position") - 1) / params.group_rows).cast("bigint")
    return places.select("item_id", group.alias("group"))


def merge_clusters(clusters: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Clusters of several blocks merged until none can be, and (item_id, top): what each is part of.

    `clusters`: item_id, created_at, n, ls, ss, block.
    """
    k, threshold = params.ann_candidates, params.birch_threshold

    def run(group: pa.Table) -> pa.Table:
        return merge_group(group, k, threshold)

    grouped = clusters.join(_groups(clusters, params), "item_id")
    merged = materialize(grouped.groupBy("group").applyInArrow(run, CLUSTERS))
    tops = merged.select("item_id", "top")
    left = merged.where(F.col("n").isNotNull()).drop("top")
    if clusters.count() <= params.group_rows:
        # One group held them all: its rounds have ended, there are no others to meet.
        return left, tops
    none = F.array().cast(CANDIDATES)
    size = left.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("ls")).alias("dims")).first()
    rows, dims = size["rows"], size["dims"]
    left = _written(left.withColumn("candidates", none).withColumn("frontier", F.lit(True)))
    moves: list[DataFrame] = []
    while matrix_bytes(rows, dims) > params.broadcast_limit_bytes or left.where("frontier").count() * rows > LAST_CELLS:
        left = _searched(left, params, dims, rows)
        pairs, count = _partners(left, params, rows)
        if not count:
            return left.drop("candidates", "frontier", "_row"), _followed(tops, moves, params)
        moves.append(pairs)
        if len(moves) == MOVES:
            moves = [materialize(reduce(DataFrame.unionByName, moves))]
        left = _written(_merged(left, pairs, count, params, dims))
        rows -= count
    done = materialize(left.groupBy().applyInArrow(_last_rounds(k, threshold), CLUSTERS))
    moves.append(done.where("top != item_id").select(F.col("top").alias("early"), F.col("item_id").alias("late")))
    return done.where(F.col("n").isNotNull()).drop("top"), _followed(tops, moves, params)


def _last_rounds(k: int, threshold: float):
    def run(group: pa.Table) -> pa.Table:
        return merge_rest(group, k, threshold)

    return run


def _written(clusters: DataFrame) -> DataFrame:
    """The clusters of a round, with a number for each that stays."""
    return materialize(clusters.withColumn("_row", F.monotonically_increasing_id()))


def _followed(tops: DataFrame, moves: list[DataFrame], params: Params) -> DataFrame:
    """(item_id, top) after the pairs of all rounds; a cluster goes into another only once."""
    if not moves:
        return tops
    moved = reduce(DataFrame.unionByName, moves)
    while True:
        # Each step follows twice as many moves.
        on = moved.select(F.col("late").alias("early"), F.col("early").alias("further"))
        steps = moved.join(broadcast_if_small(on, params.broadcast_limit_bytes), "early", "left")
        further = F.col("further").isNotNull().alias("further")
        moved = materialize(steps.select("late", F.coalesce("further", "early").alias("early"), further))
        if moved.where("further").isEmpty():
            break
        moved = moved.drop("further")
    moved = broadcast_if_small(moved.select(F.col("late").alias("top"), "early"), params.broadcast_limit_bytes)
    return tops.join(moved, "top", "left").select("item_id", F.coalesce("early", "top").alias("top"))


def _pass(items: DataFrame, params: Params) -> DataFrame:
    """Absorb or create inside each block."""
    k, threshold = params.ann_candidates, params.birch_threshold

    def run(group: pa.Table) -> pa.Table:
        return absorb_in_order(group, k, threshold)

    return items.groupBy("block").applyInArrow(run, GROWN)


def _searched(clusters: DataFrame, params: Params, dims: int, rows: int) -> DataFrame:
    """`clusters`, those of the frontier with their candidates among all of them."""
    named = clusters.withColumnRenamed("item_id", "cluster_id")
    fresh = materialize(joinable(clusters.where("frontier"), named, params, dims, rows))
    return clusters.where("NOT frontier").unionByName(fresh)


def _partners(clusters: DataFrame, params: Params, rows: int) -> tuple[DataFrame, int]:
    """(early, late) and their number: pairs of the `rows` clusters that merge in this round."""
    first = F.try_element_at(F.filter("candidates", lambda c: c["absorbs"] & (c["sim"] > -1.0)), F.lit(1))
    found = clusters.select("item_id", "created_at", first.alias("c")).where("c IS NOT NULL")
    found = found.select("item_id", "created_at", F.col("c.cluster_id").alias("other_id"), F.col("c.sim").alias("sim"))
    most = _limit(params) // EDGE_BYTES
    few = rows <= most or found.count() <= most
    other = clusters.select(F.col("item_id").alias("other_id"), F.col("created_at").alias("other_at"))
    both = (F.broadcast(found) if few else found).join(other, "other_id")
    first = F.struct("created_at", "item_id") < F.struct(
        F.col("other_at").alias("created_at"), F.col("other_id").alias("item_id")
    )
    edges = both.select(
        "sim",
        F.when(first, F.col("item_id")).otherwise(F.col("other_id")).alias("early"),
        F.when(first, F.col("other_id")).otherwise(F.col("item_id")).alias("late"),
    )
    if few:
        table = edges.toArrow()
        if not table.num_rows:
            return edges.select("early", "late"), 0
        ids, places = np.unique([*table["early"].to_pylist(), *table["late"].to_pylist()], return_inverse=True)
        early, late = mutual(*np.split(places, 2), -np.asarray(table["sim"]))
        pairs = pa.table({"early": pa.array(ids[early], pa.string()), "late": pa.array(ids[late], pa.string())})
        return clusters.sparkSession.createDataFrame(pairs, "early string, late string"), len(early)
    # An edge seen from both sides is one; the best of all is the best of both its ends.
    ends = edges.withColumn("end", F.explode(F.array("early", "late")))
    # A hub is the end of many edges: least is an aggregate, so it needs no sorting in one task.
    best = ends.groupBy("end").agg(F.min(F.struct(-F.col("sim"), "early", "late")).alias("e"))
    pairs = best.select(F.col("e.early").alias("early"), F.col("e.late").alias("late"))
    pairs = pairs.groupBy("early", "late").agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").drop("sides")
    pairs = materialize(pairs)
    return pairs, pairs.count()


def mutual(early: np.ndarray, late: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that are the best of both their ends: nearest, then first by the numbers of the ends."""
    end = np.concatenate([early, late])
    edge = np.tile(np.arange(len(early)), 2)
    order = np.lexsort((late[edge], early[edge], far[edge], end))
    _, head = np.unique(end[order], return_index=True)
    best = edge[order][head]
    pairs, sides = np.unique(np.stack([early[best], late[best]], axis=1), axis=0, return_counts=True)
    early, late = pairs[sides == 2].T
    return early, late


def _limit(params: Params) -> int:
    """What may pass through the driver in a round."""
    return min(params.broadcast_limit_bytes, BROADCAST_BYTES)


def _merged(clusters: DataFrame, pairs: DataFrame, count: int, params: Params, dims: int) -> DataFrame:
    """Clusters with the later one of each of `count` pairs added to the earlier, and the next frontier."""
    none = F.array().cast(CANDIDATES)
    few = matrix_bytes(count, dims) + 2 * count * EDGE_BYTES <= _limit(params)
    ends = pairs.select(F.explode(F.array("early", "late")).alias("item_id"), F.col("early").alias("into"))
    ends = F.broadcast(ends) if few else ends
    both = clusters.drop("candidates", "frontier", "_row").join(ends, "item_id")
    both = both if few else materialize(both)
    added = both.where("item_id != into").select(
        "into", F.col("n").alias("more_n"), F.col("ls").alias("more_ls"), F.col("ss").alias("more_ss")
    )
    changed = materialize(
        both.where("item_id = into").join(F.broadcast(added) if few else added, "into").select(
            "item_id",
            "created_at",
            (F.col("n") + F.col("more_n")).alias("n"),
            vec_add(F.col("ls"), F.col("more_ls")).alias("ls"),
            (F.col("ss") + F.col("more_ss")).alias("ss"),
            "block",
        )
    )
    rest = clusters.drop("_row").join(ends, "item_id", "left_anti")
    if few:
        named = changed.withColumnRenamed("item_id", "cluster_id").drop("created_at").toArrow()
        touched = pairs.toArrow()
        touched = pa.concat_arrays([c for name in ("early", "late") for c in touched[name].chunks])
        rest = renewed(rest, named, touched, params)
    else:
        # Too many have changed to be held against all others in one go: all search anew.
        rest = rest.withColumn("candidates", none).withColumn("frontier", F.lit(True))
    return rest.unionByName(changed.withColumn("candidates", none).withColumn("frontier", F.lit(True)))


def merge_group(group: pa.Table, k: int, threshold: float) -> pa.Table:
    """The rounds of merging inside one group of clusters.

    Every cluster comes back with the one it is part of; those that are left
    also carry their features. Inner products and cosines are kept as matrices, to
    which a merge adds one row and one column; the nearest of a cluster are kept
    until a merge may alter them.
    """
    # In the order of ids, which settles ties, as everywhere.
    group = group.combine_chunks().sort_by("item_id")
    count = group.num_rows
    vectors = as_matrix(group["ls"])[0].copy()
    n, ss = (np.asarray(group[c], dtype=np.float64).copy() for c in ("n", "ss"))
    block = np.asarray(group["block"])
    age = _ages(group)
    gram = vectors @ vectors.T
    length = np.sqrt(np.maximum(np.diagonal(gram), 0.0))
    inverse = np.divide(1.0, length, out=np.zeros(count), where=length > 0)
    sim = np.round(gram * inverse[:, None] * inverse[None, :], TIE_DIGITS)
    sim[block[:, None] == block[None, :]] = APART
    keep = min(k, count)
    near = nearest_columns(sim, keep)
    top = np.arange(count)
    gone = np.zeros(count, bool)
    while True:
        close = np.take_along_axis(sim, near, axis=1)
        radius = joined_radius(
            close, n[near], ss[near], length[near], n[:, None], ss[:, None], length[:, None]
        )
        fits = (radius <= threshold) & (close > -1.0) & ~gone[:, None]
        asks = np.flatnonzero(fits.any(axis=1))
        if not len(asks):
            break
        first = fits[asks].argmax(axis=1)
        other, far = near[asks, first], -close[asks, first]
        older = age[asks] < age[other]
        early, late = np.where(older, asks, other), np.where(older, other, asks)
        early, late = mutual(early, late, far)
        for values in (n, ss):
            np.add.at(values, early, values[late])
        vectors[early] += vectors[late]
        top[late] = early
        gone[late] = True
        gram[early] += gram[late]
        gram[:, early] += gram[:, late]
        # Only rows and columns of changed clusters are measured anew.
        length[early] = np.sqrt(np.maximum(gram[early, early], 0.0))
        inverse[early] = np.divide(1.0, length[early], out=np.zeros(len(early)), where=length[early] > 0)
        apart = block[early][:, None] == block[None, :]
        row = np.round(gram[early] * inverse[early][:, None] * inverse[None, :], TIE_DIGITS)
        column = np.round(gram[:, early] * inverse[:, None] * inverse[None, early], TIE_DIGITS)
        row[apart], column[apart.T] = APART, APART
        row[:, gone], column[gone] = GONE, GONE
        sim[early], sim[:, early], sim[late], sim[:, late] = row, column, GONE, GONE
        # A cluster looks again if it or one of its nearest changed, or a changed one is as near.
        touched = np.zeros(count, bool)
        touched[early] = touched[late] = True
        again = touched | touched[near].any(axis=1)
        again |= (column >= close[:, -1:]).any(axis=1)
        again = np.flatnonzero(again & ~gone)
        near[again] = nearest_columns(sim[again], keep)
    return _joined(group, top, gone, vectors, n, ss)


def _ages(group: pa.Table) -> np.ndarray:
    """The places of clusters in the order of time."""
    count = group.num_rows
    in_time = group.select(["created_at", "item_id"]).append_column("at", pa.array(np.arange(count))).sort_by(
        [("created_at", "ascending"), ("item_id", "ascending")]
    )
    age = np.empty(count, np.int64)
    age[np.asarray(in_time["at"])] = np.arange(count)
    return age


def _joined(group: pa.Table, top: np.ndarray, gone: np.ndarray, vectors: np.ndarray, n: np.ndarray, ss: np.ndarray) -> pa.Table:
    """The clusters of a group after its rounds, each with the one it is part of."""
    count = group.num_rows
    while (top[top] != top).any():
        top = top[top]
    return pa.table(
        {
            "item_id": group["item_id"],
            "top": group["item_id"].take(pa.array(top)),
            "created_at": group["created_at"],
            "n": pa.array(n.astype(np.int64), mask=gone),
            "ls": as_list_array(vectors).take(pa.array(np.arange(count), mask=gone)),
            "ss": pa.array(ss, mask=gone),
            "block": group["block"],
        }
    )


def merge_rest(group: pa.Table, k: int, threshold: float) -> pa.Table:
    """The rounds that are left once few clusters change in each, all in one task.

    `group` is all clusters with their candidates and `frontier`. More than `k` are
    kept of those that are looked for anew, so that a cluster whose near ones go into
    others need not look again each time: its list is whole down to its `floor`, a
    (cosine, place) after which others may come. The result is as of `merge_group`.
    """
    group = group.combine_chunks().sort_by("item_id")
    count, ids = group.num_rows, group["item_id"].combine_chunks()
    keep = min(SPARE * k, count)
    vectors = as_matrix(group["ls"])[0].copy()
    n, ss = (np.asarray(group[c], dtype=np.float64).copy() for c in ("n", "ss"))
    blocks = np.asarray(group["block"])
    age = _ages(group)
    unit, length = unit_rows(vectors)
    all_of = {"n": n, "unit": unit, "rough": unit.astype(np.float32), "columns": by_block(blocks)}
    held = group["candidates"].combine_chunks()
    sizes = np.asarray(held.value_lengths().fill_null(0))
    flat, row = held.flatten(), np.repeat(np.arange(count), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    near = np.full((count, keep), count)
    sim = np.full((count, keep), GONE)
    near[row, at] = np.asarray(pc.index_in(pc.struct_field(flat, "cluster_id"), value_set=ids))
    sim[row, at] = np.asarray(pc.struct_field(flat, "sim"))
    floor, floor_at = np.full(count, GONE), np.full(count, count)
    full = sizes >= k
    last = min(k, keep) - 1
    floor[full], floor_at[full] = sim[full, last], near[full, last]
    partner, far = np.full(count, -1), np.zeros(count)
    top, gone = np.arange(count), np.zeros(count, bool)
    look, dirty = np.asarray(group["frontier"]).copy(), np.ones(count, bool)
    while True:
        rows = np.flatnonzero(look)
        step = max(1, PRODUCT_CELLS // count)
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            position, found = nearest_rows(unit[part], all_of, keep, blocks[part])
            there = found > APART
            near[part], sim[part] = np.where(there, position, count), np.where(there, found, GONE)
            floor[part] = np.where(there[:, -1], found[:, -1], GONE)
            floor_at[part] = near[part, -1]
        rows = np.flatnonzero(dirty & ~gone)
        others, close = np.minimum(near[rows, :k], count - 1), sim[rows, :k]
        radius = joined_radius(
            close, n[others], ss[others], length[others], n[rows][:, None], ss[rows][:, None], length[rows][:, None]
        )
        fits = (radius <= threshold) & (close > -1.0)
        first, line = fits.argmax(axis=1), np.arange(len(rows))
        partner[rows] = np.where(fits[line, first], others[line, first], -1)
        far[rows] = -close[line, first]
        asks = np.flatnonzero((partner >= 0) & ~gone)
        if not len(asks):
            break
        older = age[asks] < age[partner[asks]]
        early, late = np.where(older, asks, partner[asks]), np.where(older, partner[asks], asks)
        early, late = mutual(early, late, far[asks])
        for values in (n, ss):
            np.add.at(values, early, values[late])
        vectors[early] += vectors[late]
        top[late] = early
        gone[late] = True
        unit[early], length[early] = unit_rows(vectors[early])
        all_of["rough"][early] = unit[early]
        all_of["gone"] = np.flatnonzero(gone)
        # Ends of pairs leave the lists; a list that is then too short is looked for anew.
        touched = np.zeros(count + 1, bool)
        touched[early] = touched[late] = True
        dirty = touched[near].any(axis=1)
        rows = np.flatnonzero(dirty)
        lost = touched[near[rows]]
        near[rows], sim[rows] = _in_order(
            np.where(lost, count, near[rows]), np.where(lost, GONE, sim[rows])
        )
        step = max(1, PRODUCT_CELLS // count)
        for i, one in enumerate(early):
            # Who may have the changed cluster in its list: none is missed, as floors only rise.
            if i % step == 0:
                rough = all_of["rough"][early[i : i + step]] @ all_of["rough"].T
                bar = np.where(touched[:count] | gone, np.inf, floor - slack(vectors.shape[1]))
            rows = np.flatnonzero(rough[i % step] >= bar)
            rows = rows[blocks[rows] != blocks[one]]
            exact = np.round(np.einsum("ij,ij->i", unit[rows], unit[np.full(len(rows), one)]), TIE_DIGITS)
            inside = (exact > floor[rows]) | ((exact == floor[rows]) & (one < floor_at[rows]))
            rows, exact = rows[inside], exact[inside]
            listed, cosine = _in_order(
                np.column_stack([near[rows], np.full(len(rows), one)]), np.column_stack([sim[rows], exact])
            )
            near[rows], sim[rows] = listed[:, :keep], cosine[:, :keep]
            over = cosine[:, keep] > GONE
            floor[rows[over]], floor_at[rows[over]] = cosine[over, keep - 1], listed[over, keep - 1]
            dirty[rows] = True
        look = (sim[:, last] <= GONE) & (floor > GONE)
        look[early] = True
        look &= ~gone
        dirty |= look
    return _joined(group, top, gone, vectors, n, ss)


def _in_order(near: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists nearest first, ties to the first place."""
    order = np.lexsort((near, -sim), axis=1)
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(sim, order, axis=1)


def absorb_in_order(group: pa.Table, k: int, threshold: float) -> pa.Table:
    """Absorb-or-create over one group's CFs in (created_at, item_id) order.

    Every row comes back with its founder; the founder's own row also carries
    the finished CF. All inner products come from one matrix product; a
    cluster's products with every row are kept as running sums, so a step
    costs the number of clusters, whatever the dimension.
    """
    group = group.combine_chunks().sort_by([("created_at", "ascending"), ("item_id", "ascending")])
    rows = group.num_rows
    vectors, _ = as_matrix(group["ls"])
    counts = np.asarray(group["n"], dtype=np.float64)
    squares = np.asarray(group["ss"], dtype=np.float64)
    gram = vectors @ vectors.T
    length_sq = np.diagonal(gram).copy()
    lengths = np.sqrt(length_sq)
    inverse = np.divide(1.0, lengths, out=np.zeros(rows), where=lengths > 0)
    with_row = np.empty((min(rows, 64), rows))  # cluster x row inner products
    n, ss, ls_sq, inverse_ls = np.empty(rows), np.empty(rows), np.empty(rows), np.empty(rows)
    founder_row = np.empty(rows, dtype=np.int64)
    owner = np.empty(rows, dtype=np.int64)
    made = 0

    def absorbs(c: int, i: int) -> bool:
        total = n[c] + counts[i]
        joined = ls_sq[c] + 2 * with_row[c, i] + length_sq[i]
        return math.sqrt(max(0.0, (ss[c] + squares[i]) / total - joined / total**2)) <= threshold

    for i in range(rows):
        home = -1
        if made:
            sim = with_row[:made, i] * inverse_ls[:made] * inverse[i]
            nearest = int(sim.argmax())
            if sim[nearest] > -1.0 and absorbs(nearest, i):
                home = nearest
            else:
                for c in np.argsort(-sim, kind="stable")[:k]:
                    if sim[c] > -1.0 and absorbs(c, i):
                        home = int(c)
                        break
        if home < 0:
            home = made
            founder_row[made] = i
            if made == len(with_row):
                with_row = np.vstack([with_row, np.empty((min(rows - made, made), rows))])
            with_row[made] = gram[i]
            n[made], ss[made], ls_sq[made] = counts[i], squares[i], length_sq[i]
            made += 1
        else:
            ls_sq[home] += 2 * with_row[home, i] + length_sq[i]
            with_row[home] += gram[i]
            n[home] += counts[i]
            ss[home] += squares[i]
        inverse_ls[home] = 1.0 / math.sqrt(ls_sq[home]) if ls_sq[home] > 0 else 0.0
        owner[i] = home
    by_owner = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by_owner], np.arange(made))
    ls = np.add.reduceat(vectors[by_owner], starts, axis=0)
    founders = founder_row[:made]
    cf_at = np.full(rows, -1)
    cf_at[founders] = np.arange(made)
    take = pa.array(cf_at, mask=cf_at < 0)
    return pa.table(
        {
            "item_id": group["item_id"],
            "founder_id": group["item_id"].take(pa.array(founders[owner])),
            "created_at": group["created_at"],
            "n": pa.array(n[:made].astype(np.int64)).take(take),
            "ls": as_list_array(ls).take(take),
            "ss": pa.array(ss[:made]).take(take),
        }
    )
