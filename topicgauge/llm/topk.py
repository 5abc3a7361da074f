"""Exact top-k search by inner product with no-random-access aggregation.

Rows stay in their partitions and are read in blocks; a block keeps, for every
component, its vectors sorted by that component, built once for all queries. A
query reads all lists of a block in step, from the end its own component's sign
calls for. What has been read of a vector gives a lower bound of its score
(unread components at the list's far end) and an upper bound (unread components
at the reading depth). The k-th best lower bound, or the k-th best score of the
blocks before if that is higher, is a query's level: vectors whose upper bound is
below it are left, and the query stops when unread vectors are below it too and
few are left; those get their final scores. Bounds of all waiting queries are
matrix products over the vectors still open.

Queries pass in slices of bounded size; a task gives at most k rows a query.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; every row is a query and a candidate of its own, also
when ids repeat; rows without an id are no queries, and stand after others of
equal score; shorter vectors count as padded with zeros. Scores are exact while
they are below 2^63; from 2^53 on lists are read to their ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicgauge.llm.hard_negatives import matrix_of, scores, widened
from topicgauge.session import materialize

K = 5
BLOCK = 4096
# Queries that meet a block at a time, and bytes of queries broadcast at a time.
CHUNK = 256
SLICE_BYTES = 16 << 20
# Shares of a block's lists after which the bounds are looked at.
DEPTHS = (0.05, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0)
# A query with no more open vectors than this times k gets their final scores.
FEW = 4
_LAST_ID = np.iinfo(np.int64).max
FOUND = "query long, query_id long, vec_id long, row long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, parts): floor(scale * x) of each component of the rows that take part."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    whole = F.forall(
        "embedding",
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")),
    )
    kept = vectors.where((F.size("embedding") > 0) & whole)
    return kept.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), x.alias("parts")
    )


class SortedLists:
    """A block's vectors with the place of each in the list of every component."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray, rows: np.ndarray | None = None):
        rows = ids if rows is None else rows
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.parts = ids[order], rows[order], parts[order]
        by_part = np.argsort(self.parts, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.parts, by_part, axis=0)
        self.place = np.empty_like(by_part)
        np.put_along_axis(self.place, by_part, np.arange(len(ids))[:, None], axis=0)
        self.largest = float(np.abs(parts).max(initial=0))
        self.read: dict[float, int] = {}  # queries that stopped, by depth

    def bounds(
        self, queries: np.ndarray, depth: int, at: np.ndarray | slice = slice(None)
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of the vectors `at` after `depth` reads of each list.

        The third result bounds the score of a vector that no list has shown.
        """
        n = len(self.ids)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        top, low = self.sorted[n - depth], self.sorted[depth - 1]
        first, last = self.sorted[0], self.sorted[-1]
        parts, place = self.parts[at], self.place[at]
        from_top, from_low = place >= n - depth, place < depth
        # Positive components are read from the greatest on, negative ones from the least.
        least = up @ np.where(from_top, parts, first).T
        least += down @ np.where(from_low, parts, last).T
        most = up @ np.where(from_top, parts, top).T
        most += down @ np.where(from_low, parts, low).T
        return least, most, up @ top + down @ low

    def best(
        self, own: np.ndarray, queries: np.ndarray, k: int, levels: np.ndarray | None = None
    ) -> list[tuple[int, int, int]]:
        """(query, vector, score) of each query's k best, ties to the smaller id.

        `own` names the queries' rows, which they do not find. Scores below a
        query's level may be left out.
        """
        levels = np.full(len(own), -np.inf) if levels is None else levels
        found = self.found(own, queries, k, levels)
        return [
            (own[query], self.ids[at], int(score))
            for query, places, values in found
            for at, score in zip(places, values)
        ]

    def found(self, own, queries, k: int, levels) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, places, scores) of every query that finds something."""
        n = len(self.ids)
        reach = float(np.abs(queries).max(initial=0))
        exact = max(queries.shape[1], self.parts.shape[1]) * reach * self.largest < 2**53
        waiting, open_ = np.arange(len(queries)), np.arange(n)
        for share in DEPTHS if exact else (1.0,):
            depth = max(1, min(n, math.ceil(n * share)))
            least, most, unseen = self.bounds(queries[waiting], depth, open_)
            if not exact:
                # Sums that doubles cannot hold bound nothing.
                least, most = np.full_like(least, -np.inf), np.full_like(most, np.inf)
            mine = self.rows[open_][None, :] == own[waiting][:, None]
            least[mine] = -np.inf
            level = levels[waiting]
            if len(open_) > k:
                level = np.maximum(level, np.partition(least, len(open_) - k, axis=1)[:, len(open_) - k])
            left = (most >= level[:, None]) & ~mine
            more = (left.sum(axis=1) > FEW * k) | (unseen >= level)
            more &= depth < n
            for line in np.flatnonzero(~more):
                at = open_[left[line]]
                if len(at):
                    value = scores(queries[waiting[line]][None], self.parts[at], reach, self.largest)[0]
                    order = np.lexsort((self.rows[at], self.ids[at], -value))[:k]
                    yield waiting[line], at[order], value[order]
            self.read[share] = self.read.get(share, 0) + int((~more).sum())
            waiting = waiting[more]
            if not len(waiting):
                return
            # What no waiting query wants any more is not looked at again.
            open_ = open_[left[more].any(axis=0)]


def _level(held: tuple, k: int) -> float:
    return float(held[0][-1]) if len(held[0]) == k else -np.inf


def top_k(rows: DataFrame, is_query: Column, k: int = K, slice_bytes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the k best other rows.

    `rows`: row (unique), vec_id, parts.
    """
    queries = rows.where(is_query & F.col("vec_id").isNotNull())
    size = queries.agg(F.sum(F.size("parts") * 8 + 128).alias("bytes")).first()["bytes"] or 0
    slices = max(1, math.ceil(size / (slice_bytes or SLICE_BYTES)))
    found = None
    for at in range(slices):
        part = queries.where(F.pmod(F.xxhash64("row"), F.lit(slices)) == at).toArrow()
        if part.num_rows:
            some = _met(rows, part, k)
            found = some if found is None else found.unionByName(some)
    if found is None:
        none = "query_id long, rank int, vec_id long, score long"
        return rows.sparkSession.createDataFrame([], none)
    order = Window.partitionBy("query").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"
    )
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _met(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """Up to k rows a query and task."""
    asked = asked.combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast(
        (np.asarray(asked["row"]), np.asarray(asked["vec_id"]), matrix_of(asked["parts"]))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, queries = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none, none)] * len(own)  # scores, ids, rows

        def meet(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            width = queries.shape[1]
            parts = matrix_of(table["parts"], width)
            ids = np.asarray(table["vec_id"].fill_null(_LAST_ID), dtype=np.int64)
            lists = SortedLists(ids, parts, np.asarray(table["row"]))
            wide = widened(queries, parts.shape[1])
            for start in range(0, len(own), CHUNK):
                these = slice(start, start + CHUNK)
                levels = np.array([_level(b, k) for b in best[these]])
                for query, at, value in lists.found(own[these], wide[these], k, levels):
                    old = best[start + query]
                    joined = [np.concatenate(x) for x in zip(old, (value, lists.ids[at], lists.rows[at]))]
                    order = np.lexsort((joined[2], joined[1], -joined[0]))[:k]
                    best[start + query] = tuple(x[order] for x in joined)

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK:
                meet(held)
                held, count = [], 0
        if count:
            meet(held)
        sizes = [len(b[0]) for b in best]
        score, ids, row = (np.concatenate([b[i] for b in best]) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(own, sizes)),
                pa.array(np.repeat(names, sizes)),
                pa.array(ids, mask=ids == _LAST_ID),
                pa.array(row),
                pa.array(score),
            ],
            ["query", "query_id", "vec_id", "row", "score"],
        )

    return rows.mapInArrow(search, FOUND)


def search(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """Top k of every `every`th id against all vectors."""
    rows = materialize(quantised(vectors))
    return top_k(rows, F.pmod("vec_id", F.lit(every)) == 0, k)
