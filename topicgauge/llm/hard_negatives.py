"""Hard negatives by angular triangle filtering.

Every vector stores its norm and its angles to a few reference directions. For
an anchor and a row the angles to one reference differ by at most the angle
between the two, and add up to no less; all references together give an interval
of that angle, hence of the cosine, and times the norms an interval of the
integer score, widened by more than any rounding. A score is computed only where
that interval meets what is sought: for positives all above the anchor's k-th
best so far, for negatives the windows below its positives' scores, whose lower
ends rise with what has been found. Rows of a block stand in cells of like
angles, whose ranges rule out whole cells first.

Anchors pass in slices of bounded size; rows stay in their partitions and are
read twice for each slice, once for positives and once for negatives. A task
gives at most k rows for each anchor, or anchor and positive.

Defined results: rows without a label, or with a null, non-finite or missing
component take no part; shorter (empty) vectors count as padded with zeros.
Every row is an anchor, a positive or a candidate of its own, also when ids
repeat; rows without an id are no anchors, and stand after others of equal
score. Scores are exact while they are below 2^63. Columns other than the named
ones are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicgauge.session import materialize

POSITIVES = 5
NEGATIVES = 5
# Per cent of the positive's score that a negative's may have.
LOW, HIGH = 80, 100
REFERENCES = 8
# References are chosen among this many rows, those of smallest hash.
SAMPLE = 256
BLOCK = 4096
CELL = 64
# Anchors that meet a block at a time, and bytes of anchors broadcast at a time.
CHUNK = 256
SLICE_BYTES = 16 << 20
# Share of the norms' product that intervals are widened by; angles are exact to about 1e-7.
MARGIN = 1e-6
_LAST_ID = np.iinfo(np.int64).max
ROWS = "row long, vec_id long, label long, parts array<double>, norm double, angles array<double>"


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, parts): rows that take part, components as floor(scale * x)."""
    whole = F.forall(
        "embedding",
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")),
    )
    parts = F.transform(
        "embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double")
    )
    kept = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    return kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), parts.alias("parts"))


# ---- references and angles -------------------------------------------------------


def references(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit directions that lie far apart, chosen in a bounded sample of the rows."""
    order = F.xxhash64("vec_id", F.col("parts").cast("string"))
    drawn = rows.where(F.exists("parts", lambda x: x != 0)).orderBy(order).limit(sample)
    matrix = matrix_of(drawn.select("parts").toArrow()["parts"])
    if not len(matrix):
        return np.zeros((0, 0))
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def matrix_of(lists: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, max(0, width - matrix.shape[1]))))


def with_angles(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """Rows with a number of their own, their norm and their angle to each direction."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            parts = matrix_of(batch["parts"], at.shape[1])
            norm = np.linalg.norm(parts, axis=1)
            unit = np.divide(parts, norm[:, None], out=np.zeros_like(parts), where=norm[:, None] > 0)
            angles = np.arccos(np.clip(unit @ widened(at, parts.shape[1]).T, -1.0, 1.0))
            ends = pa.array(np.arange(len(parts) + 1, dtype=np.int32) * len(at))
            lists = pa.ListArray.from_arrays(ends, pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("row", "vec_id", "label", "parts")), pa.array(norm), lists],
                ["row", "vec_id", "label", "parts", "norm", "angles"],
            )

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return numbered.select("row", "vec_id", "label", "parts").mapInArrow(measure, ROWS)


class Rows:
    """Rows as arrays, in cells of like label and angles."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        angles = matrix_of(table["angles"])
        label = np.asarray(table["label"])
        if angles.shape[1]:
            order = np.lexsort((angles.min(axis=1), angles.argmin(axis=1), label))
        else:
            order = np.argsort(label, kind="stable")
        self.angles, self.label = angles[order], label[order]
        self.parts = matrix_of(table["parts"])[order]
        self.norm = np.asarray(table["norm"])[order]
        self.row = np.asarray(table["row"])[order]
        self.ids = np.asarray(table["vec_id"].fill_null(_LAST_ID), dtype=np.int64)[order]
        self.largest = float(np.abs(self.parts).max(initial=0))

    def __len__(self) -> int:
        return len(self.row)

    def cells(self) -> dict:
        """Ranges of angles and norms, and the only label or none, of every run of CELL rows."""
        starts = np.arange(0, len(self), CELL)
        low, high = (f.reduceat(self.label, starts) for f in (np.minimum, np.maximum))
        return {
            "starts": starts,
            "angles": tuple(f.reduceat(self.angles, starts, axis=0) for f in (np.minimum, np.maximum)),
            "norms": tuple(f.reduceat(self.norm, starts) for f in (np.minimum, np.maximum)),
            "labels": (low, high),
        }


def intervals(a_norm, a_angles, norms, angles) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score of each anchor with rows in ranges of norm and angles.

    `norms`, `angles`: (least, greatest) by cell, the same array twice for single rows.
    """
    shape = (len(a_norm), len(norms[0]))
    near, far = np.zeros(shape), np.full(shape, np.pi)
    for r in range(a_angles.shape[1]):
        own, low, high = a_angles[:, r, None], angles[0][None, :, r], angles[1][None, :, r]
        np.maximum(near, np.maximum(low - own, own - high), out=near)
        # Two angles add up to the widest possible one, on either side of the half turn.
        least, most = own + low, own + high
        widest = np.where(
            (least <= np.pi) & (most >= np.pi),
            np.pi,
            np.maximum(np.minimum(least, 2 * np.pi - least), np.minimum(most, 2 * np.pi - most)),
        )
        np.minimum(far, widest, out=far)
    near, far = np.cos(np.minimum(near, np.pi)), np.cos(far)
    short, long = a_norm[:, None] * norms[0], a_norm[:, None] * norms[1]
    spare = MARGIN * long + MARGIN
    lower = np.floor(np.where(far >= 0, short, long) * far - spare)
    upper = np.ceil(np.where(near >= 0, long, short) * near + spare)
    return lower, upper


def scores(a: np.ndarray, x: np.ndarray, a_largest: float, x_largest: float) -> np.ndarray:
    """Integer inner products of all rows of `a` and `x`."""
    width = max(a.shape[1], x.shape[1])
    a, x = widened(a, width), widened(x, width)
    if width * a_largest * x_largest < 2**53:
        return (a @ x.T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


# ---- the two searches over a task's blocks ------------------------------------------


class Sought:
    """What anchors seek: scores of `low` to `high` for each of their places, the k best of each.

    `same`: rows of the anchor's label (positives), or of any other (negatives).
    """

    def __init__(self, anchors: Rows, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.anchors, self.k, self.same = anchors, k, same
        self.low, self.high = low.astype(np.float64), high.astype(np.float64)  # anchor x place
        empty = np.zeros(0, np.int64)
        self.found = [[(empty, empty, empty) for _ in range(low.shape[1])] for _ in range(len(low))]
        self.scored = 0

    def read(self, rows: Rows) -> None:
        cells = rows.cells()
        for at in range(0, len(self.anchors), CHUNK):
            self._meet(rows, cells, np.arange(at, min(at + CHUNK, len(self.anchors))))

    def _meet(self, rows: Rows, cells: dict, at: np.ndarray) -> None:
        own = self.anchors
        low, high = self.low[at].min(axis=1)[:, None], self.high[at].max(axis=1)[:, None]
        norm, angles, label = own.norm[at], own.angles[at], own.label[at][:, None]
        lower, upper = intervals(norm, angles, cells["norms"], cells["angles"])
        only = (cells["labels"][0] == cells["labels"][1])[None, :]
        mine = (cells["labels"][0] <= label) & (label <= cells["labels"][1])
        cell = (upper >= low) & (lower <= high) & (mine if self.same else ~(only & mine))
        of_cell = np.repeat(np.arange(len(cells["starts"])), CELL)[: len(rows)]
        some = np.flatnonzero(cell.any(axis=0)[of_cell])
        if not len(some):
            return
        alike = rows.label[some][None, :] == label
        open_ = cell[:, of_cell[some]] & (alike if self.same else ~alike)
        open_ &= rows.row[some][None, :] != own.row[at][:, None]
        lower, upper = intervals(
            norm, angles, (rows.norm[some],) * 2, (rows.angles[some],) * 2
        )
        open_ &= (upper >= low) & (lower <= high)
        asked, met = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(asked):
            return
        some, open_ = some[met], open_[np.ix_(asked, met)]
        value = scores(own.parts[at[asked]], rows.parts[some], own.largest, rows.largest)
        self.scored += int(open_.sum())
        for line, anchor in enumerate(at[asked]):
            for place in range(self.low.shape[1]):
                fits = open_[line] & (value[line] >= self.low[anchor, place])
                fits &= value[line] <= self.high[anchor, place]
                if fits.any():
                    self._add(anchor, place, value[line][fits], rows.ids[some[fits]], rows.row[some[fits]])

    def _add(self, anchor: int, place: int, score, ids, row) -> None:
        held = self.found[anchor][place]
        score, ids, row = (np.concatenate(pair) for pair in zip(held, (score, ids, row)))
        order = np.lexsort((row, ids, -score))[: self.k]
        self.found[anchor][place] = (score[order], ids[order], row[order])
        if len(order) == self.k:
            self.low[anchor, place] = max(self.low[anchor, place], float(score[order[-1]]))

    def results(self) -> pa.RecordBatch:
        """anchor, place, vec_id, row, score: the k best of each place."""
        flat = [
            (anchor, place, *held)
            for anchor, places in enumerate(self.found)
            for place, held in enumerate(places)
        ]
        sizes = [len(f[2]) for f in flat]
        ids = np.concatenate([f[3] for f in flat])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([f[0] for f in flat], sizes), pa.int64()),
                pa.array(np.repeat([f[1] for f in flat], sizes), pa.int64()),
                pa.array(ids, mask=ids == _LAST_ID),
                pa.array(np.concatenate([f[4] for f in flat])),
                pa.array(np.concatenate([f[2] for f in flat])),
            ],
            ["anchor", "place", "vec_id", "row", "score"],
        )


FOUND = "anchor long, place long, vec_id long, row long, score long"


def _search(rows: DataFrame, anchors: Rows, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """The k best rows of every anchor and place, ranked from 1."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, low, high))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = Sought(*shared.value, k, same)
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK:
                sought.read(Rows(pa.Table.from_batches(held)))
                held, count = [], 0
        if count:
            sought.read(Rows(pa.Table.from_batches(held)))
        yield sought.results()

    found = rows.mapInArrow(task, FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"
    )
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors`: vec_id, label, parts, as `usable` gives them. For every anchor
    and each of its best rows of the same label, the best rows of other labels
    with `low` to `high` per cent of that row's score.
    """
    rows = materialize(with_angles(vectors, references(vectors)))
    anchors = rows.where(is_anchor & F.col("vec_id").isNotNull())
    size = anchors.agg(F.sum(F.size("parts") * 8 + 256).alias("bytes")).first()["bytes"] or 0
    slices = max(1, math.ceil(size / slice_bytes))
    found = None
    for at in range(slices):
        part = anchors.where(F.pmod(F.xxhash64("row"), F.lit(slices)) == at).toArrow()
        if part.num_rows:
            some = _mined_slice(rows, Rows(part), positives, negatives, low, high)
            found = some if found is None else found.unionByName(some)
    if found is None:
        none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], none)
    return found


def _mined_slice(rows, anchors: Rows, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    anything = np.full((len(anchors), 1), np.inf)
    best = materialize(_search(rows, anchors, -anything, anything, positives, True))
    held = best.select("anchor", "rank", "vec_id", "score").toArrow()
    # A place for each positive; those an anchor lacks seek nothing.
    floor = np.full((len(anchors), positives), np.inf)
    ceiling = -floor
    where = np.asarray(held["anchor"]), np.asarray(held["rank"]) - 1
    score = np.asarray(held["score"], dtype=np.int64)
    least, most = -((-low * score) // 100), (high * score) // 100
    some = least <= most
    floor[where[0][some], where[1][some]] = least[some]
    ceiling[where[0][some], where[1][some]] = most[some]
    found = _search(rows, anchors, floor, ceiling, negatives, False)
    names = spark.createDataFrame(
        pa.table({"anchor": pa.array(np.arange(len(anchors))), "anchor_id": pa.array(anchors.ids)})
    )
    pairs = best.select(
        "anchor", (F.col("rank") - 1).cast("long").alias("place"),
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    # At most one slice's anchors, and as many positives each.
    return (
        found.join(F.broadcast(pairs.join(F.broadcast(names), "anchor")), ["anchor", "place"])
        .select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )
