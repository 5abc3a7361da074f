"""Drift detection kept up to date as scores arrive."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from topicgauge.params import MIN_SCORES, SCORE_WINDOW

SCORE = "cluster_id string, micros bigint, response_id string, quality_score double"
OUTPUT = (
    "cluster_id string, n_scores bigint, baseline_score double, current_score double, "
    "delta double, alert_triggered boolean"
)
NEWEST_FIRST = [("cluster_id", "ascending"), ("micros", "descending"), ("response_id", "descending")]


def newest_per_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep what can still matter of a batch before it is shuffled: at most
    the newest SCORE_WINDOW scores per cluster, scores without a time last."""
    for batch in batches:
        missing = pc.or_(pc.is_null(batch["quality_score"], nan_is_null=True), pc.is_null(batch["cluster_id"]))
        scored = batch.filter(pc.invert(missing))
        newest = scored.take(pc.sort_indices(scored, sort_keys=NEWEST_FIRST))
        at = np.arange(newest.num_rows)
        cluster = newest["cluster_id"]
        first = np.ones(newest.num_rows, dtype=bool)
        first[1:] = pc.not_equal(cluster[1:], cluster[:-1]).to_numpy(zero_copy_only=False)
        rank = at - np.maximum.accumulate(np.where(first, at, 0))
        yield newest.filter(pa.array(rank < SCORE_WINDOW))


def by_time(score: list) -> tuple[bool, int, bool, str]:
    """Order of scores; those without a time, and at one time without an id, come last."""
    micros, id, _ = score
    return micros is None, micros or 0, id is None, id or ""


class RollingDrift(StatefulProcessor):
    """Per cluster: the newest scores by time, and a detection per update.

    Scores are placed by their own time, so late ones land where they belong.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState(
            "window",
            "micros array<bigint>, ids array<string>, scores array<double>",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Of one response the score that comes first counts, new ones before those held.
        every, timeless = {}, False
        for _, *score in rows:
            timeless |= score[0] is None
            every.setdefault(score[1], score)
        held = self.window.get() or ([], [], [])
        for score in zip(*held):
            every.setdefault(score[1], score)
        kept = sorted(every.values(), key=by_time)[-SCORE_WINDOW:]
        micros, ids, scores = map(list, zip(*kept))
        # A score without a time leaves none to those held with it.
        if timeless or 0 < list(held[0]).count(None) < len(held[0]):
            micros = [None] * len(kept)
        self.window.update((micros, ids, scores))
        n = len(kept)
        if n < MIN_SCORES:
            return
        values = np.array(scores)
        baseline, current = float(values[: n // 2].mean()), float(values[n // 2 :].mean())
        delta = (baseline - current) / baseline if baseline > 0 else 0.0
        yield Row(
            cluster_id=key[0],
            n_scores=n,
            baseline_score=baseline,
            current_score=current,
            delta=delta,
            alert_triggered=delta > self.threshold,
        )

    def close(self) -> None:
        pass


def rolling_drift(scores: DataFrame, threshold: float) -> DataFrame:
    """Streaming scores → an updated detection for every cluster that got scores."""
    # The processor is also started next to the driver, where shipped files are
    # not on the path: send the class itself.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return (
        scores.select(
            F.col("cluster_id").cast("string").alias("cluster_id"),
            F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"),
            F.col("response_id").cast("string").alias("response_id"),
            "quality_score",
        )
        .mapInArrow(newest_per_cluster, SCORE)
        .groupBy("cluster_id")
        .transformWithState(
            statefulProcessor=RollingDrift(threshold),
            outputStructType=OUTPUT,
            outputMode="Update",
            timeMode="None",
        )
    )
