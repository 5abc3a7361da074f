"""What is known of response ids, without reading the whole history.

A base holds the ids that are assigned, flagged for evaluation or dead, in
folders by hash of about `BUCKET_ROWS` ids: as the history grows there are more
folders, not larger ones, up to `MOST_FOLDERS` of each kind; files cost more than
rows beyond. A look-up reads the folders its ids fall into and the
commits since the base was made, so for a batch of n ids at most 2 n folders
however long the history is. A second base holds the responses that wait to be
clustered. Both are rewritten by `plans.jobs.compact_lookups` alone; until that
ran, look-ups read the logs. The answers are the same at any time.

Ids may repeat and be null: a repeated id is one row, a null one meets nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.session import materialize
from topicgauge.sources.state import StateStore

BUCKET_ROWS = 1 << 20
# Every folder is at least a file to write, to list and to open.
MOST_FOLDERS = 1024
# The log that tells of each kind, and which of its rows do.
KINDS = {"assigned": ("assignments", "true"), "flagged": ("responses", "sampled"), "dead": ("dead_letter", "true")}


def known(store: StateStore, kind: str, ids: DataFrame) -> DataFrame:
    """(response_id) of the kind, among them all of `ids` (response_id) that are of it."""
    base, seq = store.based("ids")
    mine = base.where(F.col("kind") == kind)
    one = mine.select("buckets").first()
    if one is not None:
        # Never more than there are folders; when it is most of them all are read.
        asked = [r[0] for r in ids.select(_bucket(one["buckets"])).distinct().collect()]
        if 2 * len(asked) < one["buckets"]:
            mine = mine.where(F.col("bucket").isin(asked))
    return mine.select("response_id").unionByName(_since(store, kind, seq))


def waiting(store: StateStore) -> DataFrame:
    """Responses that are neither assigned nor dead."""
    base, seq = store.based("waiting")
    new = store.newer("responses", seq)
    for kind in ("assigned", "dead"):
        base = base.join(_since(store, kind, seq), "response_id", "left_anti")
        # A response may be logged after it was assigned.
        new = new.join(known(store, kind, new.select("response_id")), "response_id", "left_anti")
    return base.unionByName(new)


def compacted(store: StateStore, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A new base of ids: the old one and what came since, dealt into folders anew."""
    base, seq = store.based("ids")
    rows = base.select("response_id", "kind")
    for kind in KINDS:
        rows = rows.unionByName(_since(store, kind, seq).withColumn("kind", F.lit(kind)))
    rows = materialize(rows.where(F.col("response_id").isNotNull()).distinct())
    buckets = min(MOST_FOLDERS, max(1, math.ceil(rows.count() / bucket_rows)))
    return rows.withColumn("buckets", F.lit(buckets)).withColumn("bucket", _bucket(buckets)).repartition(
        "kind", "bucket"
    )


def _since(store: StateStore, kind: str, seq: int) -> DataFrame:
    log, which = KINDS[kind]
    return store.newer(log, seq).where(which).select("response_id")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("response_id"), F.lit(buckets)).cast("int")
