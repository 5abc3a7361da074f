"""Batch entry points over the state store, to be run by any scheduler.

Each opens an epoch, writes its tables and commits; a repeated run is a new
epoch, a failed one leaves nothing visible. Jobs may run side by side: one that
writes a snapshot another job has replaced meanwhile is done again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.functions.embedding import Embedder, embed_pairs
from topicgauge.operators import assign, drift, evaluate, golden, normalize, recover, sampling, split
from topicgauge.params import Params
from topicgauge.session import broadcast_if_small, materialize, scratch
from topicgauge.sources import lookups, outbox
from topicgauge.sources.state import Epoch, StateMoved, StateStore


def _at(now: datetime):
    return F.lit(now.isoformat(sep=" ")).cast("timestamp")


def log_calls(store: StateStore, calls: DataFrame, params: Params, batch_id: int = -1) -> None:
    """Captured calls → responses (every Nth marked as sampled) and dead letters."""
    if batch_id >= 0 and store.committed("log", batch_id):
        return
    with scratch(store.spark):
        store.publish("log", lambda epoch: _write_calls(epoch, store, calls, params), batch_id)


def _write_calls(epoch: Epoch, store: StateStore, calls: DataFrame, params: Params) -> None:
    rows = normalize.validate_responses(normalize.normalize_calls(calls))
    good, dead = normalize.split_rejects(materialize(rows))
    seen = store.at(epoch.base).snapshot("sampling").agg(F.max("rows_seen").alias("n")).first()["n"] or 0
    order = ["created_at", "response_id"]
    marked = sampling.every_nth(good.select(*order), order, params.sampling_rate, start=seen)
    # Only the marked ids join back, 1 in `sampling_rate` rows.
    responses = good.join(
        marked.where("sampled").select("response_id", "sampled"), "response_id", "left"
    ).withColumn("sampled", F.coalesce("sampled", F.lit(False)))
    epoch.write("responses", responses)
    epoch.write("dead_letter", dead)
    total = seen + good.count()
    epoch.write("sampling", store.spark.createDataFrame([(total,)], "rows_seen bigint"))


def cluster_batch(
    store: StateStore,
    entries: DataFrame,
    embedder: Embedder,
    params: Params,
    now: datetime,
    job: str = "cluster",
    batch_id: int = -1,
    stream: str = "",
    dead: DataFrame | None = None,
) -> None:
    """Embed, assign, admit goldens and evaluate one batch of stream entries.

    Entries already assigned are left out, so a batch delivered twice, or
    recovered while still on its way, is counted once. `dead` letters of the
    batch become visible with it.
    """
    if batch_id >= 0 and store.committed(job, batch_id, stream):
        return

    def work(epoch: Epoch) -> None:
        _write_batch(epoch, store, entries, embedder, params, now)
        if dead is not None:
            epoch.write("dead_letter", dead)

    with scratch(store.spark):
        store.publish(job, work, batch_id, stream)


def _write_batch(
    epoch: Epoch, store: StateStore, entries: DataFrame, embedder: Embedder, params: Params, now: datetime
) -> None:
    assigned = lookups.known(store, "assigned", entries)
    fresh = entries.dropDuplicates(["response_id"]).join(assigned, "response_id", "left_anti")
    embedded = materialize(embed_pairs(fresh, embedder, params.embedding_dim))
    # Another job that takes the same entries meanwhile must not count them too.
    epoch.only_once("assignments", "response_id", embedded.select("response_id"))
    clusters = store.snapshot("clusters")
    done = assign.assign_batch(embedded, clusters, params, _at(now))
    rows, deltas = materialize(done.rows), materialize(done.deltas)
    epoch.write("assignments", rows)
    epoch.write("cluster_deltas", deltas)
    goldens = store.snapshot("goldens")
    if params.golden_set_mode == "auto":
        live = clusters.select("cluster_id").unionByName(deltas.select("cluster_id")).distinct()
        admitted = materialize(golden.admit(rows, goldens, live, params.golden_set_warmup))
        epoch.write("golden_entries", admitted)
        goldens = goldens.unionByName(admitted)
    flagged = lookups.known(store, "flagged", rows)
    sampled = rows.join(flagged, "response_id", "left_semi")
    write_scores(epoch, evaluate.evaluate(sampled, goldens, params), sampled)


def write_scores(epoch: Epoch, scores: DataFrame, scored: DataFrame) -> None:
    """Scores, and beside them what detection needs: the cluster and time of each response in `scored`."""
    scores = materialize(scores)
    epoch.write("scores", scores)
    placed = scored.select("response_id", "cluster_id", "created_at")
    entries = scores.select("response_id", "quality_score").join(placed, "response_id")
    epoch.write("recent_entries", entries.withColumn("evaluated", F.lit(epoch.number)))


def compact_state(store: StateStore) -> None:
    """New bases of clusters and goldens, from the old ones and what was added since."""

    def work(epoch: Epoch) -> None:
        then = store.at(epoch.base)
        for table in ("clusters", "goldens"):
            epoch.write(table, then.snapshot(table))

    store.publish("compact", work)


def compact_lookups(store: StateStore, bucket_rows: int = lookups.BUCKET_ROWS) -> None:
    """New bases of the ids and of the waiting responses, so that look-ups read less."""

    def work(epoch: Epoch) -> None:
        then = store.at(epoch.base)
        epoch.write("ids", lookups.compacted(then, bucket_rows))
        epoch.write("waiting", lookups.waiting(then))

    with scratch(store.spark):
        store.publish("compact", work)


def evaluate_pending(store: StateStore, embedder: Embedder, params: Params) -> None:
    """Score sampled responses that have a cluster but no score yet."""
    epoch = store.open("evaluate")
    waiting = evaluate.pending_evaluations(
        store.log("responses").select("response_id", "raw_content", "sampled"),
        store.members().select("response_id", "cluster_id", "created_at", "response_embedding"),
        store.log("scores"),
    )
    with scratch(store.spark):
        full = materialize(evaluate.fill_embeddings(waiting, embedder))
        write_scores(epoch, evaluate.evaluate(full, store.snapshot("goldens"), params), full)
        epoch.commit()


def detect_drift(store: StateStore, params: Params, now: datetime) -> int:
    """One detection run over all clusters; writes the events and returns the epoch.

    Reads the newest scores as the last run left them and what was added since,
    never the logs of scores and assignments.
    """

    def work(epoch: Epoch) -> int:
        recent = materialize(drift.merge_recent(store.at(epoch.base).snapshot("recent")))
        found = drift.detect(recent, params.drift_threshold)
        epoch.write("recent", recent)
        epoch.write("drift_events", drift.drift_events(found, _at(now), params.notification_channel))
        return epoch.number

    with scratch(store.spark):
        return store.publish("detect", work)


def send_alerts(store: StateStore, send: Callable[[dict], None], params: Params, now: datetime) -> None:
    """Send what is pending on the chosen channel; `none` leaves it pending."""
    if params.notification_channel == "none":
        return
    epoch = store.open("alerts")
    waiting = outbox.pending(store.log("drift_events").drop("epoch"), store.log("alert_deliveries"))
    ready = outbox.outgoing(waiting, params)
    epoch.write("alert_deliveries", outbox.deliver(ready, send, _at(now)))
    epoch.commit()


def split_wide_clusters(store: StateStore, params: Params, now: datetime) -> int:
    """Split every oversized cluster once; returns how many were split."""
    while True:
        try:
            return _split_once(store, params, now)
        except StateMoved:
            continue


def _split_once(store: StateStore, params: Params, now: datetime) -> int:
    epoch = store.open("split")
    # What batches commit from here on is added to the new base, so it must not be in it.
    store = store.at(epoch.base)
    clusters = store.snapshot("clusters")
    with scratch(store.spark):
        wide = materialize(split.oversized(clusters, params.birch_threshold).select("cluster_id"))
        if wide.isEmpty():
            return 0
        # Find the rows concerned on narrow columns, then fetch their vectors.
        here = store.current_assignments().join(
            broadcast_if_small(wide, params.broadcast_limit_bytes), "cluster_id", "left_semi"
        )
        vectors = store.log("assignments").select("response_id", "request_embedding")
        done = split.split_clusters(
            vectors.join(here, "response_id"), wide, params, epoch=epoch.number
        )
        splits = done.parts.select("cluster_id").distinct().count()
        if splits:
            _write_split(epoch, store, clusters, done, now)
        return splits


def _write_split(epoch: Epoch, store: StateStore, clusters, done: split.Split, now: datetime) -> None:
    epoch.write("clusters", split.replace_clusters(clusters, done.parts, _at(now)))
    epoch.write(
        "remaps",
        done.members.select("response_id", F.col("new_cluster_id").alias("cluster_id")),
    )
    epoch.write("goldens", split.remap_goldens(store.snapshot("goldens"), done.parts))
    # The parts' newest scores are among all of the split clusters', not only their newest.
    moved = done.members.select("response_id", F.col("new_cluster_id").alias("cluster_id"))
    when = store.log("assignments").select("response_id", "created_at")
    scores = store.current_scores().select("response_id", "quality_score", F.col("epoch").alias("evaluated"))
    theirs = scores.join(moved, "response_id").join(when, "response_id")
    gone = done.parts.select("cluster_id").distinct()
    others = store.snapshot("recent").join(gone, "cluster_id", "left_anti")
    epoch.write("recent", drift.merge_recent(others.unionByName(theirs.select(others.columns))))
    epoch.commit()


def add_goldens(store: StateStore, entries: DataFrame, embedder: Embedder, params: Params, now: datetime) -> int:
    """Manual goldens from (response_text, description); returns the set's new size."""

    def work(epoch: Epoch) -> None:
        then = store.at(epoch.base)
        rows = golden.manual_goldens(entries, embedder, _at(now))
        everything = materialize(golden.insert(then.snapshot("goldens"), rows))
        clusters = then.snapshot("clusters")
        if not clusters.isEmpty():
            everything = assign.assign_goldens(everything, clusters, params)
        epoch.write("goldens", everything)

    with scratch(store.spark):
        store.publish("goldens", work)
    return store.snapshot("goldens").count()


def clear_goldens(store: StateStore) -> int:
    """Empty the golden set; returns how many it held."""

    def work(epoch: Epoch) -> int:
        empty, held = golden.cleared(store.at(epoch.base).snapshot("goldens"))
        epoch.write("goldens", empty)
        return held

    return store.publish("goldens", work)


def recover_unclustered(
    store: StateStore,
    embedder: Embedder,
    params: Params,
    now: datetime,
    limit: int | None = None,
) -> int:
    """Cluster responses that were never queued; returns how many were picked up.

    All that wait are taken, or the oldest `limit` of them.
    """
    cutoff = _at(now - timedelta(seconds=params.recovery_min_age_s))
    waiting = lookups.waiting(store).where(F.col("created_at") < cutoff)
    with scratch(store.spark):
        picked = materialize(recover.oldest(waiting, limit))
        entries, skipped = recover.split_recoverable(picked)
        if not skipped.isEmpty():
            epoch = store.open("recover")
            epoch.write("dead_letter", skipped)
            epoch.commit()
        found = entries.count()
        if found:
            cluster_batch(store, entries, embedder, params, now, job="recover")
    return found
