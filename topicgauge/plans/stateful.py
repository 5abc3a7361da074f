"""Queries that run jobs with state: growth, streams, outbox, manual goldens."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge.functions import vectors as vf
from topicgauge.functions.embedding import HashedWords, try_pairs
from topicgauge.operators import assign, drift, golden, grow, metrics
from topicgauge.plans import jobs
from topicgauge.plans.checked import (
    PARAMS, _events, _goldens, _labels_as_clusters, _recovery, anthropic_lines, openai_lines, r6,
)
from topicgauge.schemas import STREAM_ENTRY
from topicgauge.session import SETTINGS, materialize, shared_dir
from topicgauge.sources import lookups, outbox
from topicgauge.sources import tables as src
from topicgauge.sources.state import StateStore, latest
from topicgauge.streaming import cluster_stream, drift_stream, transcript_stream

TOPIC = replace(PARAMS, birch_threshold=0.6)
NOW = datetime(2024, 2, 1)
FILE_LINES = 200_000


def _work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/topicgauge/{name}-{uuid.uuid4().hex}"


# ---- growth and assignment ------------------------------------------------------


def _grown(spark: SparkSession, folder: str) -> grow.Grown:
    docs = materialize(src.embedded_documents(spark, folder))
    return grow.grow_clusters(docs, TOPIC)


def grow_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters grown from all documents, none wider than the threshold."""
    return metrics.cluster_report(_grown(spark, folder).clusters).select(
        "cluster_id", "n", r6("radius").alias("radius")
    )


def grow_membership(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every document."""
    return _grown(spark, folder).members


def assign_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of documents by time, the second tested against the clusters
    of the first: the cluster of every document, its size and its radius."""
    docs = materialize(src.embedded_documents(spark, folder))
    early = F.col("created_at") < F.lit("2024-01-01 00:05:00").cast("timestamp")
    none = spark.createDataFrame(
        [], "cluster_id string, n bigint, ls array<double>, ss double, centroid array<double>, "
        "created_at timestamp, updated_at timestamp"
    )
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp")
    first = assign.assign_batch(docs.where(early), none, TOPIC, now)
    second = assign.assign_batch(docs.where(~early), materialize(first.clusters), TOPIC, now)
    rows = first.rows.unionByName(second.rows).select("response_id", "cluster_id")
    sizes = metrics.cluster_report(second.clusters).select("cluster_id", "n", r6("radius").alias("radius"))
    return rows.join(sizes, "cluster_id", "left").select("response_id", "cluster_id", "n", "radius")


def assign_goldens(spark: SparkSession, folder: str) -> DataFrame:
    """Goldens stripped of their cluster find the nearest label centroid."""
    loose = _goldens(spark, folder).withColumn("cluster_id", F.lit(None).cast("string"))
    placed = assign.assign_goldens(loose, _labels_as_clusters(spark, folder), PARAMS)
    return placed.select("response_text", "cluster_id")


def latest_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Last write wins per user over all events."""
    log = src.table(spark, folder, "events").select(
        F.col("user_id").alias("response_id"), "event_type",
        F.struct("ts", "event_id").alias("epoch"), "event_id",
    )
    return latest(log, "response_id").select("response_id", "event_type", "event_id")


def alert_outbox(spark: SparkSession, folder: str) -> DataFrame:
    """Alert status after one round of sending in which small drops failed."""
    events = materialize(_events(spark, folder))
    rows = events.select("event_id", F.col("alert_channel").alias("channel"),
                         F.col("delta").cast("string").alias("body"))

    def send(row: dict) -> None:
        if float(row["body"]) <= 0.2:
            raise ConnectionError("receiver not reachable")

    tried = materialize(outbox.deliver(rows, send, F.current_timestamp()))
    waiting = outbox.pending(events, tried).select("event_id", F.lit(True).alias("pending"))
    return (
        outbox.event_status(events, tried)
        .join(waiting, "event_id", "left")
        .select("cluster_id", "alert_sent", F.coalesce("pending", F.lit(False)).alias("pending"))
    )


# ---- jobs over a state built from the tables ----------------------------------------


def _labelled_state(spark: SparkSession, folder: str) -> StateStore:
    """Embeddings as assigned responses, their labels as clusters, ten goldens each."""
    store = StateStore(spark, f"{_work_dir(spark, 'labels')}/state")
    members = src.members(spark, folder)
    clusters = _labels_as_clusters(spark, folder)
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp")

    def fill(epoch) -> None:
        epoch.write("assignments", members)
        epoch.write("cluster_deltas", clusters.withColumns({"created_at": now, "updated_at": now}))
        epoch.write("golden_entries", _goldens(spark, folder))
        nothing = {name: F.lit(None) for name, _ in store.fields("responses")}
        known = members.select(F.col("response_id").alias("id"), F.col("response_text").alias("text"))
        epoch.write("responses", known.select(*[
            {"response_id": F.col("id"), "raw_content": F.col("text")}.get(n, c).alias(n) for n, c in nothing.items()
        ]))

    store.publish("fill", fill)
    return store


def _split_state(spark: SparkSession, folder: str) -> tuple[StateStore, int]:
    store = _labelled_state(spark, folder)
    return store, jobs.split_wide_clusters(store, replace(PARAMS, birch_threshold=0.9), NOW)


def split_job_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters after the split job: two new ones for each old one, which is gone."""
    store, splits = _split_state(spark, folder)
    return metrics.cluster_report(store.snapshot("clusters")).select(
        "cluster_id", "n", r6("radius").alias("radius"), F.lit(splits).cast("bigint").alias("splits")
    )


def split_job_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Where every response belongs before and after the split job."""
    store, _ = _split_state(spark, folder)
    before = store.log("assignments").select("response_id", F.col("cluster_id").alias("old_cluster"))
    return before.join(store.current_assignments().drop("created_at"), "response_id")


def split_job_goldens(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of all goldens after the split job."""
    store, _ = _split_state(spark, folder)
    return store.snapshot("goldens").select("response_text", "cluster_id")


def manual_goldens(spark: SparkSession, folder: str) -> DataFrame:
    """All documents added as goldens by hand: the nearest cluster of each, and the set's size."""
    store = _labelled_state(spark, folder)
    given = src.table(spark, folder, "documents").select(
        F.col("text").alias("response_text"), F.col("doc_id").cast("string").alias("description")
    )
    size = jobs.add_goldens(store, given, HashedWords(PARAMS.embedding_dim), PARAMS, NOW)
    added = store.snapshot("goldens").where("description <> 'auto'")
    return added.select("description", "cluster_id", F.lit(size).cast("bigint").alias("size"))


def cleared_goldens(spark: SparkSession, folder: str) -> DataFrame:
    """How many goldens clearing drops, how many are left, and the responses that stay."""
    store = _labelled_state(spark, folder)
    held = jobs.clear_goldens(store)
    left = store.snapshot("goldens").count()
    return store.log("assignments").agg(
        F.lit(held).cast("bigint").alias("dropped"), F.lit(left).cast("bigint").alias("left"),
        F.count(F.lit(1)).alias("responses"),
    )


def golden_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Goldens of one cluster beside those of all clusters: sums of what the look-up gives."""
    goldens = _labelled_state(spark, folder).snapshot("goldens")
    one, every = golden.of_cluster(goldens, "3"), golden.of_cluster(goldens)
    both = one.withColumn("scope", F.lit("3")).unionByName(every.withColumn("scope", F.lit("all")))
    return both.groupBy("scope", "cluster_id").agg(
        F.count(F.lit(1)).alias("goldens"),
        F.round(F.sum(F.element_at("expected_embedding", 1).cast("double")), 5).alias("first_component"),
    )


def golden_counts(spark: SparkSession, folder: str) -> DataFrame:
    return golden.counts(_labelled_state(spark, folder).snapshot("goldens"))


def response_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One response by its id, and an unknown one."""
    store = _labelled_state(spark, folder)
    found = store.response("7")
    try:
        store.response("nobody")
        missing = False
    except LookupError:
        missing = True
    rows = [(found["response_id"], found["raw_content"], missing)]
    return spark.createDataFrame(rows, "response_id string, raw_content string, unknown_is_an_error boolean")


def cluster_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled_state(spark, folder).cluster_ids()


# ---- streams ------------------------------------------------------------------------


def stream_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling drift per user from the events read as a stream; last update wins."""
    schema = src.table(spark, folder, "events").schema
    work = _work_dir(spark, "drift")
    entries = (
        spark.readStream.schema(schema)
        .parquet(f"{folder}/events*.parquet")
        .select(
            F.col("user_id").alias("cluster_id"), F.col("ts").alias("created_at"),
            F.col("event_id").alias("response_id"),
            (1.0 / (1.0 + F.col("value") / 50.0)).alias("quality_score"),
        )
    )
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, SETTINGS[provider])
    try:
        query = (
            drift_stream.rolling_drift(entries, PARAMS.drift_threshold)
            .writeStream.foreachBatch(
                lambda batch, n: batch.write.mode("overwrite").parquet(f"{work}/out/epoch={n}")
            )
            .outputMode("update")
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    updates = spark.read.schema(drift_stream.OUTPUT + ", epoch bigint").parquet(f"{work}/out")
    return latest(updates, "cluster_id").select(
        F.col("cluster_id").cast("bigint").alias("cluster_id"), "n_scores",
        r6("baseline_score").alias("baseline_score"), r6("current_score").alias("current_score"),
        r6("delta").alias("delta"), "alert_triggered",
    )


def stream_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of both providers from lines that arrive in six batches, a third of them one batch late."""
    both = openai_lines(spark, folder).select(F.concat(F.lit("o-"), "request_id").alias("request_id"), "seq",
                                              "provider", "request_model", "line").unionByName(
        anthropic_lines(spark, folder).select(F.concat(F.lit("a-"), "request_id").alias("request_id"), "seq",
                                              "provider", "request_model", "line"))
    part = F.split_part("request_id", F.lit("-"), F.lit(2)).cast("bigint") % 4
    late = (F.pmod(F.xxhash64("request_id", "seq"), F.lit(3)) == 0).cast("int")
    at = F.timestamp_millis(F.lit(1704067200000) + part * 1_000_000 + F.least(F.col("seq"), F.lit(900_000)))
    lines = materialize(both.withColumns({"at": at, "file": part + late}), "file")
    work = _work_dir(spark, "transcripts")
    # The last batch only says how late it is.
    clock = spark.createDataFrame([("~", 0, "none", "", ": ping")], transcript_stream.LINES).withColumn(
        "at", F.timestamp_millis(F.lit(1704067200000 + 10**8)))
    # Every batch is the same number of files, of at least FILE_LINES lines unless it is one.
    counts = {r["file"]: r["count"] for r in lines.groupBy("file").count().collect()}
    files = max(1, min(64, *(counts.get(number, 0) // FILE_LINES for number in range(5))))
    for number in range(6):
        rows = lines.where(F.col("file") == number).drop("file") if number < 5 else clock
        rows = rows.coalesce(1) if files == 1 or number == 5 else rows.repartition(files)
        rows.write.mode("append").parquet(f"{work}/lines")
    stream = spark.readStream.schema(clock.schema).option("maxFilesPerTrigger", files).parquet(f"{work}/lines")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, SETTINGS[provider])
    try:
        transcript_stream.start(
            stream, f"{work}/checkpoint",
            lambda rows, n: rows.write.mode("overwrite").parquet(f"{work}/out/epoch={n}"),
            "1500 seconds", available_now=True,
        ).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{work}/out").drop("epoch")


def _clustered_stream(spark: SparkSession, folder: str) -> tuple[StateStore, DataFrame]:
    """All conversation pairs through the clustering stream, into fresh state."""
    pairs = src.pairs(spark, folder)
    work = _work_dir(spark, "cluster")
    entries = pairs.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"), "request_text", "response_text",
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn")).alias("created_at"),
    )
    spark.createDataFrame([], STREAM_ENTRY).unionByName(entries).write.parquet(f"{work}/entries")
    store = StateStore(spark, f"{work}/state")
    sampled = entries.select("response_id", F.lit(True).alias("sampled"))
    epoch = store.open("log")
    responses = {name: F.lit(None) for name, _ in store.fields("responses")}
    epoch.write("responses", sampled.select("response_id", "sampled", *[
        c.alias(n) for n, c in responses.items() if n not in ("response_id", "sampled")
    ]))
    epoch.commit()
    query = cluster_stream.start(
        cluster_stream.read_entries(spark, f"{work}/entries"), store.root, f"{work}/checkpoint",
        HashedWords(64), TOPIC, available_now=True,
    )
    query.awaitTermination()
    return store, entries


def stream_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters the stream built: size and radius."""
    store, _ = _clustered_stream(spark, folder)
    return metrics.cluster_report(store.snapshot("clusters")).select(
        "cluster_id", "n", r6("radius").alias("radius")
    )


def stream_cluster_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair is assigned once and scored once, and the clusters count them all."""
    store, entries = _clustered_stream(spark, folder)
    assigned = store.log("assignments").groupBy("response_id").agg(F.count(F.lit(1)).alias("assignments"))
    scored = store.log("scores").groupBy("response_id").agg(F.count(F.lit(1)).alias("scores"))
    return (
        entries.select("response_id")
        .join(assigned, "response_id", "left")
        .join(scored, "response_id", "left")
    )


def interleaved_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Two jobs open at once, each with half of the pairs; both stay visible."""
    pairs = src.pairs(spark, folder).select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"), "conv_id",
        (F.col("turn") / 100).alias("quality_score"), F.lit(None).cast("string").alias("reject_reason"),
    )
    store = StateStore(spark, f"{_work_dir(spark, 'interleaved')}/state")
    first, second = store.open("first"), store.open("second")
    for epoch, half in ((second, 1), (first, 0)):
        epoch.write("scores", pairs.where(F.col("conv_id") % 2 == half))
        epoch.commit()
    return store.current_scores().select("response_id", r6("quality_score").alias("quality_score"))


def drift_detect_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Drift per user and event type, of scores that came in three parts with a detection after each."""
    scores = src.scores(spark, folder).withColumn("part", F.col("response_id") % 3)
    store = StateStore(spark, f"{_work_dir(spark, 'recent')}/state")
    for part in range(3):
        epoch = store.open("evaluate")
        epoch.write("recent_entries", scores.where(F.col("part") == part).withColumn("evaluated", F.lit(epoch.number)))
        epoch.commit()
        jobs.detect_drift(store, PARAMS, NOW)
    found = drift.detect(store.snapshot("recent"), PARAMS.drift_threshold)
    return found.select(
        F.col("cluster_id").cast("bigint").alias("cluster_id"), "n_scores", r6("baseline_score").alias("baseline_score"),
        r6("current_score").alias("current_score"), r6("delta").alias("delta"), "alert_triggered",
    )


class Picky:
    """Hashed words, of texts without a mark; any other fails the whole call."""

    def __init__(self, dim: int, mark: str) -> None:
        self.dim, self.mark = dim, mark

    def kernel(self):
        make, mark = HashedWords(self.dim).kernel(), self.mark

        def picky():
            encode = make()

            def checked(texts: list[str]):
                if any(mark in t for t in texts):
                    raise ValueError("unreadable text")
                return encode(texts)

            return checked

        return picky


def poison_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All documents through an embedder that fails on some: only those are set aside, in one job."""
    docs = src.table(spark, folder, "documents").select(
        "doc_id", F.lit("question").alias("request_text"), F.col("text").alias("response_text")
    )
    tried = try_pairs(docs, Picky(PARAMS.embedding_dim, "###"), PARAMS.embedding_dim)
    return tried.select(
        "doc_id", "error", F.size("response_embedding").alias("dims"),
        r6(vf.norm(vf.doubles(F.col("response_embedding")))).alias("length"),
    )


def state_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters by label, added up from batches that commit in any order around a new base.

    The first batch is in the base; the second is open while the base is made
    and commits after it; the third comes later.
    """
    rows = src.vectors(spark, folder).withColumnRenamed("label", "cluster_id")
    store = StateStore(spark, f"{_work_dir(spark, 'deltas')}/state")
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp")

    def add(epoch, number: int) -> None:
        part = vf.group_features(rows.where(F.col("vec_id") % 3 == number), ["cluster_id"], "embedding")
        epoch.write("cluster_deltas", part.withColumns({"created_at": now, "updated_at": now}))

    store.publish("first", lambda epoch: add(epoch, 0))
    base, open_ = store.open("base"), store.open("second")
    add(open_, 1)
    open_.commit()
    base.write("clusters", store.at(base.base).snapshot("clusters"))
    base.commit()
    store.publish("third", lambda epoch: add(epoch, 2))
    return metrics.cluster_report(store.snapshot("clusters")).select(
        "cluster_id", "n", r6("radius").alias("radius")
    )


def _looked_up(spark: SparkSession, folder: str) -> StateStore:
    """Events as responses, logged and assigned in parts, before and after the bases of look-ups were made."""
    responses, done = _recovery(spark, folder)
    store = StateStore(spark, f"{_work_dir(spark, 'lookups')}/state")

    def add(table: str, rows: DataFrame, number: int) -> None:
        part = rows.where(F.col("response_id") % 3 == number)
        lacking = {n: F.lit(None) for n, _ in store.fields(table) if n not in part.columns}
        store.publish("fill", lambda epoch: epoch.write(table, part.withColumns(lacking)))

    add("responses", responses, 0)
    add("assignments", done, 1)  # these are logged later
    jobs.compact_lookups(store, bucket_rows=200)
    add("responses", responses, 1)
    add("assignments", done, 0)
    jobs.compact_lookups(store, bucket_rows=200)
    add("responses", responses, 2)
    add("assignments", done, 2)
    return store


def recovery_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """What waits to be clustered, from the bases and what came since."""
    waiting = lookups.waiting(_looked_up(spark, folder)).where("created_at < TIMESTAMP '2024-01-25'")
    return waiting.select(
        F.col("response_id").cast("bigint").alias("response_id"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def known_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each response is assigned and flagged, by its id."""
    store = _looked_up(spark, folder)
    ids = src.table(spark, folder, "events").select(F.col("event_id").cast("string").alias("response_id"))
    for kind in ("assigned", "flagged"):
        found = lookups.known(store, kind, ids).withColumn(kind, F.lit(True))
        ids = ids.join(found, "response_id", "left").withColumn(kind, F.coalesce(kind, F.lit(False)))
    return ids


STATEFUL = [
    recovery_compacted, known_ids,
    state_deltas, poison_rows, drift_detect_merged, stream_transcripts,
    split_job_clusters, split_job_responses, split_job_goldens, manual_goldens, cleared_goldens,
    golden_embeddings, golden_counts, response_lookup, cluster_ids,
    interleaved_jobs,
    grow_clusters, grow_membership, assign_batch, assign_goldens, latest_assignment, alert_outbox,
    stream_drift, stream_cluster, stream_cluster_coverage,
]
