"""The jobs over the state store, and the streams, end to end."""

import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicgauge.functions.embedding import HashedWords, ModelEmbedder, try_in_halves
from topicgauge.functions.vectors import group_features
from topicgauge.operators import drift
from topicgauge.params import Params
from topicgauge.plans import jobs
from topicgauge.schemas import STREAM_ENTRY, TABLES
from topicgauge.sources.state import StateMoved, StateStore
from topicgauge.streaming import cluster_stream, drift_stream

T0 = datetime(2024, 1, 1)
DIM = 32
P = Params(embedding_dim=DIM, birch_threshold=0.5, sampling_rate=2, golden_set_warmup=4)
EMBED = HashedWords(DIM)


def calls(spark, n, start=0):
    topics = ["red apple pie recipe", "fast train ticket price", "old stone castle tour"]
    rows = []
    for i in range(start, start + n):
        content = None if i % 11 == 10 else f"{topics[i % 3]} answer"
        rows.append((
            f"req{i:04d}", "gpt-4o", False,
            json.dumps([{"role": "user", "content": topics[i % 3]}]),
            json.dumps({"model": "gpt-4o", "choices": [{"message": {"content": content}, "finish_reason": "stop"}]}),
            T0, T0 + timedelta(milliseconds=12), T0 + timedelta(seconds=i),
        ))
    return spark.createDataFrame(
        rows, "request_id string, model string, stream boolean, messages_json string, payload string, "
        "started_at timestamp, finished_at timestamp, created_at timestamp")


def entries(store):
    return store.log("responses").select(
        "response_id", "request_text", F.col("raw_content").alias("response_text"), "created_at")


def check_invariants(store, cap):
    members = store.members()
    actual = {r["cluster_id"]: r for r in group_features(members, ["cluster_id"], "request_embedding").collect()}
    snapshot = store.snapshot("clusters").collect()
    assert {c["cluster_id"] for c in snapshot} == set(actual)
    for c in snapshot:
        assert c["n"] == actual[c["cluster_id"]]["n"]
        np.testing.assert_allclose(c["ls"], actual[c["cluster_id"]]["ls"], atol=1e-5)
    sizes = store.snapshot("goldens").groupBy("cluster_id").count().collect()
    assert all(s["count"] <= cap for s in sizes)


def test_log_cluster_detect_alert_split(spark, root):
    store = StateStore(spark, root)
    assert store.last_epoch() == -1 and store.snapshot("clusters").count() == 0
    jobs.log_calls(store, calls(spark, 44), P, batch_id=0)
    jobs.log_calls(store, calls(spark, 44), P, batch_id=0)      # a replay changes nothing
    jobs.log_calls(store, calls(spark, 22, start=44), P, batch_id=1)
    responses = store.log("responses")
    assert responses.count() == 60 and store.log("dead_letter").count() == 6
    by_time = [r["sampled"] for r in responses.orderBy("created_at", "response_id").collect()]
    assert [i for i, s in enumerate(by_time) if s] == list(range(1, 60, 2))
    some = responses.first()
    assert store.response(some["response_id"])["latency_ms"] == 12
    with pytest.raises(LookupError):
        store.response("nobody")

    jobs.cluster_batch(store, entries(store), EMBED, P, T0)
    jobs.cluster_batch(store, entries(store), EMBED, P, T0)      # all known by now
    assert store.log("assignments").count() == 60 and store.cluster_ids().count() == 3
    check_invariants(store, P.golden_set_warmup)
    assert store.log("scores").count() == 30
    assert store.log("scores").where("quality_score IS NULL").count() == 0

    jobs.evaluate_pending(store, EMBED, P)
    assert store.log("scores").count() == 30
    jobs.detect_drift(store, replace(P, drift_threshold=0.9), T0)
    assert store.log("drift_events").count() == 0

    sent = jobs.split_wide_clusters(store, replace(P, birch_threshold=0.01), T0)
    assert sent == 0                                              # identical points have no radius


def test_split_moves_responses_goldens_and_clusters_together(spark, root):
    store = StateStore(spark, root)
    jobs.log_calls(store, calls(spark, 30), P)
    loose = replace(P, birch_threshold=0.99)
    jobs.cluster_batch(store, entries(store), EMBED, loose, T0)
    assert store.cluster_ids().count() == 1
    before = store.last_epoch()
    assert jobs.split_wide_clusters(store, P, T0) == 1
    assert store.last_epoch() == before + 1 and store.cluster_ids().count() == 2
    check_invariants(store, P.golden_set_warmup)
    now = {r["cluster_id"] for r in store.current_assignments().collect()}
    assert {g["cluster_id"] for g in store.snapshot("goldens").collect()} <= now
    assert now == {c["cluster_id"] for c in store.cluster_ids().collect()}
    assert jobs.split_wide_clusters(store, P, T0) == 1
    check_invariants(store, P.golden_set_warmup)
    assert jobs.split_wide_clusters(store, P, T0) == 0


def test_uncommitted_epochs_stay_invisible(spark, root):
    store = StateStore(spark, root, "orc")
    jobs.log_calls(store, calls(spark, 9), P)
    open_epoch = store.open("broken")
    open_epoch.write("responses", store.log("responses").drop("epoch"))
    assert store.log("responses").count() == 9
    jobs.log_calls(store, calls(spark, 3, start=9), P)
    assert store.log("responses").count() == 11 and store.last_epoch() == 2   # one of the three is null; 1 stays unused


def test_recovery_takes_the_old_and_skips_the_textless(spark, root):
    store = StateStore(spark, root)
    rows = calls(spark, 9)
    silent = rows.where("request_id = 'req0003'").withColumn("messages_json", F.lit("[]"))
    jobs.log_calls(store, rows.where("request_id <> 'req0003'").unionByName(silent), P)
    now = T0 + timedelta(seconds=305)                              # five seconds' worth are old enough
    assert jobs.recover_unclustered(store, EMBED, P, now) == 4
    assert [r["error"] for r in store.log("dead_letter").collect()] == ["no_request_text"]
    assert jobs.recover_unclustered(store, EMBED, P, now) == 0
    assert jobs.recover_unclustered(store, EMBED, P, now + timedelta(seconds=60), limit=2) == 2
    assert jobs.recover_unclustered(store, EMBED, P, now + timedelta(seconds=60), limit=None) == 2
    check_invariants(store, P.golden_set_warmup)


def test_manual_goldens_find_a_cluster_and_can_be_cleared(spark, root):
    store = StateStore(spark, root)
    given = spark.createDataFrame([("red apple pie recipe", "pie"), ("old stone castle tour", "castle")],
                                  "response_text string, description string")
    assert jobs.add_goldens(store, given.limit(1), EMBED, P, T0) == 1
    assert store.snapshot("goldens").first()["cluster_id"] is None
    jobs.log_calls(store, calls(spark, 9), P)
    jobs.cluster_batch(store, entries(store), EMBED, replace(P, golden_set_mode="manual"), T0)
    assert store.log("scores").count() == 0
    assert jobs.add_goldens(store, given.where("description = 'castle'"), EMBED, P, T0) == 2
    assert store.snapshot("goldens").where("cluster_id IS NULL").count() == 0
    jobs.evaluate_pending(store, EMBED, P)
    assert store.log("scores").count() > 0
    assert jobs.clear_goldens(store) == 2 and store.snapshot("goldens").count() == 0


def test_alert_run(spark, root):
    store = StateStore(spark, root)
    jobs.log_calls(store, calls(spark, 60), P)
    jobs.cluster_batch(store, entries(store), EMBED, P, T0)
    epoch = store.open("scores")
    ranked = store.log("responses").select(
        "response_id", F.when(F.col("created_at") < F.lit(T0 + timedelta(seconds=30)), 0.9).otherwise(0.3).alias("quality_score"),
        F.lit(None).cast("string").alias("reject_reason"))
    jobs.write_scores(epoch, ranked, store.current_assignments())  # a later evaluation wins
    epoch.commit()
    assert store.current_scores().count() == store.log("responses").count()
    loud = replace(P, notification_channel="webhook", webhook_url="u", webhook_secret="s")
    jobs.detect_drift(store, loud, T0)
    assert store.log("drift_events").count() == 3
    jobs.send_alerts(store, lambda row: None, replace(P), T0)     # channel none sends nothing
    assert store.log("alert_deliveries").count() == 0
    jobs.send_alerts(store, lambda row: None, loud, T0)
    jobs.send_alerts(store, lambda row: None, loud, T0)
    assert store.log("alert_deliveries").where("sent").count() == 3


def test_detection_reads_no_old_scores(spark, root):
    """After a run the logs of scores and assignments are not looked at; a split finds older scores again."""
    store = StateStore(spark, root)
    jobs.log_calls(store, calls(spark, 150), replace(P, sampling_rate=1))
    jobs.cluster_batch(store, entries(store), EMBED, replace(P, birch_threshold=0.99), T0)

    def whole():
        scored = drift.with_current_cluster(
            store.current_scores().select("response_id", "quality_score"), store.current_assignments())
        return sorted(map(tuple, drift.detect(scored, 0.15).collect()))

    def merged():
        return sorted(map(tuple, drift.detect(store.snapshot("recent"), 0.15).collect()))

    assert jobs.detect_drift(store, P, T0) >= 0
    assert merged() == whole() and store.snapshot("recent").count() == 50
    hidden = root + "-hidden"
    for table in ("scores", "assignments", "recent_entries"):
        os.rename(f"{root}/{table}", f"{hidden}-{table}")
    jobs.detect_drift(store, P, T0)
    for table in ("scores", "assignments", "recent_entries"):
        os.rename(f"{hidden}-{table}", f"{root}/{table}")
    assert jobs.split_wide_clusters(store, P, T0) == 1
    assert len(merged()) == 2 and merged() == whole()
    assert store.snapshot("recent").count() > 50


class Failing:
    def column(self, text):
        @F.udf("array<float>")
        def broken(t):
            raise ValueError("model is down")

        return broken(text)


class Poisoned:
    def column(self, text):
        @F.udf("string")
        def checked(t):
            if t.startswith("poison"):
                raise ValueError("cannot read " + t)
            return t

        return EMBED.column(checked(text))


def test_stream_batches_and_poison(spark, root, tmp_path):
    store = StateStore(spark, root)
    jobs.log_calls(store, calls(spark, 33), P)
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    entries(store).where("response_text <> ''").repartition(3).write.parquet(source)

    def run(embedder):
        stream = cluster_stream.read_entries(spark, source, files_per_trigger=1)
        query = cluster_stream.start(stream, root, check, embedder, P, available_now=True)
        query.awaitTermination()

    run(EMBED)
    assert store.log("assignments").count() == 30
    assert store.commits().where("job = 'stream'").count() == 3
    check_invariants(store, P.golden_set_warmup)

    bad = F.when(F.col("response_id") < "8", F.concat(F.lit("poison "), "request_text")).otherwise(F.col("request_text"))
    late = entries(store).withColumn("request_text", bad).withColumn("response_id", F.concat(F.lit("x"), "response_id"))
    late.coalesce(1).write.mode("append").parquet(source)
    poisoned = late.where("request_text LIKE 'poison%'").count()
    assert 0 < poisoned < late.count()
    good = late.count() - poisoned
    for _ in range(P.max_delivery_attempts + 1):                   # an outage is no poison
        with pytest.raises(Exception):
            run(Failing())
    for _ in range(P.max_delivery_attempts):
        with pytest.raises(Exception):
            run(Poisoned())
    assert store.log("dead_letter").where("attempts = 3").count() == 0
    run(Poisoned())                                                # only bad rows are set aside
    dead = store.log("dead_letter").where("attempts = 3").collect()
    assert len(dead) == poisoned and all("cannot read" in r["error"] for r in dead)
    assert store.log("assignments").count() == 30 + good

    # A stream of its own counts its batches from 0 again; none is taken for done.
    again = entries(store).limit(2).withColumn("response_id", F.concat(F.lit("y"), "response_id"))
    again.coalesce(1).write.parquet(str(tmp_path / "in2"))
    stream = cluster_stream.read_entries(spark, str(tmp_path / "in2"))
    cluster_stream.start(stream, root, str(tmp_path / "check2"), EMBED, P, available_now=True).awaitTermination()
    assert store.log("assignments").count() == 30 + good + 2


class Kernel(Poisoned):
    """The same failing texts, by an embedder whose kernel can be tried row by row."""

    def kernel(self):
        def make():
            encode = EMBED.kernel()()

            def checked(texts):
                for t in texts:
                    if t.startswith("poison"):
                        raise ValueError("cannot read " + t)
                return encode(texts)

            return checked

        return make


def test_poison_rows_cost_one_job(spark, root, tmp_path):
    """A third of a batch is bad: found inside the tasks, whatever their number."""
    source = str(tmp_path / "in")
    rows = [(f"r{i:04d}", ("poison " if i % 3 == 0 else "") + f"text {i % 7}", "answer", T0) for i in range(900)]
    rows.append(("r0000", "text of a row sent again", "answer", T0))
    spark.createDataFrame(rows, STREAM_ENTRY).coalesce(1).write.parquet(source)
    runner = cluster_stream.BatchRunner(root, Kernel(), P)
    store = StateStore(spark, root)
    batch = spark.read.schema(STREAM_ENTRY).parquet(source)
    runner._note(spark, "", 0, P.max_delivery_attempts, "failed before")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sift", "sift")
    good, dead = runner._sifted(store, batch, P.max_delivery_attempts, T0)
    assert len(before.getJobIdsForGroup("sift")) <= 2
    assert (good.count(), dead.count()) == (601, 299)
    runner(batch, 0)
    letters = store.log("dead_letter").collect()
    assert len(letters) == 299 and all(r["attempts"] == 3 and "cannot read" in r["error"] for r in letters)
    assert store.log("assignments").count() == 601
    check_invariants(store, P.golden_set_warmup)


def test_halving_finds_every_bad_text_and_wrong_sizes():
    calls = []

    def encode(texts):
        calls.append(len(texts))
        if any(t == "bad" for t in texts):
            raise RuntimeError
        return np.ones((len(texts), 3 if "short" in texts else 2))

    texts = ["a"] * 40
    texts[7] = texts[8] = texts[31] = "bad"
    texts[20] = "short"
    vectors = np.zeros((40, 2), dtype=np.float32)
    errors = try_in_halves(encode, texts, vectors)
    assert [i for i, e in enumerate(errors) if e] == [7, 8, 20, 31] and errors[7] == "RuntimeError"
    assert (vectors.sum(1) == 2).sum() == 36 and len(calls) < 50
    assert try_in_halves(encode, [], np.zeros((0, 2))) == []


def test_open_epochs_of_two_jobs_both_stay(spark, root):
    store = StateStore(spark, root)
    first, second = store.open("a"), store.open("b")
    assert first.number != second.number
    row = spark.createDataFrame([("r", 0.5, None)], "response_id string, quality_score double, reject_reason string")
    for epoch in (second, first):
        epoch.write("scores", row)
        epoch.commit()
    assert store.log("scores").count() == 2
    clusters = spark.createDataFrame([], TABLES["clusters"])
    early, late = store.open("a"), store.open("b")
    late.write("clusters", clusters)
    late.commit()
    early.write("clusters", clusters)
    with pytest.raises(StateMoved):
        early.commit()
    tries = []
    store.publish("a", lambda epoch: tries.append(epoch.number) or epoch.write("clusters", clusters))
    assert len(tries) == 1 and store.version() == 3


def test_a_job_killed_while_committing_leaves_no_trace(spark, root, monkeypatch):
    store = StateStore(spark, root)
    clusters = spark.createDataFrame([], TABLES["clusters"])
    broken = store.open("killed")
    broken.write("clusters", clusters)

    def killed(*_):
        raise KeyboardInterrupt

    for step in ("_fill", "_name"):                                # before and after the text is written
        with monkeypatch.context() as patch:
            patch.setattr(StateStore, step, killed)
            with pytest.raises(KeyboardInterrupt):
                broken.commit()
        assert store.version() == -1 and store.last_epoch() == -1
    (Path(root) / "commits" / f"{0:020d}.json").write_text("")     # a name that another tool has spoilt
    tries = []
    store.publish("after", lambda epoch: tries.append(epoch.number) or epoch.write("clusters", clusters))
    assert len(tries) == 1 and store.version() == 1 and store.commits().count() == 1


def test_names_are_given_once(spark, root):
    store = StateStore(spark, root)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: store.create("numbers/0", str(i)), range(16)))
    assert won.count(True) == 1
    assert [p.name for p in (Path(root) / "numbers").iterdir() if not p.name.endswith(".crc")] == ["0"]
    assert (Path(root) / "numbers" / "0").read_text() == str(won.index(True))


def test_batches_and_a_split_side_by_side_repeat_no_work(spark, root):
    """Two batches, a split and a compaction, open at once: all commit, nothing is lost or counted twice."""
    store = StateStore(spark, root)
    jobs.log_calls(store, calls(spark, 48), P)
    loose = replace(P, birch_threshold=0.99)
    rows = entries(store).where("response_text <> ''").orderBy("created_at").collect()
    part = lambda n: spark.createDataFrame([r for i, r in enumerate(rows) if i % 4 == n], STREAM_ENTRY)
    jobs.cluster_batch(store, part(0), EMBED, loose, T0)
    done = []

    def others_commit(epoch):
        done.append(epoch.number)
        jobs.cluster_batch(store, part(1), EMBED, loose, T0)
        assert jobs.split_wide_clusters(store, P, T0) == 1
        jobs._write_batch(epoch, store, part(2), EMBED, loose, T0)
        jobs.compact_state(store)

    store.publish("slow", others_commit)
    assert len(done) == 1                                          # embedded once
    jobs.cluster_batch(store, part(3), EMBED, loose, T0)
    check_invariants(store, 3 * P.golden_set_warmup)
    jobs.compact_state(store)
    check_invariants(store, 3 * P.golden_set_warmup)
    assert store.log("assignments").count() == len(rows)


def test_a_batch_writes_what_it_adds(spark, root):
    """Bytes a batch writes do not grow with the clusters and goldens there are."""
    store = StateStore(spark, root)
    rng = np.random.RandomState(0)

    def batch(start, count):
        rows = [(f"r{i}", " ".join(f"w{x}" for x in rng.randint(0, 10**6, 6)), "text", T0) for i in range(start, start + count)]
        jobs.cluster_batch(store, spark.createDataFrame(rows, STREAM_ENTRY), EMBED, replace(P, birch_threshold=0.1), T0)
        epoch = store.last_epoch()
        return sum(f.stat().st_size for f in Path(root).glob(f"*/epoch={epoch}/*.parquet"))

    first = batch(0, 8)
    batch(100, 600)
    assert store.cluster_ids().count() > 500
    assert batch(1000, 8) < 2 * first


def test_a_moved_state_is_worked_on_again(spark, root):
    store = StateStore(spark, root)
    jobs.log_calls(store, calls(spark, 12), P)
    rows = entries(store).where("response_text <> ''").collect()
    part = lambda n: spark.createDataFrame([r for i, r in enumerate(rows) if i % 2 == n], STREAM_ENTRY)
    inner = []

    def embeds_late(epoch):
        if not inner:                                              # another job commits meanwhile
            inner.append(1)
            jobs.cluster_batch(store, part(1), EMBED, P, T0)
        jobs._write_batch(epoch, store, part(0), EMBED, P, T0)

    store.publish("slow", embeds_late)
    assert store.log("assignments").count() == len(rows)
    check_invariants(store, P.golden_set_warmup)


def test_rolling_drift_over_many_batches_with_late_rows(spark, tmp_path):
    rng = np.random.RandomState(0)
    rows = [("hot" if i % 3 else f"c{i % 5}", f"r{i:05d}", T0 + timedelta(seconds=int(rng.randint(0, 10**6))),
             None if i % 50 == 0 else float(rng.rand())) for i in range(600)]
    df = spark.createDataFrame(rows, "cluster_id string, response_id string, created_at timestamp, quality_score double")
    source = str(tmp_path / "scores")
    df.repartition(4).write.parquet(source)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        drift_stream.rolling_drift(stream, 0.05).writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.parquet(f"{out}/epoch={n}"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    updates = spark.read.parquet(out)
    assert updates.select("epoch").distinct().count() == 4
    last = {}
    for r in updates.orderBy("epoch").collect():
        last[r["cluster_id"]] = r
    want = {r["cluster_id"]: r for r in drift.detect(df, 0.05).collect()}
    assert set(last) == set(want)
    for c, w in want.items():
        assert last[c]["n_scores"] == w["n_scores"] and last[c]["alert_triggered"] == w["alert_triggered"]
        assert last[c]["delta"] == pytest.approx(w["delta"])


def test_model_embedder_sees_whole_texts_once(spark):
    def load():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=float)

    long = "a" * 100_000
    df = spark.createDataFrame([(long,), ("ab",), (None,)], "t string").coalesce(1)
    got = [r[0] for r in df.select(ModelEmbedder(load, batch=2).column(F.col("t"))).collect()]
    assert got == [[100000.0, 100000.0], [2.0, 1.0], [0.0, 0.0]]


def test_hashed_words_match_plain_python(spark):
    import hashlib

    def plain(text):
        v = np.zeros(DIM)
        for w in text.lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % DIM] += 1 if (h // DIM) % 2 == 0 else -1
        length = np.linalg.norm(v)
        return v / length if length else v

    texts = ["Red apple  pie\n", "É漢 tab\tend " * 5000, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for row, t in zip(df.select(EMBED.column(F.col("t"))).collect(), texts):
        np.testing.assert_allclose(row[0], plain(t), atol=1e-6)


def test_entries_from_queue_messages(spark):
    good = json.dumps({"response_id": "a", "request_text": "q", "response_text": "r", "created_at": "2024-01-01T00:00:00Z"})
    df = spark.createDataFrame([(bytearray(good.encode()),), (bytearray(b"junk"),)], "value binary")
    got = cluster_stream.parse_entries(df).collect()
    assert [(r["request_text"], r["unreadable"]) for r in got] == [("q", None), (None, "junk")]
    short = json.dumps({"response_id": "b", "request_text": "q", "response_text": "r"})
    df = spark.createDataFrame([(short, T0)], "value string, timestamp timestamp")
    assert cluster_stream.parse_entries(df).first()["created_at"] == T0


def test_vectors_of_the_wrong_size_fail_the_batch(spark, root):
    store = StateStore(spark, root)
    jobs.log_calls(store, calls(spark, 2), P)
    with pytest.raises(Exception, match="embedding of size"):
        jobs.cluster_batch(store, entries(store), HashedWords(DIM + 1), P, T0)
    assert store.log("assignments").count() == 0


def test_centroid_backfill(spark):
    from topicgauge.operators.assign import backfill_centroids

    df = spark.createDataFrame([(2, [2.0, 4.0], None), (0, [0.0, 0.0], None)],
                               "n bigint, ls array<double>, centroid array<double>").coalesce(1)
    assert [r["centroid"] for r in backfill_centroids(df).collect()] == [[1.0, 2.0], None]
