"""Detection, alert texts, signature, sampling and metrics."""

import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from topicgauge.functions import messages
from topicgauge.operators import drift, evaluate, metrics, recover, sampling
from topicgauge.params import Params
from topicgauge.sources import outbox

T0 = datetime(2024, 1, 1)
SCORE = "cluster_id string, response_id string, created_at timestamp, quality_score double"


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """This module runs the plans as they ship, with whole-stage code."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def scores(spark, **clusters):
    rows = [
        (c, f"{c}{i:05d}", T0 + timedelta(minutes=i), s) for c, xs in clusters.items() for i, s in enumerate(xs)
    ]
    return spark.createDataFrame(rows, SCORE).repartition(5)


def detected(spark, threshold=0.15, **clusters):
    return {r["cluster_id"]: r for r in drift.detect(scores(spark, **clusters), threshold).collect()}


def test_halves_window_and_minimum(spark):
    got = detected(
        spark,
        nine=[1.0] * 9,
        ten=[0.8] * 5 + [0.4] * 5,
        odd=[1.0] * 5 + [0.5] * 6,          # the middle score is in the newer half
        long=[0.0] * 70 + [1.0] * 25 + [0.9] * 25,
        nulls=[None] * 20 + [0.5] * 9,
        zero=[0.0] * 12,
        at=[1.0] * 5 + [0.75] * 5,
    )
    assert set(got) == {"ten", "odd", "long", "zero", "at"}
    assert got["ten"]["delta"] == pytest.approx(0.5) and got["ten"]["alert_triggered"]
    assert (got["odd"]["baseline_score"], got["odd"]["current_score"]) == (1.0, 0.5)
    assert got["long"]["n_scores"] == 50 and got["long"]["baseline_score"] == 1.0
    assert got["long"]["current_score"] == pytest.approx(0.9)
    assert got["zero"]["delta"] == 0 and not got["zero"]["alert_triggered"]
    exact = detected(spark, threshold=0.25, at=[1.0] * 5 + [0.75] * 5)
    assert not exact["at"]["alert_triggered"]


def test_one_cluster_with_most_scores(spark):
    n = 20000
    big = scores(spark, hot=[0.9] * n, cold=[0.5] * 12)
    got = {r["cluster_id"]: r["n_scores"] for r in drift.detect(big, 0.1).collect()}
    assert got == {"hot": 50, "cold": 12}


def test_rank_is_bounded_before_the_shuffle(spark):
    plan = drift.detect(scores(spark, a=[1.0] * 3), 0.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_coverage(spark):
    rows = drift.coverage(scores(spark, a=[1.0] * 10, b=[1.0] * 3, c=[None] * 30)).collect()
    assert {(r["covered"], r["clusters"], r["scores"]) for r in rows} == {(True, 1, 10), (False, 1, 3)}


def events(spark, cluster="c-1"):
    found = drift.detect(scores(spark, **{cluster: [0.8] * 5 + [0.6] * 5}), 0.15)
    return drift.drift_events(found, F.lit("2024-02-01 10:00:00.5").cast("timestamp"), "webhook")


def test_events_are_stable_and_texts_match_python(spark):
    first, again = events(spark).first(), events(spark).first()
    assert first["event_id"] == again["event_id"] and first["similarity_score"] == pytest.approx(0.6)
    payload = messages.alert_payload(events(spark), 0.15)
    row = payload.select(
        "*", messages.telegram_text("T").alias("text"), messages.webhook_body().alias("body")
    ).withColumn("signature", messages.signature("key", F.col("body"))).first()
    assert row["summary"] == (
        f"Drift detected in cluster c-1: {25.0:.1f}% drop (baseline {0.8:.3f} → current {0.6:.3f})")
    assert row["text"].endswith("Drop:     `25.0%` (threshold: 15.0%)\nTime:     `2024-02-01T10:00:00.500000+00:00`")
    body = json.loads(row["body"])
    assert list(body) == ["detected_at", "cluster_id", "baseline_score", "current_score", "delta_percent",
                          "threshold_percent", "alert_channel", "summary"]
    assert body["detected_at"] == "2024-02-01T10:00:00.500000Z"
    assert row["signature"] == hmac.new(b"key", row["body"].encode(), hashlib.sha256).hexdigest()
    unknown = payload.withColumn("cluster_id", F.lit(None).cast("string")).withColumn("summary", messages.summary_text())
    assert unknown.first()["summary"].startswith("Drift detected in unknown cluster:")
    assert json.loads(unknown.select(messages.webhook_body()).first()[0])["cluster_id"] is None


def test_secret_is_not_in_the_plan(spark):
    signed = messages.alert_payload(events(spark), 0.15).select(
        messages.signature("very-secret", F.col("summary")).alias("s"))
    assert "very-secret" not in signed._jdf.queryExecution().toString()


def test_outbox(spark):
    params = Params(notification_channel="webhook", webhook_url="u", webhook_secret="s")
    both = events(spark, "good").unionByName(events(spark, "bad"))

    def send(row):
        if '"bad"' in row["body"]:
            raise OSError("down")

    tried = outbox.deliver(outbox.outgoing(both, params), send, F.lit(T0))
    tried = spark.createDataFrame(tried.collect(), tried.schema)
    status = {r["cluster_id"]: r["alert_sent"] for r in outbox.event_status(both, tried).collect()}
    assert status == {"good": True, "bad": False}
    assert [r["cluster_id"] for r in outbox.pending(both, tried).collect()] == ["bad"]
    assert outbox.outgoing(both, Params()).count() == 0
    assert [r["alerts"] for r in metrics.delivered_alerts(tried).collect()] == [1]


@pytest.mark.parametrize("partitions,start", [(1, 0), (6, 0), (3, 17)])
def test_every_nth_is_a_global_row_number(spark, partitions, start):
    rows = spark.range(257).select(
        F.col("id"), (F.lit(T0) + F.make_interval(secs=(F.col("id") * 37 % 101))).alias("t")).repartition(7)
    local = sorted(((r["t"], r["id"]) for r in rows.collect()))
    want = {i: n + 1 + start for n, (_, i) in enumerate(local)}
    got = sampling.arrival_positions(rows, ["t", "id"], start, partitions)
    assert {r["id"]: r["position"] for r in got.collect()} == want
    hit = sampling.every_nth(rows, ["t", "id"], 10, start).where("sampled").collect()
    assert {r["id"] for r in hit} == {i for i, p in want.items() if p % 10 == 0}


def members(spark, rows):
    return spark.createDataFrame(rows, "response_id string, cluster_id string, response_embedding array<float>")


def test_scores_reject_negatives_and_skip_clusters_without_goldens(spark):
    gold = spark.createDataFrame(
        [("g1", "a", [1.0, 0.0]), ("g2", "a", [0.0, 2.0]), ("g3", "b", [-1.0, 0.0]), ("g4", "z", [0.0, 0.0]), ("g5", None, [1.0, 0.0])],
        "golden_id string, cluster_id string, expected_embedding array<float>")
    rows = members(spark, [("r1", "a", [3.0, 0.0]), ("r2", "b", [1.0, 0.0]), ("r3", "none", [1.0, 0.0]),
                           ("r4", None, [1.0, 0.0]), ("r5", "z", [1.0, 0.0]), ("r6", "a", [0.0, 0.0]), ("r7", "b", [-1.0, 0.0])])
    got = {r["response_id"]: (r["quality_score"], r["reject_reason"])
           for r in evaluate.evaluate(rows, gold, Params(embedding_dim=2)).collect()}
    assert got == {"r1": (pytest.approx(0.5), None), "r2": (None, "out_of_range"), "r5": (0.0, None),
                   "r6": (0.0, None), "r7": (pytest.approx(1.0), None)}


def test_overshoot_is_cut(spark):
    df = spark.createDataFrame([(1.0 + 5e-7,), (1.1,), (0.0,), (-1e-9,)], "m double").coalesce(1)
    assert [r[0] for r in df.select(evaluate.stored_score(F.col("m"))).collect()] == [1.0, None, 0.0, None]


def test_params_keep_their_bounds():
    for bad in ({"drift_threshold": 1.0}, {"sampling_rate": 0}, {"ann_candidates": 101}, {"max_batch": 33},
                {"detection_interval_s": 59}, {"golden_set_mode": "x"}, {"notification_channel": "telegram"},
                {"notification_channel": "webhook"}, {"recovery_min_age_s": 29}, {"max_wait_ms": 9}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert "s3cret" not in repr(Params(webhook_secret="s3cret"))
