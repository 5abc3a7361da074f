"""Alerts as an outbox: events and deliveries are separate facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions import messages
from topicgauge.params import Params


def pending(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Events no delivery has reached yet."""
    sent = deliveries.where("sent").select("event_id")
    return events.join(sent, "event_id", "left_anti")


def event_status(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Events with alert_sent, true once any delivery succeeded."""
    sent = deliveries.groupBy("event_id").agg(F.max("sent").alias("was_sent"))
    return (
        events.join(sent, "event_id", "left")
        .withColumn("alert_sent", F.coalesce("was_sent", F.lit(False)))
        .drop("was_sent")
    )


def outgoing(events: DataFrame, params: Params) -> DataFrame:
    """(event_id, channel, body, signature) of the events, ready to send."""
    payload = messages.alert_payload(events, params.drift_threshold)
    if params.notification_channel == "telegram":
        body, sign = messages.telegram_text(params.alert_title), F.lit(None).cast("string")
    elif params.notification_channel == "webhook":
        body = messages.webhook_body()
        sign = messages.signature(params.webhook_secret, F.col("body"))
    else:
        return payload.limit(0).select(
            "event_id", F.col("alert_channel").alias("channel"), F.col("summary").alias("body"),
            F.lit(None).cast("string").alias("signature"),
        )
    return payload.withColumn("body", body).select(
        "event_id", F.col("alert_channel").alias("channel"), "body", sign.alias("signature")
    )


def deliver(rows: DataFrame, send: Callable[[dict], None], now: Column) -> DataFrame:
    """Call the user's `send` for every row, inside the tasks.

    Sending is at least once (a lost task sends again), so receivers should
    tell repeats apart by event_id. A failing send is recorded, not raised.
    """

    def attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent = []
            for row in batch.to_pylist():
                try:
                    send(row)
                    sent.append(True)
                except Exception:  # noqa: BLE001 - any failure means "not sent"
                    sent.append(False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("event_id"), pa.array(sent, type=pa.bool_()), batch.column("channel")],
                ["event_id", "sent", "channel"],
            )

    return rows.mapInArrow(attempt, "event_id string, sent boolean, channel string").withColumn(
        "attempted_at", now
    )
