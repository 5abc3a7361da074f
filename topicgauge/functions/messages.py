"""Alert payload, texts and signature."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Text formats of an alert.
SUMMARY = "Drift detected in %s: %.1f%% drop (baseline %.3f → current %.3f)"
TELEGRAM = (
    "*%s*\n\n%s\n\nBaseline: `%.4f`\nCurrent:  `%.4f`\n"
    "Drop:     `%.1f%%` (threshold: %.1f%%)\nTime:     `%s`"
)


def alert_payload(events: DataFrame, threshold: float) -> DataFrame:
    """Event rows as alert payloads; percentages carry one decimal.

    Ties round half to even (`bround`); Python rounds the binary value, so
    the two differ only where the decimal value sits exactly on a tie.
    """
    return events.select(
        "event_id",
        "detected_at",
        "cluster_id",
        "baseline_score",
        F.col("similarity_score").alias("current_score"),
        F.bround(F.col("delta") * 100, 1).alias("delta_percent"),
        F.bround(F.lit(float(threshold)) * 100, 1).alias("threshold_percent"),
        "alert_channel",
    ).withColumn("summary", summary_text())


def summary_text() -> Column:
    where = F.when(F.col("cluster_id").isNull(), F.lit("unknown cluster")).otherwise(
        F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"))
    )
    return F.format_string(
        SUMMARY,
        where,
        F.col("delta_percent"),
        F.col("baseline_score"),
        F.col("current_score"),
    )


def iso_time(ts: Column, offset: str) -> Column:
    """ISO text of a UTC timestamp; the fraction appears only when non-zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole,
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit(offset),
    )


def telegram_text(title: str) -> Column:
    return F.format_string(
        TELEGRAM,
        F.lit(title),
        F.col("summary"),
        F.col("baseline_score"),
        F.col("current_score"),
        F.col("delta_percent"),
        F.col("threshold_percent"),
        iso_time(F.col("detected_at"), "+00:00"),
    )


def webhook_body() -> Column:
    """The payload as compact JSON, nulls kept."""
    return F.to_json(
        F.struct(
            iso_time(F.col("detected_at"), "Z").alias("detected_at"),
            "cluster_id",
            "baseline_score",
            "current_score",
            "delta_percent",
            "threshold_percent",
            "alert_channel",
            "summary",
        ),
        {"ignoreNullFields": "false"},
    )


def signature(secret: str, body: Column) -> Column:
    """HMAC-SHA256 hex of `body`. The secret lives in the function's closure,
    never in the plan or its logs."""
    key = secret.encode()

    @F.arrow_udf("string")
    def sign(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest()
                for t in texts.to_pylist()
            ],
            type=pa.string(),
        )

    return sign(body)
