"""Responses that never reached a cluster, and those that cannot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unclustered(
    responses: DataFrame, assignments: DataFrame, cutoff: Column, dead: DataFrame | None = None
) -> DataFrame:
    """Responses created before `cutoff` with no assignment (nor dead letter)."""
    waiting = responses.where(F.col("created_at") < cutoff).join(
        assignments.select("response_id"), "response_id", "left_anti"
    )
    if dead is not None:
        waiting = waiting.join(dead.select("response_id"), "response_id", "left_anti")
    return waiting


def oldest(waiting: DataFrame, limit: int | None = None) -> DataFrame:
    """All waiting rows, or only the oldest `limit` of them if the caller asks for that."""
    if limit is None:
        return waiting
    return waiting.orderBy("created_at", "response_id").limit(limit)


def split_recoverable(waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream entries to cluster, rows without request text to mark as done)."""
    has_text = F.coalesce(F.length("request_text") > 0, F.lit(False))
    entries = waiting.where(has_text).select(
        "response_id", "request_text", F.col("raw_content").alias("response_text"), "created_at"
    )
    skipped = waiting.where(~has_text).select(
        "response_id", F.lit(0).alias("attempts"), F.lit("no_request_text").alias("error")
    )
    return entries, skipped
