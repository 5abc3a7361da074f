"""Captured calls → validated response rows and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions import payloads
from topicgauge.params import PROVIDERS, ROLES


def normalize_calls(calls: DataFrame) -> DataFrame:
    """Raw calls → one wide row each, with a reject_reason (NULL = good).

    `calls`: request_id, model, stream, messages_json, payload, started_at,
    finished_at, created_at, and optionally endpoint (`messages` is always
    Anthropic's, whatever the model is called). No shuffle; the response id is a
    hash of the request id, so a retried task writes the same id. Requests whose
    messages have an unknown role or no content are rejected.
    """
    u = F.col("u")
    endpoint = F.col("endpoint") if "endpoint" in calls.columns else None
    asked = F.try_variant_get(
        F.try_parse_json("messages_json"), "$", "array<struct<role:string,content:variant>>"
    )
    return (
        calls.withColumn("_payload", F.try_parse_json("payload"))
        .withColumn("u", payloads.uniform_response(F.col("_payload"), F.col("model"), endpoint))
        .withColumn("_asked", asked)
        .select(
            response_id(F.col("request_id")).alias("response_id"),
            "request_id",
            payloads.prompt_hash_json(F.col("messages_json")).alias("prompt_hash"),
            u["model"].alias("model"),
            u["provider"].alias("provider"),
            "stream",
            u["prompt_tokens"].alias("prompt_tokens"),
            u["completion_tokens"].alias("completion_tokens"),
            payloads.latency_ms(F.col("started_at"), F.col("finished_at")).alias("latency_ms"),
            u["finish_reason"].alias("finish_reason"),
            u["content"].alias("raw_content"),
            empty_to_null(payloads.request_text(F.col("messages_json"))).alias("request_text"),
            "created_at",
            F.coalesce(u["reject_reason"], validate_messages(F.col("_asked"))).alias("reject_reason"),
        )
    )


def response_id(request_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("response|"), request_id), 256).substr(1, 32)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def validate_messages(messages: Column) -> Column:
    """Reject reason of an array of role/content structs, else NULL."""
    bad_role = F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    bad_content = F.exists(messages, lambda m: m["content"].isNull())
    return (
        F.when(messages.isNull(), F.lit("messages"))
        .when(bad_role, F.lit("role"))
        .when(bad_content, F.lit("content"))
    )


def validate_responses(rows: DataFrame) -> DataFrame:
    """Adds reject_reason for logged rows: required fields, counts, provider."""

    def fails(*conditions: Column) -> Column:
        passes = F.lit(True)
        for c in conditions:
            passes = passes & F.coalesce(c, F.lit(False))
        return ~passes

    reason = F.lit(None).cast("string")
    required = ("request_id", "prompt_hash", "model", "finish_reason", "raw_content")
    checks = [(name, fails(F.col(name).isNotNull())) for name in required if name in rows.columns]
    checks += [
        (name, fails(F.col(name).isNotNull()))
        for name in ("prompt_tokens", "completion_tokens", "latency_ms")
        if name in rows.columns
    ]
    if "provider" in rows.columns:
        checks.append(("provider", fails(F.col("provider").isin(*PROVIDERS))))
    for name, failed in reversed(checks):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    existing = F.col("reject_reason") if "reject_reason" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("reject_reason", F.coalesce(existing, reason))


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) by reject_reason."""
    good = rows.where(F.col("reject_reason").isNull()).drop("reject_reason")
    dead = rows.where(F.col("reject_reason").isNotNull()).select(
        "response_id", F.lit(1).alias("attempts"), F.col("reject_reason").alias("error")
    )
    return good, dead
