"""Provider payloads, chat messages and headers as Column expressions.

Payloads are read as VARIANT: only that keeps "key missing" (a default
applies) apart from "explicit null" (the row is rejected).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,text:string>>"


def _kind(v: Column, path: str) -> Column:
    """Variant type name at `path`; NULL when the path is missing."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _text(v: Column, path: str, default: Column) -> tuple[Column, Column]:
    """(value, is-valid) of a required string: missing takes the default."""
    kind = _kind(v, path)
    value = F.when(kind.isNull(), default).when(
        kind == "STRING", F.try_variant_get(v, path, "string")
    )
    return value, kind.isNull() | (kind == "STRING")


def _count(v: Column, path: str) -> tuple[Column, Column]:
    """(value, is-valid) of a required whole number: missing is 0."""
    kind = _kind(v, path)
    value = F.when(kind.isNull(), F.lit(0)).otherwise(F.try_variant_get(v, path, "int"))
    return value, value.isNotNull()


def _reject(*checks: tuple[str, Column]) -> Column:
    """First failing check's name, else NULL."""
    out = None
    for name, passes in checks:
        failed = ~F.coalesce(passes, F.lit(False))
        out = F.when(failed, F.lit(name)) if out is None else out.when(failed, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def uniform_openai(raw: Column, model: Column) -> Column:
    """Chat-completion payload → uniform struct with a reject_reason."""
    return openai_fields(F.try_parse_json(raw), model)


def openai_fields(v: Column, model: Column) -> Column:
    """The same from a payload parsed in a step of its own, so it is parsed once."""
    # A null choice object, or a null message in it, is as broken as a bad type.
    shape = (
        F.coalesce(_kind(v, "$.choices[0]").startswith("OBJECT"), F.lit(True))
        & F.coalesce(_kind(v, "$.choices[0].message").startswith("OBJECT"), F.lit(True))
    )
    content, content_ok = _text(v, "$.choices[0].message.content", F.lit(""))
    name, name_ok = _text(v, "$.model", model)
    reason, reason_ok = _text(v, "$.choices[0].finish_reason", F.lit(""))
    prompt, prompt_ok = _count(v, "$.usage.prompt_tokens")
    completion, completion_ok = _count(v, "$.usage.completion_tokens")
    return _uniform(
        v, "openai", content, name, prompt, completion, reason,
        ("choices", shape), ("content", content_ok), ("model", name_ok),
        ("prompt_tokens", prompt_ok), ("completion_tokens", completion_ok),
        ("finish_reason", reason_ok),
    )


def uniform_anthropic(raw: Column, model: Column) -> Column:
    """Messages payload → uniform struct: text blocks joined without separator."""
    return anthropic_fields(F.try_parse_json(raw), model)


def anthropic_fields(v: Column, model: Column) -> Column:
    blocks = F.filter(
        F.coalesce(F.try_variant_get(v, "$.content", BLOCKS), F.array().cast(BLOCKS)),
        lambda b: b["type"] == "text",
    )
    content = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    kind = _kind(v, "$.content")
    name, name_ok = _text(v, "$.model", model)
    reason, reason_ok = _text(v, "$.stop_reason", F.lit(""))
    prompt, prompt_ok = _count(v, "$.usage.input_tokens")
    completion, completion_ok = _count(v, "$.usage.output_tokens")
    return _uniform(
        v, "anthropic", content, name, prompt, completion, reason,
        ("content", F.coalesce(kind.startswith("ARRAY") | (kind == "VOID"), F.lit(True))),
        ("model", name_ok), ("prompt_tokens", prompt_ok),
        ("completion_tokens", completion_ok), ("finish_reason", reason_ok),
    )


def _uniform(v, provider, content, model, prompt, completion, reason, *checks) -> Column:
    return F.struct(
        content.alias("content"),
        model.alias("model"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        reason.alias("finish_reason"),
        F.lit(provider).alias("provider"),
        _reject(("json", v.isNotNull() & _kind(v, "$").startswith("OBJECT")), *checks).alias(
            "reject_reason"
        ),
    )


def route_provider(model: Column) -> Column:
    """Provider of a model name: ordered prefix rules, first match wins."""
    # The one routing prefix that is not the default's, and the default.
    return F.when(model.startswith("claude-"), F.lit("anthropic")).otherwise(F.lit("openai"))


def endpoint_provider(endpoint: Column | None, model: Column) -> Column:
    """Provider of a call: the messages endpoint has one of its own, others route by model."""
    if endpoint is None:
        return route_provider(model)
    return F.when(endpoint == "messages", F.lit("anthropic")).otherwise(route_provider(model))


def uniform_response(v: Column, model: Column, endpoint: Column | None = None) -> Column:
    """Uniform struct of a parsed payload, by the provider of its call."""
    return F.when(
        endpoint_provider(endpoint, model) == "anthropic", anthropic_fields(v, model)
    ).otherwise(openai_fields(v, model))


def request_text(messages_json: Column) -> Column:
    """Text of the last user message: a string, or its text blocks joined."""
    messages = F.try_variant_get(
        F.try_parse_json(messages_json), "$", "array<struct<role:string,content:variant>>"
    )
    kind = lambda m: F.schema_of_variant(m["content"])
    usable = F.filter(
        messages,
        lambda m: (m["role"] == "user")
        & ((kind(m) == "STRING") | kind(m).startswith("ARRAY")),
    )
    last = F.try_element_at(usable, F.lit(-1))["content"]
    blocks = F.filter(F.try_variant_get(last, "$", BLOCKS), lambda b: b["type"] == "text")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return F.coalesce(
        F.when(F.schema_of_variant(last) == "STRING", F.try_variant_get(last, "$", "string")).otherwise(joined),
        F.lit(""),
    )


def last_user_text(turns: DataFrame) -> DataFrame:
    """Long form of the same: one row per conversation from (conv_id, turn, role, text)."""
    return (
        turns.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.max_by("text", "turn").alias("request_text"))
    )


def _quoted(text: Column) -> Column:
    """`text` as a JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def prompt_hash(messages: Column) -> Column:
    """SHA-256 of the compact JSON of `messages` (array of role/content structs)."""
    return F.sha2(F.to_json(F.struct(messages.alias("messages"))), 256)


def prompt_hash_json(messages_json: Column) -> Column:
    """The same hash from raw message JSON, where a content may be a block list.

    Keys other than role and content are left out; a block list is hashed as
    its compact JSON with its own key order.
    """
    kinds = F.try_variant_get(
        F.try_parse_json(messages_json), "$", "array<struct<role:string,content:variant>>"
    )
    texts = F.from_json(messages_json, "array<struct<role:string,content:string>>")
    parts = F.zip_with(
        kinds,
        texts,
        lambda k, t: F.concat(
            F.lit('{"role":'),
            _quoted(t["role"]),
            F.lit(',"content":'),
            F.when(F.schema_of_variant(k["content"]) == "STRING", _quoted(t["content"])).otherwise(
                t["content"]
            ),
            F.lit("}"),
        ),
    )
    return F.sha2(F.concat(F.lit('{"messages":['), F.array_join(parts, ","), F.lit("]}")), 256)


def latency_ms(start: Column, end: Column) -> Column:
    """Elapsed whole milliseconds, cut off."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("int")


# Headers that never leave the logging boundary.
HOP_HEADERS = ("host", "content-length")
CREDENTIAL_HEADERS = ("authorization", "x-api-key", "cookie", "proxy-authorization")


def redact_headers(
    headers: Column, internal: Iterable[str] = (), credentials: Iterable[str] = CREDENTIAL_HEADERS
) -> Column:
    """Captured headers without hop, internal and credential entries (any case)."""
    dropped = [h.lower() for h in (*HOP_HEADERS, *internal, *credentials)]
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(dropped))


def forwarded_headers(headers: Column, provider: Column, internal: Iterable[str] = ()) -> Column:
    """Redacted headers with the entries a provider requires: its API version
    and, when absent, the content type."""
    clean = redact_headers(headers, internal)
    # Provider header names and version.
    version = F.create_map(F.lit("anthropic-version"), F.lit("2023-06-01"))
    content_type = F.create_map(F.lit("content-type"), F.lit("application/json"))
    without = F.map_filter(clean, lambda k, _: k != "anthropic-version")
    has_type = F.map_contains_key(clean, F.lit("content-type"))
    return F.when(
        provider == "anthropic",
        F.when(has_type, F.map_concat(without, version)).otherwise(
            F.map_concat(without, version, content_type)
        ),
    ).otherwise(clean)
