"""Payload normalisation, routing, headers, hashes and validation."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from topicgauge.functions import payloads
from topicgauge.operators import normalize


def uniform(spark, fn, payload, model="m"):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    df = spark.createDataFrame([(text, model)], "raw string, model string")
    return df.select(fn(F.col("raw"), F.col("model")).alias("u")).first()["u"]


def openai(content="hi", **extra):
    return {"model": "gpt-4o-x", "choices": [{"message": {"content": content}, "finish_reason": "stop"}], **extra}


def test_openai_full(spark):
    u = uniform(spark, payloads.uniform_openai, openai(usage={"prompt_tokens": 3, "completion_tokens": 4}))
    assert (u["content"], u["model"], u["prompt_tokens"], u["completion_tokens"], u["finish_reason"]) == (
        "hi", "gpt-4o-x", 3, 4, "stop")
    assert u["provider"] == "openai" and u["reject_reason"] is None


@pytest.mark.parametrize("payload", [openai(), openai(usage=None), openai(usage={})])
def test_openai_missing_usage_is_zero(spark, payload):
    u = uniform(spark, payloads.uniform_openai, payload)
    assert (u["prompt_tokens"], u["completion_tokens"], u["reject_reason"]) == (0, 0, None)


@pytest.mark.parametrize("payload", [{}, {"choices": []}, {"choices": None}, {"error": {"x": 1}}])
def test_openai_without_choices_is_empty_text_from_request_model(spark, payload):
    u = uniform(spark, payloads.uniform_openai, payload, "asked")
    assert (u["content"], u["model"], u["finish_reason"], u["reject_reason"]) == ("", "asked", "", None)


@pytest.mark.parametrize(
    "payload,reason",
    [
        (openai(content=None), "content"),
        (openai(content=5), "content"),
        (openai(model=None), "model"),
        (openai(usage={"prompt_tokens": None}), "prompt_tokens"),
        (openai(usage={"completion_tokens": "x"}), "completion_tokens"),
        ({"choices": [{"message": None}]}, "choices"),
        ({"choices": [{"message": {"content": "a"}, "finish_reason": None}]}, "finish_reason"),
        ("no json", "json"),
        ("[1]", "json"),
    ],
)
def test_openai_rejects(spark, payload, reason):
    assert uniform(spark, payloads.uniform_openai, payload)["reject_reason"] == reason


def anthropic(blocks, **extra):
    return {"model": "claude-x", "content": blocks, "stop_reason": "end_turn",
            "usage": {"input_tokens": 1, "output_tokens": 2}, **extra}


@pytest.mark.parametrize(
    "blocks,text",
    [
        ([{"type": "text", "text": "a"}], "a"),
        ([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "ab"),
        ([{"type": "text", "text": "a"}, {"type": "tool_use", "input": {"q": 1}}], "a"),
        ([{"type": "text"}], ""),
        ([], ""),
        (None, ""),
    ],
)
def test_anthropic_blocks(spark, blocks, text):
    u = uniform(spark, payloads.uniform_anthropic, anthropic(blocks))
    assert (u["content"], u["prompt_tokens"], u["completion_tokens"]) == (text, 1, 2)
    assert (u["finish_reason"], u["provider"], u["reject_reason"]) == ("end_turn", "anthropic", None)


def test_anthropic_null_stop_reason_is_rejected(spark):
    u = uniform(spark, payloads.uniform_anthropic, anthropic([], stop_reason=None))
    assert u["reject_reason"] == "finish_reason"


def test_null_payload_is_rejected(spark):
    df = spark.createDataFrame([(None, "m")], "raw string, model string")
    assert df.select(payloads.uniform_openai(F.col("raw"), F.col("model")).alias("u")).first()["u"][
        "reject_reason"] == "json"


ROUTES = {
    "gpt-4o": "openai", "gpt-3.5-turbo": "openai", "o1-preview": "openai", "o3-mini": "openai",
    "o4-mini": "openai", "claude-3-opus": "anthropic", "claude-3-5-sonnet": "anthropic",
    "mistral": "openai", "Claude-3": "openai", "claude": "openai",
}


def test_routing(spark):
    df = spark.createDataFrame([(m,) for m in ROUTES], "m string")
    got = {r["m"]: r["p"] for r in df.select("m", payloads.route_provider(F.col("m")).alias("p")).collect()}
    assert got == ROUTES


MESSAGES = [
    ([{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}], "c"),
    ([{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "a"),
    ([{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y"}]}], "xy"),
    ([{"role": "user", "content": "early"}, {"role": "user", "content": 7}], "early"),
    ([{"role": "user", "content": "[x]"}], "[x]"),
    ([{"role": "system", "content": "s"}], ""),
    ([], ""),
]


@pytest.mark.parametrize("messages,text", MESSAGES)
def test_request_text(spark, messages, text):
    df = spark.createDataFrame([(json.dumps(messages),)], "m string")
    assert df.select(payloads.request_text(F.col("m"))).first()[0] == text


def test_prompt_hash_is_of_compact_json(spark):
    odd = 'quote " slash / \\ newline \n accent é 漢'
    messages = [{"role": "user", "content": odd}, {"role": "assistant", "content": "[not a list]"},
                {"role": "user", "content": [{"type": "text", "text": odd}]}]
    want = hashlib.sha256(
        json.dumps({"messages": messages}, separators=(",", ":"), ensure_ascii=False).encode()
    ).hexdigest()
    df = spark.createDataFrame([(json.dumps(messages),)], "m string")
    assert df.select(payloads.prompt_hash_json(F.col("m"))).first()[0] == want
    plain = spark.createDataFrame([([("user", odd)],)], "m array<struct<role:string,content:string>>")
    want = hashlib.sha256(json.dumps({"messages": [{"role": "user", "content": odd}]},
                                     separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert plain.select(payloads.prompt_hash(F.col("m"))).first()[0] == want


def test_headers(spark):
    df = spark.createDataFrame([({"Host": "h", "AUTHORIZATION": "s", "X-Key": "k", "accept": "a"},)], "h map<string,string>")
    clean = df.select(payloads.redact_headers(F.col("h"), internal=["x-key"])).first()[0]
    assert clean == {"accept": "a"}
    sent = df.select(payloads.forwarded_headers(F.col("h"), F.lit("anthropic"), ["x-key"])).first()[0]
    assert sent == {"accept": "a", "anthropic-version": "2023-06-01", "content-type": "application/json"}


def test_latency_is_cut_to_whole_ms(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' s, timestamp'2024-01-01 00:00:01.234999' e")
    assert df.select(payloads.latency_ms(F.col("s"), F.col("e"))).first()[0] == 1234


def test_message_validation(spark):
    df = spark.createDataFrame(
        [([("user", "a")],), ([("robot", "a")],), ([("user", None)],), (None,)],
        "m array<struct<role:string,content:string>>",
    ).coalesce(1)
    got = [r[0] for r in df.select(normalize.validate_messages(F.col("m"))).collect()]
    assert got == [None, "role", "content", "messages"]


def test_insert_turns_empty_request_text_into_null(spark):
    df = spark.createDataFrame([("",), ("a",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(normalize.empty_to_null(F.col("t"))).collect()] == [None, "a"]
