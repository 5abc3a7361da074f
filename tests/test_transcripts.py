"""Transcript assembly, with runs shorter than the calls."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicgauge.operators import transcripts
from topicgauge.schemas import SSE_LINES
from topicgauge.streaming import transcript_stream


@pytest.fixture(autouse=True, params=[4096, 2])
def run(request, monkeypatch):
    monkeypatch.setattr(transcripts, "RUN", request.param)


def lines(spark, provider, calls):
    rows = [
        (rid, i, provider, "asked", line) for rid, texts in calls.items() for i, line in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SSE_LINES).repartition(3)


def data(obj):
    return "data: " + (obj if isinstance(obj, str) else json.dumps(obj))


def chunk(text, model="live"):
    return data({"model": model, "choices": [{"delta": {"content": text}}]})


def by_id(df):
    return {r["request_id"]: r for r in df.collect()}


def test_openai(spark):
    calls = {
        "whole": ["", chunk("a", "first"), ": note", chunk(None), data("{bad"), chunk("b", "second"),
                  data({"choices": []}), chunk("c"), data(" [DONE] "), chunk("late")],
        "cut": [chunk("a"), chunk("b")],
        "empty": [data("[DONE]")],
    }
    got = by_id(transcripts.assemble_openai(lines(spark, "openai", calls)))
    assert set(got) == {"whole", "empty"}
    assert (got["whole"]["content"], got["whole"]["model"]) == ("abc", "first")
    assert (got["whole"]["prompt_tokens"], got["whole"]["finish_reason"]) == (0, "stop")
    assert (got["empty"]["content"], got["empty"]["model"]) == ("", "asked")


def test_anthropic(spark):
    def delta(text):
        return data({"type": "content_block_delta", "delta": {"type": "text_delta", "text": text}})

    def change(reason, tokens):
        return data({"type": "message_delta", "delta": {"stop_reason": reason}, "usage": {"output_tokens": tokens}})

    start = data({"type": "message_start", "message": {"model": "live", "usage": {"input_tokens": 7}}})
    stop = data({"type": "message_stop"})
    calls = {
        "whole": ["event: x", start, delta("a"), data({"type": "ping"}), delta("b"),
                  data({"type": "content_block_delta", "delta": {"type": "input_json_delta", "partial_json": "{"}}),
                  change("max_tokens", 1), change("end_turn", 9), stop, delta("late"), change("late", 99)],
        "cut": [start, delta("a"), change("end_turn", 2)],
        "bare": [delta("x"), stop],
        "null": [start, change(None, 3), stop],
    }
    got = by_id(transcripts.assemble_anthropic(lines(spark, "anthropic", calls)))
    assert set(got) == {"whole", "bare", "null"}
    w = got["whole"]
    assert (w["content"], w["model"], w["prompt_tokens"], w["completion_tokens"], w["finish_reason"]) == (
        "ab", "live", 7, 9, "end_turn")
    b = got["bare"]
    assert (b["content"], b["model"], b["prompt_tokens"], b["finish_reason"]) == ("x", "asked", 0, "")
    assert got["null"]["finish_reason"] is None


def test_one_call_with_most_lines(spark):
    words = [f"w{i} " for i in range(3000)]
    calls = {"big": [chunk(w) for w in words] + [data("[DONE]")], "small": [chunk("x"), data("[DONE]")]}
    got = by_id(transcripts.assemble_openai(lines(spark, "openai", calls)))
    assert got["big"]["content"] == "".join(words) and got["small"]["content"] == "x"


class OneCall:
    """The state of one call, counting what is put into it."""

    def __init__(self):
        self.entries, self.value, self.timers = [], None, set()

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return OneCall()

    def appendList(self, entries):
        self.entries += entries

    def get(self):
        return self.value if self.value else iter(self.entries)

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        pass

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_state_grows_with_the_calls_not_with_their_lines():
    call = transcript_stream.OpenCalls(1000)
    state = OneCall()
    call.init(state)
    call.call.get = lambda: call.call.value
    texts = [f"p{i}" for i in range(2000)]
    frame = pd.DataFrame({"seq": range(2000), "provider": "openai", "request_model": "m", "line": texts,
                          "packed": texts, "millis": range(2000), "done": [i == 1500 for i in range(2000)]})
    list(call.handleInputRows(("a",), iter([frame]), state))
    assert len(state.entries) == 1 and state.timers == {1501}
    (out,) = call.handleExpiredTimer(("a",), state, None)
    assert list(out["run"]) == ["\n".join(texts)] and set(out["last_seq"]) == {1500}


def test_packed_lines_come_back_as_they_were(spark):
    rows = [("a", 1, "openai", "m", 'x "y" \\ \n\r\t  z'), ("a", (1 << 62) + 1, None, "", ""), ("b", -1, "p", None, None)]
    lines = spark.createDataFrame(rows, SSE_LINES)
    runs = lines.select("request_id", transcript_stream.packed().alias("p")).groupBy("request_id").agg(
        F.array_join(F.collect_list("p"), "\n").alias("run"))
    back = runs.select("request_id", transcript_stream.unpacked("run")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


def test_a_batch_runs_the_state_once(spark, tmp_path):
    """Both assemblies read what the state gave, written once, instead of running it again each."""
    late = [("a", 0, "openai", "m", chunk("x")), ("a", 1, "openai", "m", data("[DONE]"))]
    spark.createDataFrame(late, SSE_LINES).withColumn("at", F.timestamp_millis(F.col("seq"))).coalesce(1).write.parquet(
        str(tmp_path / "in"))
    plans = []
    stream = spark.readStream.schema(SSE_LINES + ", at timestamp").parquet(str(tmp_path / "in"))
    transcript_stream.start(
        stream, str(tmp_path / "check"),
        lambda rows, n: plans.append((rows._jdf.queryExecution().toString(), [r["content"] for r in rows.collect()])),
        "0 seconds", available_now=True,
    ).awaitTermination()
    assert not any("TransformWithState" in plan for plan, _ in plans)
