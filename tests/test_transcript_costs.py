"""Assembly of transcripts: odd lines, and how much of them is shuffled."""

import json

from pyspark.sql import functions as F

from topicgauge.operators import transcripts
from topicgauge.schemas import SSE_LINES


def data(obj):
    return "data: " + (obj if isinstance(obj, str) else json.dumps(obj))


def delta(text):
    return data({"type": "content_block_delta", "delta": {"type": "text_delta", "text": text}})


def change(reason, tokens):
    return data({"type": "message_delta", "delta": {"stop_reason": reason}, "usage": {"output_tokens": tokens}})


def start(model, tokens):
    return data({"type": "message_start", "message": {"model": model, "usage": {"input_tokens": tokens}}})


STOP = data({"type": "message_stop"})


def chunk(text, model):
    return data({"model": model, "choices": [{"delta": {"content": text}}]})


def shuffled(plan):
    """Bytes put into each shuffle of a plan that has run, the first one first."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    children = plan.children()
    found = [b for i in range(children.size()) for b in shuffled(children.apply(i))]
    return found + [plan.metrics().apply("dataSize").value()] if name == "ShuffleExchangeExec" else found


def test_a_piece_is_shuffled_as_its_place_and_its_text(spark):
    calls = F.concat(F.lit("c"), F.floor(F.col("id") / 1000))
    lines = spark.range(0, 20_000, 1, 2).select(
        calls.alias("request_id"), (F.col("id") % 1000).alias("seq"), F.lit("anthropic").alias("provider"),
        F.lit("asked").alias("request_model"),
        F.when(F.col("id") % 1000 == 999, F.lit(STOP)).otherwise(F.lit(delta("word"))).alias("line"),
    )
    got = transcripts.assemble_anthropic(lines)
    rows = got.collect()
    assert len(rows) == 20 and {r["content"] for r in rows} == {"word" * 999}
    pieces, _ = shuffled(got._jdf.queryExecution().executedPlan())
    assert pieces < 32 * 20_000  # a struct with all that a line can tell took 64 a line


def test_lines_without_a_number_twice_or_without_text(spark):
    """What is assembled of odd lines, as it was when lines were collected whole."""
    rows = [("twice", n, line) for n, line in [
        (0, start("b", 1)), (0, start("a", 2)), (1, delta("y")), (1, delta("x")), (1, delta("x")), (2, delta(None)),
        (3, change("one", 1)), (3, change("two", None)), (4, STOP), (4, STOP), (4, delta("late"))]]
    rows += [("unnumbered", None, start("n", 3)), ("unnumbered", None, delta("never")), ("unnumbered", 5, STOP),
             ("unnumbered", 3, delta("kept")), ("endless", None, STOP), (None, 1, delta("nobody")), (None, 2, STOP)]
    lines = spark.createDataFrame([(r, n, "anthropic", "asked", x) for r, n, x in rows], SSE_LINES).repartition(3)
    got = {r["request_id"]: tuple(r)[1:6] for r in transcripts.assemble_anthropic(lines).collect()}
    assert got == {
        "twice": ("xxy", "b", 1, 0, "two"),
        "unnumbered": ("kept", "asked", 0, 0, ""),
        None: ("nobody", "asked", 0, 0, ""),
    }


def test_chunks_without_a_number_or_twice(spark):
    rows = [("twice", n, line) for n, line in [
        (0, chunk("z", "second")), (0, chunk("a", "first")), (0, chunk(None, "none")), (1, chunk("b", "x")),
        (2, data("[DONE]")), (3, data("[DONE]"))]]
    rows += [("unnumbered", None, chunk("?", "m")), ("unnumbered", 0, chunk("k", "n")), ("unnumbered", 1, data("[DONE]")),
             (None, 0, chunk("nobody", "m")), (None, 1, data("[DONE]"))]
    lines = spark.createDataFrame([(r, n, "openai", "asked", x) for r, n, x in rows], SSE_LINES).repartition(3)
    got = {r["request_id"]: tuple(r)[1:3] for r in transcripts.assemble_openai(lines).collect()}
    assert got == {"twice": ("azb", "none"), "unnumbered": ("k", "n"), None: ("nobody", "m")}


def test_a_run_is_parsed_as_one_array(spark):
    from topicgauge.streaming import transcript_stream

    odd = ['data: {"a": "},{"}', "]\n[", "\\n , ", "", None, "é \\u0041\t"]
    rows = [("a", n, None if n == 2 else "openai", "m", line) for n, line in enumerate(odd)] + [("a", None, None, None, None)]
    lines = spark.createDataFrame(rows, SSE_LINES).coalesce(1)
    runs = lines.select("request_id", transcript_stream.packed().alias("p")).groupBy("request_id").agg(
        F.array_join(F.collect_list("p"), "\n").alias("run"))
    back = runs.select("request_id", transcript_stream.unpacked("run"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    # One parser for a run, not one for every line.
    plan = back._jdf.queryExecution().analyzed().toString()
    assert "transform(" not in plan and "split(" not in plan


def test_terminal_lines_of_a_stream_are_found_in_any_spelling(spark, tmp_path):
    from topicgauge.streaming import transcript_stream

    stops = ['data: {"type":"message_stop"}', 'data: {"type": "message\\u005fstop"}', 'data: {"type":"message\\u005Fstop", "x": "message_stop"}']
    others = ['data: {"type":"ping","text":"message_stop"}', "message_stop", 'data: {"type":"message_stop', None, ": \\"]
    rows = [(f"{kind}{i}", n, "anthropic", "m", x) for kind, lines in (("stop", stops), ("open", others))
            for i, line in enumerate(lines) for n, x in enumerate([delta("a"), line])]
    rows += [("done", 0, "openai", "m", chunk("x", "y")), ("done", 1, "openai", "m", data(" [DONE] ")),
             ("quoted", 0, "openai", "m", STOP), ("nobody", 0, None, "m", STOP)]
    at = F.timestamp_millis(F.col("seq") + 1000)
    spark.createDataFrame(rows, SSE_LINES).withColumn("at", at).coalesce(1).write.parquet(f"{tmp_path}/in")
    clock = spark.createDataFrame([("~", 10**9, "none", "", ": ping")], SSE_LINES).withColumn("at", at)
    clock.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {}
    stream = spark.readStream.schema(SSE_LINES + ", at timestamp").parquet(f"{tmp_path}/in")
    transcript_stream.start(
        stream, f"{tmp_path}/check",
        lambda rows, n: got.update({r["request_id"]: r["content"] for r in rows.collect()}),
        "0 seconds", available_now=True,
    ).awaitTermination()
    assert got == {"stop0": "a", "stop1": "a", "stop2": "a", "done": "x"}


class Store:
    """State and timers of one call, counting what is written to the state."""

    def __init__(self):
        self.value, self.updates, self.timers = None, 0, set()

    def getListState(self, name, schema):
        return Store()

    def getValueState(self, name, schema):
        return self

    def appendList(self, entries):
        pass

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_late_lines_of_an_ended_call_leave_its_end_alone():
    import pandas as pd

    from topicgauge.streaming import transcript_stream

    call, store = transcript_stream.OpenCalls(1000), Store()
    call.init(store)

    def batch(*lines):
        seqs, millis, done = zip(*lines)
        frame = pd.DataFrame({"seq": seqs, "millis": millis, "done": done, "packed": "x"})
        list(call.handleInputRows(("a",), iter([frame]), store))
        return store.value[0], store.value[3], store.timers, store.updates

    assert batch((0, 5, False), (3, None, False)) == (-1, -1, {1006}, 1)
    assert batch((1, 7, False)) == (-1, -1, {1008}, 2)
    assert batch((9, 30, True), (12, 40, True)) == (30, 9, {31}, 3)
    assert batch((2, 50, False), (11, 60, True)) == (30, 9, {31}, 3)  # nothing to write
    assert batch((8, 20, True)) == (20, 8, {21}, 4)
