"""Streamed calls assembled while they arrive.

Lines of a call may come in any order, over several batches. A call is finished
once its terminal line is there and the watermark has passed that line's time,
so that no earlier line is still to come; its lines then go out together and the
batch assembly makes the row. A call that falls silent without a terminal line
is closed after `idle_s` seconds of event time and gives no row.

Lines are packed as text before the state and unpacked behind it, and what a batch
brings of a call is kept in runs of at most `RUN` lines, one entry of state each: the
cost of state follows the calls and not the lines.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from topicgauge.operators.transcripts import DATA_PREFIX, RUN, assemble_anthropic, assemble_openai
from topicgauge.session import materialize, scratch

LINES = "request_id string, seq bigint, provider string, request_model string, line string"
LINE = "seq bigint, provider string, request_model string, line string"
# A run of a finished call: its packed lines, and the number of the call's last line.
RUNS = "request_id string, run string, last_seq bigint"
CALL = "ends_at bigint, last_at bigint, timer bigint, last_seq bigint"


class OpenCalls(StatefulProcessor):
    """Per call: the lines so far, and a timer for its end or its silence."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "run string")
        self.call = handle.getValueState("call", CALL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.call.get() or (-1, -1, -1, -1)
        ends_at, last_at, timer, last_seq = known
        for frame in rows:
            packed = frame["packed"].tolist()
            self.runs.appendList([("\n".join(packed[at : at + RUN]),) for at in range(0, len(packed), RUN)])
            millis = frame["millis"].to_numpy()
            last_at = max(last_at, int(np.nanmax(millis)))
            # The first terminal line counts; what follows it is no part of the call.
            done = frame["done"].to_numpy().nonzero()[0]
            seqs = frame["seq"].to_numpy() if len(done) else ()
            for at in done:
                if last_seq < 0 or seqs[at] < last_seq:
                    ends_at, last_seq = int(millis[at]), int(seqs[at])
        due = ends_at if ends_at >= 0 else last_at + self.idle_ms
        due = max(due, timerValues.getCurrentWatermarkInMs()) + 1
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        # Once the end is known, it does not matter when the last line came.
        if ends_at < 0 or (ends_at, due, last_seq) != (known[0], timer, known[3]):
            self.call.update((ends_at, last_at, due, last_seq))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends_at, _, _, last_seq = self.call.get()
        runs = [run for run, in self.runs.get()] if ends_at >= 0 else []
        self.runs.clear()
        self.call.clear()
        if runs:
            yield pd.DataFrame({"request_id": key[0], "run": runs, "last_seq": last_seq})

    def close(self) -> None:
        pass


def finished_calls(lines: DataFrame, delay: str, idle_s: int = 3600) -> DataFrame:
    """Streaming lines (with their time `at`) → the lines of calls, each call whole, once it is finished."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    body = F.substring("line", F.lit(len(DATA_PREFIX) + 1), F.length("line"))
    # Only a line that holds the word, as it is or in escapes, is worth parsing.
    may_stop = body.contains("message_stop") | body.contains("\\")
    ends = F.when(F.col("provider") == "openai", F.trim(body) == "[DONE]").when(
        may_stop, F.get_json_object(body, "$.type") == "message_stop"
    )
    done = F.col("line").startswith(DATA_PREFIX) & F.coalesce(ends, F.lit(False))
    runs = (
        lines.withWatermark("at", delay)
        .select("request_id", "at", "seq", done.alias("done"), F.unix_millis("at").alias("millis"), packed().alias("packed"))
        .groupBy("request_id")
        .transformWithStateInPandas(
            statefulProcessor=OpenCalls(idle_s * 1000),
            outputStructType=RUNS,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return runs.select("request_id", "last_seq", unpacked("run")).where("seq <= last_seq").drop("last_seq")


def packed() -> Column:
    """A line as one text that holds no line break."""
    return F.to_json(F.struct("seq", "provider", "request_model", "line"))


def unpacked(run: str) -> Column:
    """The lines of a run of packed ones, a row each; the run is parsed once, as one array."""
    array = F.concat(F.lit("["), F.replace(F.col(run), F.lit("\n"), F.lit(",")), F.lit("]"))
    return F.inline(F.from_json(array, f"array<struct<{LINE}>>"))


def start(
    lines: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], delay: str,
    idle_s: int = 3600, available_now: bool = False,
) -> StreamingQuery:
    """Assemble calls as they finish; `sink(rows, batch_id)` gets the uniform rows."""

    def assemble(batch: DataFrame, batch_id: int) -> None:
        # Written once: both assemblies read it, and either would run the state again.
        with scratch(batch.sparkSession):
            lines = materialize(batch)
            sink(assemble_openai(lines).unionByName(assemble_anthropic(lines)), batch_id)

    writer = (
        finished_calls(lines, delay, idle_s).writeStream.foreachBatch(assemble)
        .outputMode("append").option("checkpointLocation", checkpoint)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.start()
