"""Server-sent-event transcripts → uniform rows.

Lines are reduced to the few facts they carry before any shuffle, then joined
in two steps: runs of `RUN` lines first, whole calls second. A call with very
many lines is thus spread over many tasks, and the last step only sees the
text that is its result. Lines after the terminal event are ignored, as is a
call that never reached it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DATA_PREFIX = "data: "
RUN = 4096


def _data(lines: DataFrame, provider: str) -> DataFrame:
    """Data lines of a provider, with the text behind the prefix in `body`."""
    line = F.col("line")
    return lines.where((F.col("provider") == provider) & line.startswith(DATA_PREFIX)).withColumn(
        "body", F.substring(line, F.lit(len(DATA_PREFIX) + 1), F.length(line))
    )


def _join_calls(lines: DataFrame, first: str = "", last: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, seq, request_model, done, text, facts) lines → one row per
    finished call: content, the earliest fact `first`, the latest ones `last`.

    Facts are structs that begin with `seq`, and null on lines without one. Places
    and texts of the pieces are collected as two plain lists, which shuffle in far
    fewer bytes than a struct a line; both skip the same lines. Lines without a
    piece or fact are not filtered out but simply not collected: a filter on parsed
    values would be pushed down and parse every line twice.
    """
    seq, end, firsts = F.col("seq"), F.col("end"), [first] if first else []

    def counts(fact: Column) -> Column:
        return end.isNull() | (fact["seq"] < end)

    runs = (
        lines.groupBy("request_id", F.floor(seq / RUN).alias("run"))
        .agg(
            F.min(F.when(F.col("done"), seq)).alias("end"),
            F.max("request_model").alias("request_model"),
            F.collect_list(F.when(F.col("text").isNotNull(), seq)).alias("seqs"),
            F.collect_list("text").alias("texts"),
            *[F.min(c).alias(c) for c in firsts],
            *[F.collect_list(c).alias(c) for c in last],
        )
        # Lines without a number share a run; their list of places is empty and reads as nulls.
        .withColumn("pieces", F.zip_with("seqs", "texts", lambda s, t: F.struct(s.alias("seq"), t.alias("text"))))
        .withColumn("pieces", F.sort_array(F.filter("pieces", counts)))
        .select(
            "request_id",
            "run",
            "end",
            "request_model",
            F.array_join(F.transform("pieces", lambda e: e["text"]), "").alias("text"),
            *[F.when(counts(F.col(c)), F.col(c)).alias(c) for c in firsts],
            *[F.array_max(F.filter(c, counts)).alias(c) for c in last],
        )
    )
    calls = (
        runs.groupBy("request_id")
        .agg(
            F.min("end").alias("end"),
            F.max("request_model").alias("request_model"),
            F.collect_list(F.struct("run", "text", *firsts, *last)).alias("runs"),
        )
        .where(end.isNotNull())
        .withColumn("runs", F.sort_array(F.filter("runs", lambda r: r["run"] <= F.floor(end / RUN))))
    )

    def present(field: str) -> Column:
        return F.filter(F.transform("runs", lambda r: r[field]), lambda x: x.isNotNull())

    return calls.select(
        "request_id",
        "request_model",
        F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("content"),
        *[F.try_element_at(present(c), F.lit(1)).alias(c) for c in firsts],
        *[F.try_element_at(present(c), F.lit(-1)).alias(c) for c in last],
    )


def assemble_openai(lines: DataFrame) -> DataFrame:
    """Chat-completion chunks up to `[DONE]`: the first chunk names the model,
    token counts are 0 and the reason is 'stop'."""
    v, seq = F.col("v"), F.col("seq").cast("bigint").alias("seq")
    text = F.try_variant_get(v, "$.choices[0].delta.content", "string")
    model = F.coalesce(F.try_variant_get(v, "$.model", "string"), F.lit(""))
    parsed = (
        _data(lines, "openai")
        .withColumn("done", F.trim(F.col("body")) == "[DONE]")
        .withColumn("v", F.when(~F.col("done"), F.try_parse_json(F.col("body"))))
        .select(
            "request_id",
            "seq",
            "request_model",
            "done",
            # Every chunk may carry text, and the first one names the model.
            F.when(v.isNotNull(), text).alias("text"),
            F.when(v.isNotNull(), F.struct(seq, text.alias("text"), model.alias("name"))).alias("chunk"),
        )
    )
    return _join_calls(parsed, first="chunk").select(
        "request_id",
        "content",
        F.coalesce(F.col("chunk")["name"], F.col("request_model"), F.lit("")).alias("model"),
        F.lit(0).alias("prompt_tokens"),
        F.lit(0).alias("completion_tokens"),
        F.lit("stop").alias("finish_reason"),
        F.lit("openai").alias("provider"),
    )


def assemble_anthropic(lines: DataFrame) -> DataFrame:
    """Typed message events up to `message_stop`; the last message_delta wins.

    A stop reason that is an explicit null leaves `finish_reason` NULL, which
    row validation rejects.
    """
    v = F.col("v")
    kind = F.col("kind")

    def string(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def count(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "int"), F.lit(0))

    reason = F.when(
        F.variant_get(v, "$.delta.stop_reason", "variant").isNull(), F.lit("")
    ).otherwise(string("$.delta.stop_reason"))

    def fact(of: str, name: Column, tokens: Column) -> Column:
        return F.when(kind == of, F.struct(F.col("seq").cast("bigint").alias("seq"), name.alias("name"), tokens.alias("tokens")))

    is_text = (kind == "content_block_delta") & (string("$.delta.type") == "text_delta")
    parsed = (
        _data(lines, "anthropic")
        .withColumn("v", F.try_parse_json(F.col("body")))
        .withColumn("kind", string("$.type"))
        .select(
            "request_id",
            "seq",
            "request_model",
            F.coalesce(kind == "message_stop", F.lit(False)).alias("done"),
            F.when(is_text, string("$.delta.text")).alias("text"),
            fact("message_start", string("$.message.model"), count("$.message.usage.input_tokens")).alias("start"),
            fact("message_delta", reason, count("$.usage.output_tokens")).alias("change"),
        )
    )
    start, change = F.col("start"), F.col("change")
    return _join_calls(parsed, last=("start", "change")).select(
        "request_id",
        "content",
        F.coalesce(start["name"], F.col("request_model"), F.lit("")).alias("model"),
        F.coalesce(start["tokens"], F.lit(0)).alias("prompt_tokens"),
        F.coalesce(change["tokens"], F.lit(0)).alias("completion_tokens"),
        F.when(change.isNull(), F.lit("")).otherwise(change["name"]).alias("finish_reason"),
        F.lit("anthropic").alias("provider"),
    )


def pair_turns(turns: DataFrame) -> DataFrame:
    """User turn answered by the conversation's next turn, as request/response pairs.

    Turn numbers may have gaps. Which turn comes next is found on narrow rows;
    the texts then meet by (conv_id, turn), spread by both keys, so those of a
    very long conversation do not land in one task.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    follows = turns.select(
        "conv_id",
        "turn",
        "role",
        F.lead("turn").over(order).alias("next_turn"),
        F.lead("role").over(order).alias("next_role"),
    ).where("role = 'user' AND next_role = 'assistant'")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("request_text")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next_turn"), F.col("text").alias("response_text")
    )
    return (
        follows.select("conv_id", "turn", "next_turn")
        .join(answered, ["conv_id", "next_turn"])
        .join(asked, ["conv_id", "turn"])
        .select("conv_id", "turn", "request_text", "response_text")
    )
