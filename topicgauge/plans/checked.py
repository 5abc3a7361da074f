"""Queries with an equivalent in plain SQL, each over its whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge.functions import messages, payloads, vectors as vf
from topicgauge.functions.embedding import HashedWords
from topicgauge.operators import assign, cells, drift, evaluate, golden, knn, metrics, normalize, recover
from topicgauge.operators import sampling, split, transcripts
from topicgauge.params import Params
from topicgauge.schemas import TABLES
from topicgauge.session import broadcast_if_small, materialize, spread
from topicgauge.sources import tables as src

RUN_TS = "2024-02-01 00:00:00"
SECRET = "demo-secret"
ABSORB = 0.945
PARAMS = Params(embedding_dim=64)


def r6(column):
    return F.round(column, 6)


def _long(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim from 1, value) rows of a vector column."""
    return df.select(key, F.posexplode(vector).alias("pos", "x")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("dim"), r6(F.col("x").cast("double")).alias("value")
    )


# ---- drift -------------------------------------------------------------------


def _drift_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "cluster_id", "n_scores", r6("baseline_score").alias("baseline_score"),
        r6("current_score").alias("current_score"), r6("delta").alias("delta"), "alert_triggered",
    )


def drift_detect(spark: SparkSession, folder: str) -> DataFrame:
    return _drift_rows(drift.detect(src.scores(spark, folder), PARAMS.drift_threshold))


def drift_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return _drift_rows(drift.detect(src.scores(spark, folder, by_user=True), PARAMS.drift_threshold))


def drift_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return drift.coverage(src.scores(spark, folder))


def recent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return drift.recent_scores(src.scores(spark, folder)).select(
        "cluster_id", "response_id", "newest_rank", r6("quality_score").alias("quality_score")
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    found = drift.detect(src.scores(spark, folder), PARAMS.drift_threshold)
    return drift.drift_events(found, F.lit(RUN_TS).cast("timestamp"), "webhook")


def _payload(spark: SparkSession, folder: str) -> DataFrame:
    rounded = _events(spark, folder).withColumn(
        "baseline_score", F.round("baseline_score", 3)
    ).withColumn("similarity_score", F.round("similarity_score", 3))
    return messages.alert_payload(rounded, PARAMS.drift_threshold)


def drift_event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        "cluster_id", r6("similarity_score").alias("similarity_score"),
        r6("baseline_score").alias("baseline_score"), r6("delta").alias("delta"), "alert_channel",
    )


def drift_alert_payload(spark: SparkSession, folder: str) -> DataFrame:
    return _payload(spark, folder).select(
        "cluster_id", "baseline_score", "current_score", "delta_percent", "threshold_percent", "summary"
    )


def drift_alert_text(spark: SparkSession, folder: str) -> DataFrame:
    return _payload(spark, folder).select(
        "cluster_id", messages.telegram_text(PARAMS.alert_title).alias("text")
    )


def webhook_signature(spark: SparkSession, folder: str) -> DataFrame:
    return _payload(spark, folder).withColumn("body", messages.webhook_body()).select(
        "cluster_id", "body", messages.signature(SECRET, F.col("body")).alias("signature")
    )


# ---- vectors and clustering features -----------------------------------------


def vector_functions(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.vectors(spark, folder)
    means = rows.groupBy("label").agg(vf.vec_mean(F.col("embedding")).alias("mean"))
    v, m = F.col("embedding"), F.col("mean")
    means = broadcast_if_small(means, PARAMS.broadcast_limit_bytes, "mean")
    return rows.join(means, "label").select(
        "vec_id",
        r6(vf.dot_kernel(v, m)).alias("inner_product"),
        r6(F.sqrt(vf.sq_norm_kernel(v))).alias("length"),
        r6(vf.cosine_kernel(v, m)).alias("cosine"),
        r6(1 - vf.cosine_kernel(v, m)).alias("distance"),
        r6(F.get(vf.vec_add(vf.doubles(v), m), F.lit(0))).alias("first_of_sum"),
        r6(F.get(vf.vec_divide(v, F.lit(4)), F.lit(0))).alias("first_quarter"),
    )


def cluster_cf(spark: SparkSession, folder: str) -> DataFrame:
    cf = vf.group_features(src.vectors(spark, folder), ["label"], "embedding")
    return metrics.cluster_report(cf.withColumnRenamed("label", "cluster_id")).select(
        "cluster_id", "n", r6("radius").alias("radius"), r6(vf.norm(F.col("centroid"))).alias("centroid_length")
    )


def cluster_centroids(spark: SparkSession, folder: str) -> DataFrame:
    cf = vf.group_features(src.grouped_vectors(spark, folder), ["cluster_id"], "embedding")
    return _long(
        cf.withColumn("centroid", vf.cf_centroid(F.col("n"), F.col("ls"))), "cluster_id", "centroid"
    )


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    cf = vf.group_features(src.grouped_vectors(spark, folder), ["cluster_id"], "embedding")
    return cf.select(
        "cluster_id", "n", "ls", "ss", vf.cf_centroid(F.col("n"), F.col("ls")).alias("centroid"),
        F.lit(RUN_TS).cast("timestamp").alias("created_at"),
        F.lit(RUN_TS).cast("timestamp").alias("updated_at"),
    )


def _knn(spark: SparkSession, folder: str, params: Params) -> DataFrame:
    return assign.nearest_clusters(
        src.vectors(spark, folder), "vec_id", "embedding", _snapshot(spark, folder), params
    ).select("vec_id", F.col("rank").cast("bigint").alias("rank"), "cluster_id", r6("sim").alias("sim"))


def knn_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, PARAMS)


def knn_centroids_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The same search past the broadcast limit, in several slices of the matrix."""
    return _knn(spark, folder, replace(PARAMS, broadcast_limit_bytes=6000))


def _document_search(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every 50th document as a query, and every document as a cluster of its own.

    Texts without words have no direction and take no part.
    """
    docs = src.embedded_documents(spark, folder).select(
        F.col("response_id").alias("cluster_id"), F.col("request_embedding").alias("ls")
    )
    docs = materialize(docs.where(F.exists("ls", lambda x: x != 0)))
    queries = docs.where(F.col("cluster_id").cast("bigint") % 50 == 0)
    clusters = docs.withColumn("n", F.lit(1)).withColumn("ss", vf.sq_norm_kernel("ls"))
    return queries.select(F.col("cluster_id").alias("item_id"), F.col("ls").alias("v")), clusters


def knn_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest documents over coarse cells."""
    queries, clusters = _document_search(spark, folder)
    found = cells.nearest(queries, cells.build(clusters, PARAMS), PARAMS)
    return found.select("item_id", F.posexplode("candidates").alias("pos", "c")).select(
        "item_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "c.cluster_id", r6("c.sim").alias("sim")
    )


def knn_cells_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of each query's nearest documents the cells give, against the exact search."""
    queries, clusters = _document_search(spark, folder)
    found = cells.nearest(queries, cells.build(clusters, PARAMS), PARAMS)
    return cells.recall(found, knn.top_candidates(queries, clusters, PARAMS))


def cf_points(spark: SparkSession, folder: str) -> DataFrame:
    """Features of single points, of a point absorbed twice, and the absorb test."""
    point = F.col("embedding")
    one = src.vectors(spark, folder).withColumn("one", vf.cf_from_point(point))
    two = one.withColumn("two", vf.cf_absorb(F.col("one.n"), F.col("one.ls"), F.col("one.ss"), point))
    turned = F.transform(point, lambda x: -x)
    return two.select(
        "vec_id",
        F.col("one.n").alias("n"),
        r6("one.ss").alias("ss"),
        F.col("two.n").alias("n2"),
        r6("two.ss").alias("ss2"),
        F.round(F.element_at("two.ls", 1), 6).alias("first2"),
        vf.cf_would_absorb(F.col("one.n"), F.col("one.ls"), F.col("one.ss"), point, 0.01).alias("same"),
        vf.cf_would_absorb(F.col("one.n"), F.col("one.ls"), F.col("one.ss"), turned, 0.9).alias("opposite"),
    )


def centroid_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids computed anew from the features of clusters that lost theirs."""
    lost = _snapshot(spark, folder).withColumn("centroid", F.lit(None).cast("array<double>"))
    return _long(assign.backfill_centroids(lost), "cluster_id", "centroid")


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    return assign.snapshot_assign(
        src.vectors(spark, folder), "vec_id", "embedding", _snapshot(spark, folder),
        replace(PARAMS, birch_threshold=ABSORB),
    )


def birch_snapshot_assign(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select("vec_id", "cluster_id", r6("sim").alias("sim"))


def birch_absorb_merge(spark: SparkSession, folder: str) -> DataFrame:
    deltas = vf.group_features(
        _assigned(spark, folder).where(F.col("cluster_id").isNotNull()), ["cluster_id"], "embedding"
    )
    merged = assign.merge_deltas(
        _snapshot(spark, folder), deltas, F.lit("2024-02-02 00:00:00").cast("timestamp")
    )
    ls = F.col("ls")
    return merged.select(
        "cluster_id", "n", r6("ss").alias("ss"),
        r6(vf.cf_radius(F.col("n"), vf.dot(ls, ls), F.col("ss"))).alias("radius"),
        (F.col("updated_at") > F.col("created_at")).alias("touched"),
    )


def _labels_as_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return vf.group_features(src.members(spark, folder), ["cluster_id"], "request_embedding")


def oversized_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized(_labels_as_clusters(spark, folder), 0.9895).select("cluster_id", "n")


def _split(spark: SparkSession, folder: str) -> split.Split:
    wide = split.oversized(_labels_as_clusters(spark, folder), 0.9)
    return split.split_clusters(src.members(spark, folder), wide, PARAMS)


def split_two_means(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).members.select("response_id", "cluster_id", "label")


def split_cluster_parts(spark: SparkSession, folder: str) -> DataFrame:
    ls = F.col("ls")
    return _split(spark, folder).parts.select(
        "cluster_id", "label", "n", r6("ss").alias("ss"),
        r6(vf.cf_radius(F.col("n"), vf.dot(ls, ls), F.col("ss"))).alias("radius"),
    )


def _empty_goldens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TABLES["goldens"])


def _goldens(spark: SparkSession, folder: str, cap: int = 10) -> DataFrame:
    return golden.admit(
        src.members(spark, folder), _empty_goldens(spark), _labels_as_clusters(spark, folder), cap
    )


def split_golden_remap(spark: SparkSession, folder: str) -> DataFrame:
    parts = _split(spark, folder).parts
    moved = split.remap_goldens(_goldens(spark, folder), parts)
    names = parts.select(F.col("new_cluster_id").alias("cluster_id"), "label",
                         F.col("cluster_id").alias("old_cluster"))
    return moved.join(names, "cluster_id").select("response_text", "old_cluster", "label")


# ---- goldens and evaluation ---------------------------------------------------


def golden_admit(spark: SparkSession, folder: str) -> DataFrame:
    return _goldens(spark, folder).select("cluster_id", "response_text", "description")


def golden_admit_topup(spark: SparkSession, folder: str) -> DataFrame:
    """Admission into sets that already hold 10 of 25: only the room left is filled."""
    return golden.admit(
        src.members(spark, folder), _goldens(spark, folder), _labels_as_clusters(spark, folder), 25
    ).select("cluster_id", "response_text")


def golden_list(spark: SparkSession, folder: str) -> DataFrame:
    return golden.listing(_goldens(spark, folder)).select(
        "golden_id", "description", F.col("created_at").cast("timestamp_ntz").alias("created_at")
    )


def golden_size(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.golden_sizes(_goldens(spark, folder))


def evaluate_quality(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.evaluate(
        src.members(spark, folder), _goldens(spark, folder), PARAMS
    ).select("response_id", r6("quality_score").alias("quality_score"), "reject_reason")


def evaluate_without_self(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.mean_similarity(
        src.members(spark, folder).select("response_id", "cluster_id", "response_embedding"),
        _goldens(spark, folder), replace(PARAMS, exclude_self=True),
    ).select("response_id", r6("mean_sim").alias("mean_sim"))


def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document vectors in long form, zero components left out."""
    docs = spread(src.table(spark, folder, "documents").select("doc_id", "text"))
    embedded = docs.select("doc_id", HashedWords(64).column(F.col("text")).alias("v"))
    return _long(embedded, "doc_id", "v").where(F.col("value") != 0)


def document_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Documents embedded, grouped by language and source, and assigned to the
    nearest of those groups that absorbs them."""
    docs = materialize(src.embedded_documents(spark, folder))
    groups = vf.group_features(docs, ["group"], "request_embedding").withColumnRenamed(
        "group", "cluster_id"
    )
    return assign.snapshot_assign(
        docs, "response_id", "request_embedding", groups, replace(PARAMS, birch_threshold=0.7)
    ).select("response_id", "cluster_id", r6("sim").alias("sim"))


# ---- calls, payloads, transcripts ----------------------------------------------


def request_text(spark: SparkSession, folder: str) -> DataFrame:
    return payloads.last_user_text(src.table(spark, folder, "conversations"))


def pair_turns(spark: SparkSession, folder: str) -> DataFrame:
    return src.pairs(spark, folder)


def pair_turns_gapped(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of conversations whose turn numbers leave gaps and lack some turns."""
    turns = src.table(spark, folder, "conversations").where("(conv_id + turn) % 7 <> 3")
    return transcripts.pair_turns(turns.withColumn("turn", F.col("turn") * 3 + F.col("conv_id") % 2))


def normalize_by_endpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Messages-endpoint payloads under an alias that routes nowhere, and chat ones."""
    pairs = src.pairs(spark, folder).withColumn(
        "endpoint", F.when(F.col("conv_id") % 2 == 0, F.lit("messages")).otherwise(F.lit("chat"))
    )
    block = F.struct(F.lit("text").alias("type"), F.col("response_text").alias("text"))
    message = F.struct(F.lit("assistant").alias("role"), F.col("response_text").alias("content"))
    payload = F.when(
        F.col("endpoint") == "messages",
        F.to_json(
            F.struct(
                F.array(block).alias("content"),
                F.struct(F.col("conv_id").alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage"),
            )
        ),
    ).otherwise(F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))))
    parsed = pairs.withColumn("v", F.try_parse_json(payload))
    u = payloads.uniform_response(F.col("v"), F.lit("my-alias"), F.col("endpoint"))
    return parsed.withColumn("u", u).select(
        "conv_id", "turn", "u.provider", "u.content", "u.prompt_tokens", "u.completion_tokens", "u.reject_reason"
    )


def validate_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Reject reasons of requests with unknown roles and missing contents."""
    turns = src.table(spark, folder, "conversations")
    role = F.when(F.col("conv_id") % 5 == 0, F.lit("robot")).otherwise(F.col("role"))
    text = F.when(F.col("turn") % 3 != 1, F.col("text"))
    asked = F.when(
        F.col("conv_id") % 11 != 0, F.array(F.struct(role.alias("role"), text.alias("content")))
    )
    return turns.select("conv_id", "turn", normalize.validate_messages(asked).alias("reason"))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs as chat messages: text content on even turns' halves, block lists else."""
    pairs = src.pairs(spark, folder)
    text = F.to_json(
        F.array(
            F.struct(F.lit("user").alias("role"), F.col("request_text").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("response_text").alias("content")),
        )
    )
    blocks = F.to_json(
        F.array(
            F.struct(
                F.lit("user").alias("role"),
                F.array(
                    F.struct(F.lit("text").alias("type"), F.col("request_text").alias("text")),
                    F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")),
                    F.struct(F.lit("text").alias("type"), F.lit("!").alias("text")),
                ).alias("content"),
            )
        )
    )
    listed = F.col("conv_id") % 2 == 1
    return pairs.withColumn("messages_json", F.when(listed, blocks).otherwise(text))


def request_text_json(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder).select(
        "conv_id", "turn", payloads.request_text(F.col("messages_json")).alias("request_text")
    )


def prompt_hash(spark: SparkSession, folder: str) -> DataFrame:
    turns = src.table(spark, folder, "conversations")
    message = F.array(F.struct("role", F.col("text").alias("content")))
    return turns.select("conv_id", "turn", payloads.prompt_hash(message).alias("prompt_hash"))


def prompt_hash_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder).select(
        "conv_id", "turn", payloads.prompt_hash_json(F.col("messages_json")).alias("prompt_hash")
    )


def _openai_payload(pairs: DataFrame) -> DataFrame:
    """Payloads with the variants the normaliser must tell apart, by conversation."""
    kind = F.col("conv_id") % 5
    choice = F.array(
        F.struct(
            F.struct(F.lit("assistant").alias("role"), F.col("response_text").alias("content")).alias("message"),
            F.lit("stop").alias("finish_reason"),
        )
    )
    usage = F.struct(
        F.length("request_text").alias("prompt_tokens"), F.length("response_text").alias("completion_tokens")
    )
    full = F.to_json(F.struct(F.lit("gpt-4o-2024").alias("model"), choice.alias("choices"), usage.alias("usage")))
    no_usage = F.to_json(F.struct(choice.alias("choices")))
    payload = (
        F.when(kind == 0, full)
        .when(kind == 1, no_usage)
        .when(kind == 2, F.lit('{"error":{"code":429}}'))
        .when(kind == 3, F.lit('{"choices":[{"message":{"content":null},"finish_reason":"stop"}]}'))
        .otherwise(F.concat(F.lit("not json "), F.col("response_text")))
    )
    return pairs.withColumn("payload", payload).withColumn("model", F.lit("gpt-4o"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", "u.*")


def normalize_openai(spark: SparkSession, folder: str) -> DataFrame:
    calls = _openai_payload(src.pairs(spark, folder))
    return _flat(calls.withColumn("u", payloads.uniform_openai(F.col("payload"), F.col("model"))))


def normalize_anthropic(spark: SparkSession, folder: str) -> DataFrame:
    pairs = src.pairs(spark, folder)
    kind = F.col("conv_id") % 3
    block = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    full = F.to_json(
        F.struct(
            F.lit("claude-3-x").alias("model"),
            F.array(block("text", F.col("request_text")), block("tool_use", F.lit("no")),
                    block("text", F.col("response_text"))).alias("content"),
            F.lit("end_turn").alias("stop_reason"),
            F.struct(F.length("request_text").alias("input_tokens"),
                     F.length("response_text").alias("output_tokens")).alias("usage"),
        )
    )
    payload = F.when(kind == 0, full).when(kind == 1, F.lit('{"content":[]}')).otherwise(
        F.lit('{"content":[],"stop_reason":null}')
    )
    calls = pairs.withColumn("payload", payload)
    return _flat(
        calls.withColumn("u", payloads.uniform_anthropic(F.col("payload"), F.lit("claude-3")))
    )


def _stream_id():
    return F.concat_ws("-", "conv_id", "turn")


def _chunks(pairs: DataFrame) -> DataFrame:
    """Response words as chunks: (request_id, seq from 1, piece)."""
    return pairs.select(
        _stream_id().alias("request_id"), "conv_id",
        F.posexplode(F.split("response_text", " ")).alias("pos", "word"),
    ).withColumn("piece", F.when(F.col("pos") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), "word")))


def sse_openai(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.assemble_openai(openai_lines(spark, folder))


def openai_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Chat-completion transcripts of all conversation pairs, with noise around them."""
    pairs = src.pairs(spark, folder)
    one = F.struct(F.struct(F.col("piece").alias("content")).alias("delta"))
    body = F.to_json(F.struct(F.lit("gpt-4o-live").alias("model"), F.array(one).alias("choices")))
    chunk = _chunks(pairs).select(
        "request_id", F.col("pos").cast("bigint").alias("seq"), F.concat(F.lit("data: "), body).alias("line")
    )
    # Every third conversation breaks off before the end and yields no row.
    ends = pairs.where(F.col("conv_id") % 3 != 2).select(
        _stream_id().alias("request_id"), F.lit(1 << 40).alias("seq"), F.lit("data: [DONE]").alias("line")
    )
    noise = pairs.select(
        _stream_id().alias("request_id"), F.explode(F.array(F.lit(-1), F.lit((1 << 40) + 1))).alias("seq")
    ).select("request_id", F.col("seq").cast("bigint").alias("seq"),
             F.when(F.col("seq") < 0, F.lit(": ping")).otherwise(F.lit('data: {"choices":[{"delta":{"content":"late"}}]}')).alias("line"))
    return chunk.unionByName(ends).unionByName(noise).withColumn("provider", F.lit("openai")).withColumn(
        "request_model", F.lit("gpt-4o"))


def sse_anthropic(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.assemble_anthropic(anthropic_lines(spark, folder))


def anthropic_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Message transcripts of all conversation pairs."""
    pairs = src.pairs(spark, folder)
    rid = _stream_id().alias("request_id")

    def line(body):
        return F.concat(F.lit("data: "), body).alias("line")

    start = pairs.select(
        rid, F.lit(-1).cast("bigint").alias("seq"),
        line(F.to_json(F.struct(
            F.lit("message_start").alias("type"),
            F.struct(F.lit("claude-live").alias("model"),
                     F.struct(F.length("request_text").alias("input_tokens")).alias("usage")).alias("message"),
        ))),
    )
    chunk = _chunks(pairs).select(
        "request_id", F.col("pos").cast("bigint").alias("seq"),
        line(F.to_json(F.struct(
            F.lit("content_block_delta").alias("type"),
            F.struct(F.lit("text_delta").alias("type"), F.col("piece").alias("text")).alias("delta"),
        ))),
    )
    change = pairs.select(
        rid, F.explode(F.array(F.lit(1 << 40), F.lit((1 << 40) + 1))).alias("seq"), "response_text",
    ).select(
        "request_id", "seq",
        line(F.to_json(F.struct(
            F.lit("message_delta").alias("type"),
            F.struct(F.lit("end_turn").alias("stop_reason")).alias("delta"),
            F.struct((F.length("response_text") + (F.col("seq") - F.lit(1 << 40))).alias("output_tokens")).alias("usage"),
        ))),
    )
    stop = pairs.where(F.col("conv_id") % 3 != 2).select(
        rid, F.lit((1 << 40) + 2).alias("seq"), F.lit('data: {"type":"message_stop"}').alias("line")
    )
    return start.unionByName(chunk).unionByName(change).unionByName(stop).withColumn(
        "provider", F.lit("anthropic")).withColumn("request_model", F.lit("claude-3"))


def route_provider(spark: SparkSession, folder: str) -> DataFrame:
    return src.logged_calls(spark, folder).select(
        "event_id", "model", payloads.route_provider(F.col("model")).alias("provider")
    )


def redact_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Captured header maps of all events, without hop, internal and secret entries."""
    headers = F.create_map(
        F.lit("Host"), F.lit("h"), F.lit("Authorization"), F.concat(F.lit("Bearer "), F.col("event_id")),
        F.lit("X-Gateway-Key"), F.lit("k"), F.lit("user-agent"), F.col("event_type"),
    )
    clean = payloads.redact_headers(F.col("headers"), internal=["x-gateway-key"])
    return (
        src.table(spark, folder, "events")
        .withColumn("headers", headers)
        .select("event_id", F.explode(clean).alias("name", "value"))
    )


def forwarded_headers(spark: SparkSession, folder: str) -> DataFrame:
    headers = F.create_map(F.lit("Authorization"), F.lit("Bearer s"), F.lit("user-agent"), F.col("event_type"))
    provider = payloads.route_provider(src.model_of(F.col("event_type")))
    return (
        src.table(spark, folder, "events")
        .withColumn("headers", headers)
        .select("event_id", F.explode(payloads.forwarded_headers(F.col("headers"), provider)).alias("name", "value"))
    )


def validate_responses(spark: SparkSession, folder: str) -> DataFrame:
    calls = _openai_payload(src.pairs(spark, folder))
    rows = _flat(calls.withColumn("u", payloads.uniform_openai(F.col("payload"), F.col("model"))))
    # A provider outside the allowed two, and a missing count, are caught too.
    rows = rows.withColumn("provider", F.when(F.col("turn") == 2, F.lit("other")).otherwise(F.col("provider")))
    rows = rows.withColumn("latency_ms", F.when(F.col("turn") == 4, F.lit(None)).otherwise(F.lit(5)).cast("int"))
    return normalize.validate_responses(rows).select("conv_id", "turn", "reject_reason")


def insert_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Logged rows from whole calls: hashes, latency, NULL for empty request text."""
    pairs = _messages(spark, folder)
    even = F.col("conv_id") % 4 == 0
    calls = _openai_payload(pairs).select(
        _stream_id().alias("request_id"), "model", F.lit(False).alias("stream"),
        F.when(even, F.lit('[{"role":"system","content":"s"}]')).otherwise(F.col("messages_json")).alias("messages_json"),
        "payload",
        F.timestamp_micros(F.lit(1704067200000000)).alias("started_at"),
        F.timestamp_micros(F.lit(1704067200000000) + F.length("response_text") * 1234).alias("finished_at"),
        F.timestamp_micros(F.lit(1704067200000000)).alias("created_at"),
    )
    good, _ = normalize.split_rejects(normalize.normalize_calls(calls))
    return good.select("response_id", "request_id", "model", "latency_ms", "raw_content", "request_text")


# ---- sampling, recovery, flags ---------------------------------------------------


def sample_every_nth(spark: SparkSession, folder: str) -> DataFrame:
    events = src.table(spark, folder, "events").select("event_id", "ts")
    return sampling.every_nth(events, ["ts", "event_id"], PARAMS.sampling_rate).select(
        "event_id", "position", "sampled"
    )


def _recovery(spark: SparkSession, folder: str):
    events = src.table(spark, folder, "events")
    responses = events.select(
        F.col("event_id").alias("response_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).alias("request_text"),
        F.col("props").alias("raw_content"), (F.col("user_id") % 3 == 0).alias("sampled"),
    )
    done = events.where(F.col("value") > 20).select(F.col("event_id").alias("response_id"))
    return responses, done


def unclustered_recovery(spark: SparkSession, folder: str) -> DataFrame:
    responses, done = _recovery(spark, folder)
    waiting = recover.unclustered(responses, done, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    entries, skipped = recover.split_recoverable(waiting)
    return entries.select("response_id", F.lit("queue").alias("outcome")).unionByName(
        skipped.select("response_id", F.col("error").alias("outcome"))
    )


def recovery_oldest(spark: SparkSession, folder: str) -> DataFrame:
    responses, done = _recovery(spark, folder)
    waiting = recover.unclustered(responses, done, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return recover.oldest(waiting, 100).select("response_id")


def recovery_all(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that waits, which is what a run takes unless told otherwise."""
    responses, done = _recovery(spark, folder)
    waiting = recover.unclustered(responses, done, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return recover.oldest(waiting).select("response_id", "created_at")


def flagged_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    responses, done = _recovery(spark, folder)
    return evaluate.flagged_in_batch(done, responses)


def pending_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    responses, done = _recovery(spark, folder)
    current = src.scores(spark, folder).select("response_id", "cluster_id")
    return evaluate.pending_evaluations(responses, current, done).select("response_id", "cluster_id")


# ---- metrics -----------------------------------------------------------------------


def requests_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.requests_by_model(src.logged_calls(spark, folder))


def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.latency_histogram(src.logged_calls(spark, folder))


def latest_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = src.scores(spark, folder).withColumn("epoch", F.dayofmonth("created_at"))
    return metrics.latest_score(scored).select(r6("quality_score").alias("quality_score"))


def delivered_alerts(spark: SparkSession, folder: str) -> DataFrame:
    sent = _events(spark, folder).select(
        "event_id", (F.col("delta") > 0.2).alias("sent"), F.col("alert_channel").alias("channel")
    )
    return metrics.delivered_alerts(sent)


CHECKED = [
    drift_detect, drift_by_user, drift_coverage, recent_scores, drift_event_rows,
    drift_alert_payload, drift_alert_text, webhook_signature,
    vector_functions, cluster_cf, cluster_centroids, knn_centroids, knn_centroids_cells, knn_cells, knn_cells_recall,
    birch_snapshot_assign, birch_absorb_merge, oversized_clusters, split_two_means,
    split_cluster_parts, split_golden_remap,
    golden_admit, golden_admit_topup, golden_list, golden_size, evaluate_quality,
    evaluate_without_self, embed_documents, document_topics,
    request_text, pair_turns, pair_turns_gapped, normalize_by_endpoint, validate_messages, request_text_json, prompt_hash, prompt_hash_blocks,
    normalize_openai, normalize_anthropic, sse_openai, sse_anthropic, route_provider,
    redact_headers, forwarded_headers, validate_responses, insert_responses,
    sample_every_nth, cf_points, centroid_backfill, unclustered_recovery, recovery_oldest, recovery_all, flagged_semi_join,
    pending_evaluations, requests_by_model, latency_histogram, latest_score, delivered_alerts,
]
