"""Schemas of the stored tables (vectors are float in storage, sums are double)."""

from __future__ import annotations

# Each value is a Spark DDL string; `epoch` is the partition column of the table.
TABLES: dict[str, str] = {
    "responses": (
        "response_id string, request_id string, prompt_hash string, model string, "
        "provider string, stream boolean, prompt_tokens int, completion_tokens int, "
        "latency_ms int, finish_reason string, raw_content string, request_text string, "
        "sampled boolean, created_at timestamp"
    ),
    "assignments": (
        "response_id string, cluster_id string, created_at timestamp, "
        "request_embedding array<float>, response_embedding array<float>"
    ),
    # Written by splits: the cluster a response moved to; the latest epoch wins.
    "remaps": "response_id string, cluster_id string",
    "scores": "response_id string, quality_score double, reject_reason string",
    # The newest scores of each cluster, as detection needs them: a base of at
    # most a window a cluster, and what evaluations have added since.
    "recent": (
        "cluster_id string, response_id string, created_at timestamp, "
        "quality_score double, evaluated bigint"
    ),
    "clusters": (
        "cluster_id string, n bigint, ls array<double>, ss double, "
        "centroid array<double>, created_at timestamp, updated_at timestamp"
    ),
    # What a batch adds to clusters and founds; summed on read.
    "cluster_deltas": (
        "cluster_id string, n bigint, ls array<double>, ss double, "
        "created_at timestamp, updated_at timestamp"
    ),
    "goldens": (
        "golden_id string, response_text string, expected_embedding array<float>, "
        "request_embedding array<float>, description string, cluster_id string, "
        "created_at timestamp"
    ),
    "drift_events": (
        "event_id string, detected_at timestamp, cluster_id string, "
        "similarity_score double, baseline_score double, delta double, alert_channel string"
    ),
    "alert_deliveries": "event_id string, sent boolean, channel string, attempted_at timestamp",
    "dead_letter": "response_id string, attempts int, error string",
    "sampling": "rows_seen bigint",
}

# Bases for look-ups by id: what is known of each id, and the responses that wait to be clustered.
TABLES["ids"] = "response_id string, kind string, buckets int, bucket int"
TABLES["waiting"] = TABLES["responses"]
# Columns that are folders of a table.
FOLDERS = {"ids": ("buckets", "kind", "bucket")}

# What a batch adds to the goldens and to the newest scores.
TABLES["golden_entries"] = TABLES["goldens"]
TABLES["recent_entries"] = TABLES["recent"]

# Entry of the response stream: what the clustering job needs of a response.
STREAM_ENTRY = (
    "response_id string, request_text string, response_text string, created_at timestamp"
)

SSE_LINES = "request_id string, seq bigint, provider string, request_model string, line string"

CANDIDATES = "array<struct<cluster_id:string,sim:double,absorbs:boolean>>"
