"""The clustering job as a stream: one epoch of state per micro-batch."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicgauge.functions.embedding import Embedder, embed_pairs, try_pairs
from topicgauge.params import Params
from topicgauge.plans.jobs import cluster_batch
from topicgauge.schemas import STREAM_ENTRY
from topicgauge.session import materialize, scratch
from topicgauge.sources.state import StateStore

ATTEMPT = "batch_id bigint, attempt int, error string"


def read_entries(spark, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream entries from a folder of Parquet files, rate-limited per trigger."""
    return (
        spark.readStream.schema(STREAM_ENTRY)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def parse_entries(messages: DataFrame, value: str = "value") -> DataFrame:
    """Stream entries from messages holding one JSON object each, as a queue
    source delivers them.

    `created_at` is the entry's own, else the message's `timestamp`, else the
    time of processing. What is not an entry keeps its text in `unreadable`,
    which the batch runner sends to the dead letters.
    """
    raw = F.col(value).cast("string")
    when = [F.col("e.created_at"), F.current_timestamp()]
    if "timestamp" in messages.columns:
        when.insert(1, F.col("timestamp"))
    good = F.col("e.response_id").isNotNull()
    return messages.withColumn("e", F.from_json(raw, STREAM_ENTRY)).select(
        F.when(good, F.col("e.response_id")).alias("response_id"),
        F.col("e.request_text").alias("request_text"),
        F.col("e.response_text").alias("response_text"),
        F.coalesce(*when).alias("created_at"),
        F.when(~good, F.coalesce(raw, F.lit(""))).alias("unreadable"),
    )


def _unreadable(batch: DataFrame) -> DataFrame:
    """Dead letters of messages that hold no entry, named after their text."""
    text = F.col("unreadable")
    return batch.where(text.isNotNull()).select(
        F.sha2(F.concat(F.lit("message|"), text), 256).substr(1, 32).alias("response_id"),
        F.lit(1).alias("attempts"),
        F.concat(F.lit("unreadable: "), text).alias("error"),
    )


class BatchRunner:
    """Body of foreachBatch: counts deliveries, sets poison rows aside.

    A batch is committed once for each stream, whose id the checkpoint keeps. A
    failure counts as a delivery unless the embedder fails on any text at all,
    which is an outage and only delays the batch. After `max_delivery_attempts`
    the rows that fail on their own are found; those go to the dead letters and
    all others are clustered. An embedder with a kernel tries its rows inside
    the tasks, in one job whatever the number of bad rows; for one that is only a
    column the batch is halved from here.
    """

    def __init__(self, root: str, embedder: Embedder, params: Params, job: str = "stream") -> None:
        self.root, self.embedder, self.params, self.job = root, embedder, params, job

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = StateStore(spark, self.root)
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        if store.committed(self.job, batch_id, stream):
            return
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        dead = None
        if "unreadable" in batch.columns:
            dead, batch = _unreadable(batch), batch.where("unreadable IS NULL").drop("unreadable")
        attempts, error = self._attempts(spark, stream, batch_id)
        if attempts >= self.params.max_delivery_attempts:
            with scratch(spark):
                good, poison = self._sifted(store, batch, attempts, now)
                dead = poison if dead is None else dead.unionByName(poison)
                cluster_batch(store, good, self.embedder, self.params, now, self.job, batch_id, stream, dead)
            return
        try:
            cluster_batch(store, batch, self.embedder, self.params, now, self.job, batch_id, stream, dead)
        except Exception as failure:
            if self._embeds(spark.createDataFrame([("probe", "probe", "probe", now)], STREAM_ENTRY)):
                self._note(spark, stream, batch_id, attempts + 1, str(failure))
            raise

    def _embeds(self, rows: DataFrame) -> bool:
        try:
            embed_pairs(rows, self.embedder, self.params.embedding_dim).write.format("noop").mode(
                "overwrite"
            ).save()
        except Exception:
            return False
        return True

    def _sifted(
        self, store: StateStore, batch: DataFrame, attempts: int, now: datetime
    ) -> tuple[DataFrame, DataFrame]:
        """The rows that can be embedded, and the dead letters of the others."""
        if not hasattr(self.embedder, "kernel"):
            poison = self._poison(store, batch, attempts, now)
            return batch.join(poison.select("response_id"), "response_id", "left_anti"), poison
        tried = materialize(try_pairs(batch, self.embedder, self.params.embedding_dim))
        poison = tried.where("error IS NOT NULL")
        letters = poison.select("response_id", F.lit(attempts).alias("attempts"), "error")
        # Rows of one id are one entry: a bad one sets aside no good one.
        good = tried.where("error IS NULL").drop("error")
        return good, letters.join(good, "response_id", "left_anti").dropDuplicates(["response_id"])

    def _poison(self, store: StateStore, batch: DataFrame, attempts: int, now: datetime) -> DataFrame:
        """Dead letters of the rows that cannot be embedded, found by halving on a hash.

        A half that embeds is done with; a half that does not is halved again
        on the next bit, so good rows are never given up with a bad one.
        """
        spark = store.spark
        found: list[tuple[str, int, str]] = []
        parts = [(batch, 0)]
        while parts:
            rows, bit = parts.pop()
            few = rows.select("response_id").distinct().limit(2).collect()
            if not few or self._embeds(rows):
                continue
            if len(few) == 1 or bit == 63:
                found += [(r[0], attempts, self._reason(rows)) for r in few]
                continue
            side = F.shiftright(F.xxhash64("response_id"), bit).bitwiseAND(F.lit(1))
            parts += [(rows.where(side == x), bit + 1) for x in (0, 1)]
        return spark.createDataFrame(found, "response_id string, attempts int, error string")

    def _reason(self, rows: DataFrame) -> str:
        try:
            embed_pairs(rows, self.embedder, self.params.embedding_dim).count()
            embed_pairs(rows, self.embedder, self.params.embedding_dim).collect()
        except Exception as failure:
            return str(failure)
        return "failed"

    def _path(self, stream: str, batch_id: int) -> str:
        return f"{self.root.rstrip('/')}/attempts/{self.job}/stream={stream}/batch={batch_id}"

    def _attempts(self, spark, stream: str, batch_id: int) -> tuple[int, str | None]:
        try:
            noted = spark.read.schema(ATTEMPT).parquet(f"{self._path(stream, batch_id)}/*")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, None
        row = noted.agg(F.max("attempt").alias("n"), F.max_by("error", "attempt").alias("error")).first()
        return row["n"] or 0, row["error"]

    def _note(self, spark, stream: str, batch_id: int, attempt: int, error: str) -> None:
        row = spark.createDataFrame([(batch_id, attempt, error)], ATTEMPT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self._path(stream, batch_id)}/attempt={attempt}")


def start(
    entries: DataFrame,
    root: str,
    checkpoint: str,
    embedder: Embedder,
    params: Params,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the clustering stream; offsets live in `checkpoint`."""
    writer = entries.writeStream.foreachBatch(BatchRunner(root, embedder, params)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{params.max_wait_ms} milliseconds").start()
