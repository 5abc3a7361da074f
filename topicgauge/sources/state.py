"""State in plain Parquet or ORC files: append logs and bases, published by epoch.

Every table is `root/<table>/epoch=<n>/`. A job takes a number of its own,
writes its tables under it and commits last, naming the tables it wrote;
readers only see committed epochs. Commits are numbered files that appear whole
or not at all, and only where no other has that number.

Most tables are logs, and epochs that only append never wait for each other.
Clusters and goldens are a base and a log beside it: clusters are summed from
the base and all increments committed since it was read, so a batch writes what
it adds and nothing else, and a split or a compaction replaces the base while
batches go on. Two epochs that replace the same table, or append rows of the
same id where that is ruled out, cannot both stay: the later commit fails with
StateMoved and its work is done again (`publish`).
"""

from __future__ import annotations

import copy
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from topicgauge.functions.vectors import cf_centroid, vec_sum
from topicgauge.schemas import FOLDERS, TABLES
from topicgauge.session import apply_settings, broadcast_if_small

FORMATS = ("parquet", "orc")
# One JSON file for each commit, whatever the format of the tables.
COMMIT = (
    "epoch bigint, job string, batch_id bigint, stream string, tables array<string>, "
    "seq bigint, base bigint, committed_at timestamp"
)
SNAPSHOTS = ("clusters", "goldens", "sampling", "recent", "ids", "waiting")
# Logs that add to a snapshot.
ADDED = {"clusters": "cluster_deltas", "goldens": "golden_entries", "recent": "recent_entries"}
# Fixed value: what a file system says it can do that refuses to overwrite when a file is closed.
CONDITIONAL = "fs.option.create.conditional.overwrite"


class StateMoved(Exception):
    """Another job made a new version of the state since the epoch was opened."""


@dataclass
class Epoch:
    """An open epoch: write tables, then commit."""

    store: "StateStore"
    number: int
    job: str
    batch_id: int
    stream: str
    base: int  # number of the last commit when the epoch was opened
    tables: list[str] = field(default_factory=list)
    once: list[tuple[str, str, DataFrame]] = field(default_factory=list)

    def write(self, table: str, rows: DataFrame) -> None:
        fields = self.store.fields(table)
        typed = rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])
        self.store.write(typed, self.store.path(table, self.number), *FOLDERS.get(table, ()))
        self.tables.append(table)

    def only_once(self, table: str, key: str, rows: DataFrame) -> None:
        """The epoch must not commit if another one added rows of these keys meanwhile."""
        self.once.append((table, key, rows))

    def commit(self) -> None:
        """Publish the epoch; StateMoved if what it is built on is no longer so."""
        replaced = set(self.tables) & set(SNAPSHOTS)
        seq, checked = self.base, self.base
        while True:
            newer = self.store.commits().where(F.col("seq") > checked).collect()
            if any(replaced & set(e["tables"]) for e in newer):
                raise StateMoved(f"another job has replaced {sorted(replaced)}")
            for table, key, rows in self.once:
                epochs = [e["epoch"] for e in newer if table in e["tables"]]
                if epochs and not self.store.added(table, epochs).join(rows, key, "left_semi").isEmpty():
                    raise StateMoved(f"another job has written the same rows of {table}")
            checked = max([checked, *(e["seq"] for e in newer)])
            seq = max(seq, checked) + 1
            entry = {
                "epoch": self.number,
                "job": self.job,
                "batch_id": self.batch_id,
                "stream": self.stream,
                "tables": self.tables,
                "seq": seq,
                "base": self.base,
                "committed_at": self.store.clock(),
            }
            if self.store.create(f"commits/{seq:020d}.json", json.dumps(entry)):
                return


class StateStore:
    def __init__(self, spark: SparkSession, root: str, file_format: str = "parquet") -> None:
        if file_format not in FORMATS:
            raise ValueError(f"file_format must be one of {FORMATS}")
        apply_settings(spark)
        self.spark = spark
        self.root = root.rstrip("/")
        self.file_format = file_format
        self.upto: int | None = None  # the last commit that is seen, all if None

    def at(self, seq: int) -> "StateStore":
        """The state as of a commit."""
        view = copy.copy(self)
        view.upto = seq
        return view

    def path(self, table: str, epoch: int) -> str:
        return f"{self.root}/{table}/epoch={epoch}"

    def write(self, rows: DataFrame, path: str, *folders: str) -> None:
        rows.write.mode("overwrite").partitionBy(*folders).format(self.file_format).save(path)

    def _reader(self, schema: str):
        return self.spark.read.schema(schema).format(self.file_format)

    def fields(self, table: str) -> list[tuple[str, str]]:
        empty = self.spark.createDataFrame([], TABLES[table])
        return [(f.name, f.dataType.simpleString()) for f in empty.schema.fields]

    # ---- commits ----

    def create(self, name: str, text: str) -> bool:
        """Publish a whole file of the state folder unless it is there already.

        The text is written under a hidden name first, so a job that dies
        leaves nothing a reader sees and no name taken. It then gets its name
        in one step that fails if the name is taken: a link on a local disk, a
        rename that refuses to overwrite elsewhere. Object stores, where a
        rename is no such step, refuse when the file is closed.
        """
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        path = hadoop.Path(f"{self.root}/{name}")
        files = path.getFileSystem(conf)
        if files.exists(path):
            return False
        try:
            if files.hasPathCapability(path, CONDITIONAL):
                self._fill(files.createFile(path).recursive().must(CONDITIONAL, True).build(), text)
                return True
            hidden = hadoop.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
            self._fill(files.create(hidden, False), text)
            self._name(files, hidden, path)
            return True
        except (FileExistsError, Py4JJavaError):
            if files.exists(path):
                return False
            raise

    def _fill(self, out, text: str) -> None:
        out.write(bytearray(text.encode()))
        out.close()

    def _name(self, files, hidden, path) -> None:
        try:
            if files.getUri().getScheme() == "file":
                os.link(hidden.toUri().getPath(), path.toUri().getPath())
                return
            hadoop = self.spark._jvm.org.apache.hadoop.fs
            option = getattr(hadoop, "Options$Rename")
            keep = self.spark.sparkContext._gateway.new_array(option, 1)
            keep[0] = option.NONE
            context = hadoop.FileContext.getFileContext(files.getUri(), files.getConf())
            context.rename(hidden, path, keep)
        finally:
            files.delete(hidden, False)

    def clock(self) -> str:
        return self.spark.range(1).select(F.current_timestamp().cast("string")).first()[0]

    def commits(self) -> DataFrame:
        """epoch, job, batch_id, stream, tables, seq, base, committed_at: one row per commit."""
        found = self._found(self.spark.read.schema(COMMIT).json, f"{self.root}/commits", COMMIT)
        seen = found.where("seq IS NOT NULL")
        return seen if self.upto is None else seen.where(F.col("seq") <= self.upto)

    def last_epoch(self) -> int:
        found = self.commits().agg(F.max("epoch").alias("e")).first()["e"]
        return -1 if found is None else found

    def version(self) -> int:
        """Number of the last commit, -1 before the first."""
        found = self.commits().agg(F.max("seq").alias("v")).first()["v"]
        return -1 if found is None else found

    def committed(self, job: str, batch_id: int, stream: str = "") -> bool:
        done = self.commits().where(
            (F.col("job") == job) & (F.col("batch_id") == batch_id) & (F.col("stream") == stream)
        )
        return not done.isEmpty()

    def open(self, job: str, batch_id: int = -1, stream: str = "") -> Epoch:
        """A new epoch with a number that no other job has."""
        base, number = self.version(), self.last_epoch() + 1
        while not self.create(f"numbers/{number}", job):
            number += 1
        return Epoch(self, number, job, batch_id, stream, base)

    def publish(
        self, job: str, work: Callable[[Epoch], object], batch_id: int = -1, stream: str = ""
    ) -> object:
        """Do `work` in an epoch and commit it; again from the start if the state has moved."""
        while True:
            epoch = self.open(job, batch_id, stream)
            result = work(epoch)
            try:
                epoch.commit()
            except StateMoved:
                continue
            return result

    # ---- reading ----

    def snapshot(self, table: str) -> DataFrame:
        """A table as it is now: its last base, and what was added to it since."""
        base, seq = self.based(table)
        if table not in ADDED:
            return base
        epochs = self._epochs(ADDED[table], seq)
        if not epochs:
            return base
        more = self.added(ADDED[table], epochs)
        return summed_clusters(base, more) if table == "clusters" else base.unionByName(more)

    def based(self, table: str) -> tuple[DataFrame, int]:
        """The last base of a table, and the number of the commit up to which it holds all (-1: no base)."""
        holding = self.commits().where(F.array_contains("tables", table))
        last = holding.orderBy(F.col("seq").desc()).select("epoch", "base").first()
        if last is None:
            return self.spark.createDataFrame([], TABLES[table]), -1
        return self._reader(TABLES[table]).load(self.path(table, last["epoch"])), last["base"]

    def newer(self, table: str, seq: int) -> DataFrame:
        """Rows of a log from the commits after `seq`."""
        if seq < 0:
            return self.log(table).drop("epoch")
        epochs = self._epochs(table, seq)
        return self.added(table, epochs) if epochs else self.spark.createDataFrame([], TABLES[table])

    def _epochs(self, table: str, seq: int) -> list[int]:
        later = self.commits().where((F.col("seq") > seq) & F.array_contains("tables", table))
        return [e["epoch"] for e in later.select("epoch").collect()]

    def added(self, table: str, epochs: list[int]) -> DataFrame:
        """Rows that these epochs wrote."""
        return self._reader(TABLES[table]).load([self.path(table, epoch) for epoch in epochs])

    def log(self, table: str) -> DataFrame:
        """All committed rows of an append table, with their epoch.

        The commit list is one row per epoch and normally small enough for
        Spark to broadcast, which prunes partitions at run time and leaves the
        table unshuffled.
        """
        epochs = self.commits().where(F.array_contains("tables", table)).select("epoch")
        return self._read(table, TABLES[table]).join(epochs, "epoch", "left_semi")

    def _read(self, table: str, schema: str) -> DataFrame:
        whole = schema + ", epoch bigint"
        return self._found(self._reader(whole).load, f"{self.root}/{table}", whole)

    def _found(self, load: Callable[[str], DataFrame], path: str, schema: str) -> DataFrame:
        try:
            return load(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # ---- derived views ----

    def current_assignments(self, *columns: str) -> DataFrame:
        """(response_id, cluster_id, created_at, …): where a response belongs now.

        Splits append narrow remap rows; while those are few the join is a
        broadcast and the assignments are not shuffled at all. Columns not
        asked for, vectors among them, are not read.
        """
        moved = latest(self.log("remaps"), "response_id").select(
            "response_id", F.col("cluster_id").alias("moved_to")
        )
        first = self.log("assignments").select("response_id", "cluster_id", "created_at", *columns)
        return (
            first.join(moved, "response_id", "left")
            .withColumn("cluster_id", F.coalesce("moved_to", "cluster_id"))
            .drop("moved_to")
        )

    def members(self) -> DataFrame:
        """Clustered responses with their vectors and current cluster."""
        return self.current_assignments("request_embedding", "response_embedding")

    def response(self, response_id: str) -> Row:
        """One logged response; an unknown id is an error."""
        row = self.log("responses").where(F.col("response_id") == response_id).first()
        if row is None:
            raise LookupError(f"no response {response_id}")
        return row

    def cluster_ids(self) -> DataFrame:
        return self.snapshot("clusters").select("cluster_id")

    def current_scores(self) -> DataFrame:
        """(response_id, quality_score, reject_reason, epoch), latest evaluation only."""
        return latest(self.log("scores"), "response_id")


def summed_clusters(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Clusters of `base` with the increments in `deltas` (cluster_id, n, ls, ss, times).

    Only touched clusters are summed anew; those that come to no rows are gone.
    """
    columns = ["cluster_id", "n", "ls", "ss", "created_at", "updated_at"]
    ids = broadcast_if_small(deltas.select("cluster_id").distinct(), 64 << 20)
    touched = base.join(ids, "cluster_id", "left_semi").select(columns).unionByName(deltas.select(columns))
    fresh = touched.groupBy("cluster_id").agg(
        F.sum("n").alias("n"),
        vec_sum(F.col("ls")).alias("ls"),
        F.sum("ss").alias("ss"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )
    fresh = fresh.where("n > 0").withColumn("centroid", cf_centroid(F.col("n"), F.col("ls")))
    return base.join(ids, "cluster_id", "left_anti").unionByName(fresh.select(base.columns))


def latest(log: DataFrame, key: str) -> DataFrame:
    """The row of the highest epoch per key."""
    newest = Window.partitionBy(key).orderBy(F.col("epoch").desc())
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
