"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicgauge.session import materialize, ship_package

# The white space that separates words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"

# Rows of one Arrow batch, small enough for batches of very long texts.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Settings and code that the operators rely on, in any session."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def words(text: Column) -> Column:
    """White-space separated words of a text; none for null or blank texts."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE_CLASS + "+")
    )


def word_count(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast(
        "long"
    )


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds `place`, the row's number from 0 in the given order, without a global window.

    Rows are sorted by range and written, so that every later read sees the
    same partitions; only one count per partition meets in one task.
    """
    placed = materialize(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # One row for each partition of the sort.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("place", F.col("_start") + F.col("_at") - F.shiftleft("_part", 33))
        .drop("_at", "_part", "_start")
    )
