"""Every Nth response in arrival order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.session import checkpointed

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def arrival_positions(
    rows: DataFrame, order: list[str], start: int = 0, partitions: int | None = None
) -> DataFrame:
    """`rows` plus `position`: start+1, start+2, … in `order` (unique together).

    Rows are range-partitioned and sorted, and that layout is checkpointed
    because range bounds are sampled and a recomputation could place rows
    differently. Then one count per partition goes to the driver, and a row's
    position is its partition's offset plus its place inside. Pass narrow rows
    (the order columns and an id) and join the rest back where it is needed.
    """
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = checkpointed(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", ROW_BITS)
    sizes = laid_out.groupBy(part.cast("int").alias("part")).count().collect()
    offsets, seen = [], start
    for row in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((row["part"], seen))
        seen += row["count"]
    table = spark.createDataFrame(offsets, "_part int, _offset bigint")
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        laid_out.withColumn("_part", part.cast("int"))
        .join(F.broadcast(table), "_part")
        .withColumn("position", F.col("_offset") + inside + 1)
        .select(*rows.columns, "position")
    )


def every_nth(rows: DataFrame, order: list[str], rate: int, start: int = 0) -> DataFrame:
    """`rows` plus position and sampled (position divisible by `rate`)."""
    return arrival_positions(rows, order, start).withColumn(
        "sampled", F.col("position") % rate == 0
    )
