"""Packing: optimal length buckets and token-budget batches.

Documents longer than the context are cut into pieces of CONTEXT words and a
rest. The global histogram of piece lengths has at most CONTEXT bins; dynamic
programming over it finds the BUCKETS upper bounds with the least padding.
Inside a bucket, pieces in a seeded order fill batches whose padded size stays
within the token budget.

Defined results: empty and null texts have no words and no piece; an empty
table has no rows. Rows of equal id are packed each for themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicgauge.llm.common import word_count

CONTEXT = 2048
BUCKETS = 8
BUDGET = 32768
SEED = "pack"
# Pieces of one window when they are numbered.
RUN = 1 << 14


def bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding.

    Of equal paddings, the one whose last cuts come first wins.
    """
    order = np.argsort(lengths)
    at = np.asarray(lengths, dtype=np.int64)[order]
    many = np.asarray(counts, dtype=np.int64)[order]
    n = len(at)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(many)])
    words = np.concatenate([[0], np.cumsum(many * at)])
    # Padding of the bins i..j-1 in one bucket, for every i < j.
    best = np.concatenate([[0], at * rows[1:] - words[1:]])
    cuts = []
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            costs = best[:j] + at[j - 1] * (rows[j] - rows[:j]) - (words[j] - words[:j])
            i = int(np.argmin(costs))
            if costs[i] < best[j]:
                new[j], cut[j] = costs[i], i
        best = new
        cuts.append(cut)
    found, j = [int(at[n - 1])], n
    for cut in reversed(cuts):
        if cut[j] > 0:
            j = int(cut[j])
            found.append(int(at[j - 1]))
    return found[::-1]


def pieces(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, n_words, piece, start, length): the runs of words to be packed."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("n_words")).where("n_words > 0")
    last = F.floor((F.col("n_words") - 1) / context).cast("long")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * context
    return cut.withColumn("start", start).withColumn(
        "length", F.least(F.col("n_words") - start, F.lit(context)).cast("long")
    )


def _seed() -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece"))


def packed(
    docs: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """Pieces with their bucket's bound, batch number and padding.

    Batches are numbered inside a bucket. Pieces of a bucket are spread by hash
    over runs of about RUN pieces; windows number the pieces of a run and one
    row per run carries the counts on, so no bucket meets in one task.
    """
    if budget < context:
        raise ValueError("a batch must hold a piece of the context's length")
    cut = pieces(docs, context)
    # At most one row for each length up to the context.
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    ends = bounds([r["length"] for r in histogram], [r["n"] for r in histogram], buckets)
    total = sum(r["n"] for r in histogram)
    runs = max(1, -(-total // RUN))
    bound = F.lit(ends[-1] if ends else 0)
    for end in reversed(ends[:-1]):
        bound = F.when(F.col("length") <= end, F.lit(end)).otherwise(bound)
    cut = (
        cut.withColumn("bucket", bound.cast("long"))
        .withColumn("_seed", _seed())
        .withColumn("_run", F.conv(F.substring("_seed", 1, 8), 16, 10).cast("long") % runs)
    )
    sizes = cut.groupBy("bucket", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_run").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        "bucket", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    in_run = Window.partitionBy("bucket", "_run").orderBy("_seed", "doc_id", "n_words")
    place = F.row_number().over(in_run) - 1
    rows = cut.withColumn("_place", place).join(starts, ["bucket", "_run"])
    per_batch = F.floor(F.lit(budget) / F.col("bucket"))
    return rows.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "bucket",
        F.floor((F.col("_before") + F.col("_place")) / per_batch).cast("long").alias("batch"),
        (F.col("bucket") - F.col("length")).alias("padding"),
    )
