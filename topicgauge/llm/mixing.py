"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get target sizes by weight, none above `MOST` times its own size. The
mix is a number of blocks of BLOCK words. Highest quotients (target over odd
numbers) give each source its blocks, and again each shard of a source; within
a shard a seeded order of the documents makes a stream of words, of which
blocks are taken from a seeded start on, going round as often as needed. So
documents are taken whole, once or twice, but for the ones at the two cuts.

Everything is a DataFrame expression. Shards hold about SHARD words, so a
source with a third of all words is many shards; only one row for each source
meets in one task.

Defined results: a null text has size 0 and is never taken; null sources form
one source, ordered last; rows of one id count each for themselves; rows that
agree in id and size are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicgauge.session import materialize

# Weights in the order of the sources, share of all words, repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 16
SHARD = 1 << 20
SEED = "mix"
# Columns that the mix adds; input columns of these names are replaced.
ADDED = ["source_size", "target", "copies", "cut_from", "cut_to", "cut_end", "taken"]


def targets(sources: DataFrame) -> DataFrame:
    """Adds `number`, `target` and `house` to (source, source_size, rows), one row each.

    Sources by the ratio of bound to weight: those up to the first that stays
    under its bound are full, the others share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    rows = sources.withColumn("number", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(weights, F.pmod("number", F.lit(len(WEIGHTS))).cast("int"))
    )
    rows = rows.withColumn("_bound", MOST * F.col("source_size")).withColumn(
        "_ratio", F.col("_bound") / F.col("weight")
    )
    by_ratio = Window.orderBy("_ratio", "number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    full = F.coalesce(F.sum("_bound").over(before), F.lit(0))
    level = (SHARE * F.sum("source_size").over(every) - full) / F.sum("weight").over(after)
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn(
        "_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    )
    share = F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight")
    house = F.floor(SHARE * F.sum("source_size").over(every) / BLOCK + 0.5)
    return rows.select(
        "source",
        "source_size",
        "rows",
        "number",
        F.least(share, F.col("_bound").cast("double")).alias("target"),
        house.alias("house"),
    )


def apportion(parties: DataFrame, group: list[str], key: str, seats: str) -> DataFrame:
    """Adds `seats` by Sainte-Laguë: the `house` highest quotients votes / (2 j - 1) of a group.

    `parties` has votes, most (a bound on seats) and house (equal in a group).
    Quotients far above the last winning one need no ranking: a party surely
    has the seats that a divisor safely too large gives it, and surely no more
    than one safely too small gives; about two quotients a party are ranked.
    """
    parties = materialize(parties)
    whole = parties.groupBy(*group).agg(
        F.sum("votes").alias("_votes"), F.count(F.lit(1)).alias("_parties")
    )
    joined = parties.join(whole, group)
    half = F.col("_parties") / 2

    def at(house: Column) -> Column:
        share = F.try_divide(F.col("votes") * F.greatest(house, F.lit(0.0)), F.col("_votes"))
        return F.coalesce(F.floor(share + 0.5), F.lit(0))

    sure = F.least(F.greatest(at(F.col("house") - half) - 1, F.lit(0)), F.col("most"))
    possible = F.least(at(F.col("house") + half) + 1, F.col("most"))
    joined = materialize(joined.withColumn("_sure", sure).withColumn("_possible", possible))
    taken = joined.groupBy(*group).agg(F.sum("_sure").alias("_given"))
    open_seats = joined.where("_possible > _sure").withColumn(
        "_j", F.explode(F.sequence(F.col("_sure") + 1, F.col("_possible")))
    )
    open_seats = open_seats.join(taken, group)
    order = Window.partitionBy(*group).orderBy((F.col("votes") / (2 * F.col("_j") - 1)).desc(), key)
    won = (
        open_seats.withColumn("_rank", F.row_number().over(order))
        .where("_rank <= house - _given")
        .groupBy(*group, key)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return joined.join(won, [*group, key], "left").select(
        *parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(seats)
    )


def _number(text: Column) -> Column:
    """A number of 32 bits that only the text decides."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mixed(docs: DataFrame, size: str = "size") -> DataFrame:
    """Adds source_size, target, copies, cut_from, cut_to, cut_end and taken to every row.

    `docs` has doc_id, source and a word count in `size`, and any other columns.
    The mix takes `copies` whole copies of a row, its words from cut_from up to
    cut_to, and its first cut_end words; taken is their number.
    """
    docs = docs.drop(*ADDED)
    sized = materialize(docs.select("doc_id", "source", F.col(size).alias("_size")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    totals = sized.groupBy("source").agg(
        F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    shard_count = F.ceil((F.col("source_size") + F.col("rows")) / SHARD).cast("long")
    sources = materialize(
        targets(totals).select(
            key.alias("_source"), "number", "source_size", "target", "house", shard_count.alias("_shards")
        )
    )

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with the shard they belong to and their place in its order."""
        name = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        facts = sources.select(
            "_source", F.col("number").alias("_number"), "_shards", "source_size", "target"
        )
        return (
            rows.withColumn("_source", key)
            .join(facts, "_source")
            .withColumn("_seed", F.md5(name))
            .withColumn("_shard", F.pmod(_number(name), F.col("_shards")))
            .drop("_source", "_shards")
        )

    shards = materialize(
        placed(sized)
        .groupBy(F.col("_number").alias("number"), F.col("_shard").alias("shard"))
        .agg(F.sum("_size").alias("votes"))
        .withColumn("blocks", F.ceil(F.col("votes") / BLOCK).cast("long"))
    )
    within = shards.groupBy("number").agg(F.sum("blocks").alias("_blocks"))
    quotas = apportion(
        sources.join(within, "number").select(
            "number",
            F.col("target").alias("votes"),
            (MOST * F.col("_blocks")).alias("most"),
            "house",
            F.lit(0).alias("mix"),
        ),
        ["mix"],
        "number",
        "seats",
    )
    shares = apportion(
        shards.join(quotas.select("number", F.col("seats").alias("house")), "number").withColumn(
            "most", MOST * F.col("blocks")
        ),
        ["number"],
        "shard",
        "seats",
    )
    first = F.pmod(
        _number(F.concat_ws(":", F.lit(SEED), F.col("number"), F.col("shard"))),
        F.greatest("blocks", F.lit(1)),
    )
    rest = F.when(F.col("blocks") > 0, F.pmod("seats", "blocks")).otherwise(F.lit(0))
    last = F.col("_first") + F.col("_rest")
    shares = materialize(
        shares.withColumn("_first", first)
        .withColumn("_rest", rest)
        .select(
            F.col("number").alias("_number"),
            F.col("shard").alias("_shard"),
            F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks")))
            .otherwise(0)
            .cast("long")
            .alias("copies"),
            (F.col("_first") * BLOCK).alias("_from"),
            F.least(last * BLOCK, F.col("votes")).alias("_to"),
            F.greatest((last - F.col("blocks")) * BLOCK, F.lit(0)).alias("_end"),
        )
    )
    in_shard = Window.partitionBy("_number", "_shard").orderBy("_seed", "doc_id", "_size")
    before = in_shard.rowsBetween(Window.unboundedPreceding, -1)
    rows = placed(docs.withColumn("_size", F.col(size)))
    rows = rows.withColumn("_at", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    rows = rows.join(shares, ["_number", "_shard"])

    def inside(place: str) -> Column:
        return F.least(F.greatest(F.col(place) - F.col("_at"), F.lit(0)), F.col("_size"))

    rows = (
        rows.withColumn("cut_from", inside("_from"))
        .withColumn("cut_to", F.greatest(inside("_to"), F.col("cut_from")))
        .withColumn("cut_end", inside("_end"))
    )
    taken = F.col("copies") * F.col("_size") + F.col("cut_to") - F.col("cut_from")
    return rows.withColumn("taken", taken + F.col("cut_end")).drop(
        "_number", "_shard", "_seed", "_at", "_from", "_to", "_end", "_size"
    )
