"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the `k` smallest distinct 64-bit hashes of a text's shingles in
ascending order; texts with at most `k` shingles are held exactly. Sketches of
parts merge into the sketch of the whole. Everything is a Column expression.

Defined results: a null text is an empty one; an empty text has an empty
sketch; a text with fewer words than a shingle is one shingle; two empty
sketches are alike (1.0), an empty and another one are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicgauge.llm.common import numbered, words

SIZE = 128
WIDTH = 5
# Documents whose ids share all bits above these meet in one window.
ID_BITS = 6


def shingle_hashes(tokens: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of `width` words. `tokens` must be a column, not an expression."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - width, F.lit(0)))
    # Places past the end of a short text are null and leave the hash as it is.
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(width))))
    return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(hashes)


def bottom(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def sketch(df: DataFrame, text: str, out: str, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Adds `out`, the sketch of the column `text`."""
    return (
        df.withColumn("_words", words(F.lower(text)))
        .withColumn(out, bottom(shingle_hashes(F.col("_words"), width), size))
        .drop("_words")
    )


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below `size`."""
    share = (F.element_at(a, size).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of the joint bottom-k that lies in both sketches."""
    union = merged(a, b, size)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of `a` that `b` holds."""
    union = merged(a, b, size)
    alike = resemblance(a, b, size)
    share = alike * distinct_shingles(union, size) / distinct_shingles(a, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """The sketch as fixed-width hex words, one for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def neighbours(docs: DataFrame, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Every document with the text and sketch of the next one, in descending id order.

    Returns doc_id, text, sketch, next_text, next_sketch. Texts move once: ids
    that share their high bits meet in one small window, and only the last
    document of each such group looks up the head of the following group.
    Rows with a null id stand last; rows of equal id are ordered by text.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = sketch(own, "text", "sketch", size, width)
    lowest = F.lit(-(2**63) >> ID_BITS) - 1
    own = own.withColumn("_group", F.coalesce(F.shiftright("doc_id", ID_BITS), lowest))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    within = Window.partitionBy("_group").orderBy(*order)
    placed = own.withColumn("next_text", F.lead("text").over(within)).withColumn(
        "next_sketch", F.lead("sketch").over(within)
    )
    heads = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("_group", F.coalesce(F.shiftright("doc_id", ID_BITS), lowest))
        .withColumn("_rank", F.row_number().over(within))
        .where("_rank = 1")
    )
    heads = sketch(heads, "text", "sketch", size, width)

    ids = docs.select(F.coalesce(F.shiftright("doc_id", ID_BITS), lowest).alias("_group"))
    groups = numbered(ids.distinct(), F.col("_group").desc())
    # The first group follows the last one.
    follows = groups.select(
        F.col("_group").alias("_follower"),
        F.pmod(F.col("place") - 1, F.lit(max(groups.count(), 1))).alias("place"),
    )
    chain = groups.join(follows, "place").select("_group", "_follower")
    columns = ["doc_id", "text", "sketch", "next_text", "next_sketch"]
    inner = placed.where("next_text IS NOT NULL").select(columns)
    last = placed.where("next_text IS NULL").drop("next_text", "next_sketch")
    outer = (
        last.join(chain, "_group")
        .join(
            heads.select(
                F.col("_group").alias("_follower"),
                F.col("text").alias("next_text"),
                F.col("sketch").alias("next_sketch"),
            ),
            "_follower",
        )
        .select(columns)
    )
    return inner.unionByName(outer)


def edited_fingerprints(docs: DataFrame, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced.

    The last third of the code points gives way to as many first ones of the
    next document (all of a shorter one).
    """
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    pairs = neighbours(docs, size, width).withColumn("n_chars", n.cast("long"))
    pairs = pairs.withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)),
    )
    pairs = sketch(pairs.drop("text", "next_text"), "edited", "edited_sketch", size, width)
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"),
        resemblance(own, edited, size).alias("near_edited"),
        resemblance(own, F.col("next_sketch"), size).alias("near_next"),
        containment(own, edited, size).alias("held_by_edited"),
        distinct_shingles(own, size).alias("distinct_shingles"),
    )
