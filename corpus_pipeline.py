"""The corpus pipeline: language, line dedup, near dedup, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. `run` writes each stage's rows as Parquet in
the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge.llm import language, lines, mixing, near, packing
from topicgauge.llm.common import prepare, word_count, words
from topicgauge.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Documents whose words are spread over languages more than this are no language.
MIN_LANGUAGE_SHARE = 0.3
# Stages on word runs take five words.
WIDTH = 5


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language, with the language found as `lang`.

    Documents without a letter go, and those whose words are spread over more
    languages than the share allows. Where no row has a language none can be
    learned, nothing is known against any text, and all with a letter stay as they are.
    """
    prepare(spark)
    model = language.fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = language.labelled(docs.select(COLUMNS), model)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; every document stays, with the text that is left."""
    prepare(spark)
    found = lines.dedup(docs.select(COLUMNS))
    return _documents(found.withColumn("text", F.col("kept")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies, repeated rows of it once.

    Rows of one id are one document; those of different texts all stay, and rows
    without an id are documents of their own.
    """
    prepare(spark)
    docs = docs.select(COLUMNS)
    gone = materialize(near.linked(docs, width=WIDTH).where("NOT kept").select("doc_id").distinct())
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # Usually few: only rows of these ids are compared by their texts.
    repeated = materialize(ids.where("n > 1").select("doc_id").join(gone, "doc_id", "left_anti"))
    others = docs.join(gone.unionAll(repeated), "doc_id", "left_anti").select(COLUMNS)
    rest = [c for c in COLUMNS if c != "doc_id"]
    text = F.sha2(F.col("text").cast("binary"), 256)
    rows = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id", text.alias("_text"))
    once = rows.agg(F.min(F.struct(rest)).alias("_row")).select("doc_id", "_row.*")
    return others.unionByName(once.select(COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents as the mix takes them, one row a copy or piece."""
    prepare(spark)
    sized = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    mixed = mixing.mixed(sized).where("taken > 0")
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    cut = F.struct(F.col("cut_from").alias("start"), F.col("cut_to").alias("end"))
    head = F.struct(F.lit(0).cast("long").alias("start"), F.col("cut_end").alias("end"))
    taken = F.concat(F.array_repeat(whole, F.col("copies").cast("int")), F.array(cut, head))
    rows = mixed.withColumn("_part", F.explode(F.filter(taken, lambda p: p["end"] > p["start"])))
    size = F.col("_part.end") - F.col("_part.start")
    piece = F.array_join(
        F.slice(words(F.col("text")), (F.col("_part.start") + 1).cast("int"), size.cast("int")), " "
    )
    text = F.when(size == F.col("size"), F.col("text")).otherwise(piece)
    return _documents(rows.withColumn("text", text))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in length buckets and batches."""
    prepare(spark)
    return packing.packed(docs)


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mix", mix_stage),
    ("packing", packing_stage),
]

# The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
