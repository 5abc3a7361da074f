"""The registered queries of this subpackage, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge.llm import (
    fingerprint,
    hard_negatives,
    language,
    lexical,
    licenses,
    lines,
    mixing,
    near,
    packing,
    quality_rules,
    secret_scan,
    sql,
    topk,
    toxicity,
)
from topicgauge.llm.common import read, word_count


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edited_fingerprints(read(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of all documents."""
    found = licenses.scan(read(spark, sf_dir))
    span = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"], s["end"]))
    return found.withColumn("spans", F.array_join(span, ","))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document."""
    docs = read(spark, sf_dir)
    sized = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"))
    return mixing.mixed(sized).select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in length buckets and batches."""
    return packing.packed(read(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that several documents repeat."""
    found = lines.dedup(read(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(F.col("kept").cast("binary"), 256)
    return found.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return near.linked(read(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language.identify(read(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.scan(read(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(read(spark, sf_dir), read(spark, sf_dir, "labels"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every fiftieth id."""
    return topk.search(read(spark, sf_dir, "embeddings"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules and the verdict on all documents."""
    found = quality_rules.cleaned(read(spark, sf_dir))
    digest = F.sha2(F.col("cleaned").cast("binary"), 256).alias("cleaned_sha256")
    return found.select(*[c for c in found.columns if c not in ("cleaned", "removed_by")], digest)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.rank(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth id; every seventh has the next label."""
    vectors = hard_negatives.usable(read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in [
        op1_fingerprints,
        op2_licenses,
        op3_language,
        op4_mixing,
        op5_packing,
        op6_line_dedup,
        op7_secrets,
        op8_near_dedup,
        op9_toxicity,
        op10_top_k,
        op11_quality,
        op12_lexical,
        op13_hard_negatives,
    ]
}
SQL: dict[str, str] = {
    "op4_mixing": sql.MIXING,
    "op5_packing": sql.PACKING,
    "op6_line_dedup": sql.LINE_DEDUP,
    "op10_top_k": sql.TOP_K,
    "op11_quality": sql.QUALITY,
    "op12_lexical": sql.LEXICAL,
    "op13_hard_negatives": sql.HARD_NEGATIVES,
}
