"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows that its predecessor kept; its result is written as
Parquet and read again, so that a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.curve_packing import pack_along_curve
from tidegrid.llm.line_runs import drop_repeated_lines
from tidegrid.llm.shared import stage, table
from tidegrid.llm.signature_join import shingle_components
from tidegrid.llm.site_quality import fit_quality, score_quality
from tidegrid.llm.subword_language import fit_language, predict_language


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of being good is one half or more."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("quality_kept").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and a language the model is sure enough of."""
    model = fit_language(docs)
    return predict_language(docs, model).where("NOT lang_rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share (but for one holder)."""
    kept = drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Null ids come after all others.  Where several rows of a group share that id, one of
    them stays: of the least text hash, then of the least hash of all columns.  Documents
    without words are in no group and stay.
    """
    found = stage(shingle_components(docs).select("doc_id", "text_hash", "group_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    groups = (
        found.where("group_id IS NOT NULL").groupBy("group_id")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("group_id").alias("of"), "first")
    )
    members = stage(
        found.join(groups, F.col("group_id") == F.col("of"))
        .groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.max(order == F.col("first")).alias("stays"))
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    gone, again = members.where("NOT stays"), members.where("stays AND rows > 1")
    kept = rows.join(gone.select("doc_id", "text_hash"), same, "left_anti")
    if not again.isEmpty():  # rows alike in id and text
        alike = kept.join(again.select("doc_id", "text_hash"), same, "left_semi")
        one = alike.groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(again.select("doc_id", "text_hash"), same, "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids and a digest; see the operator for the columns."""
    pieces = pack_along_curve(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tokens"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("language ID", language),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("packing", packing),
]

# Trained classifiers and token sequences are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
