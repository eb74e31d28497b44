"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens; each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import op2_lines, op3_mixing, op4_simhash, op9_quality, op10_sentencepiece
from lexmill.llm.common import saved, table, where_computed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = op9_quality.fit(docs, table(spark, sf_dir, "labels"))
    return where_computed(op9_quality.judge(docs, rules), F.col("kept")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in three or more; n_chars follows the text."""
    out = op2_lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return op4_simhash.keep_one_of_each_group(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in training order: a row for each copy that it takes."""
    return op3_mixing.training_order(op3_mixing.mix(docs), COLUMNS).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    out = op10_sentencepiece.encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_tokens", "ids", F.coalesce(F.col("decoded") == F.col("text"), F.lit(True)).alias("round_trip"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("mixing", mixture), ("sentencepiece", tokens)]

#: Learned rules, fingerprints and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
