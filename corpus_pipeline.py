"""From raw documents to token ids in five stages, each over all that the one before kept.

``documents`` -> quality classifier -> line dedup -> MinHash near-dedup -> benchmark
decontamination -> BPE ids. A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``, further ones too, whatever their names. Each stage says what becomes of NULLs, empty
texts and rows that repeat; an empty table stays empty in all of them, very long texts are worked on whole, in pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from sedimenta.llm.common import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good and not toxic. NULL and empty texts are judged as documents without
    words, NULL metadata is a value of its own, NULL ids are kept or not like others; rows that repeat fare alike. Without labels all stay."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later occurrences of three lines in a row. NULL texts and those of fewer than three lines stay as they are; one that
    loses all lines stays with an empty text; NULL ids come last in the order; rows that repeat with id and text count as one occurrence."""
    return line_dedup.line_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id. Rows with NULL id or text stay; empty texts equal each other; rows that
    repeat with their id fare alike."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. NULL and empty texts stay, whatever their ids; rows that repeat fare alike;
    items that are NULL or without words match nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, input_ids, n_tokens, round_trip`` of what is left: NULL for NULL texts, no ids for empty ones; NULL ids of documents
    are returned as they are, rows that repeat are encoded again."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: A trained classifier and BPE can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one but the last returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
