"""The corpus pipeline: raw documents to token ids, in five stages over the operators of verity.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm import bpe, decontam, quality, simhash, substring
from verity.llm.common import fresh, materialize
from verity.llm.queries import table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Empty and null texts score as the bias does."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; a row without an id only where the group has none."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; a document that loses all its words goes."""
    n = fresh(docs.columns, "n_removed")
    cut = substring.dedup_texts(docs, window=50).where(
        (F.coalesce(F.col(n), F.lit(0)) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    chars = F.when(F.col(n) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("substring", substring_stage),
          ("decontamination", decontamination_stage), ("encoding", encoding_stage)]

ORACLE_SQL = None     # fingerprints, trained scores and tokens have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
