"""Training-data pipeline over ``documents``: quality rules, near duplicates, benchmark
decontamination, personal data, packing. Part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import configure, scratch_path, table
from faultline.llm.decontaminate import drop_contaminated
from faultline.llm.jaccard_join import jaccard_components
from faultline.llm.packing import pack_documents
from faultline.llm.pii import redact
from faultline.llm.quality_rules import keep_good
from faultline.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    configure(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    configure(spark)
    group = jaccard_components(docs, k=5, percent=75)
    first = group.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    # rows that repeat an id are rare: only then the texts move once more
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), k=5, percent=75)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    configure(spark)
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    configure(spark)
    return pack_documents(docs, tokenizer_path(), 2048, keep_ids=False)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]

#: boosted trees and byte-level tokens cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
