"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept up to date from signed events
instead of recounts: an insert adds a document and its tokens, a delete takes them away, a
revision takes the old count away and adds the new one, under another tokenizer version if
that changed. Totals are sums, so events may come in any order and batch.

A batch is reduced to its signed sums (map-side first: a hot source is one row per task)
and committed as one folder named by the batch. Committing a batch again replaces that
folder by equal content, so a job that is retried after a lost driver counts nothing twice;
a commit that did not finish leaves no totals behind. Readers add up the committed folders.

Null source, language or version are groups of their own; null texts and texts without
content have no tokens but are documents. Repeated rows count each. Groups whose documents
are all gone are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pick
from .packing import byte_bpe, encode

KEYS = ["source", "lang", "tokenizer"]
EVENT = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"


def token_counts(docs: DataFrame, tokenizers: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", lang_col: str = "lang", skip: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: one row per document and tokenizer version.
    ``skip`` names a language that a version is not asked about."""
    src = pick(docs, doc_id=id_col, source=source_col, lang=lang_col, text=text_col)
    skip = skip or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            langs = batch.column(2).to_pylist()
            for version, path in tokenizers.items():
                bpe = byte_bpe(path)
                rows = [i for i, x in enumerate(langs) if x is None or x != skip.get(version)]
                n = np.array([len(encode(bpe, texts[i] or "")) for i in rows], np.int64)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(take) for i in range(3)], pa.array([version] * len(rows), pa.string()), pa.array(n)],
                    names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    return src.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select("doc_id", *KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).union(inserts(new))


class Rollup:
    """Totals in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, events: DataFrame) -> None:
        delta = events.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def totals(self) -> DataFrame:
        return (self.spark.read.schema("source string, lang string, tokenizer string, docs long, tokens long, batch string").parquet(self.path)
                .groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
                .where("n_docs <> 0 OR n_tokens <> 0"))
