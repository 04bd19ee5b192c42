"""Quality rules with host-level verdicts, in column expressions and one aggregation.

A document fails for itself if a hard rule fires (too short, or most words repeat). Softer
rules have a severe and a mild bound. How often documents of a host fail any mild rule is
aggregated by host, and the rates are shrunk towards each other with a beta prior fitted
to the hosts' own rates (method of moments), so a host with few documents is not judged
by them alone. Host verdicts are joined back: on a host whose shrunk rate is high the mild
bounds decide, elsewhere the severe ones, and a document that breaks no rule is kept
everywhere.

Nulls and blank texts have no words and fail. A null host is a host of its own. Repeated
rows count and are judged each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, pick
from .wordstats import with_counts

#: (mild, severe) bounds: symbols a word, repeated lines a hundred words, letters a word
SYMBOLS_A_WORD = (0.10, 0.30)
DUP_LINES_A_WORD = (0.02, 0.05)
LETTERS_A_WORD = ((3.0, 10.0), (2.0, 16.0))
HOST_LIMIT = 0.5


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def soft_failures(level: int) -> Column:
    """How many soft rules fire at the mild (0) or severe (1) bound. Bounds are compared in
    whole numbers: value > bound * words."""
    n = F.col("n_words")
    per = lambda c, x: 1000 * F.col(c) > int(round(1000 * x)) * n
    low, high = LETTERS_A_WORD[level]
    rules = [per("n_symbols", SYMBOLS_A_WORD[level]), per("n_dup_lines", DUP_LINES_A_WORD[level]),
             (1000 * F.col("word_chars") < int(1000 * low) * n) | per("word_chars", high)]
    return sum((r.cast("int") for r in rules), F.lit(0))


def host_verdicts(stats: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host -> strict: whether its shrunk failure rate exceeds the limit."""
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("f"))
    prior = (hosts.select("n", (F.col("f") / F.col("n")).alias("r"))
             .agg(F.count(F.lit(1)).alias("k"), F.avg("r").alias("m"), F.var_pop("r").alias("v"), F.avg(1 / F.col("n")).alias("inv")))
    m, between = F.col("m"), F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv"), F.lit(1e-6))
    strength = F.greatest(m * (1 - m) / between - 1, F.lit(1.0))
    prior = prior.select(m.alias("m"), strength.alias("s"))
    # one row of prior for every host
    return (hosts.join(F.broadcast(prior), F.lit(True))
            .select("host", ((F.col("f") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s")) > limit).alias("strict")))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, kept, and strict (the host's verdict)."""
    src = pick(docs, doc_id=id_col, host=host_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    stats = (with_counts(src, "text").withColumn("base_failed", base_failed())
             .withColumn("mild", soft_failures(0)).withColumn("severe", soft_failures(1))
             .withColumn("failed", (F.col("base_failed") | (F.col("mild") > 0)).cast("int")))
    stats = cut_lineage(stats)
    hosts = host_verdicts(stats)
    falls = F.when(F.coalesce("strict", F.lit(False)), F.col("mild") > 0).otherwise(F.col("severe") > 0)
    return (stats.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~falls).alias("kept"), F.coalesce("strict", F.lit(False)).alias("strict")))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    good = quality_verdicts(docs, id_col, text_col, host_col).where("kept").select(F.col("doc_id").alias("_good")).distinct()
    return docs.join(good, F.col(id_col).eqNullSafe(F.col("_good")), "left_semi")
