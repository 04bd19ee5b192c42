"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of every whole text are column expressions. Boosted trees are grown on a
bounded sample of labelled rows (``sample_rows``, the rows with the smallest hash of their
id), their paths become conjunctive rules, a lasso logistic regression keeps few of them,
and the rules that keep a weight are compiled into one sum of CASE expressions. Scoring is
a projection: no Python, no shuffle.

Null and blank texts have all statistics 0 and are scored like any other. Without labelled
rows of both classes every score is the share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import fit, lasso_logistic, paths
from .common import cut_lineage, pick
from .wordstats import WHITE, count_chars, lines_with_words, strip_chars, words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ["n_words", "mean_word", "symbols", "bars", "shouts", "upper", "digits", "commas", "stops",
            "dup_lines", "lines", "distinct_words", "mean_line"]


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """FEATURES of a text column without nulls; the text is dropped."""
    keep = [c for c in df.columns if c != text]
    t = F.col(text)
    df = df.select(*keep, text, words(t).alias("_w"), lines_with_words(t).alias("_l"))
    per = lambda c, n: F.when(n > 0, c / n).otherwise(0.0)
    n, chars = F.size("_w"), F.char_length(strip_chars(t, WHITE))
    upper = F.octet_length(t) - F.octet_length(F.regexp_replace(t, "[A-Z]+", ""))
    digits = F.octet_length(t) - F.octet_length(F.regexp_replace(t, "[0-9]+", ""))
    return df.select(
        *keep, n.cast("double").alias("n_words"), per(chars, n).alias("mean_word"), per(count_chars(t, "#*$%&<>"), n).alias("symbols"),
        per(count_chars(t, "|"), n).alias("bars"), per(count_chars(t, "!?"), n).alias("shouts"), per(upper, chars).alias("upper"),
        per(digits, chars).alias("digits"), per(count_chars(t, ","), n).alias("commas"), per(count_chars(t, "."), n).alias("stops"),
        per(F.size("_l") - F.size(F.array_distinct("_l")), F.size("_l")).alias("dup_lines"), F.size("_l").cast("double").alias("lines"),
        per(F.size(F.array_distinct("_w")), n).alias("distinct_words"), per(n, F.size("_l")).alias("mean_line"))


def compile_rules(rules: list[tuple], weights: np.ndarray, intercept: float, features: list[str]) -> Column:
    """sigmoid(intercept + sum of weights of the rules that hold), as a column."""
    total = F.lit(float(intercept))
    for rule, w in zip(rules, weights.tolist()):
        if w:
            holds = F.lit(True)
            for j, above, bound in rule:
                holds = holds & (F.col(features[j]) > float(bound) if above else F.col(features[j]) <= float(bound))
            total = total + F.when(holds, float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def rule_matrix(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, bound in rule:
            out[:, k] *= x[:, j] > bound if above else x[:, j] <= bound
    return out


def learn(sample: np.ndarray, labels: np.ndarray, penalty: float = 2e-3) -> tuple[list[tuple], np.ndarray, float]:
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        return [], np.zeros(0), float(np.log(share / (1 - share)))
    rules = paths(fit(sample, labels, trees=40, depth=3, rate=0.2, least=max(5, len(labels) // 1000)))
    x = rule_matrix(sample, rules)
    _, once = np.unique(x, axis=1, return_index=True)  # rules that hold on the same rows
    rules = [rules[i] for i in sorted(once)]
    intercept, weights = lasso_logistic(rule_matrix(sample, rules), labels, penalty)
    return rules, weights, intercept


def quality_scores(docs: DataFrame, labelled: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id",
                   text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; ``labelled`` holds the ids and
    labels that may be learned from."""
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    stats = cut_lineage(with_statistics(src, "text"))
    known = pick(labelled, doc_id=label_id, label=label_col).where("label IS NOT NULL AND doc_id IS NOT NULL")
    sample = (stats.join(known, "doc_id").select(*FEATURES, F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"), "doc_id")
              .orderBy("h", "doc_id", *FEATURES).limit(sample_rows).collect())
    x = np.array([[r[c] for c in FEATURES] for r in sample], float).reshape(-1, len(FEATURES))
    rules, weights, intercept = learn(x, np.array([r["label"] for r in sample], float))
    return (stats.select("doc_id", compile_rules(rules, weights, intercept, FEATURES).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
