"""End-to-end flows composed from the operators."""

from pyspark.sql import DataFrame, functions as F

from ..operators.metrics import (
    disagreement, position_table, risk_coverage, score_table, selection_signal,
    selective_prediction, type_strata, within_file_auroc,
)
from ..operators.normalize import (
    apply_folds, fit_loo_stats, fit_loo_thresholds, fold_stability, require_folds, step_labels,
    thresholds_for,
)
from ..operators.reports import fallback_rate
from ..operators.rules import PRIMARY, ablation_methods, attribute
from ..operators.scoring import delta_field


def normalize_scores(scores: DataFrame, labels: DataFrame, policy: str = "prefix",
                     typed: bool = True) -> DataFrame:
    """Scores with ``p_norm`` under each file's own leave-one-out fold. Subsets of one file
    and files without a fold are errors."""
    require_folds(labels)
    stats = fit_loo_stats(step_labels(scores, labels, policy), labels)
    return apply_folds(scores, stats, typed)


def attribution_run(scores: DataFrame, labels: DataFrame, methods: list[str] | None = None,
                    policy: str = "prefix", bins: int | None = None,
                    n_boot: int | None = None) -> dict[str, DataFrame]:
    """Fit, normalize, attribute and evaluate one score field."""
    methods = methods or [PRIMARY, *ablation_methods()]
    require_folds(labels)
    labelled = step_labels(scores, labels, policy)
    stats = fit_loo_stats(labelled, labels)
    thresholds = fit_loo_thresholds(labelled, stats, bins=bins)
    normed = apply_folds(scores, stats)
    preds = attribute(normed, methods, thresholds_for(thresholds))
    primary = preds.filter(F.col("method") == PRIMARY)
    other = preds.filter(F.col("method") == "first_crossing")
    return {
        "predictions": preds,
        "accuracy": score_table(preds, labels, n_boot=n_boot),
        "positions": position_table(preds, labels),
        "fallback": fallback_rate(preds),
        "disagreement": disagreement(primary, other, type_strata(primary, normed)),
        "stability": fold_stability(stats, thresholds),
    }


def primary_accuracy(scores: DataFrame, labels: DataFrame,
                     methods: list[str] | None = None) -> DataFrame:
    """Flagship: leave-one-out normalization, primary rule and threshold-free
    ablations, accuracy by scorer and slice."""
    normed = normalize_scores(scores, labels)
    preds = attribute(normed, methods or [PRIMARY, "argmin", "changepoint"])
    return score_table(preds, labels)


def shift_run(base: DataFrame, arm: DataFrame, labels: DataFrame,
              method: str = PRIMARY) -> dict[str, DataFrame]:
    """Shift field between two arms, its step-level signal, and whether the shift
    at the pick predicts a right pick."""
    delta = delta_field(base, arm)
    normed = normalize_scores(delta, labels)
    preds = attribute(normed, [method])
    signals = selection_signal(preds, delta)
    return {
        "field": delta,
        "step_level": within_file_auroc(delta, labels, use_parse_ok=True),
        "file_level": selective_prediction(signals, labels),
        "risk_coverage": risk_coverage(signals, labels),
    }
