"""Leave-one-file-out normalization: folds, thresholds, z-scores, field checks.

Each file is scored under statistics fitted on every *other* file of its subset.
Means and variances come from the subset totals minus the file's own moments, so
all folds cost one aggregation instead of one refit per file.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.stats import coefficient_of_variation, z_score
from ..functions.text import half_even
from ..schema import K
from .fold_index import BLOCKS, FOLDS_PER_TASK, POOLED, best_cuts, objective_of
from .metrics import auroc
from .sequence import AUTO, exact_quantiles, join_files, resolve


class NormalizationError(RuntimeError):
    """Statistics that cannot be fitted or applied."""


def step_labels(scores: DataFrame, labels: DataFrame, policy: str = "prefix",
                block: int | None = AUTO) -> DataFrame:
    """Derived ``correct`` per step. ``prefix``: steps up to the labelled one,
    correct before it. ``point``: every step, correct except the labelled one."""
    if policy not in ("prefix", "point"):
        raise NormalizationError(f"unknown label policy {policy!r}")
    j = join_files(scores.drop("n_steps"), labels.select(*K, "n_steps", "mistake_step"), "inner", block)
    if policy == "prefix":
        return j.filter(F.col("step_idx") <= F.col("mistake_step")).withColumn(
            "correct", F.col("step_idx") < F.col("mistake_step"))
    return j.withColumn("correct", F.col("step_idx") != F.col("mistake_step"))


def fit_loo_stats(labelled: DataFrame, labels: DataFrame,
                  min_per_type: int = V.MIN_PER_TYPE_N) -> DataFrame:
    """One row per (held-out file, cell): mean, population sd and n over the other
    files; the cell is a step type or '' for all types pooled.

    The totals table has at most types + 1 rows per subset.
    """
    rows = labelled.select(*K, "p_raw", F.explode(F.array("type_norm", F.lit(POOLED))).alias("cell"))
    moments = [F.count("p_raw").alias("n"), F.avg("p_raw").alias("mean"),
               (F.var_pop("p_raw") * F.count("p_raw")).alias("m2")]
    own = rows.groupBy(*K, "cell").agg(*moments)
    # the totals are merged from the files' moments: the rows are read once
    part = F.col("n") * F.col("mean")
    total = own.filter("n > 0").groupBy("subset", "cell").agg(
        F.sum("n").alias("tn"), (F.sum(part) / F.sum("n")).alias("tm"),
        F.sum("m2").alias("within"), F.sum(part * F.col("mean")).alias("squares")).select(
        "subset", "cell", "tn", "tm",
        (F.col("within") + F.greatest(F.col("squares") - F.col("tn") * F.col("tm") * F.col("tm"), F.lit(0.0))).alias("tq"))
    files = labels.groupBy("subset").agg((F.count(F.lit(1)) - 1).alias("n_train_files"))
    grid = (
        labels.select(*K).join(total, "subset").join(files, "subset")
        .filter(F.col("n_train_files") >= 1)
    )
    j = grid.join(own, [*K, "cell"], "left")
    n_own, m_own = F.coalesce("n", F.lit(0)), F.coalesce("mean", F.lit(0.0))
    n = F.col("tn") - n_own
    mean = (F.col("tn") * F.col("tm") - n_own * m_own) / n
    shift = n_own * n / F.col("tn") * F.pow(m_own - mean, 2)
    m2 = F.greatest(F.col("tq") - F.coalesce("m2", F.lit(0.0)) - shift, F.lit(0.0))
    enough = F.when(F.col("cell") == POOLED, F.lit(1)).otherwise(F.lit(min_per_type))
    return j.filter(n >= enough).select(
        *K, "cell", mean.alias("mean"), F.sqrt(m2 / n).alias("sd"), n.cast("bigint").alias("n"),
        "n_train_files")


def require_folds(labels: DataFrame) -> None:
    """Leave-one-out needs two files per subset."""
    short = labels.groupBy("subset").count().filter("count < 2").collect()  # one row per subset
    if short:
        raise NormalizationError(f"leave-one-out needs at least 2 files: {short}")


def fold_map(stats: DataFrame) -> DataFrame:
    """(subset, file_id, stats): all cells of a fold as one map (at most six)."""
    return stats.groupBy(*K).agg(F.map_from_entries(F.collect_list(F.struct(
        "cell", F.struct("mean", "sd")))).alias("stats"))


def _cell_stats(typed: bool) -> Column:
    pooled = F.try_element_at("stats", F.lit(POOLED))
    return F.coalesce(F.try_element_at("stats", F.col("type_norm")), pooled) if typed else pooled


def apply_folds(scores: DataFrame, stats: DataFrame, typed: bool = True, strict: bool = True,
                block: int | None = AUTO) -> DataFrame:
    """``p_norm`` under the file's own fold. A file without one is an error: its raw scores
    would be ranked beside z-scores. With ``strict=False`` its ``p_norm`` stays null, and
    :func:`scale_counts` tells how many rows are on which scale."""
    folds = fold_map(stats)
    if strict:
        missing = scores.select(*K).distinct().join(folds, K, "left_anti").limit(3).collect()
        if missing:
            raise NormalizationError(f"no fold statistics, for example {missing}")
    block = resolve(scores, block)
    if block:
        sizes = scores.groupBy(*K).agg((F.max("step_idx") + 1).alias("n_steps"))
        s = join_files(scores.drop("n_steps"), sizes.join(folds, K, "left"), "inner", block)
    else:
        s = scores.drop("n_steps").join(folds, K, "left")
    c = _cell_stats(typed)
    return s.withColumn("p_norm", z_score("p_raw", c["mean"], c["sd"])).drop("stats", "n_steps")


def scale_counts(normed: DataFrame) -> DataFrame:
    """Rows and files of each subset on the normalized and on the raw scale."""
    return normed.groupBy("subset", F.col("p_norm").isNotNull().alias("normalized")).agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_distinct("file_id").alias("n_files"))


# --- thresholds -------------------------------------------------------------

def _best_cut(cells: DataFrame, keys: list[str], objective: str) -> DataFrame:
    """Best threshold from per-cell counts.

    Candidates are z rounded to 3 places, so all z between two candidates share a
    cell. A cell holds (``ok``, ``bad``) and how many of each lie below its own
    candidate; only cells are ordered, never rows.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    c = (
        cells.filter(F.col("ok") + F.col("bad") > 0)
        .withColumn("tp", F.coalesce(F.sum("bad").over(before), F.lit(0)) + F.col("lo_bad"))
        .withColumn("fp", F.coalesce(F.sum("ok").over(before), F.lit(0)) + F.col("lo_ok"))
        .withColumn("n_bad", F.sum("bad").over(whole)).withColumn("n_ok", F.sum("ok").over(whole))
    )
    tp, fp = F.col("tp"), F.col("fp")
    v = objective_of(tp, fp, F.col("n_ok"), F.col("n_bad"), objective)
    both = (F.col("n_bad") > 0) & (F.col("n_ok") > 0)
    best = c.groupBy(*keys).agg(
        F.max(F.when(both, F.struct(v.alias("v"), (-F.col("k")).alias("nk")))).alias("b"))
    return best.select(*keys, F.coalesce(-F.col("b.nk") / F.lit(1000.0), F.lit(0.0)).alias("threshold"))


def _cells(rows: DataFrame, keys: list[str], z: str = "z", ok: str = "ok", bad: str = "bad") -> DataFrame:
    k = F.rint(F.col(z) * 1000.0)
    below = F.col(z) < k / 1000.0
    return rows.withColumn("k", k.cast("long")).withColumn("_below", below).groupBy(*keys, "k").agg(
        F.sum(ok).alias("ok"), F.sum(bad).alias("bad"),
        F.sum(F.when(F.col("_below"), F.col(ok)).otherwise(0)).alias("lo_ok"),
        F.sum(F.when(F.col("_below"), F.col(bad)).otherwise(0)).alias("lo_bad"))


def choose_threshold(rows: DataFrame, keys: list[str], z: str = "z", correct: str = "correct",
                     objective: str = "f1") -> DataFrame:
    """Crossing threshold per key that best separates incorrect (low z) steps.
    One class only: 0."""
    counted = rows.withColumn("_ok", F.col(correct).cast("int")).withColumn(
        "_bad", 1 - F.col("_ok"))
    return _best_cut(_cells(counted, keys, z, "_ok", "_bad"), keys, objective)


def fit_loo_thresholds(labelled: DataFrame, stats: DataFrame, objective: str = "f1",
                       bins: int | None = None, blocks: int = BLOCKS,
                       folds_per_task: int = FOLDS_PER_TASK) -> DataFrame:
    """Thresholds of every fold: cell '' over all types, plus one per typed cell.

    The training z of a row depends on the fold. All folds ask one index of the scores
    (:mod:`.fold_index`) that skips most of it by bounds; one plan at every size, and exact.
    Rows without a score are left out. ``bins`` rounds scores to that many steps of the unit
    interval, which bounds the index whatever the corpus.
    """
    rows = labelled
    if bins:
        rows = rows.withColumn("p_raw", F.rint(F.col("p_raw") * bins) / F.lit(float(bins)))
    return best_cuts(rows, fold_map(stats), objective, blocks, folds_per_task)


def thresholds_for(thresholds: DataFrame, typed: bool = True) -> DataFrame:
    """(subset, file_id, thresholds map); the '' entry is the fold's global one."""
    t = thresholds if typed else thresholds.filter(F.col("cell") == POOLED)
    return t.groupBy(*K).agg(F.map_from_entries(F.collect_list(F.struct("cell", "threshold")))
                             .alias("thresholds"))


def fold_stability(stats: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Variation of thresholds and statistics across folds, per subset and cell."""
    t = thresholds.groupBy("subset", "cell").agg(
        F.count(F.lit(1)).alias("n_thresholds"), F.avg("threshold").alias("threshold_mean"),
        F.stddev_pop("threshold").alias("threshold_sd"), F.min("threshold").alias("threshold_min"),
        F.max("threshold").alias("threshold_max"),
        coefficient_of_variation("threshold").alias("_cv"))
    s = stats.groupBy("subset", "cell").agg(
        F.count(F.lit(1)).alias("n_folds"), coefficient_of_variation("mean").alias("mean_cv"),
        coefficient_of_variation("sd").alias("sd_cv"))
    typed = F.col("cell") != POOLED
    return s.join(t, ["subset", "cell"], "left").withColumn(
        "threshold_cv", F.when(~typed | (F.col("n_thresholds") > 1), F.col("_cv"))).drop("_cv")


def worst_threshold_cv(stability: DataFrame) -> DataFrame:
    """The cell whose threshold moves most across folds."""
    name = F.concat("subset", F.lit("/"), F.when(F.col("cell") == POOLED, F.lit("global"))
                    .otherwise(F.col("cell")))
    return stability.filter(F.col("threshold_cv").isNotNull()).agg(
        F.max_by(name, F.struct("threshold_cv", name)).alias("cell"),
        F.max("threshold_cv").alias("cv"))


# --- field sanity -----------------------------------------------------------

def field_sanity(scores: DataFrame, labels: DataFrame, policy: str = "prefix") -> DataFrame:
    """Distribution of the raw field per (subset, type) with degeneracy flags."""
    cell = ["subset", "type_norm"]
    p = F.col("p_raw")
    saturated = (p <= V.SATURATION_EPS) | (p >= 1 - V.SATURATION_EPS)
    basic = scores.groupBy(*cell).agg(
        F.count("p_raw").alias("n"), F.avg("p_raw").alias("mean"), F.stddev_pop("p_raw").alias("sd"),
        F.min("p_raw").alias("min"), F.max("p_raw").alias("max"),
        F.avg(saturated.cast("int")).alias("saturated_fraction"),
        F.countDistinct(half_even("p_raw", 1_000_000)).alias("n_distinct"))
    quant = exact_quantiles(scores.select(*cell, "p_raw"), cell, "p_raw",
                            {"p05": 0.05, "median": 0.5, "p95": 0.95})
    labelled = step_labels(scores, labels, policy)
    rank = auroc(labelled, cell, "p_raw", "correct").select(
        *cell, F.col("n").alias("n_labelled"), F.col("auroc").alias("auroc_vs_labels"))
    sized = F.col("n") >= V.MIN_CELL_N
    problems = F.array_compact(F.array(
        F.when(sized & (F.col("sd") < V.DEGENERATE_SD), F.lit("constant")),
        F.when(sized & (F.col("n_distinct") <= 2), F.lit("near-binary")),
        F.when(F.col("saturated_fraction") >= V.SATURATION_FRACTION, F.lit("saturated"))))
    return (
        basic.join(quant, cell).join(rank, cell, "left")
        .withColumn("undersized", ~sized)
        .withColumn("degenerate", F.array_join(problems, ", "))
    )
