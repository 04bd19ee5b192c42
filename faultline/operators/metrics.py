"""Accuracy, intervals and ranking metrics over predictions and scores."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.stats import hypergeometric_hit
from ..functions.text import collapse_agent, hash_fraction, loose_agent_match, strip
from ..schema import K
from ..session import cut_lineage
from .quality import in_range, slices
from .rules import effective_score, rank_steps
from .sequence import AUTO, dense_position, exact_quantiles, join_files, running_total

SCORERS = ["exact", "tol1", "tol2", "substring"]
DRAWS_PER_TASK = 2_000_000


# --- H1, H2 -----------------------------------------------------------------

def match_predicates(pred_agent="pred_agent", pred_step="pred_step", gold_agent="mistake_agent",
                     gold_step="mistake_step") -> dict[str, Column]:
    """Named match columns; a missing prediction or label is a miss."""
    pa, ps, ga, gs = (F.col(c) for c in (pred_agent, pred_step, gold_agent, gold_step))
    has_agent, has_step = pa.isNotNull() & ga.isNotNull(), ps.isNotNull() & gs.isNotNull()

    def hit(known, cond):
        return known & F.coalesce(cond, F.lit(False))

    exact = hit(has_agent, collapse_agent(pa) == collapse_agent(ga))
    return {
        "agent_exact": exact,
        "agent_substring": hit(has_agent, F.lower(strip(pa)).contains(F.lower(strip(ga)))),
        "step_exact": hit(has_step, ps == gs),
        "step_tol1": hit(has_step, F.abs(ps - gs) <= 1),
        "step_tol2": hit(has_step, F.abs(ps - gs) <= 2),
        "step_substring": hit(has_step, ps.cast("string").contains(gs.cast("string"))),
    }


def judged(preds: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Predictions beside gold, with every match column."""
    gold = labels.select(*K, "mistake_agent", "mistake_step",
                         *[c for c in (keep or []) if c not in preds.columns])
    j = preds.join(gold, K)
    return j.select("*", *[c.alias(n) for n, c in match_predicates().items()])


def score_table(preds: DataFrame, labels: DataFrame, by: list[str] | None = None,
                n_boot: int | None = None, seed: int = 0) -> DataFrame:
    """(by..., subset, scorer, slice): n and agent, step, both accuracy.

    Predictions are first reduced to counts per combination of match columns and
    slice memberships (at most a few hundred rows per method); scorers and slices
    are expanded on those counts.
    """
    by = by or ["method"]
    names = list(match_predicates())
    counts = judged(preds, slices(labels, True), ["slices"]).groupBy(*by, "subset", "slices", *names).agg(
        F.count(F.lit(1)).alias("w"))
    scorer = F.explode(F.array(
        *[F.struct(F.lit(n).alias("scorer"), F.col(a).alias("a"), F.col(st).alias("s"))
          for n, a, st in (("exact", "agent_exact", "step_exact"), ("tol1", "agent_exact", "step_tol1"),
                           ("tol2", "agent_exact", "step_tol2"),
                           ("substring", "agent_substring", "step_substring"))]))
    wide = counts.withColumn("slice", F.explode("slices")).withColumn("m", scorer)
    w = F.col("w")

    def hits(cond):
        return F.sum(F.when(cond, w).otherwise(0))

    out = wide.groupBy(*by, "subset", "m.scorer", "slice").agg(
        F.sum(w).alias("n"), hits(F.col("m.a")).alias("agent_hits"),
        hits(F.col("m.s")).alias("step_hits"), hits(F.col("m.a") & F.col("m.s")).alias("both_hits"))
    for c in ("agent", "step", "both"):
        out = out.withColumn(f"{c}_acc", F.col(f"{c}_hits") / F.col("n"))
    if n_boot:
        out = with_rate_ci(out, "agent_hits", "n", "agent", n_boot, seed)
        out = with_rate_ci(out, "step_hits", "n", "step", n_boot, seed + 1)
    return out


def accuracy(judged_rows: DataFrame, by: list[str], n_boot: int | None = None,
             seed: int = 0) -> DataFrame:
    """Exact agent and step accuracy per group, with optional intervals."""
    g = judged_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("agent_exact").alias("agent_hits"),
        F.count_if("step_exact").alias("step_hits"))
    g = g.withColumn("agent_acc", F.col("agent_hits") / F.col("n")).withColumn(
        "step_acc", F.col("step_hits") / F.col("n"))
    if n_boot:
        g = with_rate_ci(g, "agent_hits", "n", "agent", n_boot, seed)
        g = with_rate_ci(g, "step_hits", "n", "step", n_boot, seed + 1)
    return g


# --- H3: bootstrap ----------------------------------------------------------

def ci_positions(n_boot: int, level: float = 0.95) -> tuple[int, int]:
    """0-based order statistics of the percentile interval."""
    a = (1 - level) / 2
    return max(int(a * n_boot) - 1, 0), min(int((1 - a) * n_boot), n_boot - 1)


def with_rate_ci(cells: DataFrame, hits: str, n: str, out: str, n_boot: int = V.N_BOOT,
                 seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of a hit rate over files.

    Resampling n hit-or-miss files with replacement makes the number of hits a
    binomial draw, so a cell costs ``n_boot`` draws whatever its n. Draws are
    seeded by the cell's own counts.
    """
    lo, hi = ci_positions(n_boot, level)

    @F.pandas_udf("struct<lo double, hi double>")
    def interval(k: pd.Series, size: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(k, size):
            if b is None or b < 2:
                rows.append((None, None))
                continue
            rng = np.random.default_rng([seed, int(a), int(b)])
            means = np.sort(rng.binomial(int(b), a / b, n_boot)) / b
            rows.append((float(means[lo]), float(means[hi])))
        return pd.DataFrame(rows, columns=["lo", "hi"])

    ci = interval(F.col(hits).cast("long"), F.col(n).cast("long"))
    return cells.withColumn("_ci", ci).withColumn(f"{out}_lo", F.col("_ci.lo")).withColumn(
        f"{out}_hi", F.col("_ci.hi")).drop("_ci")


def bootstrap_ci(units: DataFrame, keys: list[str], value: str, n_boot: int = V.N_BOOT,
                 seed: int = 0, level: float = 0.95, rule: str = "package") -> DataFrame:
    """Percentile bootstrap of a mean over units, by explicit hash draws.

    Replicate b draws unit floor(h(seed|b|j) * n) for each of its n places, so any
    engine can repeat it. The ``n_boot x n`` narrow rows stream to the drawn values and are
    summed by replicate before any shuffle; a task makes about ``DRAWS_PER_TASK`` of them. For
    0/1 values use :func:`with_rate_ci`, which needs none.
    """
    u = units.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, value)
    # equal values are interchangeable, so any order among them gives the same draws; written,
    # so that the planner sees its size
    u = cut_lineage(dense_position(u, keys, [value], "_j"))
    sizes = u.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("point"))
    n = F.col("n")
    parts = max(-(-u.count() * n_boot // DRAWS_PER_TASK), u.sparkSession.sparkContext.defaultParallelism)
    places = u.select(*keys, "_j").join(sizes.select(*keys, "n"), keys).filter(n >= 2).repartition(parts, *keys, "_j")
    key = F.concat_ws("|", F.lit(str(seed)), "_b", "_j")
    drawn = (
        places.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .select(*keys, "n", "_b", F.floor(hash_fraction(key) * n).alias("_i"))
    )
    means = (
        drawn.join(u.withColumnRenamed("_j", "_i"), [*keys, "_i"])
        .groupBy(*keys, "n", "_b").agg((F.sum(value) / n).alias("m"))
    )
    if rule == "package":
        lo, hi = ci_positions(n_boot, level)
    else:
        lo, hi = int(0.025 * n_boot), int(0.975 * n_boot)
    # n_boot means per key
    sorted_means = means.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("s"))
    bounds = sorted_means.select(*keys, F.element_at("s", lo + 1).alias("lo"),
                                 F.element_at("s", hi + 1).alias("hi"))
    return sizes.join(bounds, keys, "left")


# --- H4, H5 -----------------------------------------------------------------

def reliability(rows: DataFrame, p: str, label: str, by: list[str], n_bins: int = 10) -> DataFrame:
    """Equal-width reliability bins plus ECE, MCE and Brier on every bin row.

    Bin edges are compared as the fractions i/n_bins (a floor would misplace
    0.3); values outside [0, 1] are in no bin but count in n and Brier.
    """
    edges = np.linspace(0, 1, n_bins + 1)
    v = F.col(p)
    b = F.lit(None).cast("int")
    for i in reversed(range(n_bins)):
        upper = v <= F.lit(float(edges[i + 1])) if i == n_bins - 1 else v < F.lit(float(edges[i + 1]))
        b = F.when((v >= F.lit(float(edges[i]))) & upper, F.lit(i)).otherwise(b)
    y = F.col(label).cast("double")
    cells = rows.withColumn("bin", b).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("frac_pos"),
        F.sum(F.pow(v - y, 2)).alias("_sq"))
    gap = F.abs(F.col("frac_pos") - F.col("mean_p"))
    binned = F.col("bin").isNotNull()
    totals = cells.groupBy(*by).agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(binned, F.col("n") * gap)), F.lit(0.0)).alias("_e"),
        F.coalesce(F.max(F.when(binned, gap)), F.lit(0.0)).alias("mce"),
        F.sum("_sq").alias("_b"))
    grid = totals.select(
        *by, "n_total", (F.col("_e") / F.col("n_total")).alias("ece"), "mce",
        (F.col("_b") / F.col("n_total")).alias("brier"),
        F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return grid.join(cells.filter(binned).drop("_sq"), [*by, "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


def auroc(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Mid-rank AUROC per key; null when only one class is present.

    Equal scores are counted first, then positives are weighed by the negatives
    below them: a running count over distinct scores, split where a key is hot.
    """
    y = F.col(label)
    cells = rows.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    run = running_total(cells, keys, [score], {"_upto": "neg"})
    wins = F.col("pos") * (F.col("_upto") - F.col("neg") / 2)
    return run.groupBy(*keys).agg(
        (F.sum("pos") + F.sum("neg")).alias("n"), F.sum("pos").alias("n_pos"),
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0),
               F.sum(wins) / (F.sum("pos") * F.sum("neg"))).alias("auroc"))


# --- H6 ---------------------------------------------------------------------

def per_file_auroc(scores: DataFrame, labels: DataFrame, use_parse_ok: bool = False,
                   block: int | None = AUTO) -> DataFrame:
    """AUROC of -p for the gold step against the other steps of its file.

    One positive per file, so it is the share of other steps with a higher score
    (ties count half): one join of the gold score back to the steps.
    """
    ok = F.col("parse_ok") if use_parse_ok else F.lit(True)
    n = scores.groupBy(*K).agg(F.count(F.lit(1)).alias("n_steps"))
    gold_files = n.join(labels.select(*K, "mistake_step"), K).filter(in_range())
    usable = scores.filter(ok)
    gold = usable.join(gold_files.withColumnRenamed("mistake_step", "step_idx"), [*K, "step_idx"])
    gold = gold.select(*K, "n_steps", F.col("step_idx").alias("gold_idx"), F.col("p_raw").alias("gold_p"))
    j = join_files(usable.drop("n_steps"), gold, "inner", block)
    other = F.col("step_idx") != F.col("gold_idx")
    win = F.when(F.col("p_raw") > F.col("gold_p"), 1.0).when(
        F.col("p_raw") == F.col("gold_p"), 0.5).otherwise(0.0)
    return j.groupBy(*K).agg(
        F.first("gold_p").alias("gold_p"), F.count_if(other).alias("n_other"),
        F.sum(F.when(other, F.col("p_raw"))).alias("sum_other"),
        (F.sum(F.when(other, win)) / F.count_if(other)).alias("auroc"))


def within_file_auroc(scores: DataFrame, labels: DataFrame, use_parse_ok: bool = False,
                      pooled: bool = True, n_boot: int | None = None,
                      block: int | None = AUTO) -> DataFrame:
    """Per subset: mean within-file AUROC, pooled AUROC, mean score at the gold
    step and elsewhere."""
    per = per_file_auroc(scores, labels, use_parse_ok, block)
    out = per.groupBy("subset").agg(
        F.count("auroc").alias("n_files"), F.avg("auroc").alias("within_file_auroc"),
        F.avg("gold_p").alias("mean_gold"),
        (F.sum("sum_other") / F.sum(F.when(F.col("sum_other").isNotNull(), F.col("n_other"))))
        .alias("mean_other"))
    if pooled:
        n = scores.groupBy(*K).agg(F.count(F.lit(1)).alias("n_steps"))
        files = n.join(labels.select(*K, "mistake_step"), K).filter(in_range())
        s = join_files(scores.filter("parse_ok") if use_parse_ok else scores, files, "inner", block)
        rows = s.select("subset", (-F.col("p_raw")).alias("_s"),
                        (F.col("step_idx") == F.col("mistake_step")).alias("_y"))
        out = out.join(auroc(rows, ["subset"], "_s", "_y").select(
            "subset", F.col("auroc").alias("pooled_auroc")), "subset", "left")
    if n_boot:
        ci = bootstrap_ci(per.select("subset", "auroc"), ["subset"], "auroc", n_boot)
        out = out.join(ci.select("subset", F.col("lo").alias("auroc_lo"),
                                 F.col("hi").alias("auroc_hi")), "subset", "left")
    return out


# --- H7 ---------------------------------------------------------------------

def selection_signal(preds: DataFrame, scores: DataFrame, by: str = "delta") -> DataFrame:
    """Predictions with ``signal``, low = trusted first: the raw score at the pick,
    minus the margin to the runner-up, or the trajectory length."""
    if by == "delta":
        at = scores.select(*K, F.col("step_idx").alias("pred_step"), F.col("p_raw").alias("signal"))
        return preds.join(at, [*K, "pred_step"])
    if by == "margin":
        two = rank_steps(scores, 2).groupBy(*K).agg(
            F.max(F.when(F.col("rank") == 1, F.col("p"))).alias("a"),
            F.max(F.when(F.col("rank") == 2, F.col("p"))).alias("b"))
        m = two.filter(F.col("b").isNotNull()).select(*K, (F.col("a") - F.col("b")).alias("signal"))
        return preds.join(m, K)
    if by == "n_steps":
        n = scores.groupBy(*K).agg(F.count(F.lit(1)).cast("double").alias("signal"))
        return preds.join(n, K)
    raise ValueError(f"unknown selection signal {by!r}")


def risk_coverage(signals: DataFrame, labels: DataFrame, by: list[str] | None = None,
                  fractions: list[float] | None = None) -> DataFrame:
    """Accuracy of the most trusted share of files, per fraction."""
    by = by or ["method"]
    fractions = fractions or V.COVERAGE_FRACTIONS
    j = judged(signals, labels).withColumn(
        "ok", F.col("agent_exact") & F.col("step_exact")).select(*by, *K, "signal", "ok")
    ranked = dense_position(j, by, ["signal", *[k for k in K if k not in by]], "_pos")
    sizes = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_selected"))
    # a report cell per row of `by`
    r = ranked.join(sizes, by)
    cuts = [(f, F.greatest(F.lit(1), F.rint(F.lit(f) * F.col("n_selected"))).cast("long"))
            for f in fractions]
    agg = r.groupBy(*by, "n_selected").agg(*[
        F.count_if(F.col("ok") & (F.col("_pos") < k)).alias(f"h{i}") for i, (_, k) in enumerate(cuts)])
    return agg.select(*by, "n_selected", F.explode(F.array(*[
        F.struct(F.lit(f).alias("fraction"), k.alias("n"), (k / F.col("n_selected")).alias("coverage"),
                 (F.col(f"h{i}") / k).alias("accuracy")) for i, (f, k) in enumerate(cuts)])).alias("e")
    ).select(*by, "n_selected", "e.*")


def selective_prediction(signals: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Does the signal at the pick tell right picks from wrong ones?"""
    by = by or ["method"]
    j = judged(signals, labels).withColumn("ok", F.col("agent_exact") & F.col("step_exact"))
    base = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_selected"), F.count_if("ok").alias("n_correct"),
        F.avg(F.when(F.col("ok"), F.col("signal"))).alias("mean_when_correct"),
        F.avg(F.when(~F.col("ok"), F.col("signal"))).alias("mean_when_wrong"))
    rank = auroc(j.select(*by, (-F.col("signal")).alias("_s"), "ok"), by, "_s", "ok")
    return base.join(rank.select(*by, F.col("auroc").alias("auroc_correct_vs_wrong")), by, "left")


# --- H8, H9 -----------------------------------------------------------------

def disagreement(a: DataFrame, b: DataFrame, strata: DataFrame | None = None) -> DataFrame:
    """Share of files on which two rules differ, overall and per stratum."""
    x = a.select(*K, F.col("pred_step").alias("_s"), F.col("pred_agent").alias("_a"))
    y = b.select(*K, F.col("pred_step").alias("_t"), F.col("pred_agent").alias("_b"))
    j = x.join(y, K)
    if strata is not None:
        j = j.join(strata.select(*K, "stratum"), K, "left").withColumn(
            "stratum", F.array(F.lit("all"), F.coalesce("stratum", F.lit("all"))))
    else:
        j = j.withColumn("stratum", F.array(F.lit("all")))
    counts = j.groupBy("subset", "stratum").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("_s").eqNullSafe(F.col("_t"))).alias("d_step"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("d_agent"))
    return counts.withColumn("stratum", F.explode("stratum")).groupBy("subset", "stratum").agg(
        F.sum("n").alias("n"), (F.sum("d_step") / F.sum("n")).alias("step_disagree"),
        (F.sum("d_agent") / F.sum("n")).alias("agent_disagree"))


def type_strata(preds: DataFrame, scores: DataFrame) -> DataFrame:
    """Type of the picked step as the stratum."""
    at = scores.select(*K, F.col("step_idx").alias("pred_step"), "type_norm")
    return preds.join(at, [*K, "pred_step"], "left").select(
        *K, F.coalesce("type_norm", F.lit("unknown")).alias("stratum"))


def role_strata(preds: DataFrame) -> DataFrame:
    role = F.when(collapse_agent("pred_agent") == "orchestrator", F.lit("orchestrator")).otherwise(
        F.lit("worker"))
    return preds.select(*K, role.alias("stratum"))


def position_table(preds: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Where predictions sit against gold, as a share of trajectory length."""
    by = by or ["method"]
    span = F.col("n_steps") - F.lit(1)
    j = preds.join(labels.select(*K, "n_steps", "mistake_step"), K).filter(
        (F.col("n_steps") > 1) & F.col("pred_step").isNotNull() & F.col("mistake_step").isNotNull()
    ).select(*by, (F.col("pred_step") / span).alias("pred"), (F.col("mistake_step") / span).alias("gold"))
    j = j.withColumn("delta", F.col("pred") - F.col("gold"))
    means = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("gold").alias("gold_mean"), F.avg("pred").alias("pred_mean"),
        F.avg("delta").alias("delta_mean"), F.avg((F.col("delta") > 0).cast("int")).alias("late"),
        F.avg((F.col("pred") < 0.2).cast("int")).alias("pred_first_fifth"),
        F.avg((F.col("gold") < 0.2).cast("int")).alias("gold_first_fifth"))
    for c in ("gold", "pred", "delta"):
        means = means.join(exact_quantiles(j.select(*by, c), by, c, {f"{c}_median": 0.5}), by)
    return means.select(*by, "n", *[F.round(c, 4).alias(c) for c in (
        "gold_mean", "gold_median", "pred_mean", "pred_median", "delta_mean", "delta_median",
        "late", "pred_first_fifth", "gold_first_fifth")])


# --- H10 --------------------------------------------------------------------

def recall_at_k(scores: DataFrame, labels: DataFrame, ks: list[int] | None = None,
                match: str = "collapsed", gold_range: str = "drop",
                block: int | None = AUTO) -> DataFrame:
    """Per (subset, k): gold step / agent among the k lowest steps, agents covered,
    and the matched random controls. ``gold_range='miss'`` keeps files whose gold
    step cannot be picked, as misses."""
    ks = ks or V.RECALL_KS
    s = effective_score(scores).filter(F.col("p").isNotNull())
    same = (lambda g, a: collapse_agent(g) == collapse_agent(a)) if match == "collapsed" else \
        loose_agent_match
    files = file_counts(s, labels, same, block).filter(F.col("n") >= 2)
    if gold_range == "drop":
        files = files.filter((F.col("mistake_step") >= 0) & (F.col("mistake_step") < F.col("n")))
    top = rank_steps(s.select(*K, "step_idx", "agent", "p"), max(ks)).join(files, K)
    hit_s = F.col("step_idx") == F.col("mistake_step")
    hit_a = same("mistake_agent", "agent")
    who = collapse_agent("agent")
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.max(F.when(inside, hit_s)).alias(f"s{k}"), F.max(F.when(inside, hit_a)).alias(f"a{k}"),
                 F.size(F.collect_set(F.when(inside, who))).alias(f"c{k}")]
    per = top.groupBy(*K, "n", "m", "reachable").agg(*aggs)
    long = per.select(*K, F.explode(F.array(*[F.struct(
        F.lit(k).alias("k"), F.col(f"s{k}").cast("int").alias("s"), F.col(f"a{k}").cast("int").alias("a"),
        F.col(f"c{k}").alias("c"),
        F.when(F.col("reachable"), F.least(F.lit(k), F.col("n")) / F.col("n")).otherwise(0.0).alias("rs"),
        hypergeometric_hit("n", "m", F.lit(k)).alias("ra")) for k in ks])).alias("e")).select(*K, "e.*")
    return long.groupBy("subset", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("step_hits"), F.sum("a").alias("agent_hits"),
        F.avg("s").alias("step_recall"), F.avg("a").alias("agent_recall"),
        F.avg("c").alias("agents_covered"), F.avg("rs").alias("random_step"),
        F.avg("ra").alias("random_agent"))


def file_counts(s: DataFrame, labels: DataFrame, same, block: int | None = AUTO) -> DataFrame:
    """Per file: n scored steps, m owned by the gold agent, whether gold is among them."""
    sizes = s.groupBy(*K).agg((F.max("step_idx") + 1).alias("n_steps"))
    gold = sizes.join(labels.select(*K, "mistake_step", "mistake_agent"), K)
    return join_files(s.select(*K, "step_idx", "agent"), gold, "inner", block).groupBy(
        *K, "mistake_step", "mistake_agent").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same("mistake_agent", "agent")).alias("m"),
        F.max(F.col("step_idx") == F.col("mistake_step")).alias("reachable"))
