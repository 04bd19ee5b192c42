"""Attribution rules: step scores -> one accusation (agent, step) per trajectory.

A lower score is more suspicious. Ties always go to the earliest step. Every
rule reads the same frame (one shuffle of the steps on trajectory and block) and
ends in one map-side combined aggregation per trajectory, so adding a rule adds
columns to that aggregation, not a job.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import strip
from ..schema import K
from .sequence import AUTO, block_window, dense_position, file_frame, join_files, resolve

PRIMARY = "changepoint_single"
THRESHOLD_FREE = ["changepoint_single", "argmin", "changepoint", "relative_crossing"]
THRESHOLD_DEPENDENT = ["first_crossing", "agent_first"]
WITHDRAWN = ["agent_first"]
PREDICTION_COLUMNS = [
    *K, "method", "pred_step", "pred_agent", "score", "fallback", "reason",
    "split", "contrast", "gap", "cut", "crossed",
]


def ablation_methods() -> list[str]:
    """Every reported rule other than the primary one."""
    return ["first_crossing", "argmin", "changepoint"] + [
        f"relative_crossing@{k}" for k in V.RELATIVE_K_SWEEP
    ]


def resolve_method(name: str) -> tuple[str, float | None]:
    base, sep, arg = name.partition("@")
    known = [*THRESHOLD_FREE, *THRESHOLD_DEPENDENT, "mean_crossing"]
    if base not in known:
        raise KeyError(f"unknown attribution rule {name!r}; known: {sorted(known)}")
    if sep and base != "relative_crossing":
        raise KeyError(f"rule {base!r} takes no parameter, got {name!r}")
    if base == "relative_crossing":
        return base, float(arg) if sep else V.RELATIVE_K
    return base, None


def effective_score(scores: DataFrame) -> DataFrame:
    """``p``: the normalized score where there is one, else the raw score."""
    if "p" in scores.columns:
        return scores
    if "p_norm" in scores.columns:
        return scores.withColumn("p", F.coalesce("p_norm", "p_raw"))
    return scores.withColumn("p", F.col("p_raw"))


def threshold_for(type_norm="type_norm", thresholds="thresholds") -> Column:
    """Per-type threshold from a map whose ``''`` entry is the default."""
    m = F.col(thresholds)
    return F.coalesce(
        F.try_element_at(m, F.col(type_norm)), F.try_element_at(m, F.lit("")), F.lit(0.5)
    )


def _with_threshold(scores: DataFrame, threshold, block: int) -> DataFrame:
    if isinstance(threshold, DataFrame):
        sizes = scores.groupBy(*K).agg((F.max("step_idx") + 1).alias("n_steps"))
        files = sizes.join(threshold.select(*K, "thresholds"), K, "left")
        joined = join_files(scores, files, "inner", block).drop("n_steps")
        return joined.withColumn("thr", threshold_for()).drop("thresholds")
    if isinstance(threshold, dict):
        m = F.create_map(*[F.lit(x) for kv in threshold.items() for x in kv])
        return scores.withColumn("thr", F.coalesce(
            F.try_element_at(m, F.col("type_norm")), F.lit(float(threshold.get("", 0.5)))))
    return scores.withColumn("thr", F.lit(float(threshold)))


def regime_columns(frame: DataFrame, min_seg: int = V.MIN_SEG,
                   block: int | None = None) -> DataFrame:
    """Mean gap and contrast of splitting the trajectory right before each step.

    Uses sums of the *centred* score before the step; with a zero total, the
    sums after it are their negatives.
    """
    order = block_window(block)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("p") - F.col("mean")
    k, n = F.col("k"), F.col("n")
    f = (
        frame.withColumn("_c", c)
        .withColumn("k", F.col("n_carry") + F.row_number().over(order) - 1)
        .withColumn("_cs", F.col("c_carry") + F.coalesce(F.sum("_c").over(before), F.lit(0.0)))
        .withColumn("_cq", F.col("q_carry") + F.coalesce(
            F.sum(F.col("_c") * F.col("_c")).over(before), F.lit(0.0)))
    )
    inside = (k >= min_seg) & (k <= n - min_seg)
    cs, cq = F.col("_cs"), F.col("_cq")
    gap = cs / k + cs / (n - k)
    spread = F.greatest(F.col("m2") - cs * cs / k - cs * cs / (n - k), F.lit(0.0)) / n
    sd = F.greatest(F.sqrt(spread), F.lit(V.CONTRAST_SD_FLOOR) * F.col("sd"))
    contrast = gap / (sd * F.sqrt(F.lit(1.0) / k + F.lit(1.0) / (n - k)))
    return (
        f.withColumn("gap", F.when(inside, gap))
        .withColumn("contrast", F.when(inside & (F.col("sd") > V.NO_VARIATION_SD), contrast))
        .drop("_c", "_cs", "_cq")
    )


def _pick(cond: Column | None = None) -> Column:
    """First step (in order) that satisfies a condition."""
    s = F.struct("step_idx", "agent", "p")
    return F.min(s if cond is None else F.when(cond, s))


def _lowest(cond: Column | None = None) -> Column:
    s = F.struct("p", "step_idx", "agent")
    return F.min(s if cond is None else F.when(cond, s))


def _entry(method, at, fallback=None, reason=None, split=None, contrast=None, gap=None,
           cut=None, crossed=None) -> Column:
    def lit(c, kind):
        return F.lit(None).cast(kind) if c is None else c.cast(kind)

    return F.struct(
        F.lit(method).alias("method"),
        at["step_idx"].cast("int").alias("pred_step"),
        at["agent"].alias("pred_agent"),
        at["p"].alias("score"),
        lit(F.lit(False) if fallback is None else fallback, "boolean").alias("fallback"),
        lit(reason, "string").alias("reason"),
        lit(split, "int").alias("split"),
        lit(contrast, "double").alias("contrast"),
        lit(gap, "double").alias("gap"),
        lit(cut, "double").alias("cut"),
        lit(crossed, "boolean").alias("crossed"),
    )


def _or(found: Column, low: Column) -> Column:
    """The found step, or the lowest-scoring one."""
    view = lambda s: F.struct(s["step_idx"].alias("step_idx"), s["agent"].alias("agent"),
                              s["p"].alias("p"))
    return F.when(found.isNotNull(), view(found)).otherwise(view(low))


def attribute(scores: DataFrame, methods: list[str] | None = None, threshold=0.0, *,
              min_seg: int = V.MIN_SEG, min_contrast: float = V.MIN_CONTRAST,
              boundary_fallback: bool = True, block: int | None = AUTO) -> DataFrame:
    """Run rules over every trajectory; one row per (trajectory, method).

    ``threshold`` is a number, a dict by step type with ``''`` as default, or a
    table ``(subset, file_id, thresholds map)`` with each file's own thresholds.
    """
    methods = methods or [PRIMARY, *ablation_methods()]
    resolved = {m: resolve_method(m) for m in methods}
    bases = {b for b, _ in resolved.values()}
    s = effective_score(scores).filter(F.col("p").isNotNull())
    block = resolve(s, block)
    keep = [*K, "step_idx", "agent", "p"]
    if bases & set(THRESHOLD_DEPENDENT):
        s = _with_threshold(s, threshold, block)
        keep.append("thr")
    s = s.select(*keep)

    out = None
    wide_methods = [m for m in methods if resolved[m][0] != "agent_first"]
    if wide_methods:
        out = _wide_rules(s, wide_methods, resolved, min_seg, min_contrast,
                          boundary_fallback, block)
    if "agent_first" in bases:
        af = agent_first(s)
        out = af if out is None else out.unionByName(af)
    return out


def _wide_rules(s, methods, resolved, min_seg, min_contrast, boundary_fallback, block):
    bases = {resolved[m][0] for m in methods}
    needs_frame = bases & {"relative_crossing", "mean_crossing", "changepoint", PRIMARY}
    aggs = [_lowest().alias("low")]
    frame = s
    if needs_frame:
        frame = file_frame(s, "p", block=block)
        if bases & {"changepoint", PRIMARY}:
            frame = regime_columns(frame, min_seg, block)
        aggs += [F.first("n").alias("n"), F.first("sd").alias("sd"), F.first("mean").alias("mean")]
    for m in methods:
        base, k = resolved[m]
        if base == "first_crossing":
            aggs.append(_pick(F.col("p") < F.col("thr")).alias("fc"))
        elif base == "mean_crossing":
            aggs.append(_pick(F.col("p") < F.col("mean")).alias("mc"))
        elif base == "relative_crossing":
            cut = F.col("mean") - F.lit(k) * F.col("sd")
            aggs.append(_pick((F.col("sd") > 0) & (F.col("p") < cut)).alias(f"rc_{m}"))
        elif base == "changepoint":
            aggs.append(F.max(F.when(F.col("gap").isNotNull(), F.struct(
                "gap", (-F.col("k")).alias("nk"), "step_idx", "agent", "p"))).alias("cp"))
        elif base == PRIMARY:
            aggs.append(F.max(F.when(F.col("contrast").isNotNull(), F.struct(
                "contrast", (-F.col("k")).alias("nk"), "step_idx", "agent", "p"))).alias("cps"))
    wide = frame.groupBy(*K).agg(*aggs)

    low = F.col("low")
    entries = []
    for m in methods:
        base, k = resolved[m]
        if base == "argmin":
            entries.append(_entry(m, low))
        elif base in ("first_crossing", "mean_crossing"):
            hit = F.col("fc" if base == "first_crossing" else "mc")
            entries.append(_entry(m, _or(hit, low), fallback=hit.isNull(),
                                  crossed=hit.isNotNull()))
        elif base == "relative_crossing":
            hit = F.col(f"`rc_{m}`")
            flat = F.col("sd") <= 0
            entries.append(_entry(
                m, _or(hit, low), fallback=hit.isNull(),
                reason=F.when(flat, F.lit("degenerate")), crossed=hit.isNotNull(),
                cut=F.when(~flat, F.col("mean") - F.lit(k) * F.col("sd"))))
        elif base == "changepoint":
            cp = F.col("cp")
            entries.append(_entry(
                m, _or(cp, low), fallback=cp.isNull(),
                reason=F.when(cp.isNull(), F.lit("degenerate")),
                split=-cp["nk"], gap=cp["gap"]))
        elif base == PRIMARY:
            cps = F.col("cps")
            split, contrast = -cps["nk"], cps["contrast"]
            edge = (split == min_seg) | (split == F.col("n") - min_seg)
            reason = F.when(F.col("n") < 2 * min_seg, F.lit("too_short")).when(
                F.col("sd") <= V.NO_VARIATION_SD, F.lit("no_variation"))
            if boundary_fallback:
                reason = reason.when(edge, F.lit("boundary"))
            reason = reason.when(contrast < min_contrast, F.lit("low_contrast"))
            entries.append(_entry(
                m, _or(F.when(reason.isNull(), cps), low), fallback=reason.isNotNull(),
                reason=reason, split=split, contrast=contrast))
    return wide.select(*K, F.explode(F.array(*entries)).alias("e")).select(*K, "e.*")


def agent_first(s: DataFrame) -> DataFrame:
    """Agent whose best step is still worst, then the first crossing inside it."""
    per_agent = s.groupBy(*K, "agent").agg(
        F.max("p").alias("top"), F.min("step_idx").alias("first_idx"),
        _pick(F.col("p") < F.col("thr")).alias("hit"), _lowest().alias("low"),
    )
    worst = per_agent.groupBy(*K).agg(
        F.min(F.struct("top", "first_idx", "hit", "low")).alias("w"))
    hit, low = F.col("w.hit"), F.col("w.low")
    e = _entry("agent_first", _or(hit, low), crossed=hit.isNotNull())
    return worst.select(*K, e.alias("e")).select(*K, "e.*")


# --- agent-level rules ------------------------------------------------------

TWO_STAGE_THRESHOLDS = ["mean", "median", "mean-0.5sd", "mean-1sd"]


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median per key by position, for groups of any size."""
    ranked = dense_position(df.select(*keys, value, "step_idx"), keys, [value, "step_idx"], "_pos")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    mid = sizes.select(*keys, F.explode(F.array_distinct(F.array(
        F.floor((F.col("_n") - 1) / 2).cast("int"), F.floor(F.col("_n") / 2).cast("int")))).alias("_pos"))
    return ranked.join(mid, [*keys, "_pos"]).groupBy(*keys).agg(F.avg(value).alias(out))


def two_stage(scores: DataFrame, thresholds: list[str] | None = None,
              block: int | None = AUTO) -> DataFrame:
    """The agent of the lowest step, then its first step below a threshold made
    from its own scores; its lowest step when none is."""
    names = thresholds or TWO_STAGE_THRESHOLDS
    s = effective_score(scores).filter(F.col("p").isNotNull()).select(
        *K, "step_idx", F.col("agent").alias("agent_raw"), strip("agent").alias("agent"), "p")
    block = resolve(s, block)
    picked = s.groupBy(*K).agg(
        F.min(F.struct("p", "step_idx", "agent_raw", "agent")).alias("low"),
        (F.max("step_idx") + 1).alias("n_steps"))
    mine = join_files(s, picked, "inner", block).filter(F.col("agent") == F.col("low.agent")).drop("n_steps")
    # sums in step order: a step that equals the mean of its agent falls on the same side of
    # it however the rows are dealt
    rows = file_frame(mine, "p", block=block).withColumnsRenamed({"mean": "mu"})
    if "median" in names:
        rows = (rows.withColumn("med", F.median("p").over(Window.partitionBy(*K))) if not block else
                join_files(rows, exact_median(mine, K, "p", "med").join(picked.select(*K, "n_steps"), K), "inner", block))
    cut = {"mean": lambda: F.col("mu"), "median": lambda: F.col("med"),
           "mean-0.5sd": lambda: F.col("mu") - F.lit(0.5) * F.col("sd"),
           "mean-1sd": lambda: F.col("mu") - F.col("sd")}
    wide = rows.groupBy(*K).agg(
        F.first("low").alias("low"),
        *[F.min(F.when(F.col("p") < cut[n](), F.col("step_idx"))).alias(f"h{i}")
          for i, n in enumerate(names)])
    return wide.select(
        *K, F.explode(F.array(*[
            F.struct(F.lit(f"two_stage@{n}").alias("method"),
                     F.coalesce(F.col(f"h{i}"), F.col("low.step_idx")).cast("int").alias("pred_step"),
                     F.col("low.agent_raw").alias("pred_agent"))
            for i, n in enumerate(names)])).alias("e")).select(*K, "e.*")


AGENT_SELECTORS = ["min", "max", "mean", "median", "mean_two_worst", "fraction_low",
                   "count_low", "total_suspicion"]


def agent_selector(scores: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """Worst agent under each way of summarising its own scores; the step is that
    agent's lowest."""
    names = selectors or AGENT_SELECTORS
    s = effective_score(scores).filter(F.col("p").isNotNull()).select(
        *K, "step_idx", strip("agent").alias("agent"), "p")
    low = F.when(F.col("p") < 0.5, F.lit(1)).otherwise(F.lit(0))
    per = s.groupBy(*K, "agent").agg(
        F.min("p").alias("min"), F.max("p").alias("max"), F.avg("p").alias("mean"),
        (-F.avg(low)).alias("fraction_low"), (-F.sum(low)).cast("double").alias("count_low"),
        (-F.sum(1 - F.col("p"))).alias("total_suspicion"),
        F.min("step_idx").alias("first_idx"), F.min(F.struct("p", "step_idx")).alias("low"))
    if "median" in names:
        per = per.join(exact_median(s, [*K, "agent"], "p", "median"), [*K, "agent"])
    if "mean_two_worst" in names:
        # the rank filter lets Spark drop all but two rows per agent before the shuffle
        w = Window.partitionBy(*K, "agent").orderBy("p", "step_idx")
        two = (s.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
               .groupBy(*K, "agent").agg(F.avg("p").alias("mean_two_worst")))
        per = per.join(two, [*K, "agent"])
    best = per.groupBy(*K).agg(*[
        F.min(F.struct(F.col(n).alias("v"), "first_idx", "agent", "low")).alias(n) for n in names])
    return best.select(*K, F.explode(F.array(*[
        F.struct(F.lit(f"agent_selector@{n}").alias("method"),
                 F.col(f"{n}.low.step_idx").cast("int").alias("pred_step"),
                 F.col(f"{n}.agent").alias("pred_agent"), F.col(f"{n}.v").alias("score"))
        for n in names])).alias("e")).select(*K, "e.*")


def rank_steps(scores: DataFrame, k: int) -> DataFrame:
    """The k lowest steps of each trajectory (rank 1 first). The rank filter is
    pushed below the shuffle, so a long trajectory sends k rows per task."""
    s = effective_score(scores).filter(F.col("p").isNotNull())
    w = Window.partitionBy(*K).orderBy("p", "step_idx")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
