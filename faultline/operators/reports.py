"""Report tables over predictions, labels, steps and score fields."""

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import (
    collapse_agent, fault_role, hash_fraction, is_orchestrator, length_bin, loose_agent_match,
)
from ..functions.stats import hypergeometric_hit
from ..schema import K
from .baselines import busiest_agents, naive_predictions, uniform_random_expectation
from .metrics import (
    accuracy, exact_quantiles, file_counts, judged, recall_at_k, score_table, with_rate_ci,
)
from .quality import in_range
from .rules import PRIMARY, effective_score, rank_steps
from .sequence import AUTO, join_files


class AblationError(ValueError):
    """A comparison whose claimed axis does not vary."""


def gold_types(labels: DataFrame, steps: DataFrame) -> DataFrame:
    """Labels with the type of the labelled step; ``out_of_range`` where none."""
    at = steps.select(*K, F.col("step_idx").alias("mistake_step"), F.col("type_norm").alias("gold_type"))
    return labels.join(at, [*K, "mistake_step"], "left").withColumn(
        "gold_type", F.coalesce("gold_type", F.lit("out_of_range")))


def stratified_accuracy(preds: DataFrame, labels: DataFrame, steps: DataFrame,
                        n_boot: int | None = None) -> DataFrame:
    """Accuracy by gold type, gold role, length, subset and level (one-way each).

    Match counts are reduced per combination of strata before they are expanded.
    """
    typed = gold_types(labels, steps)
    level = (
        F.when(F.coalesce("level", F.lit("")) == "", F.lit("absent"))
        .otherwise(F.concat_ws(":", "level_scale", "level"))
        if "level" in labels.columns else F.lit("absent"))
    strata = {
        "gold_step_type": F.col("gold_type"), "gold_role": fault_role("mistake_agent"),
        "trajectory_length": length_bin("n_steps"), "subset": F.col("subset"), "level": level}
    j = judged(preds, typed, ["gold_type", "n_steps", *[c for c in ("level", "level_scale")
                                                      if c in labels.columns]])
    j = j.select("method", "agent_exact", "step_exact", *[c.alias(f"_{n}") for n, c in strata.items()])
    cells = j.groupBy("method", *[f"_{n}" for n in strata]).agg(
        F.count(F.lit(1)).alias("w"), F.count_if("agent_exact").alias("a"),
        F.count_if("step_exact").alias("s"))
    long = cells.select("method", "w", "a", "s", F.explode(F.array(*[
        F.struct(F.lit(n).alias("dimension"), F.col(f"_{n}").alias("stratum")) for n in strata
    ])).alias("e"))
    out = long.groupBy("method", "e.dimension", "e.stratum").agg(
        F.sum("w").alias("n"), F.sum("a").alias("agent_hits"), F.sum("s").alias("step_hits"))
    out = out.withColumn("agent_acc", F.col("agent_hits") / F.col("n")).withColumn(
        "step_acc", F.col("step_hits") / F.col("n"))
    if n_boot:
        out = with_rate_ci(out, "agent_hits", "n", "agent", n_boot)
        out = with_rate_ci(out, "step_hits", "n", "step", n_boot, 1)
    return out


def gold_share(steps: DataFrame, labels: DataFrame, block: int | None = AUTO) -> DataFrame:
    """Share of each file's steps owned by its gold agent."""
    return join_files(steps.select(*K, "step_idx", "agent"),
                      labels.select(*K, "n_steps", "mistake_agent"), "inner", block).groupBy(
        *K, "mistake_agent").agg(F.avg((collapse_agent("agent") == collapse_agent("mistake_agent"))
                                       .cast("int")).alias("share"))


def base_rate_audit(steps: DataFrame, labels: DataFrame, n_boot: int | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Naive predictors split by whose fault it was, and the gold agent's share."""
    j = judged(naive_predictions(steps), labels).withColumn("fault", fault_role("mistake_agent"))
    acc = accuracy(j, ["subset", "method", "fault"], n_boot)
    share = gold_share(steps, labels).withColumn("fault", fault_role("mistake_agent")).groupBy(
        "subset", "fault").agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("mean_share"))
    return acc, share


def score_by_gold_position(scores: DataFrame, labels: DataFrame, type_norm: str = "final",
                           n_bins: int = 5) -> DataFrame:
    """Mean score of final steps by where the labelled step sits."""
    s = scores.filter(F.col("type_norm") == type_norm)
    files = labels.filter((F.col("n_steps") >= 2) & in_range())
    pos = F.col("mistake_step") / (F.col("n_steps") - 1)
    b = F.least(F.floor(pos * n_bins), F.lit(n_bins - 1)).cast("int")
    j = join_files(s.drop("n_steps"), files.select(*K, "n_steps", "mistake_step"))
    return j.groupBy("subset", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_raw").alias("mean_score"))


def type_composition(preds: DataFrame, labels: DataFrame, steps: DataFrame) -> DataFrame:
    """Types of predicted and gold steps side by side; files without a gold step
    are counted apart as ``out_of_range``."""
    at = steps.select(*K, F.col("step_idx").alias("pred_step"), F.col("type_norm").alias("pred_type"))
    j = preds.join(gold_types(labels, steps).select(*K, "gold_type"), K).join(
        at, [*K, "pred_step"], "left")
    ranged = F.col("gold_type") != "out_of_range"
    cells = j.groupBy("method", "subset", "gold_type", "pred_type").agg(F.count(F.lit(1)).alias("w"))
    rows = cells.select("method", "subset", "w", F.explode(F.array(
        F.struct(F.lit("gold").alias("side"), F.col("gold_type").alias("type_norm")),
        F.struct(F.lit("pred").alias("side"), F.when(ranged, F.col("pred_type")).alias("type_norm"))
    )).alias("e")).select("method", "subset", "w", "e.*").filter(F.col("type_norm").isNotNull())
    return rows.groupBy("method", "subset", "type_norm").agg(
        F.sum(F.when(F.col("side") == "gold", F.col("w")).otherwise(0)).alias("gold"),
        F.sum(F.when(F.col("side") == "pred", F.col("w")).otherwise(0)).alias("pred"))


def tolerance_curve(table: DataFrame, method: str = PRIMARY) -> DataFrame:
    """exact / within 1 / within 2 step accuracy, from a score table."""
    t = table.filter((F.col("method") == method) & (F.col("slice") == "all"))
    return t.groupBy("subset").agg(*[
        F.max(F.when(F.col("scorer") == s, F.col("step_acc"))).alias(s) for s in ("exact", "tol1", "tol2")])


def position_ownership(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """How often step 0, 1, 2 and the last (``n_steps`` - 1, the greatest) belong to the faulty
    agent."""
    own = collapse_agent("agent") == collapse_agent("mistake_agent")
    idx, last = F.col("step_idx"), F.col("n_steps") - 1
    # the steps of an agent are counted where they lie; a name is compared once for all of them
    cells = steps.groupBy(*K, "agent").agg(
        F.count(F.lit(1)).alias("n"), F.max("step_idx").alias("_last"),
        *[F.max(idx == k).alias(f"_at{k}") for k in (0, 1, 2)])
    n = F.col("n")
    per = cells.join(labels.select(*K, "n_steps", "mistake_agent"), K).groupBy(*K).agg(
        *[F.max(F.when(F.col(f"_at{k}"), own)).alias(f"o{k}") for k in (0, 1, 2)],
        F.max(F.when(F.col("_last") == last, own)).alias("o_last"),
        (F.sum(F.when(own, n).otherwise(0)) / F.sum(n)).alias("share"))
    return per.groupBy("subset").agg(
        *[F.avg(F.col(f"o{k}").cast("int")).alias(f"step_{k}") for k in (0, 1, 2)],
        F.avg(F.col("o_last").cast("int")).alias("last_step"), F.avg("share").alias("mean_share"))


def depth_accuracy(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Agent accuracy by how deep the pick is: 0, 1, 2-4, 5+."""
    s = F.col("pred_step")
    depth = F.when(s == 0, F.lit("0")).when(s == 1, F.lit("1")).when(s < 5, F.lit("2-4")).otherwise(
        F.lit("5+"))
    j = judged(preds, labels).filter(s.isNotNull()).withColumn("depth", depth)
    return j.groupBy("method", "subset", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("agent_exact").cast("int")).alias("agent_acc"))


def fallback_rate(preds: DataFrame, method: str = PRIMARY, by: list[str] | None = None) -> DataFrame:
    """Reasons of the primary rule's fallback, with the overall rate on each row."""
    by = by or ["subset"]
    reason = F.coalesce("reason", F.lit("regime_found"))
    counts = preds.filter(F.col("method") == method).groupBy(*by, reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    rates = counts.groupBy(*by).agg(
        F.sum("n").alias("n_files"),
        F.round(F.sum(F.when(F.col("reason") != "regime_found", F.col("n")).otherwise(0))
                / F.sum("n"), 4).alias("rate"))
    return counts.join(rates, by)


def fallback_by_length(preds: DataFrame, labels: DataFrame, method: str = PRIMARY) -> DataFrame:
    n = F.col("n_steps")
    b = F.when(n < 10, F.lit("< 10")).when(n < 20, F.lit("10-20")).when(n < 50, F.lit("20-50")).otherwise(
        F.lit("50+"))
    return preds.filter(F.col("method") == method).join(labels.select(*K, "n_steps"), K).groupBy(
        b.alias("length")).agg(F.count(F.lit(1)).alias("n"),
                               F.avg(F.col("fallback").cast("int")).alias("fallback"))


def fault_split(preds: DataFrame, labels: DataFrame, n_boot: int | None = None) -> DataFrame:
    """Accuracy by orchestrator / worker fault, for cells of at least two files."""
    j = judged(preds, labels).withColumn("fault", fault_role("mistake_agent"))
    return accuracy(j, ["method", "subset", "fault"], n_boot).filter(F.col("n") >= 2)


# --- grids ------------------------------------------------------------------

def method_grid(rows: DataFrame, n_boot: int | None = None) -> DataFrame:
    """judge x method x answer x subset over stored predictions (with gold)."""
    hit_a = loose_agent_match(F.col("pred_agent"), F.col("gold_agent"))
    hit_s = F.coalesce(F.col("pred_step") == F.col("gold_step"), F.lit(False))
    none = F.col("pred_step").isNull() & F.col("pred_agent").isNull()
    g = rows.groupBy("judge", "method", "with_gt", "subset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit_s).alias("step_hits"),
        F.count_if(hit_a).alias("agent_hits"), F.count_if(none).alias("no_answer"),
        F.avg(F.coalesce("n_calls", F.lit(0))).alias("calls_per_log"))
    g = g.withColumn("step_acc", F.col("step_hits") / F.col("n")).withColumn(
        "agent_acc", F.col("agent_hits") / F.col("n"))
    if n_boot:
        g = with_rate_ci(g, "step_hits", "n", "step", n_boot)
        g = with_rate_ci(g, "agent_hits", "n", "agent", n_boot)
    return g


def search_directions(rows: DataFrame) -> DataFrame:
    """What binary search decided: direction shares and how often it ended at 0."""
    r = rows.filter((F.col("method") == "binary_search") & (F.coalesce("raw", F.lit("")) != ""))
    moves = F.split("raw", ">")

    def count(word):
        return F.size(F.filter(moves, lambda x: x == word))

    lower, upper = count("lower"), count("upper")
    return r.select("judge", "with_gt", "pred_step", lower.alias("l"), upper.alias("u"),
                    F.size(moves).alias("t")).groupBy("judge", "with_gt").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("l") / F.sum("t")).alias("lower_share"), (F.sum("u") / F.sum("t")).alias("upper_share"),
        F.sum(F.col("t") - F.col("l") - F.col("u")).alias("unreadable"),
        F.count_if(F.col("pred_step") == 0).alias("converged_to_0"))


def varied_axes(scores: DataFrame, axes: list[str] | None = None) -> DataFrame:
    """(axis, n_values) for every provenance column that differs. Configurations
    are reduced to their distinct combinations first."""
    axes = axes or [a for a in V.CONFIG_AXES if a in scores.columns]
    configs = scores.select(*axes).distinct()
    counts = configs.agg(*[F.countDistinct(F.coalesce(F.col(a).cast("string"), F.lit("\0"))).alias(a)
                           for a in axes])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(a).cast("bigint").alias("n_values")) for a in axes
    ])).alias("e")).select("e.*").filter(F.col("n_values") > 1)


def require_varied(scores: DataFrame, *wanted: str) -> None:
    """Refuse a comparison whose claimed axes are all constant."""
    varied = {r["axis"] for r in varied_axes(scores).collect()}  # at most one row per axis
    if not varied & set(wanted):
        raise AblationError(f"{' / '.join(wanted)} does not vary (varied: {sorted(varied)})")


def master_table(parts: dict[str, DataFrame], fields: list[str], arms: list[str],
                 subsets: list[str], rules: list[str]) -> DataFrame:
    """One long table over fields, arms, subsets and rules; what was not run stays
    as a row without values. ``parts``: field -> score table with ``arm``."""
    spark = next(iter(parts.values())).sparkSession
    grid = [(f, a, s, r) for f in fields for a in arms for s in subsets for r in rules]
    expected = spark.createDataFrame(grid, "field string, arm string, subset string, method string")
    got = None
    for field, t in parts.items():
        one = t.filter((F.col("scorer") == "exact") & (F.col("slice") == "all")).select(
            F.lit(field).alias("field"), "arm", "subset", "method", "n", "agent_acc", "step_acc")
        got = one if got is None else got.unionByName(one)
    return expected.join(got, ["field", "arm", "subset", "method"], "left").withColumn(
        "status", F.when(F.col("n").isNull(), F.lit("not run")).otherwise(F.lit("run")))


# --- samples and curves -----------------------------------------------------

def smoke_sample(labels: DataFrame, n: int, seed: int = 0, long_steps: int = 80) -> DataFrame:
    """Seeded sample: one file for each required case, then each subset filled to
    its share, then by key. Every ranking keeps at most n rows per subset."""
    cases = {
        "hc_long": (F.col("subset") == "hc") & (F.col("n_steps") > long_steps),
        "alg_early_error": (F.col("subset") == "alg") & (F.col("mistake_step") <= 1),
        "hc_orchestrator_fault": (F.col("subset") == "hc") & is_orchestrator("mistake_agent"),
    }
    draw = hash_fraction(F.concat_ws("|", F.lit(str(seed)), *K))
    pool = labels.select(*K, "n_steps", "mistake_step", "mistake_agent", draw.alias("_d"))
    chosen = None
    for i, (name, cond) in enumerate(cases.items()):
        left = pool if chosen is None else pool.join(chosen.select(*K), K, "left_anti")
        one = left.filter(cond).orderBy("_d", *K).limit(1).select(
            *K, F.lit(name).alias("reason"), F.lit(i).alias("priority"))
        chosen = one if chosen is None else chosen.unionByName(one)
    subsets = pool.select("subset").distinct()
    share = subsets.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("k"))
    have = chosen.groupBy("subset").agg(F.count(F.lit(1)).alias("have"))
    per_subset = n // max(int(share.first()["k"]), 1)
    rest = pool.join(chosen.select(*K), K, "left_anti")
    w = Window.partitionBy("subset").orderBy("_d", *K)
    fill = (
        rest.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
        .join(have, "subset", "left")
        .filter(F.col("_r") <= F.greatest(F.lit(per_subset) - F.coalesce("have", F.lit(0)), F.lit(0)))
        .select(*K, F.lit("balance").alias("reason"), F.lit(10).alias("priority"))
    )
    chosen = chosen.unionByName(fill)
    more = pool.join(chosen.select(*K), K, "left_anti").orderBy(*K).limit(n).select(
        *K, F.lit("fill").alias("reason"), F.lit(20).alias("priority"))
    return chosen.unionByName(more).orderBy("priority", *K).limit(n)


def curve_rows(scores: DataFrame, labels: DataFrame, block: int | None = AUTO) -> DataFrame:
    """Per-step curve table with the annotated step marked."""
    j = join_files(scores.drop("n_steps"), labels.select(*K, "n_steps", "mistake_step"), "inner", block)
    arm = F.col("lookahead") if "lookahead" in scores.columns else F.lit("none")
    gt = F.col("with_gt") if "with_gt" in scores.columns else F.lit(False)
    return j.select(
        arm.alias("arm"), gt.alias("with_gt"), F.concat_ws("/", *K).alias("file"),
        F.col("step_idx").alias("step"), F.col("type_norm").alias("type"), "agent", "p_raw",
        (F.col("step_idx") == F.col("mistake_step")).cast("int").alias("is_mistake_step"))


def curve_points(scores: DataFrame, labels: DataFrame, block: int | None = AUTO) -> DataFrame:
    """Per file: score and rank (1 = lowest, ties share the best) of the labelled
    step, with the extent of the curve."""
    n = scores.groupBy(*K).agg((F.max("step_idx") + 1).alias("n_steps"))
    gold = scores.select(*K, F.col("step_idx").alias("mistake_step"), F.col("p_raw").alias("gold_p"))
    files = n.join(labels.select(*K, "mistake_step"), K).join(gold, [*K, "mistake_step"], "left")
    j = join_files(scores.drop("n_steps"), files, "inner", block)
    return j.groupBy(*K, "n_steps", "mistake_step", "gold_p").agg(
        F.min("p_raw").alias("p_min"), F.max("p_raw").alias("p_max"),
        F.when(F.col("gold_p").isNotNull(), F.count_if(F.col("p_raw") < F.col("gold_p")) + 1).alias("rank"))


# --- candidate recall, health, naive tables ---------------------------------

def candidate_recall(scores: DataFrame, labels: DataFrame, field: str, ks: list[int] | None = None
                     ) -> DataFrame:
    """Top-k among candidate steps only. A gold step that is no candidate stays a
    miss, and the random control draws from the same candidates."""
    cand = scores.filter(F.col("candidate") & F.col(field).isNotNull()).withColumn("p", F.col(field))
    return recall_at_k(cand, labels, ks or [1, 2], match="loose", gold_range="miss")


def readout_health(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Missing answers, mass on the answer, most common first token."""
    by = by or ["subset"]
    ok = F.when(F.col("p_true").isNotNull(), F.col("mass_on_answer"))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_true").isNull()).alias("n_missing"),
        F.avg(ok).alias("mass_mean"), F.min(ok).alias("mass_min"))
    med = exact_quantiles(rows.select(*by, ok.alias("m")), by, "m", {"mass_median": 0.5})
    tokens = rows.groupBy(*by, "top_token").agg(F.count(F.lit(1)).alias("w"))
    top = tokens.groupBy(*by).agg(F.min(F.struct((-F.col("w")).alias("w"), "top_token")).alias("t"))
    return base.join(med, by, "left").join(
        top.select(*by, F.col("t.top_token").alias("top_token"), (-F.col("t.w")).alias("top_count")), by)


def parse_rates(scores: DataFrame, field: str = "readout") -> DataFrame:
    return scores.groupBy(field, "subset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("parse_ok").cast("int")).alias("readable"))


def unparseable_rates(preds: DataFrame, labels: DataFrame, methods: list[str]) -> DataFrame:
    """Per method, against the full gold set: files with no readable prediction."""
    have = preds.filter(F.col("pred_step").isNotNull() | F.col("pred_agent").isNotNull()).groupBy(
        "method", "subset").agg(F.countDistinct("file_id").alias("have"))
    gold = labels.groupBy("subset").agg(F.count(F.lit(1)).alias("n_gold")).withColumn(
        "method", F.explode(F.array(*[F.lit(m) for m in methods])))
    missing = F.col("n_gold") - F.coalesce("have", F.lit(0))
    return gold.join(have, ["method", "subset"], "left").select(
        "method", "subset", "n_gold", missing.alias("n_unparsed"),
        (missing / F.col("n_gold")).alias("rate"))


def naive_table(steps: DataFrame, labels: DataFrame, n_boot: int | None = None) -> DataFrame:
    """Every naive predictor through every scorer and slice, plus the random
    expectation as its own row."""
    table = score_table(naive_predictions(steps), labels, n_boot=n_boot)
    keep = ["method", "subset", "scorer", "slice", "n", "agent_acc", "step_acc"]
    rnd = uniform_random_expectation(steps, labels).groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), F.avg("agent_rate").alias("agent_acc"),
        F.avg("step_rate").alias("step_acc")).select(
        F.lit("uniform_random_step").alias("method"), "subset", F.lit("expectation").alias("scorer"),
        F.lit("all").alias("slice"), "n", "agent_acc", "step_acc")
    return table.select(*keep).unionByName(rnd)


def content_free_top_k(scores: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The field's k lowest beside the first k, last k and k busiest agents and the
    random expectation, under the loose agent match."""
    s = effective_score(scores).filter(F.col("p").isNotNull()).select(*K, "step_idx", "agent", "p")
    files = file_counts(s, labels, loose_agent_match).filter((F.col("n") >= 2) & F.col("reachable"))
    top = max(ks)
    by_p = rank_steps(s, top).select(*K, "rank", "step_idx", "agent")
    first = Window.partitionBy(*K).orderBy("step_idx")
    last = Window.partitionBy(*K).orderBy(F.desc("step_idx"))
    plain = s.select(*K, "step_idx", "agent")
    pickers = {
        "field": by_p,
        "first": plain.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top),
        "last": plain.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top),
        "busiest": busiest_agents(s, top),
    }
    picks = None
    for name, df in pickers.items():
        one = df.select(*K, F.lit(name).alias("method"), "rank", "step_idx", "agent")
        picks = one if picks is None else picks.unionByName(one)
    j = picks.join(files, K)
    hit_s = (F.col("step_idx") == F.col("mistake_step")).cast("int")
    hit_a = loose_agent_match("mistake_agent", "agent").cast("int")
    per = j.groupBy(*K, "method").agg(*[f for k in ks for f in (
        F.max(F.when(F.col("rank") <= k, hit_s)).alias(f"s{k}"),
        F.max(F.when(F.col("rank") <= k, hit_a)).alias(f"a{k}"))])
    hits = per.select("subset", "method", F.explode(F.array(*[F.struct(
        F.lit(k).alias("k"), F.col(f"s{k}").cast("double").alias("s"),
        F.col(f"a{k}").cast("double").alias("a")) for k in ks])).alias("e"))
    rnd = files.select("subset", F.lit("random").alias("method"), F.explode(F.array(*[F.struct(
        F.lit(k).alias("k"), (F.least(F.lit(k), F.col("n")) / F.col("n")).alias("s"),
        hypergeometric_hit("n", "m", F.lit(k)).alias("a")) for k in ks])).alias("e"))
    return hits.unionByName(rnd).groupBy("subset", "method", "e.k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("e.s").alias("step_acc"), F.avg("e.a").alias("agent_acc"))
