"""Anomaly flags, record validation, corpus statistics, reporting slices."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import collapse_agent, strip
from ..schema import K


class QualityError(ValueError):
    """The data breaks a rule the caller asked to enforce."""


def _blank(content="content") -> Column:
    return strip(F.coalesce(F.col(content), F.lit(""))) == ""


def in_range(step="mistake_step", n="n_steps") -> Column:
    return (F.col(step) >= 0) & (F.col(step) < F.col(n))


def anomaly_flags(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the schema anomalies they carry in ``flags``. Steps without a content
    column have no empty content."""
    ranged = F.when(~in_range(), F.lit(V.FLAG_OUT_OF_RANGE))
    if "content" not in steps.columns:
        return labels.withColumn("flags", F.array_compact(F.array(ranged)))
    blanks = steps.groupBy(*K).agg(F.max(_blank()).alias("_blank"))
    flags = F.array_compact(F.array(F.when(F.col("_blank"), F.lit(V.FLAG_EMPTY)), ranged))
    return labels.join(blanks, K, "left").withColumn("flags", flags).drop("_blank")


def flag_agent_step_mismatch(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the mismatch flag where the labelled agent is not the agent of the
    labelled (in range) step."""
    acting = steps.select(*K, F.col("step_idx").alias("mistake_step"),
                          F.col("agent").alias("_acting"))
    return flag_acting(labels.join(acting, [*K, "mistake_step"], "left"), "_acting").drop("_acting")


def flag_acting(labels: DataFrame, acting: str) -> DataFrame:
    """Adds the mismatch flag where the labelled agent is not the one in column ``acting``
    (null: unknown)."""
    current = F.col("flags") if "flags" in labels.columns else F.array().cast("array<string>")
    differs = F.col(acting).isNotNull() & (collapse_agent("mistake_agent") != collapse_agent(acting))
    return labels.withColumn("flags", F.when(differs, F.array_union(
        current, F.array(F.lit(V.FLAG_MISMATCH)))).otherwise(current))


def apply_anomaly_policy(labels: DataFrame, policy: str = "fail") -> DataFrame:
    """``fail`` raises when any trajectory carries an anomaly, ``flag`` keeps all,
    ``drop`` removes the anomalous ones."""
    if policy not in ("fail", "flag", "drop"):
        raise QualityError(f"unknown anomaly policy {policy!r}")
    bad = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in V.ANOMALY_FLAGS]))
    if policy == "drop":
        return labels.filter(~bad)
    if policy == "fail":
        first = labels.filter(bad).select(*K, "flags").limit(5).collect()
        if first:
            raise QualityError(f"anomalous trajectories, for example {first}")
    return labels


def cast_mistake_step(value) -> Column:
    """Label text -> step, null where it is not an integer (a hard failure)."""
    c = F.col(value) if isinstance(value, str) else value
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def uncastable_labels(rows: DataFrame, value: str = "mistake_step") -> DataFrame:
    return rows.filter(cast_mistake_step(value).isNull())


def validate_records(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Violation rows ``(subset, file_id, rule, detail)``; none means valid."""
    step_rules = {
        "empty_agent": F.coalesce(F.col("agent"), F.lit("")) == "",
        "bad_type_norm": ~F.coalesce(F.col("type_norm").isin(V.TYPE_NORMS), F.lit(False)),
        "bad_type_source": ~F.coalesce(F.col("type_source").isin(V.TYPE_SOURCES), F.lit(False)),
        "bad_subset": ~F.coalesce(F.col("subset").isin(V.SUBSETS), F.lit(False)),
    }
    per_step = steps.select(*K, F.explode(F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(rule).alias("rule"),
                              F.concat(F.lit("step "), F.col("step_idx")).alias("detail")))
        for rule, cond in step_rules.items()]))).alias("v")).select(*K, "v.*")

    shape = steps.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("step_idx").alias("d"),
        F.min("step_idx").alias("lo"), F.max("step_idx").alias("hi"),
        F.max(_blank()).alias("blank"))
    flags = F.coalesce(F.col("flags"), F.array().cast("array<string>"))
    file_rules = {
        "empty_trajectory": F.col("n").isNull(),
        "step_idx_not_contiguous": (F.col("n") != F.col("d")) | (F.col("lo") != 0)
        | (F.col("hi") != F.col("n") - 1),
        "empty_mistake_agent": F.coalesce(F.col("mistake_agent"), F.lit("")) == "",
        "unregistered_flag": F.size(F.array_except(
            flags, F.array(*[F.lit(f) for f in V.KNOWN_FLAGS]))) > 0,
        "unflagged_empty_content": F.col("blank") & ~F.array_contains(flags, V.FLAG_EMPTY),
        "unflagged_out_of_range": ~((F.col("mistake_step") >= 0) & (F.col("mistake_step") < F.col("n")))
        & ~F.array_contains(flags, V.FLAG_OUT_OF_RANGE),
    }
    per_file = labels.drop("n_steps").join(shape, K, "left").select(
        *K, F.explode(F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit("").alias("detail")))
            for rule, cond in file_rules.items()]))).alias("v")).select(*K, "v.*")
    return per_step.unionByName(per_file)


def require_valid(steps: DataFrame, labels: DataFrame) -> None:
    found = validate_records(steps, labels).limit(5).collect()
    if found:
        raise QualityError(f"record violations, for example {found}")


def check_expectations(labels: DataFrame, steps: DataFrame | None = None,
                       expected: dict[str, tuple[int, int]] | None = None,
                       expected_steps: int | None = None, strict: bool = False) -> DataFrame:
    """Rows where the observed counts differ from the expected ones."""
    expected = V.EXPECTED_COUNTS if expected is None else expected
    spark = labels.sparkSession
    want = spark.createDataFrame(
        [(s, float(n), c) for s, pair in expected.items()
         for n, c in ((pair[0], "files"), (pair[1], "flagged"))],
        "subset string, expected double, what string")
    seen = labels.groupBy("subset").agg(
        F.count(F.lit(1)).cast("double").alias("files"),
        F.count_if(F.array_contains("flags", V.FLAG_MISMATCH)).cast("double").alias("flagged"))
    got = seen.select("subset", F.expr("stack(2, 'files', files, 'flagged', flagged)")
                      .alias("what", "observed"))
    if expected_steps is not None and steps is not None:
        want = want.unionByName(spark.createDataFrame(
            [("all", float(expected_steps), "steps")], want.schema))
        got = got.unionByName(steps.agg(
            F.lit("all").alias("subset"), F.lit("steps").alias("what"),
            F.count(F.lit(1)).cast("double").alias("observed")))
    out = (
        want.join(got, ["subset", "what"], "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0.0)))
        .filter(F.col("observed") != F.col("expected"))
    )
    if strict:
        wrong = out.collect()  # at most two rows per subset
        if wrong:
            raise QualityError(f"corpus counts differ: {wrong}")
    return out


def corpus_stats(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Long table ``(subset, stat, item, value)``."""
    def stat(df, name, value, item=None):
        return df.select("subset", F.lit(name).alias("stat"),
                         (F.lit("") if item is None else F.col(item)).alias("item"),
                         value.cast("bigint").alias("value"))

    files = labels.groupBy("subset").agg(F.count(F.lit(1)).alias("v"))
    per_file = steps.groupBy(*K).agg(F.count(F.lit(1)).alias("n"))
    sizes = per_file.groupBy("subset").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    # the step counts all come off this one reduction (its exchange is reused)
    cells = steps.groupBy("subset", "agent", "type_norm", "type_source").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("file_id", "step_idx")).alias("_seen"))
    agents = cells.groupBy("subset", "agent").agg(F.sum("n").alias("n"), F.min("_seen").alias("_seen"))
    flags = labels.select("subset", F.explode("flags").alias("flag")).groupBy("subset", "flag").count()
    types = cells.groupBy("subset", "type_norm").agg(F.sum("n").alias("count"))
    sources = cells.groupBy("subset", "type_source").agg(F.sum("n").alias("count"))
    w = Window.partitionBy("subset").orderBy(F.desc("n"), "_seen")
    top = agents.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 10)
    parts = [
        stat(files, "n_files", F.col("v")),
        stat(sizes, "n_steps", F.col("n")),
        stat(sizes, "steps_max", F.col("m")),
        stat(flags, "flags", F.col("count"), "flag"),
        stat(types, "type_norm", F.col("count"), "type_norm"),
        stat(sources, "type_source", F.col("count"), "type_source"),
        stat(agents.groupBy("subset").agg(F.count(F.lit(1)).alias("n")), "n_agents", F.col("n")),
        stat(top, "top_agents", F.col("n"), "agent"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_counters(typed: DataFrame, labels: DataFrame) -> DataFrame:
    """Named loading counters, recomputed from the tables rather than accumulated
    (retried tasks would count twice). ``typed`` carries ``rule`` and ``target``."""
    alg = F.col("subset") == "alg"
    events = F.array_compact(F.array(
        F.when(alg, F.concat(F.lit("rule_"), F.col("rule"))),
        F.when(alg & F.col("name_missing"), F.lit("missing_name_fallback_role")),
        F.when(~alg & F.col("target").isNotNull(), F.lit("delegate_parsed")),
        F.when(~alg & F.col("role_unparsed"), F.lit("role_unparsed")),
        F.when(~alg & F.col("promoted"), F.lit("final_promoted"))))
    by_step = typed.select("subset", F.explode(events).alias("event"))
    by_file = labels.select("subset", F.explode("flags").alias("event"))
    return by_step.unionByName(by_file).groupBy("subset", "event").agg(
        F.count(F.lit(1)).alias("n"))


def slice_names(held_aside: bool = False) -> Column:
    """Slices a label row belongs to; expects ``_any_anomalous``/``_any_held``."""
    flagged = F.array_contains("flags", V.FLAG_MISMATCH)
    anomalous = is_anomalous()
    held = F.col("held_aside") if held_aside else F.lit(False)
    return F.array_compact(F.array(
        F.lit("all"),
        F.when(~flagged, F.lit("excl_flagged")),
        F.when(F.col("_any_anomalous") & ~anomalous, F.lit("excl_anomalous")),
        F.when(F.col("_any_held") & ~held, F.lit("excl_held_aside")),
        F.when((F.col("_any_anomalous") | F.col("_any_held")) & ~flagged & ~anomalous & ~held,
               F.lit("excl_all_excluded"))))


def is_anomalous() -> Column:
    return F.arrays_overlap("flags", F.array(*[F.lit(f) for f in V.ANOMALY_FLAGS]))


def slices(labels: DataFrame, keep_all: bool = False) -> DataFrame:
    """(subset, file_id, slices): optional slices exist only in a subset that has
    something to exclude. The presence table has one row per subset."""
    held = "held_aside" in labels.columns
    present = labels.groupBy("subset").agg(
        F.max(is_anomalous()).alias("_any_anomalous"),
        F.max(F.col("held_aside") if held else F.lit(False)).alias("_any_held"))
    return labels.join(present, "subset").select(
        *(labels.columns if keep_all else K), slice_names(held).alias("slices"))
