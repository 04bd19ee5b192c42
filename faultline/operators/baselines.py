"""Judge-free predictors: fixed positions, busiest agents, random picks."""

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import collapse_agent, hash_fraction, strip
from ..schema import K
from .rules import exact_median
from .sequence import AUTO, join_files


def _sizes(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*K).agg((F.max("step_idx") + 1).alias("n_steps"))


def _prediction(df: DataFrame, method: str, step, agent) -> DataFrame:
    return df.select(*K, F.lit(method).alias("method"), step.cast("int").alias("pred_step"),
                     agent.alias("pred_agent"))


def prior_position(steps: DataFrame, position: float = V.PRIOR_POSITION) -> DataFrame:
    """The step at a fixed share of the trajectory, rounded half to even."""
    at = _sizes(steps).select(*K, F.rint(F.lit(position) * (F.col("n_steps") - 1)).cast("int")
                              .alias("step_idx"))
    hit = steps.select(*K, "step_idx", "agent").join(at, [*K, "step_idx"])
    return _prediction(hit, "prior_position", F.col("step_idx"), F.col("agent"))


def first_and_last(steps: DataFrame) -> DataFrame:
    ends = steps.groupBy(*K).agg(F.min(F.struct("step_idx", "agent")).alias("a"),
                                 F.max(F.struct("step_idx", "agent")).alias("z"))
    return _prediction(ends, "first_step", F.col("a.step_idx"), F.col("a.agent")).unionByName(
        _prediction(ends, "last_step", F.col("z.step_idx"), F.col("z.agent")))


def majority_agent(steps: DataFrame, block: int | None = AUTO) -> DataFrame:
    """Agent with most steps (alphabetical on ties) and the median of its steps."""
    counts = steps.groupBy(*K, "agent").agg(
        F.count(F.lit(1)).alias("n"), (F.max("step_idx") + 1).alias("_end"))
    top = counts.groupBy(*K).agg(
        F.min(F.struct((-F.col("n")).alias("n"), "agent")).alias("t"),
        F.max("_end").alias("n_steps"))
    mine = join_files(steps.select(*K, "step_idx", "agent"), top, "inner", block).filter(
        F.col("agent") == F.col("t.agent"))
    # step indexes are distinct, so the value itself is the position order
    mid = exact_median(mine.withColumn("_idx", F.col("step_idx")), K, "_idx", "_mid")
    out = mid.join(top.select(*K, F.col("t.agent").alias("agent")), K)
    return _prediction(out, "majority_agent", F.floor("_mid"), F.col("agent"))


def naive_predictions(steps: DataFrame) -> DataFrame:
    """Every fixed predictor as one predictions table."""
    return prior_position(steps).unionByName(majority_agent(steps)).unionByName(
        first_and_last(steps))


def busiest_agents(steps: DataFrame, k: int) -> DataFrame:
    """First step of each of the k agents with most steps (first seen on ties)."""
    c = steps.withColumn("_who", F.lower(strip("agent"))).groupBy(*K, "_who").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("step_idx", "agent")).alias("first"))
    w = Window.partitionBy(*K).orderBy(F.desc("n"), "first.step_idx")
    return (
        c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        .select(*K, "rank", F.col("first.step_idx").alias("step_idx"),
                F.col("first.agent").alias("agent"))
    )


def uniform_random_expectation(steps: DataFrame, labels: DataFrame, draws: int | None = None,
                               seed: int = 0, block: int | None = AUTO) -> DataFrame:
    """Per-file hit rate of a uniformly random step: exact, or over hash draws."""
    want = labels.select(*K, "n_steps", "mistake_step",
                         collapse_agent("mistake_agent").alias("_gold"))
    s = steps.select(*K, "step_idx", collapse_agent("agent").alias("_agent"))
    if draws is None:
        own = (
            join_files(s, want, "inner", block).groupBy(*K)
            .agg(F.avg((F.col("_agent") == F.col("_gold")).cast("int")).alias("agent_rate"),
                 F.avg((F.col("step_idx") == F.col("mistake_step")).cast("int")).alias("step_rate"))
        )
        return own
    places = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: F.floor(hash_fraction(
        F.concat_ws("|", F.lit(str(seed)), *K, d.cast("string"))) * F.col("n_steps")).cast("int"))
    # the draws stay in the row of their file, and each step counts its own among them. Never a
    # broadcast: the planner takes the size of the labels' file, which says nothing of the draws
    drawn = want.withColumn("_at", places).hint("merge")
    hit = join_files(s.withColumn("step_idx", F.col("step_idx").cast("int")), drawn, "inner", block).withColumn(
        "_w", F.lit(draws) - F.size(F.array_remove("_at", F.col("step_idx")))).filter("_w > 0")
    w = F.col("_w")
    return hit.groupBy(*K).agg(
        (F.sum(F.when(F.col("_agent") == F.col("_gold"), w).otherwise(0)) / F.lit(draws))
        .alias("agent_rate"),
        (F.sum(F.when(F.col("step_idx") == F.col("mistake_step"), w).otherwise(0)) / F.lit(draws))
        .alias("step_rate"))
