"""Driver tables seen as trajectories: steps, labels and stand-in scores.

``conversations``, ``events`` and ``lineitem`` have no gold step and no judge
scores, so both are derived by formulas any SQL engine can repeat.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import hash_fraction
from ..functions.typing import parse_compound_role
from ..operators.sequence import AUTO, dense_position, join_files, resolve
from ..schema import K
from ..session import cut_lineage

EVENT_TYPES = {"view": "plan", "click": "delegate", "purchase": "execute",
               "error": "execute", "signup": "final"}
RETURN_TYPES = {"A": "plan", "N": "execute", "R": "final"}
SIZE = "_n_steps"
COMPOUND_ROLES = {"user": "Orchestrator (thought)", "system": "Orchestrator (-> WebSurfer)",
                  "assistant": "WebSurfer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(c: Column, mapping: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)


def _subset(key: Column) -> Column:
    return F.when(key % 2 == 0, F.lit("alg")).otherwise(F.lit("hc"))


def planted_content(text: Column, key: Column, turn: Column) -> Column:
    """Text with a known opening, so that every type rule has rows."""
    m = (key + turn) % 8
    c = (
        F.when(m == 1, F.concat(F.lit("Final answer: "), text))
        .when(m == 2, F.concat(F.lit('{"plan": 1} '), text))
        .when(m == 3, F.concat(F.lit("WebSurfer, find "), text))
        .when(m == 4, F.concat(F.lit("please proceed "), text))
        .when(m == 5, F.concat(F.lit("exitcode: 0 "), text))
        .when(m == 6, F.concat(F.lit("Step 1: "), text))
        .when(m == 7, F.lit("B"))
        .otherwise(text)
    )
    return F.when((key % 29 == 0) & (turn == 1), F.lit("   ")).otherwise(c)


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step before typing: the two release shapes side by side."""
    c = table(spark, sf_dir, "conversations")
    key, turn = F.col("conv_id"), F.col("turn")
    subset = _subset(key)
    role_raw = F.when(subset == "alg", F.col("role")).otherwise(
        _mapped(F.col("role"), COMPOUND_ROLES))
    return c.select(
        subset.alias("subset"), key.cast("string").alias("file_id"), key.alias("key"),
        turn.cast("int").alias("step_idx"), role_raw.alias("role_raw"),
        planted_content(F.col("text"), key, turn).alias("content"), F.col("text"),
    )


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``alg``: agent is the role, type left to the rules. ``hc``: agent and type
    parsed from the compound role."""
    h = conversation_history(spark, sf_dir)
    parsed = parse_compound_role("role_raw")
    alg = F.col("subset") == "alg"
    kind = F.when(alg, F.lit("unknown")).otherwise(F.col("_r.type_norm"))
    return (
        h.withColumn("_r", parsed)
        .withColumn("agent", F.when(alg, F.col("role_raw")).otherwise(F.col("_r.agent")))
        .withColumn("type_norm", kind)
        .withColumn("type_source", F.when(kind == "unknown", F.lit("classified"))
                    .otherwise(F.lit("parsed")))
        .drop("_r")
    )


def labelled_steps(steps: DataFrame, block: int | None = AUTO) -> DataFrame:
    """Derived gold per trajectory with the step it was taken from (``step_idx``, ``agent``);
    needs ``key`` (the numeric id) on the steps.

    key mod 23 = 0: out of range; key mod 17 = 0: an agent that never acts. Steps that carry
    the length of their trajectory (``SIZE``) need no shuffle.
    """
    last = F.max("step_idx")
    if SIZE in steps.columns:
        s = steps.select(*K, "key", "step_idx", "agent", F.col(SIZE).alias("n_steps"))
    elif block := resolve(steps, block):
        sizes = steps.groupBy(*K).agg((last + 1).alias("n_steps"))
        s = join_files(steps.select(*K, "key", "step_idx", "agent"), sizes, "inner", block)
    else:
        s = steps.select(*K, "key", "step_idx", "agent", (last.over(Window.partitionBy(*K)) + 1).alias("n_steps"))
    out_of_range = F.col("key") % 23 == 0
    at = F.when(out_of_range, F.lit(0)).otherwise(F.col("key") % F.col("n_steps"))
    return s.filter(F.col("step_idx") == at).select(
        *K, F.col("n_steps").cast("int").alias("n_steps"),
        F.when(out_of_range, F.col("n_steps") + 5).otherwise(at).cast("int").alias("mistake_step"),
        F.when(F.col("key") % 17 == 0, F.lit("ghost")).otherwise(F.col("agent")).alias("mistake_agent"),
        "key", "step_idx", "agent")


def labels_for(steps: DataFrame) -> DataFrame:
    """Derived gold per trajectory, without the step it was taken from."""
    return labelled_steps(steps).drop("step_idx", "agent")


def conversation_scores(spark: SparkSession, sf_dir: str, suffix: str = "") -> DataFrame:
    s = conversation_steps(spark, sf_dir)
    text = F.col("text") if not suffix else F.concat("text", F.lit(suffix))
    return s.withColumn("p_raw", hash_fraction(text))


def event_steps(spark: SparkSession, sf_dir: str, sized: bool = False) -> DataFrame:
    """Long trajectories: one per user, steps in time order, score in [0, 1). The
    divisor is prime so that means of scores are never exact decimal ties. ``sized``: with the
    length of the trajectory, where one shuffle gives it."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = dense_position(e, ["user_id"], ["ts", "event_id"], size=SIZE if sized else None)
    # the step table is what every later branch reads: written once
    return cut_lineage(e.select(
        _subset(F.col("user_id")).alias("subset"), F.col("user_id").cast("string").alias("file_id"),
        F.col("user_id").alias("key"), "step_idx", F.col("event_type").alias("agent"),
        _mapped(F.col("event_type"), EVENT_TYPES).alias("type_norm"),
        F.lit("parsed").alias("type_source"),
        (F.col("value") / F.lit(491.0)).alias("p_raw"),
        (F.col("event_id") % 50 != 0).alias("parse_ok"), "event_id", *[c for c in e.columns if c == SIZE],
    ))


def line_steps(spark: SparkSession, sf_dir: str, scored: bool = True, sized: bool = False) -> DataFrame:
    """Many short trajectories: one per order; with or without scores and lengths."""
    cols = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *cols, "l_returnflag", "l_discount")
    li = dense_position(li, ["l_orderkey"], cols, size=SIZE if sized else None)
    scores = [
        hash_fraction(F.concat_ws("|", "l_orderkey", "step_idx", "l_partkey")).alias("p_raw"),
        (F.col("l_discount") * 10).alias("p_tied"),
    ]
    return cut_lineage(li.select(
        _subset(F.col("l_orderkey")).alias("subset"),
        F.col("l_orderkey").cast("string").alias("file_id"), F.col("l_orderkey").alias("key"),
        "step_idx", F.col("l_returnflag").alias("agent"),
        _mapped(F.col("l_returnflag"), RETURN_TYPES).alias("type_norm"),
        *(scores if scored else []), *[c for c in li.columns if c == SIZE],
    ))
