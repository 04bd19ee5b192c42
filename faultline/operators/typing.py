"""Step typing over tables: rule application, gates, samples, splitter."""

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import hash_fraction, icase
from ..functions.typing import (
    classify_step, coarse_type, is_answer_emission, is_coordination, rule_covered,
)
from ..schema import K
from .evidence import clipped
from .sequence import AUTO, BLK, block_window, join_files, resolve, with_halo


def rule_verdicts(steps: DataFrame, block: int | None = AUTO) -> DataFrame:
    """Steps with ``rule_type`` and ``rule`` from the ordered type rules."""
    sizes = steps.groupBy(*K).agg((F.max("step_idx") + 1).alias("n_steps"))
    s = join_files(steps.drop("n_steps"), sizes, "inner", block)
    v = classify_step("content", "agent", F.col("step_idx") == F.col("n_steps") - 1, "role_raw")
    return s.withColumn("_v", v).select(
        "*", F.col("_v.type_norm").alias("rule_type"), F.col("_v.rule").alias("rule")).drop("_v")


def apply_type_rules(steps: DataFrame, block: int | None = AUTO) -> DataFrame:
    """Type every step still ``classified``; parsed types are never overridden,
    except that a parsed-corpus last step that emits an answer becomes final."""
    v = rule_verdicts(steps, block)
    promoted = (
        (F.col("subset") == "hc")
        & (F.col("step_idx") == F.col("n_steps") - 1)
        & is_answer_emission("content")
    )
    source = F.when(promoted, F.lit("parsed")).otherwise(F.col("type_source"))
    kind = (
        F.when(promoted, F.lit("final"))
        .when(source == "classified", F.col("rule_type"))
        .otherwise(F.col("type_norm"))
    )
    return v.select(
        *[c for c in v.columns if c not in ("type_norm", "type_source")],
        kind.alias("type_norm"), source.alias("type_source"), promoted.alias("promoted"))


def rule_coverage(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(rule_covered("rule").cast("int")).alias("coverage"))


def confusion_matrix(verdicts: DataFrame) -> DataFrame:
    """Zero-filled 5x5 counts of parsed type (rows) against rule type (columns)."""
    parsed = verdicts.filter(F.col("type_source") == "parsed")
    counts = parsed.groupBy("subset", "type_norm").agg(*[
        F.count_if(F.col("rule_type") == t).alias(t) for t in V.TYPE_NORMS])
    grid = parsed.select("subset").distinct().select(
        "subset", F.explode(F.array(*[F.lit(t) for t in V.TYPE_NORMS])).alias("type_norm"))
    return grid.join(counts, ["subset", "type_norm"], "left").select(
        "subset", F.col("type_norm").alias("parsed"),
        *[F.coalesce(t, F.lit(0)).alias(t) for t in V.TYPE_NORMS])


def rule_accuracy(verdicts: DataFrame) -> DataFrame:
    parsed = verdicts.filter(F.col("type_source") == "parsed")
    return parsed.groupBy("subset", "rule").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("type_norm") == F.col("rule_type")).alias("correct"))


def type_rule_gate(verdicts: DataFrame, gate: float = V.TYPE_GATE) -> DataFrame:
    """Agreement on parsed steps, coverage over all steps, and whether it passes."""
    parsed = F.col("type_source") == "parsed"
    agree = F.count_if(parsed & (F.col("type_norm") == F.col("rule_type")))
    n = F.count_if(parsed)
    got = verdicts.groupBy("subset").agg(
        n.alias("n_steps"),
        F.when(n > 0, agree / n).otherwise(F.lit(0.0)).alias("agreement"),
        F.avg(rule_covered("rule").cast("int")).alias("coverage"))
    return got.withColumn("passes_gate", F.col("agreement") >= gate)


def audit_sample(verdicts: DataFrame, n: int = 100, seed: int = 0, content_chars: int | None = None) -> DataFrame:
    """Seeded sample of n steps; the order by hash is a top-n, not a full sort. Published
    sheets show AUDIT_CHARS of the content."""
    draw = hash_fraction(F.concat_ws("|", F.lit(str(seed)), *K, "step_idx"))
    return (
        verdicts.withColumn("_draw", draw).orderBy("_draw", *K, "step_idx").limit(n)
        .select(
            *K, "step_idx", "agent", "role_raw",
            clipped(F.col("content"), content_chars).alias("content"), "rule_type", "rule",
            F.when(F.col("type_source") == "parsed", F.col("type_norm")).alias("parsed_type"),
            F.lit(None).cast("string").alias("manual_label"))
    )


def splitter_prompts(steps: DataFrame, queries: DataFrame | None = None,
                     block: int | None = AUTO, query_chars: int | None = None, prev_chars: int | None = None,
                     content_chars: int | None = None) -> DataFrame:
    """Prompt per coordination step from the task, the step before it and itself, each
    whole unless cut (published prompts: SPLITTER_QUERY/PREV/CONTENT_CHARS)."""
    block = resolve(steps, block)
    w = block_window(block)
    prev = F.lag(F.struct("agent", "type_norm", clipped(
        F.coalesce("content", F.lit("")), prev_chars).alias("content"))).over(w)
    s = (
        with_halo(steps, before=1, block=block).withColumn("_prev", prev)
        .filter(F.col("_core") & is_coordination("type_norm")).drop("_core", BLK)
    )
    if queries is not None:
        last = s.groupBy(*K).agg((F.max("step_idx") + 1).alias("n_steps"))
        s = join_files(s.drop("n_steps"), last.join(queries.select(*K, "query"), K, "left"),
                       "inner", block)
    else:
        s = s.withColumn("query", F.lit(None).cast("string"))
    task = F.when(F.coalesce("query", F.lit("")) == "", F.lit(V.NOT_RECORDED)).otherwise(
        F.col("query"))
    before = F.col("_prev").isNotNull()
    parts = {
        "query": clipped(task, query_chars),
        "prev_agent": F.when(before, F.col("_prev.agent")).otherwise(F.lit("—")),
        "prev_type": F.when(before, F.col("_prev.type_norm")).otherwise(F.lit("—")),
        "prev": F.when(before, F.col("_prev.content")).otherwise(F.lit("(none)")),
        "agent": F.col("agent"),
        "content": clipped(F.coalesce("content", F.lit("")), content_chars),
    }
    return s.withColumn("prompt", fill_template(V.SPLITTER_PROMPT, parts)).drop("_prev")


def fill_template(template: str, parts: dict):
    """A column from a ``{name}`` template."""
    from string import Formatter

    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name:
            pieces.append(parts[name])
    return F.concat(*pieces)


def parse_split_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """First PLAN/DELEGATE word decides; an unreadable answer is plan, counted."""
    word = F.lower(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), icase(V.RE_SPLIT_ANSWER), 1))
    return answers.withColumn("split_parsed", word != "").withColumn(
        "split_type", F.when(word == "", F.lit("plan")).otherwise(word))


def hash_splitter(steps: DataFrame, seed: int = 0) -> DataFrame:
    """Stand-in splitter: parity of the first sha256 byte of (seed, key, step)."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.concat_ws("/", *K), "step_idx"), 256)
    odd = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 2 == 1
    return steps.filter(is_coordination("type_norm")).select(
        *K, "step_idx", F.when(odd, F.lit("delegate")).otherwise(F.lit("plan")).alias("split_type"))


Splitter = Callable[[DataFrame], DataFrame]


def split_coordination(steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Replace plan/delegate on *classified* rows by the splitter's answer."""
    open_row = (F.col("type_source") == "classified") & is_coordination("type_norm")
    joined = steps.join(verdicts.select(*K, "step_idx", "split_type"), [*K, "step_idx"], "left")
    kind = F.when(open_row & F.col("split_type").isNotNull(), F.col("split_type")).otherwise(
        F.col("type_norm"))
    return joined.select(*[c for c in steps.columns if c != "type_norm"], kind.alias("type_norm"))


def splitter_gate(verdicts: DataFrame, split: DataFrame, gate: float = V.TYPE_GATE) -> DataFrame:
    """Splitter against parsed coordination steps: must reach the gate *and* beat
    the majority class."""
    v = verdicts.filter(F.col("type_source") == "parsed").join(
        split.select(*K, "step_idx", "split_type"), [*K, "step_idx"], "left")
    coord = is_coordination("type_norm")
    agree = F.col("type_norm") == F.col("split_type")

    def cell(a, b):
        return F.count_if((F.col("type_norm") == a) & (F.col("split_type") == b)).alias(f"{a}_{b}")

    got = v.groupBy("subset").agg(
        F.count_if(coord).alias("n"), F.count_if(coord & agree).alias("_agree"),
        F.count_if(F.col("type_norm") == "plan").alias("_plan"),
        F.count_if(F.col("type_norm") == "delegate").alias("_delegate"),
        F.count_if(coord & (F.col("type_norm") == F.col("rule_type"))).alias("_rules"),
        F.avg((coarse_type("type_norm") == coarse_type("rule_type")).cast("int"))
        .alias("coarse_agreement"),
        *[cell(a, b) for a in V.COORDINATION for b in V.COORDINATION])

    def share(c):
        return F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(0.0)) \
            if isinstance(c, str) else F.when(F.col("n") > 0, c / F.col("n")).otherwise(F.lit(0.0))

    out = got.withColumn("agreement", share("_agree")).withColumn(
        "majority_baseline", share(F.greatest("_plan", "_delegate"))).withColumn(
        "rules_agreement", share("_rules"))
    return out.withColumn(
        "passes_gate",
        (F.col("agreement") >= gate) & (F.col("agreement") > F.col("majority_baseline")),
    ).drop("_agree", "_plan", "_delegate", "_rules")
