"""Trajectory sources: release-shaped parquet and JSON into steps and labels."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.text import _col, level_scale, strip
from ..functions.typing import parse_compound_role
from ..operators.quality import (
    anomaly_flags, apply_anomaly_policy, cast_mistake_step, flag_agent_step_mismatch,
)
from ..operators.typing import apply_type_rules
from ..schema import K


class SourceError(ValueError):
    """Source data does not match the documented shape."""


# --- A3, A4: tolerant access --------------------------------------------------

def pick(df: DataFrame, names: list[str]) -> Column:
    """First value that is neither null nor empty among the columns that exist."""
    there = [n for n in names if n in df.columns]
    if not there:
        return F.lit(None).cast("string")
    kinds = dict(df.dtypes)
    return F.coalesce(*[
        F.when(F.col(n) != "", F.col(n)) if kinds[n] == "string" else F.col(n) for n in there])


def require(df: DataFrame, names: list[str], where: str = "source") -> Column:
    """First column that is *present*, even where it is null."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise SourceError(f"{where}: none of {names} present; saw {sorted(df.columns)[:12]}")


def list_depth(v: Column) -> Column:
    """How deep lists are nested in a value, at least 1. Brackets inside strings do not
    count; lists inside objects do."""
    bare = F.regexp_replace(F.regexp_replace(F.to_json(v), r"\\.", ""), '"[^"]*"', "")
    opens = lambda x: F.when(x == "[", F.lit(1)).otherwise(F.lit(0))
    depth = F.aggregate(
        F.split(F.regexp_replace(bare, r"[^\[\]]", ""), ""),
        F.struct(F.lit(0).alias("now"), F.lit(1).alias("most")),
        lambda d, x: F.struct(
            (d["now"] + opens(x) - F.when(x == "]", F.lit(1)).otherwise(F.lit(0))).alias("now"),
            F.greatest(d["most"], d["now"] + opens(x)).alias("most")))
    return depth["most"]


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def flat_items(v: Column) -> Column:
    """The items of a list and of all lists in it, in order: one level is opened per round,
    as many rounds as the value is deep."""
    return F.aggregate(
        F.sequence(F.lit(1), list_depth(v)), F.array(v),
        lambda items, _: F.flatten(F.transform(items, lambda x: F.when(
            _kind(x).startswith("ARRAY"), F.try_variant_get(x, F.lit("$"), "array<variant>"))
            .otherwise(F.array(x)))))


def variant_as_text(v: Column) -> Column:
    """Text of a value of any JSON type without discarding structure.

    Lists of any depth join their non-empty parts by newline (an object counts as its
    ``text``); objects give the first string of text, content, output, message, and
    otherwise their JSON.
    """
    def plain(x: Column) -> Column:
        def string_of(path):
            s = F.try_variant_get(x, F.lit(path), "variant")
            return F.when(F.schema_of_variant(s) == "STRING", F.try_variant_get(s, F.lit("$"), "string"))

        kind, scalar = _kind(x), F.try_variant_get(x, F.lit("$"), "string")
        return (
            F.when(x.isNull() | (kind == "VOID"), F.lit(""))
            .when(kind == "STRING", scalar)
            .when(kind == "BOOLEAN", F.initcap(scalar))
            .when(kind.startswith("OBJECT"), F.coalesce(*[string_of(f"$.{k}") for k in V.TEXT_KEYS], F.to_json(x)))
            .otherwise(scalar)
        )

    def part(item: Column) -> Column:
        inner = F.try_variant_get(item, F.lit("$.text"), "variant")
        keyed = F.schema_of_variant(item).startswith("OBJECT") & inner.isNotNull()
        return F.when(keyed, F.try_variant_get(inner, F.lit("$"), "string")).otherwise(plain(item))

    joined = F.array_join(F.filter(F.transform(flat_items(v), part), lambda t: t != ""), "\n")
    return F.when(_kind(v).startswith("ARRAY"), joined).otherwise(plain(v))


# --- A1, A2: readers --------------------------------------------------------

def read_trajectories_parquet(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """One row per trajectory with ``file_id`` resolved; a missing or repeated id
    is an error."""
    df = spark.read.parquet(path)
    return _identified(df, path, check)


def with_file_id(df: DataFrame) -> DataFrame:
    there = [n for n in V.ID_KEYS if n in df.columns]
    kinds = dict(df.dtypes)
    ids = [
        F.when(F.col(n) != ("" if kinds[n] == "string" else 0), F.col(n).cast("string"))
        for n in there]
    return df.withColumn("file_id", F.coalesce(*ids) if ids else F.lit(None).cast("string"))


def id_problems(df: DataFrame) -> DataFrame:
    """(file_id, n): null ids and ids that occur more than once."""
    return df.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("file_id").isNull() | (F.col("n") > 1))


def _identified(df: DataFrame, where: str, check: bool) -> DataFrame:
    out = with_file_id(df)
    if check:
        bad = id_problems(out).limit(3).collect()
        if bad:
            raise SourceError(f"{where}: missing or duplicate trajectory ids, for example {bad}")
    return out


def read_trajectories_json(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Folder of one-object JSON files, read whole as VARIANT; the id is the file
    stem. Dot-files are skipped."""
    raw = (
        spark.read.option("singleVariantColumn", "v").option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        .select("v", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file_id"))
    )
    if check:
        if not raw.take(1):
            raise SourceError(f"no .json trajectory files under {path}")
        bad = raw.filter(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
                         ).select("file_id").limit(3).collect()
        if bad:
            raise SourceError(f"root must be an object, for example {bad}")
    return raw


def _variant_pick(names: list[str]) -> Column:
    """First value neither null nor empty, as a variant."""
    parts = []
    for n in names:
        v = F.try_variant_get("v", F.lit(f"$.{n}"), "variant")
        kind = F.schema_of_variant(v)
        text = F.try_variant_get(v, F.lit("$"), "string")
        parts.append(F.when(v.isNotNull() & (kind != "VOID") & ~((kind == "STRING") & (text == "")), v))
    return F.coalesce(*parts)


def _first_present(v: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.try_variant_get(v, F.lit(f"$.{n}"), "variant") for n in names])


def records_from_json(raw: DataFrame, subset: str) -> DataFrame:
    """JSON rows -> (subset, file_id, query, ground_truth, label columns, history)."""
    text = lambda names: variant_as_text(_variant_pick(names))
    level = level_scale(F.try_variant_get("v", F.lit("$.level"), "string"))
    items = F.try_variant_get(_variant_pick(V.HISTORY_KEYS), F.lit("$"), "array<variant>")
    history = F.transform(items, lambda s: F.struct(
        variant_as_text(F.try_variant_get(s, F.lit("$.name"), "variant")).alias("name"),
        variant_as_text(_first_present(s, ["role", "name"])).alias("role"),
        variant_as_text(_first_present(s, V.CONTENT_KEYS)).alias("content")))
    return raw.select(
        F.lit(subset).alias("subset"), "file_id", text(V.QUERY_KEYS).alias("query"),
        text(V.TRUTH_KEYS).alias("ground_truth"), text(V.AGENT_KEYS).alias("mistake_agent"),
        text(V.STEP_KEYS).alias("mistake_step_raw"), text(V.REASON_KEYS).alias("mistake_reason"),
        level["level"].alias("level"), level["level_scale"].alias("level_scale"),
        history.alias("history"))


def records_from_parquet(rows: DataFrame, subset: str) -> DataFrame:
    """Release-shaped rows -> the same columns as :func:`records_from_json`."""
    history = pick(rows, V.HISTORY_KEYS)
    name = next((n for n in V.HISTORY_KEYS if n in rows.columns), None)
    if name is None:
        raise SourceError(f"no history column; saw {sorted(rows.columns)[:12]}")
    fields = [f.name for f in rows.schema[name].dataType.elementType.fields]

    def first(s, names):
        hit = next((n for n in names if n in fields), None)
        if hit is None:
            raise SourceError(f"history items have none of {names}; saw {fields}")
        return F.coalesce(s[hit].cast("string"), F.lit(""))

    text = lambda names: F.coalesce(pick(rows, names).cast("string"), F.lit(""))
    level = level_scale("level") if "level" in rows.columns else level_scale(
        F.lit(None).cast("string"))
    return rows.select(
        F.lit(subset).alias("subset"), "file_id", text(V.QUERY_KEYS).alias("query"),
        text(V.TRUTH_KEYS).alias("ground_truth"), text(V.AGENT_KEYS).alias("mistake_agent"),
        text(V.STEP_KEYS).alias("mistake_step_raw"), text(V.REASON_KEYS).alias("mistake_reason"),
        level["level"].alias("level"), level["level_scale"].alias("level_scale"),
        F.transform(history, lambda s: F.struct(
            (F.coalesce(s["name"].cast("string"), F.lit("")) if "name" in fields else F.lit(""))
            .alias("name"),
            first(s, ["role", "name"]).alias("role"),
            first(s, V.CONTENT_KEYS).alias("content"))).alias("history"))


# --- A5, A6 -----------------------------------------------------------------

def explode_steps(records: DataFrame) -> DataFrame:
    """One row per step. ``alg``: agent is the name, else the role, type open.
    ``hc``: agent and type parsed from the compound role."""
    e = records.select(*K, F.posexplode_outer("history").alias("step_idx", "h")).filter(
        F.col("h").isNotNull())
    alg = F.col("subset") == "alg"
    named = F.coalesce(F.col("h.name"), F.lit("")) != ""
    e = e.withColumn("_r", parse_compound_role("h.role"))
    kind = F.when(alg, F.lit("unknown")).otherwise(F.col("_r.type_norm"))
    return e.select(
        *K, "step_idx",
        F.when(alg, strip(F.when(named, F.col("h.name")).otherwise(F.col("h.role"))))
        .otherwise(F.col("_r.agent")).alias("agent"),
        F.col("h.role").alias("role_raw"), F.coalesce("h.content", F.lit("")).alias("content"),
        kind.alias("type_norm"),
        F.when(kind == "unknown", F.lit("classified")).otherwise(F.lit("parsed")).alias("type_source"),
        F.when(~alg, F.col("_r.target")).alias("target"), (alg & ~named).alias("name_missing"),
        (~alg & (kind == "unknown")).alias("role_unparsed"))


def record_labels(records: DataFrame, check: bool = True) -> DataFrame:
    """Labels per trajectory; an unreadable mistake step is a hard failure."""
    step = cast_mistake_step("mistake_step_raw")
    if check:
        bad = records.filter(step.isNull()).select(*K, "mistake_step_raw").limit(3).collect()
        if bad:
            raise SourceError(f"uncastable mistake_step, for example {bad}")
    return records.select(
        *K, F.size("history").alias("n_steps"), step.alias("mistake_step"), "mistake_agent",
        "mistake_reason", "query", "ground_truth", "level", "level_scale")


def load_corpus(records: DataFrame, anomaly_policy: str = "fail") -> tuple[DataFrame, DataFrame]:
    """Typed steps and flagged labels: explode, type, flag, apply the policy."""
    steps = apply_type_rules(explode_steps(records))
    labels = anomaly_flags(steps, record_labels(records))
    labels = apply_anomaly_policy(labels, anomaly_policy)
    if anomaly_policy == "drop":
        steps = steps.join(labels.select(*K), K, "left_semi")
    return steps, flag_agent_step_mismatch(steps, labels)


def assemble_trajectories(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Back to one nested row per trajectory, steps in order."""
    nested = steps.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct(
        F.col("step_idx").cast("int").alias("step_idx"), "agent", "role_raw", "content",
        "type_norm", "type_source"))).alias("steps"))
    return labels.join(nested, K)


def enrich_levels(labels: DataFrame, source: DataFrame, ident: str = "question_ID",
                  level: str = "level") -> DataFrame:
    """Difficulty from a second source by id; unmatched rows keep their own. Of repeated
    ids the smallest level counts, so the result does not depend on row order."""
    lv = level_scale(level)
    src = source.filter(F.coalesce(_col(ident).cast("string"), F.lit("")) != "").groupBy(
        _col(ident).cast("string").alias("file_id")).agg(F.min(lv).alias("_l"))
    j = labels.join(src, "file_id", "left")
    mine = {c: F.col(c) if c in labels.columns else F.lit(d)
            for c, d in (("level", ""), ("level_scale", "absent"))}
    return j.select(
        *[c for c in labels.columns if c not in mine],
        *[F.coalesce(F.col(f"_l.{c}"), own).alias(c) for c, own in mine.items()])
