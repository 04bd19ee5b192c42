"""Stored tables: records, scores, predictions, folds, result text."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.text import icase
from ..operators.normalize import NormalizationError, apply_folds
from ..schema import GRID_ROW, K, STEP_SCORE

MANIFEST = "version long, folder string, hashes map<string, string>"


def write_records(trajectories: DataFrame, path: str, fmt: str = "parquet") -> None:
    trajectories.write.mode("overwrite").partitionBy("subset").format(fmt).save(path)


def read_records(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)


def read_scores(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Step-score JSON lines under the explicit schema; unknown fields are dropped."""
    return spark.read.schema(STEP_SCORE).json(paths)


def read_configs(spark: SparkSession, paths: list[str], stats: DataFrame | None = None,
                 typed: bool = True) -> DataFrame:
    """Many score files at once. The configuration of a row is its own provenance
    columns (``CONFIG_AXES``), so downstream groups by them."""
    s = read_scores(spark, paths)
    return s if stats is None else apply_folds(s, stats, typed)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def read_grid_rows(spark: SparkSession, path: str, leave_out: str | None = None) -> DataFrame:
    """Prediction JSON lines of many runs; a repeated cell keeps its first row by
    (file name, position). Files whose path contains ``leave_out`` are not read."""
    raw = (
        spark.read.schema(GRID_ROW).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jsonl").json(path)
        .withColumn("_file", F.col("_metadata.file_path"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    if leave_out is not None:
        raw = raw.filter(~F.col("_file").contains(leave_out))
    return keep_first(raw, ["judge", "method", "subset", "file_id", "with_gt"],
                      ["_file", "_block", "_row"])


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key under an order, by a map-side combined aggregation."""
    payload = [c for c in rows.columns if c not in order]
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("_r")).select("_r.*")


# --- prediction blocks ------------------------------------------------------

def read_prediction_blocks(spark: SparkSession, path: str, subset: str) -> DataFrame:
    """Result text files, one row per block: the block opener is the record
    separator, so a large file is read by many tasks."""
    raw = (
        spark.read.option("lineSep", "Prediction for ").text(path)
        .withColumn("_block", F.col("_metadata.file_block_start"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return _block_fields(raw.select(F.lit(subset).alias("subset"), F.col("value").alias("block"),
                                    F.struct("_block", "_row").alias("pos")))


def split_prediction_blocks(rows: DataFrame, text: str = "text") -> DataFrame:
    """The same from a text column (``subset`` beside it)."""
    parts = rows.select("subset", F.posexplode(F.split(text, "Prediction for ")).alias("pos", "block"))
    return _block_fields(parts.filter(F.col("pos") > 0))


def _block_fields(blocks: DataFrame) -> DataFrame:
    b = F.col("block")
    name = F.trim(F.regexp_extract(b, r"(?s)^([^:]+\.json):", 1))
    body = F.regexp_extract(b, r"(?s)^[^:]+\.json:(.*)", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")
    agent = F.regexp_extract(body, icase(V.RE_PRED_AGENT), 1)
    step = F.regexp_extract(body, icase(V.RE_PRED_STEP), 1)
    return blocks.select("subset", "pos", stem.alias("stem"), agent.alias("pred_agent"),
                         step.try_cast("int").alias("pred_step")).filter(
        (F.col("stem") != "") & (F.col("pred_agent") != "") & F.col("pred_step").isNotNull())


def id_map(spark: SparkSession, directory: str) -> DataFrame:
    """(stem, file_id) from a folder of trajectory JSON files."""
    raw = spark.read.schema("question_ID string").option("multiLine", True).option(
        "pathGlobFilter", "*.json").json(directory)
    return raw.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("stem"),
                      F.col("question_ID").alias("file_id")).filter(
        F.coalesce("file_id", F.lit("")) != "")


def resolve_predictions(blocks: DataFrame, ids: DataFrame, labels: DataFrame, method: str) -> DataFrame:
    """Predictions for every gold file: an absent or unreadable one is null (a
    miss), a repeated one keeps its last block. ``ids`` with a subset column are looked up
    by subset and stem: two subsets may use one stem."""
    on = ["stem", *[c for c in ("subset",) if c in ids.columns]]
    last = blocks.join(ids, on).groupBy(*K).agg(
        F.max_by(F.struct("pred_step", "pred_agent"), "pos").alias("p"))
    return labels.select(*K).join(last, K, "left").select(
        *K, F.lit(method).alias("method"), F.col("p.pred_step").alias("pred_step"),
        F.col("p.pred_agent").alias("pred_agent"))


# --- folds ------------------------------------------------------------------

def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: row hashes are summed (two exact decimals), so
    nothing is collected and the partitioning does not matter."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    return got.select(F.substring(F.sha2(F.concat_ws(
        "|", F.col("n").cast("string"), F.coalesce("a", F.lit(0)).cast("string"),
        F.coalesce("b", F.lit(0)).cast("string")), 256), 1, 16).alias("content_hash"))


def _manifest(spark: SparkSession, path: str) -> list:
    """Committed snapshots, oldest first; none where nothing was committed."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows.collect(), key=lambda r: (r["version"], r["folder"]))  # one row per commit


def save_snapshot(spark: SparkSession, path: str, **tables: DataFrame) -> int:
    """Commit tables that belong together and return their version.

    Every commit writes a folder of its own; a row in the manifest, written last as one
    file, names it with the content hash of each table. Readers follow the manifest, so a
    commit that stopped half way is never seen and an older snapshot stays readable. Of
    two commits that take the same version at once every reader sees the same one.
    """
    folder, hashes = uuid.uuid4().hex, {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}")
        hashes[name] = fingerprint(back).first()["content_hash"]
    version = max((r["version"] for r in _manifest(spark, path)), default=0) + 1
    spark.createDataFrame([(version, folder, hashes)], MANIFEST).coalesce(1).write.mode("append").json(
        f"{path}/manifest")
    return version


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the latest (or the given) version; edited tables are refused."""
    rows = [r for r in _manifest(spark, path) if version in (None, r["version"])]
    if not rows:
        raise NormalizationError(f"{path}: no committed snapshot")
    out = {}
    for name, want in rows[-1]["hashes"].items():
        out[name] = spark.read.parquet(f"{path}/{rows[-1]['folder']}/{name}")
        if fingerprint(out[name]).first()["content_hash"] != want:
            raise NormalizationError(f"{path}: {name}: content hash mismatch")
    return out


def save_folds(stats: DataFrame, thresholds: DataFrame, path: str) -> None:
    """Fold statistics and thresholds, committed together."""
    save_snapshot(stats.sparkSession, path, stats=stats, thresholds=thresholds)


def load_folds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Refuses tables edited after they were fitted."""
    got = load_snapshot(spark, path)
    return got["stats"], got["thresholds"]
