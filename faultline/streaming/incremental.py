"""Incremental scoring: newly arrived trajectories are scored once, restart-safe."""

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scoring import finished_scores
from ..schema import K, TRAJECTORY

ScoreTable = Callable[[DataFrame], DataFrame]


def steps_of(trajectories: DataFrame) -> DataFrame:
    """Nested trajectories -> step rows."""
    return trajectories.select(*K, F.explode("steps").alias("s")).select(*K, "s.*")


def score_stream(spark: SparkSession, source: str, scores_path: str, checkpoint: str,
                 score: ScoreTable, max_files: int | None = None):
    """Score what is new under ``source`` and stop (``availableNow``).

    Each micro-batch overwrites its own ``batch_id`` folder, so a batch retried
    after a failure replaces its partial output instead of adding to it.
    """
    reader = spark.readStream.schema(TRAJECTORY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        score(steps_of(batch)).write.mode("overwrite").parquet(f"{scores_path}/batch_id={batch_id}")

    query = (
        reader.parquet(source).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_stream_scores(spark: SparkSession, scores_path: str, steps: DataFrame) -> DataFrame:
    """Score rows of completely scored trajectories."""
    return finished_scores(steps, spark.read.parquet(scores_path))
