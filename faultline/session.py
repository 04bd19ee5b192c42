"""Session settings the operators are designed for.

Everything here is a runtime SQL setting: shuffles are re-planned from measured
sizes, skewed join partitions are split, and broadcasts are chosen by AQE from
the measured size of the small side rather than from an estimate.
"""

import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a batch of texts is bounded by its bytes, whatever the length of a row
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and make this package
    importable in its Python workers."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _ship_package(spark.sparkContext.applicationId)
    return spark


@lru_cache(maxsize=None)
def _ship_package(application_id: str) -> None:
    """Send the package's source once per application."""
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    archive = shutil.make_archive(os.path.join(folder, "faultline"), "zip",
                                  os.path.dirname(package), os.path.basename(package))
    SparkSession.active().sparkContext.addPyFile(archive)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or what setCheckpointDir was
    given. Only a local session that has none gets a folder of its own; a cluster without
    one is an error, because uncut plans would repeat work (and ask a judge again)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = given.get() if given.isDefined() else None
    if where is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = _local_folder()
    return where


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table that several branches read to the shared checkpoint folder
    and read it back: lost executors do not replay what came before it, branches
    prune its columns, and the planner sees its real size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/faultline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
