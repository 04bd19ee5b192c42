"""What the operators share: input columns, tables in the shared folder, and binary
records that move many numbers in one row."""

from __future__ import annotations

import gc
import re
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure, cut_lineage, checkpoint_dir

__all__ = ["column", "configure", "cut_lineage", "numbered", "pack", "parts_of", "pick", "release", "scratch_path", "table", "unpack"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str):
    """The first column of this name: a frame may hold it twice."""
    same = [c for c in df.columns if c == name]
    if len(same) <= 1:
        return F.col("`" + name.replace("`", "``") + "`")
    return None


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own (new="theirs"): whatever else the
    frame holds cannot clash. Text columns come as strings."""
    position = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{position[old]}").alias(new) for new, old in columns.items()])


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that every executor sees."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{re.sub('[^a-z0-9]+', '-', label.lower())}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so
    when the driver's JVM collects the frames that no one holds any more. The event that
    ends a query holds its plan for a moment, hence the second call."""
    for pause in (0.5, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def numbered(df: DataFrame, place: str) -> DataFrame:
    """df, written, with the place of each row from 0 in the order of its partitions. The
    driver holds one number for each partition."""
    spark, at = df.sparkSession, F.col(place)
    kept = cut_lineage(df.withColumn(place, F.monotonically_increasing_id()))
    sizes = sorted(kept.groupBy(F.shiftright(at, 33).alias("part")).count().collect())
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total - (part << 33)))
        total += n
    bases = spark.createDataFrame(base, "_part long, _base long")
    moved = kept.withColumn("_part", F.shiftright(at, 33)).join(bases, "_part", "left")
    return moved.withColumn(place, at + F.col("_base")).select(*df.columns, place)


def parts_of(docs: DataFrame, text: str, bytes_per_item: float, items: int = 1 << 21) -> int:
    """Into how many hash parts the items of all texts go, so that a part holds about
    ``items`` whatever the size of the corpus. One scan of the text column."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4, int(total / bytes_per_item / items) + 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value; planes of equal bytes lie together, so that the
    shuffle's compression sees runs."""
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64).tobytes()
    body = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return b"".join([head, *body])


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(raw.T).view(kind).reshape(-1))
        at += size * width
    return out
