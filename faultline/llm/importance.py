"""Importance resampling towards a target distribution.

1. Features are runs of one to three words, hashed into buckets. Every task counts its
   buckets in one array; the sums over tasks are at most ``buckets`` numbers a table.
2. A bucket's gain is the log ratio of its smoothed shares in target and corpus. A
   document's weight is the sum of the gains of its features, read from one array; with the
   seeded Gumbel noise of its id this is its score. Scores are written once.
3. The lowest drawn score is found by bisection: a job counts the rows at or above evenly
   spaced thresholds, exactly, and the next job looks between the two that enclose the
   sample size. Ties go on to the id, then to the row's number, in the same way. Nothing
   is sorted for this, and the driver sees counts only.
4. Only drawn rows are range-partitioned by score and ranked.

The checksum of a feature is carried on from word to word, byte by byte for all words of
a piece of text at once.

A null text has no words; such a document has weight 0 and is never drawn. A null id is
seeded as the empty string and comes last among ties. Rows that repeat id and text are
drawn each for itself (equal scores, different ranks); which of equal rows is drawn is not
defined. Ids must be integers. Without documents there are no rows; without target texts
gains follow from the corpus alone. Columns beside id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, numbered, pick
from .textcode import flat, lowered, pieces, word_spans

BUCKETS = 10_000
#: bytes outside words: ASCII without digits and letters (of lower-cased text)
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: bytes of a word that all words of a piece take in step; longer words finish alone
_STEPS = 64
_LAST = (1 << 63) - 1


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def extend(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running CRC-32 states after data[start:end]."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    now, at, down = state[order], start[order], -size[order]
    for j in range(min(_STEPS, int(-down[0]) if len(down) else 0)):
        m = int(np.searchsorted(down, -j, "left"))
        now[:m] = _CRC[(now[:m] ^ data[at[:m] + j]) & 255] ^ (now[:m] >> 8)
    for i in range(int(np.searchsorted(down, -_STEPS, "left"))):
        rest = data[at[i] + _STEPS:at[i] - down[i]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def feature_buckets(data: np.ndarray, offs: np.ndarray, longest: int, buckets: int
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature, and the number of words of each row."""
    data = lowered(data)
    start, end, row = word_spans(data, offs, _OUTSIDE)
    state = extend(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, end)
    found, rows, first = [state], [row], np.arange(len(start))
    for n in range(1, longest):
        more = (first + n < len(start))
        more[more] = row[first[more] + n] == row[first[more]]
        first, state = first[more], state[more]
        state = extend(_CRC[(state ^ 0x20) & 255] ^ (state >> 8), data, start[first + n], end[first + n])
        found.append(state)
        rows.append(row[first])
    bucket = (np.concatenate(found) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
    return bucket, np.concatenate(rows), np.bincount(row, minlength=len(offs) - 1)


def _counted(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, off in pieces(*flat(batch.column(0))):
                total += np.bincount(feature_buckets(raw, off, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
    return run


def bucket_counts(docs: DataFrame, longest: int, buckets: int, text_col: str) -> np.ndarray:
    """Features of all texts in each bucket."""
    counts = pick(docs, text=text_col).mapInArrow(_counted(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of the smoothed shares, one number a bucket."""
    whole, other, extra = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(whole + extra) / (float(s + 1) * float(other + extra))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighed(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, raw, off in pieces(*flat(batch.column(1))):
                bucket, row, n_words = feature_buckets(raw, off, longest, len(gain))
                n = np.bincount(row, minlength=len(n_words))
                order = np.argsort(row, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                edge = np.concatenate([[0], np.cumsum(n)])
                for out, x in zip(cols, (n_words, n, sums[edge[1:]] - sums[edge[:-1]])):
                    out.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(c)) for c in cols]],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


def with_noise(weighed: DataFrame, seed: int) -> DataFrame:
    """score = weight + floor(1000 * Gumbel noise of the id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def take_first(rows: DataFrame, keys: list[str], k: int, ways: int = 32) -> Column:
    """A condition that holds for exactly k rows, the first by ascending ``keys`` (whole
    numbers without nulls; no two rows agree in all). k is at most the number of rows."""
    if k <= 0:
        return F.lit(False)
    taken, tied, before = F.lit(False), F.lit(True), 0
    for key in keys:
        col = F.col(key)
        low, high = rows.where(tied).agg(F.min(col), F.max(col)).first()
        while low < high:
            step = max(1, -(-(high - low) // ways))
            cuts = list(range(low, high, step))[:ways]
            got = rows.where(tied).agg(*[F.count_if(col <= F.lit(c).cast("long")).alias(f"n{i}") for i, c in enumerate(cuts)]).first()
            hit = next((i for i, n in enumerate(got) if before + n >= k), None)
            if hit is None:
                low = cuts[-1] + 1
            else:
                low, high = (cuts[hit - 1] + 1 if hit else low), cuts[hit]
        cut = F.lit(low).cast("long")
        less, same = rows.where(tied).agg(F.count_if(col < cut), F.count_if(col == cut)).first()
        taken, tied, before = taken | (tied & (col < cut)), tied & (col == cut), before + less
        if before + same == k:
            break
    return taken | tied


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, longest: int = 3,
             buckets: int = BUCKETS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null if not drawn) of every
    document. Drawn are floor(percent * n / 100) of the n with ``least_words`` words."""
    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be integers, not {kind}")
    gain = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets, target_text))
    weighed = src.mapInArrow(_weighed(gain, longest), f"doc_id {kind}, n_words long, n_features long, weight long")
    rows = cut_lineage(with_noise(weighed, seed).withColumns({
        "eligible": F.col("n_words") >= least_words, "down": -F.col("score"),
        "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "row": F.monotonically_increasing_id()}))
    eligible = rows.where("eligible")
    drawn = F.col("eligible") & take_first(eligible, ["down", "id", "row"], percent * eligible.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    first = (rows.where(drawn).select(*columns, "down", "id", "row")
             .repartitionByRange("down", "id", "row").sortWithinPartitions("down", "id", "row"))
    ranked = numbered(first, "place").select(*columns, (F.col("place") + 1).alias("rank"))
    return ranked.unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
