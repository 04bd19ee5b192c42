"""Smoothed word frequencies of a training corpus, summed over the words of every row.

Two passes over the texts. The first counts words: each map task adds its words up before
it deals them over hash parts, so a frequent word sends one number per task. The second
scores. Words with at least 1 / ``HOT`` of all occurrences (so fewer than ``HOT`` words in
any corpus) are broadcast with their counts and answered in place; the rest meet their
counts in the hash parts, dealt with their row, and the answers are summed by row. No word
sends more than 1 / ``HOT`` of all occurrences to a part.

A row's tokens are its words (A-Z lower-cased) and one end. Null and empty texts have the
end alone. Without training rows every count is zero. An empty frame has no scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, pack, parts_of, release, unpack
from .postings import deal, rows_of
from .textcode import U64, flat, mix, pieces, words

#: bound on the words that are broadcast, 16 bytes each
HOT = 1 << 20


def _merged(word: np.ndarray, train: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in ascending order with the sums of their counts."""
    order = np.argsort(word, kind="stable")
    word = word[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    if not len(first):
        return word, train[:0], seen[:0]
    return word[first], np.add.reduceat(train[order], first), np.add.reduceat(seen[order], first)


def _counted(parts: int, hold: int = 1 << 19):
    """(part, packed words, occurrences in training rows and in all rows)."""
    def send(held) -> pa.RecordBatch:
        keys, blobs = [], []
        for part, _, _, at in deal(held[0], np.zeros(len(held[0]), np.int64), parts):
            keys.append(part)
            blobs.append(pack(*(h[at] for h in held)))
        return rows_of(keys, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = none = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            train_all = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            data, offs = flat(batch.column(1))
            for a, b, raw, off in pieces(data, offs):
                word, count = words(raw, off)
                name, inverse, seen = np.unique(word, return_inverse=True, return_counts=True)
                train = np.bincount(inverse, np.repeat(train_all[a:b], count), len(name)).astype(np.int64)
                held = _merged(*(np.concatenate(x) for x in zip(held, (name, train, seen.astype(np.int64)))))
                if len(held[0]) > hold:
                    yield send(held)
                    held = none
        yield send(held)
    return run


def _summed(group: pa.Table) -> pa.Table:
    got = [unpack(b, U64, np.int64, np.int64) for b in group.column("blob").to_pylist()]
    word, train, seen = _merged(*(np.concatenate(x) for x in zip(*got)))
    return pa.table({"key": pa.array([group.column("key")[0].as_py()] * len(word), pa.int64()),
                     "word": word.view(np.int64), "n": train, "seen": seen})


def _scored(parts: int, shared, known_from: float):
    """key -1: packed rows (uid, words, log counts and known tokens of the frequent words);
    other keys: the rarer words of a part with the row of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, logs = shared.value
        for batch in batches:
            uid_all = batch.column(0).to_numpy().view(U64)
            data, offs = flat(batch.column(1))
            for a, b, raw, off in pieces(data, offs):
                uid = uid_all[a:b]
                word, count = words(raw, off)
                row = np.repeat(np.arange(b - a), count)
                name, inverse = np.unique(word, return_inverse=True)
                at = np.minimum(np.searchsorted(hot, name), max(len(hot) - 1, 0))
                here = hot[at] == name if len(hot) else np.zeros(len(name), bool)
                value = np.where(here, logs[at], 0.0) if len(hot) else np.zeros(len(name))
                known = here & (value > known_from)
                keys = [-1]
                blobs = [pack(uid, count.astype(np.int64), np.bincount(row, value[inverse], b - a),
                              np.bincount(row, known[inverse], b - a).astype(np.int64))]
                rare = np.flatnonzero(~here[inverse])
                for part, r, n, place in deal(word[rare], row[rare], parts):
                    keys.append(part)
                    blobs.append(pack(uid[r], n.astype(np.int32), word[rare][place]))
                yield rows_of(keys, blobs)
    return run


def _answered(parts: int, smooth: float):
    """Log counts and known tokens of a part's rarer words, summed by row, dealt by row."""
    def run(entries: pa.Table, counts: pa.Table) -> pa.Table:
        blobs = entries.column("blob").to_pylist()
        if not blobs:
            return pa.Table.from_batches([rows_of([], [])])
        uid, size, word = (np.concatenate(x) for x in zip(*(unpack(b, U64, np.int32, U64) for b in blobs)))
        name, n = counts.column("word").to_numpy().view(U64), counts.column("n").to_numpy()
        order = np.argsort(name)
        total = n[order][np.searchsorted(name[order], word)]
        names, at = np.unique(uid, return_inverse=True)
        entry = np.repeat(at, size)
        logs = np.bincount(entry, np.log10(total + smooth), len(names))
        known = np.bincount(entry, total > 0, len(names)).astype(np.int64)
        keys, out = [], []
        for part, _, _, place in deal(mix(names), np.zeros(len(names), np.int64), parts):
            keys.append(part)
            out.append(pack(names[place], logs[place], known[place]))
        return pa.Table.from_batches([rows_of(keys, out)])
    return run


def _by_row(group: pa.Table) -> pa.Table:
    uid, logs, known = (np.concatenate(x) for x in zip(*(unpack(b, U64, np.float64, np.int64) for b in group.column("blob").to_pylist())))
    names, at = np.unique(uid, return_inverse=True)
    return pa.table({"uid": names.view(np.int64), "logs": np.bincount(at, logs, len(names)),
                     "known": np.bincount(at, known, len(names)).astype(np.int64)})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(blob, np.int64, np.int64, np.float64, np.int64)],
                                             names=["uid", "n_words", "logs", "known"])


def unigram_scores(rows: DataFrame, smooth: float = 0.1, hot: int = HOT) -> DataFrame:
    """uid, n_tokens, n_known, train_tokens, base_score for a frame (uid, train, text);
    rows with the same uid have the same text and part."""
    spark = rows.sparkSession
    parts = parts_of(rows, "text", 8)
    counts = cut_lineage(rows.select("train", "text").mapInArrow(_counted(parts), "key long, blob binary")
                         .groupBy("key").applyInArrow(_summed, "key long, word long, n long, seen long"))
    release(spark)
    ends = rows.where("train").count()
    sums = counts.agg(F.sum("n"), F.sum("seen"), F.count_if(F.col("n") > 0)).first()
    total, distinct = (sums[0] or 0) + ends, sums[2] + int(ends > 0)
    least = (sums[1] or 0) // hot + 1
    frequent = counts.where(F.col("seen") >= least).select("word", "n").toArrow()  # fewer than ``hot`` rows
    name, n = frequent.column("word").to_numpy().view(U64), frequent.column("n").to_numpy()
    order = np.argsort(name)
    shared = spark.sparkContext.broadcast((name[order], np.log10(n[order] + smooth)))
    # between the logarithms of the counts 0 and 1
    known_from = float(np.log10(smooth + 0.5))
    stored = cut_lineage(rows.select("uid", "text").mapInArrow(_scored(parts, shared, known_from), "key long, blob binary"))
    shared.destroy()
    own = stored.where("key < 0").select("blob").mapInArrow(_rows, "uid long, n_words long, logs double, known long")
    rare = (stored.where("key >= 0").groupBy("key")
            .cogroup(counts.where(F.col("seen") < least).groupBy("key"))
            .applyInArrow(_answered(parts, smooth), "key long, blob binary")
            .groupBy("key").applyInArrow(_by_row, "uid long, logs double, known long"))
    both = own.withColumn("times", F.lit(1)).unionByName(
        rare.select("uid", F.lit(None).cast("long").alias("n_words"), "logs", "known", F.lit(0).alias("times")))
    per_row = both.groupBy("uid").agg(F.sum("times").alias("times"), F.max("n_words").alias("n_words"),
                                      F.sum("logs").alias("logs"), F.sum("known").alias("known"))
    scale = float(np.log10(total + smooth * (distinct + 1)))
    return per_row.select(
        "uid", (F.col("n_words") + 1).alias("n_tokens"),
        ((F.col("known") / F.col("times")).cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") / F.col("times") + float(np.log10(ends + smooth)) - (F.col("n_words") + 1) * scale).alias("base_score"))
