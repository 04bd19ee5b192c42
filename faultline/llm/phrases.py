"""Phrase collocations by an FM-index over word ids for each shard.

1. Texts are gathered into shards of one language and bounded size. A shard is written as
   the distinct words it has, their counts, and the sequence of their numbers, 0 where a
   piece of text ends.
2. Counts of words are summed over shards. Words with at least ``least`` occurrences get a
   number that holds everywhere; no phrase with a rarer word can have as many, so in the
   shards such a word ends a piece.
3. Every shard's sequence becomes an FM-index: order of suffixes to the depth of the longest
   phrase, Burrows-Wheeler transform, LF mapping. Words are its first intervals. An
   interval is extended to the left by each word that stands before it in the transform; the
   LF mapping takes all extensions of all intervals to the intervals of the next depth at
   once, whose sizes are the counts. An extension also lies in the interval of its own
   prefix, i.e. in the right extension of a shorter phrase: both parents are known.
4. Counts of phrases are summed over shards by a plain aggregation (combined in the task
   first, spilled if need be, no group collected). What is left, phrases with at least
   ``least`` occurrences, is scored by equal joins: each cut of a phrase with the counts of
   its parts, each phrase with its best extension to the left and to the right.

A null text has no words, a null language is ``und``. Repeated rows count each for itself.
Texts of any length are taken whole: a long text is a shard of its own. Equal scores and
counts are ordered by the phrase's bytes, so results do not depend on the order of rows. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut_lineage, numbered, pack, pick, release, unpack
from .textcode import flat, lowered, word_spans

#: bytes of one language in a shard
SHARD_BYTES = 1 << 21
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _ENDS.copy()
_OUTSIDE[[0x20, 0x09]] = True


# ---- shards ---------------------------------------------------------------------------

def encode_shard(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, most frequent first, their counts, and the text as numbers: a word's
    place plus one, 0 between pieces and at the end."""
    data = lowered(np.frombuffer(raw, np.uint8))
    start, end, _ = word_spans(data, np.array([0, len(data)]), _OUTSIDE)
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(1, np.int32)
    # words and the gaps between them are neighbours in the same bytes
    edges = np.append(np.stack([start, end], 1).reshape(-1), len(data)).astype(np.int64)
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    code = both.indices.to_numpy()[0::2]
    is_word = np.zeros(len(both.dictionary), bool)
    is_word[code] = True
    names = both.dictionary.filter(pa.array(is_word)).cast(pa.binary()).cast(pa.string())
    place = (np.cumsum(is_word) - 1)[code]
    count = np.bincount(place, minlength=len(names))
    order = np.argsort(-count, kind="stable")
    turned = np.empty_like(order)
    turned[order] = np.arange(len(order))
    names, count, place = names.take(pa.array(order)), count[order], turned[place]
    stops = np.concatenate([[0], np.cumsum(_ENDS[data])])
    ended = np.append(stops[start[1:]] > stops[end[:-1]], True)
    seq = np.zeros(len(code) + int(ended.sum()), np.int32)
    seq[np.arange(len(code)) + np.cumsum(ended) - ended] = place + 1
    return names, count, seq


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 33

        def shard(lang: str) -> pa.RecordBatch:
            nonlocal made
            size.pop(lang)
            names, count, seq = encode_shard(b"\n".join(held.pop(lang)))
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([made - 1]), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                 pa.array([count], pa.list_(pa.int64())), pa.array([pack(seq)], pa.binary())], names=SHARD_NAMES)

        for batch in batches:
            data, offs = flat(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                held.setdefault(lang, []).append(data[offs[i]:offs[i + 1]].tobytes())
                size[lang] = size.get(lang, 0) + int(offs[i + 1] - offs[i]) + 1
                if size[lang] >= limit:
                    yield shard(lang)
                elif sum(size.values()) >= 4 * limit:
                    yield shard(max(size, key=size.get))
        for lang in list(held):
            yield shard(lang)
    return run


SHARD_NAMES = ["shard", "lang", "words", "counts", "seq"]


# ---- the index ------------------------------------------------------------------------

class FMIndex:
    """Of a sequence of numbers below ``sigma``; 0 separates and ends it. Suffixes are ordered
    by ``depth`` numbers, which is all that intervals up to this depth need."""

    def __init__(self, seq: np.ndarray, sigma: int, depth: int):
        n, cols = len(seq), [np.roll(seq, -i) for i in range(depth)]
        if sigma ** depth < 1 << 63:
            key = np.zeros(n, np.int64)
            for c in cols:
                key = key * sigma + c
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort(cols[::-1])
        del cols
        self.bwt = np.roll(seq, 1)[order]
        # lf[j]: the place whose mapping is j, i.e. the suffix that follows the one at j
        self.lf = np.argsort(self.bwt, kind="stable")
        self.first = self.bwt[self.lf]

    def levels(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For depths 1 to ``depth``: words (one row a phrase), counts, and the numbers of the
        phrase without its first (left parent) and without its last word (right parent)
        among those of the depth before."""
        owner = np.zeros(len(self.bwt), np.int64)  # the interval each place lies in; -1: none
        words = np.zeros((1, 0), self.bwt.dtype)
        for _ in range(depth):
            left = owner[self.lf]
            edge = np.flatnonzero(np.r_[True, (self.first[1:] != self.first[:-1]) | (left[1:] != left[:-1])])
            good = (self.first[edge] > 0) & (left[edge] >= 0)
            count = np.diff(np.r_[edge, len(left)])
            number = np.where(good, np.cumsum(good) - 1, -1)
            at, parent = edge[good], left[edge[good]]
            words = np.concatenate([self.first[at][:, None], words[parent]], 1)
            yield words, count[good], parent, owner[at]
            owner = np.repeat(number, count)


def _phrases(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"w{i + 1}" for i in range(longest)] + ["n"]
        for batch in batches:
            for i in range(batch.num_rows):
                seq = unpack(batch.column(0)[i].as_py(), np.int32)[0]
                place, number = batch.column(1)[i].values.flatten()
                ids = np.concatenate([[0], number.to_numpy()])
                own = np.zeros(int(seq.max(initial=0)) + 1, np.int32)
                own[place.to_numpy() + 1] = np.arange(1, len(ids), dtype=np.int32)
                seq = own[seq]
                seq = seq[(seq > 0) | (np.r_[0, seq[:-1]] > 0)]  # separators once
                if not len(seq):
                    continue
                for words, count, _, _ in FMIndex(seq, len(ids), longest).levels(longest):
                    k = words.shape[1]
                    for a in range(0, len(words) if k > 1 else 0, 1 << 16):
                        some = words[a:a + (1 << 16)]
                        cols = [ids[some[:, j]] if j < k else np.zeros(len(some), np.int64) for j in range(longest)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, count[a:a + (1 << 16)])], names=names)
    return run


def phrase_counts(docs: DataFrame, least: int, lang_col: str, text_col: str, shard_bytes: int
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n): words of each language; (lang, word, id, f): words with at least ``least``
    occurrences; (w1, w2, w3, a): phrases of two (w3 is 0) and three words with as many."""
    spark = docs.sparkSession
    src = pick(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    shards = cut_lineage(src.where("text IS NOT NULL").mapInArrow(
        _shards(shard_bytes), "shard long, lang string, words array<string>, counts array<long>, seq binary"))
    vocabulary = (shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
                  .select("shard", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n")))
    total = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    known = numbered(vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "id")
    known = cut_lineage(known.withColumn("id", F.col("id") + 1))
    release(spark)
    mapped = (vocabulary.join(known.select("lang", "word", "id"), ["lang", "word"])
              .groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("known")))
    found = (shards.select("shard", "seq").join(mapped, "shard").select("seq", "known")
             .mapInArrow(_phrases(3), "w1 long, w2 long, w3 long, n long"))
    counts = cut_lineage(found.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    release(spark)
    return total, known, counts


# ---- scores ---------------------------------------------------------------------------

def share(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)), exact for counts below 10**16."""
    wide = "CAST({} AS DECIMAL(16, 0))"
    return F.expr(f"({wide.format(a)} * {wide.format(a)} * CAST(1000000 AS DECIMAL(7, 0))) "
                  f"DIV ({wide.format(left)} * {wide.format(right)})")


def collocations(docs: DataFrame, least: int = 10, cover_percent: int = 50, top: int = 2000, lang_col: str = "lang",
                 text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or
    three words. l and r are the counts of the parts at the cut with the lowest score. Phrases
    inside a longer one with ``cover_percent`` of their occurrences are dropped."""
    total, known, counts = phrase_counts(docs, least, lang_col, text_col, shard_bytes)
    pairs, triples = counts.where("w3 = 0").drop("w3"), counts.where("w3 > 0")

    def word(i: int):
        return known.select(F.col("id").alias(f"w{i}"), F.col("f").alias(f"f{i}"))

    def pair(a: str, b: str, name: str):
        return pairs.select(F.col("w1").alias(a), F.col("w2").alias(b), F.col("a").alias(name))

    inside = (triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
              .groupBy("w1", "w2").agg(F.max("a").alias("longer")))
    two = (pairs.join(inside, ["w1", "w2"], "left").where(100 * F.coalesce("longer", F.lit(0)) < cover_percent * F.col("a"))
           .join(word(1), "w1").join(word(2), "w2")
           .select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), share("a", "f1", "f2").alias("score")))
    cuts = (triples.join(pair("w1", "w2", "f12"), ["w1", "w2"]).join(pair("w2", "w3", "f23"), ["w2", "w3"])
            .join(word(1), "w1").join(word(3), "w3")
            .withColumns({"early": share("a", "f1", "f23"), "late": share("a", "f12", "f3")}))
    first = F.col("early") <= F.col("late")
    three = cuts.select("w1", "w2", "w3", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("early", "late").alias("score"))
    # words are looked up only for phrases that can be among the first
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    scored = two.unionByName(three).join(known.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1")), "w1")
    near = scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top)
    for i in (2, 3):
        near = near.join(known.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    named = near.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    ranked = named.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("long"))
    return ranked.where(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
