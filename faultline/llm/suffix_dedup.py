"""Removal of repeated byte strings by fingerprint grouping filtered with a difference cover.

A byte goes if a ``length``-byte string over it also starts earlier (smaller id, or
earlier in the same text). So of all suffixes with equal first ``length`` bytes only the
earliest keeps them. Sorting every suffix of a corpus to find such ties is neither
affordable nor needed:

1. Cover sample. Positions whose residue modulo v lies in a difference cover are named by
   the fingerprint of their next ``length - v + 1`` bytes. For any two suffixes there is
   one offset below v at which both fall on the cover; if they agree on ``length`` bytes,
   the two names there are equal. A suffix with no tied name in reach has no tie: it is
   never sorted. The names of one hash part are compared at a time; they get no rank.
2. Suffix buckets. The remaining suffixes are dealt into buckets by the fingerprint of
   their first ``length`` bytes and each bucket is sorted alone, by (fingerprint, id,
   start); all but the first of a tie are marked.
3. Marks come back per text, become maximal runs, and are cut out.

Names and suffixes that repeat inside one map-side block are settled there, so a string
that half the corpus holds sends one row per block. Exact copies are one text: the
earliest keeps the work, the others (of at least ``length`` bytes) go whole.

Results: one row per input row. Null or empty texts have no bytes and nothing removed.
Of repeated rows (same id, same text) one is kept and the others are copies. Rows that
share an id but not the text are ordered by the texts' fingerprints. A null id counts as
the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, pack, parts_of, pick, release, unpack
from .jaccard_join import NULL_ID
from .postings import by_group, deal, part_of, rows_of
from .textcode import U64, flat, mix, pieces, prefix_sums, span_hashes

#: a perfect difference set: every residue modulo 57 is a difference of two of these
COVER, MODULUS = (0, 1, 3, 13, 32, 36, 43, 52), 57


def _starts(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in the row of every byte."""
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(offs[-1]) - np.repeat(offs[:-1], size)


def _deltas(pos: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ascending places of each entry as steps: small numbers."""
    step = np.diff(pos, prepend=0)
    first = np.cumsum(count) - count
    step[first] = pos[first]
    return step.astype(np.uint32)


def _places(step: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.cumsum(step.astype(np.int64))
    first = np.cumsum(count) - count
    return total - np.repeat(total[first] - step[first], count)


def _again(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (last is primary), start of each class of the primary key, and the
    class of every sorted row."""
    order = np.lexsort(keys)
    k = keys[-1][order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _sample(length: int, parts: int):
    """(tid, text) -> named cover positions by name part (key >= 0) and positions already
    known to be tied, by text part (key < 0)."""
    reach = length - MODULUS + 1
    on_cover = np.zeros(MODULUS, bool)
    on_cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            tids = batch.column(0).to_numpy()
            data, offs = flat(batch.column(1))
            for a, b, raw, off in pieces(data, offs):
                tid = tids[a:b].view(U64)
                fresh = np.zeros(b - a, bool)
                for i, t in enumerate(tid.tolist()):
                    if t not in sent:
                        fresh[i] = True
                        if len(sent) < 1 << 20:
                            sent.add(t)
                row, pos = _starts(off)
                at = np.flatnonzero(on_cover[pos % MODULUS] & (pos + reach <= np.diff(off)[row]) & fresh[row])
                row, pos = row[at], pos[at]
                name = span_hashes(prefix_sums(raw), at, at + reach)
                order, first, cls = _again(name)
                tied = np.zeros(len(name), bool)
                tied[order] = np.bincount(cls, minlength=len(first))[cls] > 1
                lead = np.zeros(len(name), bool)
                lead[order[first]] = True
                keys, blobs = [], []
                for part, r, n, i in deal(name[lead], row[lead], parts):
                    keys.append(part)
                    blobs.append(pack(tid[r], n.astype(np.int32), name[lead][i].astype(np.uint32), _deltas(pos[lead][i], n)))
                for part, r, n, i in deal(mix(tid[row[tied]]), row[tied], parts):
                    keys.append(-1 - part)
                    blobs.append(pack(tid[r], n.astype(np.int32), _deltas(pos[tied][i], n)))
                yield rows_of(keys, blobs)
    return run


def _tied_names(parts: int, group: pa.Table) -> pa.Table:
    """Of one name part: the cover positions whose name occurs at another place too."""
    key, blobs = group.column("key")[0].as_py(), group.column("blob").to_pylist()
    if key < 0:
        return pa.Table.from_batches([rows_of([-1 - key] * len(blobs), blobs)])
    got = [unpack(b, U64, np.int32, np.uint32, np.uint32) for b in blobs]
    tid, count, name = (np.concatenate(x) for x in list(zip(*got))[:3])
    pos = np.concatenate([_places(s, n) for _, n, _, s in got])
    tid = np.repeat(tid, count)
    order, first, cls = _again(pos, tid, name)
    t, p = tid[order], pos[order]
    last = np.r_[first[1:], len(order)] - 1
    tie = ((t[first] != t[last]) | (p[first] != p[last]))[cls]
    return pa.Table.from_batches([rows_of(*_by_text(t[tie], p[tie], parts))])


def _by_text(tid: np.ndarray, pos: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    order = np.lexsort((pos, tid))
    tid, pos = tid[order], pos[order]
    names, row = np.unique(tid, return_inverse=True)
    keys, blobs = [], []
    for part, r, n, i in deal(mix(tid), row, parts):
        keys.append(part)
        blobs.append(pack(names[r], n.astype(np.int32), _deltas(pos[i], n)))
    return keys, blobs


def _per_text(group: pa.Table) -> pa.Table:
    """tid -> its tied cover positions, ascending, each once."""
    got = [unpack(b, U64, np.int32, np.uint32) for b in group.column("blob").to_pylist()]
    tid = np.repeat(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
    pos = np.concatenate([_places(s, n) for _, n, s in got])
    order = np.lexsort((pos, tid))
    tid, pos = tid[order], pos[order]
    keep = np.r_[True, (tid[1:] != tid[:-1]) | (pos[1:] != pos[:-1])]
    tid, pos = tid[keep], pos[keep]
    names, count = np.unique(tid, return_counts=True)
    offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
    return pa.table({"tid": names.view(np.int64), "tied": pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32)))})


def _suffixes(length: int, parts: int, text_parts: int):
    """(doc_id, tid, text, tied) -> suffixes near a tied cover position by bucket (key >= 0)
    and starts already known to be later ones, by text part (key < 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_all, tid_all = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
            data, offs = flat(batch.column(2))
            tied_all = batch.column(3)
            for a, b, raw, off in pieces(data, offs):
                doc, tid, size = doc_all[a:b], tid_all[a:b], np.diff(off)
                part_col = tied_all.slice(a, b - a)
                n = np.diff(part_col.offsets.to_numpy())
                near = part_col.flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(b - a), n)
                # a tied position c stands for the starts c - v + 1 .. c
                change = np.zeros(len(raw) + 1, np.int32)
                np.add.at(change, off[row] + np.maximum(near - MODULUS + 1, 0), 1)
                np.add.at(change, off[row] + near + 1, -1)
                rows, places = _starts(off)
                at = np.flatnonzero((np.cumsum(change)[:-1] > 0) & (places + length <= size[rows]))
                rows, places = rows[at], places[at]
                head = span_hashes(prefix_sums(raw), at, at + length)
                order, first, _ = _again(places, tid[rows], doc[rows], head)
                lead = np.zeros(len(head), bool)
                lead[order[first]] = True
                keys, blobs = [], []
                for part, r, c, i in deal(head[lead], rows[lead], parts):
                    keys.append(part)
                    blobs.append(pack(doc[r], tid[r], c.astype(np.int32), head[lead][i], _deltas(places[lead][i], c)))
                late = ~lead
                for part, r, c, i in deal(mix(tid[rows[late]]), rows[late], text_parts):
                    keys.append(-1 - part)
                    blobs.append(pack(doc[r], tid[r], c.astype(np.int32), _deltas(places[late][i], c)))
                yield rows_of(keys, blobs)
    return run


def _bucket(text_parts: int, group: pa.Table) -> pa.Table:
    """Sort one suffix bucket; all but the first suffix of each tie are marked."""
    key, blobs = group.column("key")[0].as_py(), group.column("blob").to_pylist()
    if key < 0:
        return pa.Table.from_batches([rows_of([-1 - key] * len(blobs), blobs)])
    got = [unpack(b, np.int64, U64, np.int32, U64, np.uint32) for b in blobs]
    doc, tid, count, head = (np.concatenate(x) for x in list(zip(*got))[:4])
    pos = np.concatenate([_places(s, n) for _, _, n, _, s in got])
    entry = np.repeat(np.arange(len(doc)), count)
    order, first, _ = _again(pos, tid[entry], doc[entry], head)
    late = np.ones(len(order), bool)
    late[first] = False
    late = np.sort(order[late])
    keys, out = [], []
    for part, r, n, i in deal(mix(tid[entry[late]]), entry[late], text_parts):
        keys.append(part)
        out.append(pack(doc[r], tid[r], n.astype(np.int32), _deltas(pos[late][i], n)))
    return pa.Table.from_batches([rows_of(keys, out)])


def _runs(length: int, group: pa.Table) -> pa.Table:
    """Maximal removed runs of each text of one part."""
    got = [unpack(b, np.int64, U64, np.int32, np.uint32) for b in group.column("blob").to_pylist()]
    doc, tid, count = (np.concatenate(x) for x in list(zip(*got))[:3])
    pos = np.concatenate([_places(s, n) for _, _, n, s in got])
    doc, tid = np.repeat(doc, count), np.repeat(tid, count)
    order = np.lexsort((pos, tid, doc))
    doc, tid, pos = doc[order], tid[order], pos[order]
    text = np.r_[True, (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1])]
    new = text.copy()
    new[1:] |= pos[1:] > pos[:-1] + length
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(pos)] - 1
    heads = np.flatnonzero(text)
    offsets = pa.array(np.r_[np.searchsorted(first, heads), len(first)].astype(np.int32))
    return pa.table({"doc_id": doc[heads], "tid": tid[heads].view(np.int64),
                     "starts": pa.ListArray.from_arrays(offsets, pa.array(pos[first])),
                     "ends": pa.ListArray.from_arrays(offsets, pa.array(pos[last] + length))})


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, shas, removed, runs = [], [], [], []
            for text, s, e in zip(batch.column(2).cast(pa.large_binary()), batch.column(3), batch.column(4)):
                raw, s, e = text.as_py(), s.as_py(), e.as_py()
                kept = b"".join(raw[i:j] for i, j in zip([0, *e], [*s, len(raw)]))
                shas.append(hashlib.sha256(kept).hexdigest())
                removed.append(len(raw) - len(kept))
                runs.append(len(s))
                rest.append(kept)
            cols = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "tid", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols += [pa.array(rest, pa.binary()), batch.column(3), batch.column(4)]
                names += ["kept", "starts", "ends"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = True, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the kept bytes and
    the removed runs (``starts``, ``ends``; a copy that goes whole has none)."""
    src = pick(docs, doc_id=id_col, text=text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("tid", F.xxhash64("text"))
    spark = docs.sparkSession
    parts = parts_of(src, "text", 8)
    tied = cut_lineage(src.where(F.octet_length("text") >= length).select("tid", "text")
                       .mapInArrow(_sample(length, parts), "key long, blob binary")
                       .groupBy("key").applyInArrow(by_group(_tied_names, parts), "key long, blob binary")
                       .groupBy("key").applyInArrow(_per_text, "tid long, tied array<int>"))
    release(spark)

    meta = src.select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    first = meta.groupBy("tid").agg(F.min("doc_id").alias("rep"))
    wanted = tied.join(first, "tid").select(F.col("rep").alias("doc_id"), "tid", "tied")
    texts = cut_lineage(src.join(wanted, ["doc_id", "tid"]).dropDuplicates(["doc_id", "tid"]).select("doc_id", "tid", "text", "tied"))
    del wanted
    release(spark)
    n_tied = texts.agg(F.sum(F.size("tied"))).first()[0] or 0
    buckets = max(4, int(n_tied * MODULUS / len(COVER) / (1 << 21)) + 1)
    runs = cut_lineage(texts.mapInArrow(_suffixes(length, buckets, parts), "key long, blob binary")
                       .groupBy("key").applyInArrow(by_group(_bucket, parts), "key long, blob binary")
                       .groupBy("key").applyInArrow(by_group(_runs, length), "doc_id long, tid long, starts array<long>, ends array<long>"))
    release(spark)
    more = ", kept binary, starts array<long>, ends array<long>" if keep_text else ""
    cut = texts.drop("tied").join(runs, ["doc_id", "tid"]).mapInArrow(
        _cut(keep_text), "doc_id long, tid long, n_removed long, n_spans long, kept_sha256 string" + more)

    rows = (meta.groupBy("doc_id", "tid", "n_bytes", "sha").agg(F.count(F.lit(1)).cast("int").alias("times"))
            .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))))
    copy = ((F.col("doc_id") != F.col("rep")) | (F.col("nth") > 1)) & (F.col("n_bytes") >= length)
    out = rows.join(first, "tid").join(cut, ["doc_id", "tid"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    cols = [F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    if not keep_text:
        return out.select(*cols)
    own = src.groupBy("doc_id", "tid").agg(F.first("text").cast("binary").alias("own"))
    return out.join(own, ["doc_id", "tid"]).select(
        *cols, F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", "own")).alias("kept"),
        F.when(~copy, F.col("starts")).alias("starts"), F.when(~copy, F.col("ends")).alias("ends"))
