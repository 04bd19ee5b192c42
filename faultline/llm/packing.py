"""Best-fit packing of documents into training sequences by linear grouping.

1. Every document is tokenized in its own row and cut only if it exceeds a sequence.
   A task numbers its pieces within each length as it writes them.
2. Pieces of one length are interchangeable, so a plan needs only the histogram of
   lengths: at most ``capacity`` numbers, however large the corpus. Large lengths are
   rounded up inside groups of equal cardinality, the few resulting sizes are packed by
   a configuration linear program (column generation), real lengths are put into the
   slots, and small lengths are best-fitted into what is left.
3. The plan says which run of equal-length pieces goes to which sequences and offset.
   A piece finds its place from its rank among its length: counts per (task, length)
   are summed over tasks, and a lookup in the plan does the rest. Texts never move.

Nulls and empty texts are documents of one token (the end mark). Repeated rows are
packed as separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut_lineage, pick

END_ID = 0


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The byte-level BPE of a ranks file; its end-of-text mark is read as one id, as
    the same vocabulary does in its JSON form."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={"<|endoftext|>": len(ranks)})


def encode(tokenizer, text: str) -> list[int]:
    if "<|endoftext|>" in text:
        return tokenizer.encode(text, allowed_special="all")
    return tokenizer.encode_ordinary(text)


def _pieces_of(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            ids_out: list[np.ndarray] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encode(tokenizer, text or "") + [END_ID], "<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a]))
                    seen[b - a] += 1
                    if keep_ids:
                        ids_out.append(ids[a:b])
            cols = list(zip(*rows)) or [[]] * 6
            out = [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()),
                   *[pa.array(np.array(c, np.int64)) for c in cols[2:6]],
                   pa.array(np.full(len(rows), task, np.int32))]
            if keep_ids:
                out.append(pa.array([x.astype(np.int32) for x in ids_out], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=NAMES + ["ids"] * keep_ids)
    return run


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task_rank", "task"]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, keep_ids: bool,
                     id_col: str, text_col: str) -> DataFrame:
    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
              "task_rank long, task int" + ", ids array<int>" * keep_ids)
    return src.mapInArrow(_pieces_of(tokenizer_path, capacity, keep_ids), schema)


# ---- the plan: driver-side arithmetic on at most `capacity` numbers -----------------

def equal_groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) in descending order, cut into groups of equal cardinality."""
    total, out, taken = int(counts.sum()), [[]], 0
    share = max(1, -(-total // groups))
    for length, n in zip(lengths.tolist()[::-1], counts.tolist()[::-1]):
        while n:
            room = share * len(out) - taken
            take = min(n, room)
            out[-1].append((length, take))
            taken, n = taken + take, n - take
            if taken == share * len(out) and taken < total:
                out.append([])
    return [g for g in out if g]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400
                   ) -> list[tuple[list[int], float]]:
    """Fractional optimum of the configuration program: patterns (how many of each size
    share a sequence) with their multiplicities, by column generation."""
    m = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    basis_inv = np.diag([1.0 / (capacity // s) for s in sizes])
    x = basis_inv @ np.array(demand, float)
    for _ in range(rounds):
        prices = basis_inv.sum(axis=0)
        pattern = _best_pattern(sizes, prices, capacity)
        if prices @ pattern <= 1 + 1e-7:
            break
        step = basis_inv @ pattern
        ratio = np.where(step > 1e-11, x / np.where(step > 1e-11, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        columns[:, out] = pattern
        pivot = basis_inv[out] / step[out]
        basis_inv = basis_inv - np.outer(step, pivot)
        basis_inv[out] = pivot
    return [(columns[:, j].astype(int).tolist(), float(x[j])) for j in range(m)]


def _best_pattern(sizes: list[int], prices: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of sizes that fits: a knapsack over the capacity."""
    size, value = np.array(sizes), np.maximum(prices, 0)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size)
    size_sorted, value_sorted = size[order], value[order]
    for room in range(int(size_sorted[0]), capacity + 1):
        k = int(np.searchsorted(size_sorted, room, "right"))
        worth = best[room - size_sorted[:k]] + value_sorted[:k]
        j = int(worth.argmax())
        if worth[j] > best[room - 1]:
            best[room], choice[room] = worth[j], order[j]
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        pattern[choice[room]] += 1
        room -= sizes[choice[room]]
    return pattern


class Bins:
    """Sequences of equal content are one entry (free room, how many, contents)."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.items = capacity, [], []

    def add(self, free: int, n: int, content: list[tuple[int, int]]) -> None:
        at = bisect.bisect_left(self.free, free)
        self.free.insert(at, free)
        self.items.insert(at, (n, content))

    def best_fit(self, length: int, count: int) -> None:
        """Place ``count`` pieces of one length, each where the least room is left."""
        while count:
            at = bisect.bisect_left(self.free, length)
            if at == len(self.free):
                each = self.capacity // length
                whole, rest = divmod(count, each)
                if whole:
                    self.add(self.capacity - each * length, whole, [(length, each)])
                if rest:
                    self.add(self.capacity - rest * length, 1, [(length, rest)])
                return
            free, (n, content) = self.free.pop(at), self.items.pop(at)
            each = free // length
            used = min(n, count // each)
            if used:
                self.add(free - each * length, used, [*content, (length, each)])
            count -= used * each
            if used < n and count:  # the last one takes fewer than it could
                self.add(free - count * length, 1, [*content, (length, count)])
                count, used = 0, used + 1
            if used < n:
                self.add(free, n - used, content)


def plan_packing(lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int = 64,
                 small_shares: tuple[int, ...] = (2, 3, 4, 8), grid: int = 256) -> np.ndarray:
    """Runs of the plan, one row each: length, first rank, number of pieces, pieces per
    sequence, first sequence, offset. Lengths over capacity/small_share are large; of
    the given boundaries the one with the fewest sequences is kept."""
    plans = [_plan(lengths, counts, capacity, groups, s, grid) for s in small_shares]
    return min(plans, key=lambda p: p[0])[1]


def _plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int, small_share: int,
          grid: int) -> tuple[int, np.ndarray]:
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    bins = Bins(capacity)
    large = lengths > capacity // small_share
    if large.any():
        by_group = equal_groups(lengths[large], counts[large], groups)
        rounded: dict[int, list[tuple[int, int]]] = {}
        for g in by_group:
            rounded.setdefault(g[0][0], []).extend(g)
        sizes = list(rounded)
        stock = {s: list(reversed(runs)) for s, runs in rounded.items()}
        left = {s: sum(n for _, n in runs) for s, runs in rounded.items()}
        unit = max(1, capacity // grid)  # the program sees sizes in steps of this many tokens
        coarse = [-(-s // unit) for s in sizes]
        for pattern, times in configurations(coarse, list(left.values()), capacity // unit):
            n = int(times + 1e-6)
            n = min([n, *[left[s] // k for s, k in zip(sizes, pattern) if k]])
            if n > 0:
                _substitute(bins, stock, left, [(s, k) for s, k in zip(sizes, pattern) if k], n)
        for s in sizes:  # what rounding the program down has left: a few per size
            while stock[s]:
                bins.best_fit(*stock[s].pop())
    for length, n in zip(lengths[~large].tolist()[::-1], counts[~large].tolist()[::-1]):
        bins.best_fit(length, n)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, content in bins.items:
        offset = 0
        for length, each in content:
            rows.append((length, used.get(length, 0), n * each, each, sequence, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    return sequence, np.array(sorted(rows), np.int64).reshape(-1, 6)


def _substitute(bins: Bins, stock: dict, left: dict, slots: list[tuple[int, int]], n: int) -> None:
    """Put real lengths into n sequences of one configuration: every slot takes the next
    n pieces of its group, and sequences with the same lengths stay one entry."""
    lanes = []
    for size, k in slots:
        left[size] -= n * k
        for _ in range(k):
            lane, need = [], n
            while need:
                length, have = stock[size].pop()
                take = min(need, have)
                lane.append([length, take])
                need -= take
                if have > take:
                    stock[size].append((length, have - take))
            lanes.append(lane[::-1])
    while n:
        step = min(lane[-1][1] for lane in lanes)
        content: dict[int, int] = {}
        for lane in lanes:
            content[lane[-1][0]] = content.get(lane[-1][0], 0) + 1
            lane[-1][1] -= step
            if not lane[-1][1]:
                lane.pop()
        bins.add(bins.capacity - sum(a * b for a, b in content.items()), step, list(content.items()))
        n -= step


# ---- the plan applied to every piece ------------------------------------------------

def _place(plan: np.ndarray, capacity: int):
    key = plan[:, 0] * (1 << 44) + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            run_rank, each = rank - plan[at, 1], plan[at, 3]
            keep = [i for i, c in enumerate(names) if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(plan[at, 4] + run_rank // each),
                 pa.array(plan[at, 5] + run_rank % each * length)],
                names=[*[names[i] for i in keep], "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, groups: int = 64,
                   keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    and, if kept, ids. Pieces of a sequence fill it without gaps from 0."""
    pieces = cut_lineage(tokenized_pieces(docs, tokenizer_path, capacity, keep_ids, id_col, text_col))
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = plan_packing(np.array([r[0] for r in histogram], np.int64),
                        np.array([r[1] for r in histogram], np.int64), capacity, groups)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (pieces.join(base, ["task", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      *["ids"] * keep_ids, (F.col("base") + F.col("task_rank")).alias("rank")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_place(plan, capacity), schema + ", sequence_id long, offset long")
