"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions. At each decision every suffix of the last ``depth``
bytes has a Krichevsky-Trofimov estimate, and a context tree weights them: the weighted
probability of a node is half its own estimate and half the product of its children's.
The tree is trained on the whole training corpus and then fixed; a decision is predicted
by mixing the estimates along its path with the posterior weights of the tree.

* Counts of (context, next byte) are gathered per task, dealt and summed; all shallower
  contexts follow from them. Their number is bounded by the alphabet and the depth, not by
  the corpus.
* Scoring needs the model on every executor. It is broadcast in shards by the two latest
  bytes of the context: a shard holds at most ``shard_grams`` counts where it can, and
  256**(depth - 1) in any case. Each shard is one pass over the texts that scores the
  positions whose context it holds, and a document's passes are added up.

A text is lower-cased (A-Z), preceded by ``depth`` marks 255 (a byte that UTF-8 never has)
and followed by one, so probabilities of texts of all lengths sum to one. Null and empty
texts are the end mark alone. Without training texts every decision is even. Repeated rows
are learned and scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, pack, release, unpack
from .postings import deal, rows_of
from .textcode import _LOWER, U64, flat, mix, pieces

MARK = 255


# ---- context counts -------------------------------------------------------------------

def marked(raw: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of every row with marks around them, and the new offsets."""
    size = np.diff(off)
    new = np.concatenate([[0], np.cumsum(size + depth + 1)])
    out = np.full(new[-1], MARK, np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(raw)) - off[row] + new[row] + depth] = _LOWER[raw]
    return out, new


def grams(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, next byte) of every position as one number, latest context byte next to
    the lowest, and how many each row has."""
    n = max(0, len(data) - depth)
    out = np.zeros(n, U64)
    for i in range(depth + 1):
        out = (out << U64(8)) | data[i:i + n].astype(U64)
    count = np.diff(off) - depth
    inside = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return out[inside], count


def _merge(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _counted(depth: int, parts: int, hold: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, U64), np.zeros(0, np.int64))
        for batch in batches:
            data, offs = flat(batch.column(0))
            for _, _, raw, off in pieces(data, offs):
                g, _ = grams(*marked(raw, off, depth), depth)
                key, n = np.unique(g, return_counts=True)
                held = _merge(np.concatenate([held[0], key]), np.concatenate([held[1], n]))
                if len(held[0]) > hold:
                    yield _send(*held, parts)
                    held = (held[0][:0], held[1][:0])
        yield _send(*held, parts)
    return run


def _send(key: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    keys, blobs = [], []
    for part, _, _, at in deal(mix(key), np.zeros(len(key), np.int64), parts):
        keys.append(part)
        blobs.append(pack(key[at], n[at]))
    return rows_of(keys, blobs)


def _summed(group: pa.Table) -> pa.Table:
    got = [unpack(b, U64, np.int64) for b in group.column("blob").to_pylist()]
    key, n = _merge(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
    return pa.table({"gram": key.view(np.int64), "n": n})


def context_counts(texts: DataFrame, depth: int, parts: int = 32) -> DataFrame:
    """gram, n over a one-column frame of training texts."""
    return (texts.mapInArrow(_counted(depth, parts), "key long, blob binary")
            .groupBy("key").applyInArrow(_summed, "gram long, n long"))


# ---- the tree -------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series after shifting x up by eight."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.ones_like(y)
    for i in range(8):
        shift = shift * (x + i)
    return series - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def nodes_of(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes of sorted (context, byte) counts: node key, zeros, ones. A node is the
    leading bits of a byte after a leading one."""
    x, ctx = key & U64(255), key >> U64(8) << U64(8)
    keys, zeros, ones = [], [], []
    for bit in range(8):
        node = ctx | (U64(1) << U64(bit)) | (x >> U64(8 - bit))
        up = ((x >> U64(7 - bit)) & U64(1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        keys.append(node[first])
        ones.append(np.add.reduceat(n * up, first) if len(first) else n)
        zeros.append(np.add.reduceat(n * (1 - up), first) if len(first) else n)
    key, zeros, ones = np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)
    order = np.argsort(key)
    return key[order], zeros[order].astype(float), ones[order].astype(float)


class ContextTree:
    """Nodes by depth: sorted keys, estimate of a one and of a zero, weight of the node's
    own estimate against its children's."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.levels, self.top = depth, [None] * (depth + 1), {}
        below = None
        for d in range(depth, -1, -1):
            k, m = _merge(key & U64((1 << 8 * (d + 1)) - 1), n)
            nodes, zeros, ones = nodes_of(k, m)
            own = log_kt(zeros, ones)
            if below is None:
                weight, total = np.ones(len(own)), own
            else:
                parent, sums = _merge(below[0] & U64((1 << 8 * (d + 1)) - 1), below[1])
                children = np.zeros(len(nodes))
                children[np.searchsorted(nodes, parent)] = sums
                weight = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
                total = np.logaddexp(own, children) - np.log(2)
            self.levels[d] = (nodes, (ones + 0.5) / (zeros + ones + 1), weight)
            self.top[d] = (nodes, total)
            below = self.top[d]
            if d > 2:
                del self.top[d]

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the byte after its context."""
        out = np.zeros(len(gram))
        x = gram & U64(255)
        for bit in range(8):
            lead = (U64(1) << U64(bit)) | (x >> U64(8 - bit))
            up = ((x >> U64(7 - bit)) & U64(1)).astype(bool)
            p, known = np.full(len(gram), 0.5), np.zeros(len(gram), bool)
            for d in range(self.depth, -1, -1):
                nodes, one, weight = self.levels[d]
                if not len(nodes):
                    continue
                want = (gram & U64((1 << 8 * (d + 1)) - 1)) >> U64(8) << U64(8) | lead
                at = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)
                here = nodes[at] == want
                own = np.where(up, one[at], 1 - one[at])
                # a context never seen predicts as its suffix does
                deeper = np.where(known, p, own)
                p = np.where(here, weight[at] * own + (1 - weight[at]) * deeper, p)
                known |= here
            out += np.log10(p)
        return out


def trees(counts: DataFrame, depth: int, shard_grams: int) -> Iterator[tuple[int, int, ContextTree]]:
    """(first, last + 1 pair of latest context bytes, tree) for every shard."""
    pair = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")
    sizes = dict(counts.groupBy(pair.alias("pair")).count().collect())  # 65,536 rows at most
    edges, held = [0], 0
    for p in range(1 << 16):
        if held and held + sizes.get(p, 0) > shard_grams:
            edges.append(p)
            held = 0
        held += sizes.get(p, 0)
    edges.append(1 << 16)

    def load(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        got = counts.where((pair >= a) & (pair < b)).toArrow()
        key, n = got.column("gram").to_numpy().view(U64), got.column("n").to_numpy()
        order = np.argsort(key)
        return key[order], n[order]

    shards = list(zip(edges, edges[1:]))
    if len(shards) == 1:
        yield *shards[0], ContextTree(*load(*shards[0]), depth)
        return
    # what the depths below two need of all shards: 65,536 contexts of 255 nodes are
    # reduced to 256 contexts as each shard is read
    low, low_n, top, top_sum = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0)
    for a, b in shards:
        key, n = load(a, b)
        tree = ContextTree(key, n, depth)
        k, m = _merge(key & U64(0xFFFF), n)
        low, low_n = _merge(np.concatenate([low, k]), np.concatenate([low_n, m]))
        k, s = _merge(tree.top[2][0] & U64(0xFFFF), tree.top[2][1])
        top, top_sum = _merge(np.concatenate([top, k]), np.concatenate([top_sum, s]))
    for a, b in shards:
        yield a, b, _sharded(*load(a, b), depth, low, low_n, top, top_sum)


def _sharded(key, n, depth, low, low_n, top, top_sum) -> ContextTree:
    """A shard's tree with the whole corpus at depths 0 and 1."""
    tree = ContextTree(key, n, depth)
    nodes, zeros, ones = nodes_of(low, low_n)
    own, children = log_kt(zeros, ones), np.zeros(len(nodes))
    children[np.searchsorted(nodes, top)] = top_sum
    tree.levels[1] = (nodes, (ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(children - own, -700, 700))))
    total = np.logaddexp(own, children) - np.log(2)
    k, m = _merge(low & U64(0xFF), low_n)
    root, zeros, ones = nodes_of(k, m)
    own, (parent, sums) = log_kt(zeros, ones), _merge(nodes & U64(0xFF), total)
    children = np.zeros(len(root))
    children[np.searchsorted(root, parent)] = sums
    tree.levels[0] = (root, (ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(children - own, -700, 700))))
    return tree


def _scored(shared, first: int, last: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            data, offs = flat(batch.column(1))
            out = []
            for _, _, raw, off in pieces(data, offs, 1 << 20):
                g, count = grams(*marked(raw, off, depth), depth)
                row = np.repeat(np.arange(len(count)), count)
                pair = (g >> U64(8)) & U64(0xFFFF)
                mine = (pair >= U64(first)) & (pair < U64(last))
                key, inverse = np.unique(g[mine], return_inverse=True)
                out.append(np.bincount(row[mine], tree.log10(key)[inverse], minlength=len(count)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["uid", "score"])
    return run


def tree_scores(texts: DataFrame, training: DataFrame, depth: int = 4, shard_grams: int = 1 << 20) -> DataFrame:
    """uid, score for a frame (uid, text); ``training`` holds one text column."""
    spark = texts.sparkSession
    counts = cut_lineage(context_counts(training, depth))
    release(spark)
    passes = None
    for first, last, tree in trees(counts, depth, shard_grams):
        part = texts.mapInArrow(_scored(spark.sparkContext.broadcast(tree), first, last, depth), "uid long, score double")
        part = part.withColumn("shard", F.lit(first))
        passes = part if passes is None else passes.union(part)
    # repeated rows share a uid and a score
    return passes.groupBy("uid", "shard").agg(F.max("score").alias("score")).groupBy("uid").agg(F.sum("score").alias("score"))
