"""Best cut of every leave-one-out fold from one index of the scores.

The z of a row depends on the fold, so a plain answer visits folds x distinct scores. But z
is an affine map of the score inside a step type, hence monotone: a fold needs only how many
rows lie below its cut points. The index holds each (subset, type)'s distinct scores in
order, cut into blocks, with counts per block; a fold subtracts its own file's counts.

A *zone* is a run of candidate thresholds between two neighbouring block edges. From the
block counts alone, a fold has a lower and an upper bound of the objective on each zone.
Zones whose upper bound is under the best lower bound cannot win and are skipped; only the
blocks that reach into a remaining zone are opened, by a join, and only there are rows
compared one by one. The result is exact.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.stats import z_score
from ..schema import K
from ..session import cut_lineage
from .sequence import running_total

POOLED = ""
BLOCKS = 16_384
FOLDS_PER_TASK = 128
RUNS = 256

FOUND = ("subset string, file_id string, cell string, asks boolean, zone long, last long, k long, ok long, "
         "bad long, lo_ok long, lo_bad long, n_ok long, n_bad long, kind string, block long, mean double, sd double")
NAMES = [c.split()[0] for c in FOUND.split(", ")]


def score_index(labelled: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Distinct scores with their block and counts, per (subset, kind) and per file of it.

    Rows without a score (null or NaN) are left out; rows without a type are of kind ''."""
    rows = labelled.filter(F.col("p_raw").isNotNull() & ~F.isnan("p_raw")).select(
        *K, F.coalesce("type_norm", F.lit(POOLED)).alias("kind"), F.col("p_raw").cast("double").alias("p"),
        "correct")
    own = cut_lineage(rows.groupBy(*K, "kind", "p").agg(
        F.count_if("correct").alias("ok"), F.count_if(~F.col("correct")).alias("bad")))
    scores = own.groupBy("subset", "kind", "p").agg(
        F.sum("ok").alias("ok"), F.sum("bad").alias("bad"), F.lit(1).alias("_one"))
    placed = running_total(scores, ["subset", "kind"], ["p"], {"_pos": "_one"})
    sizes = placed.groupBy("subset", "kind").agg(F.ceil(F.max("_pos") / F.lit(blocks)).alias("_len"))
    index = cut_lineage(placed.join(sizes, ["subset", "kind"]).select(
        "subset", "kind", "p", "ok", "bad", F.floor((F.col("_pos") - 1) / F.col("_len")).alias("block")))
    at = index.select("subset", "kind", "p", "block")
    return index, cut_lineage(own.join(at, ["subset", "kind", "p"]))


def best_cuts(labelled: DataFrame, folds: DataFrame, objective: str = "f1",
              blocks: int = BLOCKS, folds_per_task: int = FOLDS_PER_TASK) -> DataFrame:
    """(subset, file_id, cell, threshold) for ``folds`` (subset, file_id, stats map).

    A block table has at most ``blocks`` rows per (subset, type). It is sent once for every
    ``folds_per_task`` folds; the driver holds nothing."""
    index, own = score_index(labelled, blocks)
    chunks = folds.groupBy("subset").agg(F.ceil(F.count(F.lit(1)) / F.lit(folds_per_task)).alias("_n"))
    names = ["block", "p_lo", "p_hi", "ok", "bad"]
    table = index.groupBy("subset", "kind", "block").agg(
        F.min("p").alias("p_lo"), F.max("p").alias("p_hi"), F.sum("ok").alias("ok"), F.sum("bad").alias("bad"))
    table = _listed(table, ["subset", "kind"], names).join(chunks, "subset").withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    mine = own.groupBy(*K, "kind", "block").agg(F.sum("ok").alias("ok"), F.sum("bad").alias("bad"))
    mine = _listed(mine, K, ["kind", "block", "ok", "bad"])
    fits = F.map_entries("stats")
    asking = folds.join(mine, K, "left").join(chunks, "subset").select(
        *K, F.pmod(F.xxhash64("file_id"), "_n").alias("_c"), "kind", "block", "ok", "bad",
        F.transform(fits, lambda e: e["key"]).alias("cells"),
        F.transform(fits, lambda e: e["value"]["mean"]).alias("means"),
        F.transform(fits, lambda e: e["value"]["sd"]).alias("sds"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lines = {r.kind: _Kind(r.p_lo, r.p_hi, r.ok, r.bad) for r in right.itertuples()}
        return _frame([part for fold in left.itertuples() for part in fold_zones(fold, lines, objective)])

    # few bytes, much work: partitions by number, which are not merged for their small size
    parts = int(folds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["subset", "_c"]
    found = cut_lineage(asking.repartition(parts, *key).groupBy(*key).cogroup(
        table.repartition(parts, *key).groupBy(*key)).applyInPandas(search, FOUND))
    return _best(found, index, own, objective)


def _listed(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The rows of a key as parallel arrays, in the order of ``names``."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_r"))
    return rows.select(*keys, *[F.col("_r").getField(n).alias(n) for n in names])


def _best(found: DataFrame, index: DataFrame, own: DataFrame, objective: str) -> DataFrame:
    """Opens the blocks asked for and takes the best candidate of the remaining zones."""
    key = [*K, "cell", "zone"]
    counts = ["ok", "bad", "lo_ok", "lo_bad"]
    asked = found.filter("asks").select(*key, "last", "kind", "block", "mean", "sd")
    less = own.select(*K, "kind", "block", "p", (-F.col("ok")).alias("ok"), (-F.col("bad")).alias("bad"))
    opened = asked.join(index, ["subset", "kind", "block"]).unionByName(asked.join(less, [*K, "kind", "block"]))
    z = z_score("p", "mean", "sd")
    opened = opened.withColumn("z", z).withColumn("k", F.rint(F.col("z") * 1000.0)).filter("k <= last")
    inside = F.col("k") >= F.col("zone")
    below = inside & (F.col("z") < F.col("k") / 1000.0)
    opened = opened.select(
        *key, F.when(inside, F.col("k").cast("long")).otherwise(F.col("zone") - 1).alias("k"), "ok", "bad",
        F.when(below, F.col("ok")).otherwise(0).alias("lo_ok"),
        F.when(below, F.col("bad")).otherwise(0).alias("lo_bad"),
        F.lit(0).cast("long").alias("n_ok"), F.lit(0).cast("long").alias("n_bad"))
    known = found.filter("NOT asks").select(*key, "k", *counts, "n_ok", "n_bad")
    cells = known.unionByName(opened).groupBy(*key, "k").agg(
        *[F.sum(c).alias(c) for c in counts], F.max("n_ok").alias("n_ok"), F.max("n_bad").alias("n_bad"))
    zone = Window.partitionBy(*key)
    before = zone.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    tp = F.coalesce(F.sum("bad").over(before), F.lit(0)) + F.col("lo_bad")
    fp = F.coalesce(F.sum("ok").over(before), F.lit(0)) + F.col("lo_ok")
    cells = cells.select(
        *K, "cell", "zone", "k", "ok", "bad", tp.alias("tp"), fp.alias("fp"),
        F.max("n_ok").over(zone).alias("n_ok"), F.max("n_bad").over(zone).alias("n_bad"))
    value = objective_of(F.col("tp"), F.col("fp"), F.col("n_ok"), F.col("n_bad"), objective)
    candidate = (F.col("k") >= F.col("zone")) & (F.col("ok") + F.col("bad") > 0) & (
        F.col("n_ok") > 0) & (F.col("n_bad") > 0)
    best = cells.groupBy(*K, "cell").agg(
        F.max(F.when(candidate, F.struct(value.alias("v"), (-F.col("k")).alias("nk")))).alias("b"))
    return best.select(*K, "cell", F.coalesce(-F.col("b.nk") / F.lit(1000.0), F.lit(0.0)).alias("threshold"))


def objective_of(tp, fp, n_ok, n_bad, objective: str):
    """F1 of calling everything below the cut incorrect, or Youden's J; numbers or columns."""
    if objective == "f1":
        return (2 * tp) / (2 * tp + fp + (n_bad - tp))
    return tp / n_bad - fp / n_ok


class _Kind:
    """The blocks of one type over all files, and runs of neighbouring blocks."""

    def __init__(self, p_lo, p_hi, ok, bad):
        self.p_lo, self.p_hi = np.asarray(p_lo, float), np.asarray(p_hi, float)
        self.ok, self.bad = (_before(np.asarray(c, "int64")) for c in (ok, bad))
        size = -(-len(self.p_lo) // RUNS)
        self.starts = np.arange(0, len(self.p_lo), size)
        self.ends = np.append(self.starts[1:], len(self.p_lo))


class _Line:
    """One type under one fold's fit, with the fold's own counts taken out."""

    def __init__(self, table: _Kind, at, own_ok, own_bad, mean, sd):
        self.table, self.at, self.mean, self.sd = table, at, mean, sd
        self.own = {"ok": _before(own_ok), "bad": _before(own_bad)}
        self.n_ok, self.n_bad = (int(self._rows(side, np.array([len(table.p_lo)]))[0]) for side in ("ok", "bad"))
        self.runs = _Blocks(self, table.starts, table.ends)

    def _rows(self, side: str, blocks):
        """Rows of the other files before each block."""
        return getattr(self.table, side)[blocks] - self.own[side][np.searchsorted(self.at, blocks)]

    def _z(self, p):
        return (p - self.mean) / max(self.sd, V.MIN_SD)

    def blocks(self, spans) -> "_Blocks":
        """The blocks that reach into the spans of candidates, and the next block on either
        side: the counts before any candidate of a span are then those of all blocks."""
        t, runs = self.table, self.runs
        take = np.zeros(len(t.p_lo), bool)
        for a, c in zip(np.maximum(np.searchsorted(runs.k_hi, spans[0]) - 1, 0).tolist(),
                        np.minimum(np.searchsorted(runs.k_lo, spans[1], "right"), len(t.starts) - 1).tolist()):
            take[t.starts[min(a, len(t.starts) - 1)]:t.ends[c]] = True
        return _Blocks(self, *(lambda i: (i, i + 1))(np.flatnonzero(take)))


class _Blocks:
    """Edges and counts of blocks, or of runs of them, from ``starts`` up to ``ends``."""

    def __init__(self, line: _Line, starts, ends):
        t, at = line.table, line.at
        self.block = starts
        self.z_lo, self.z_hi = line._z(t.p_lo[starts]), line._z(t.p_hi[ends - 1])
        self.k_lo = np.rint(self.z_lo * 1000.0).astype("int64")
        self.k_hi = np.rint(self.z_hi * 1000.0).astype("int64")
        after = ends[-1:]
        self.ok = line._rows("ok", np.concatenate([starts, after]))
        self.bad = line._rows("bad", np.concatenate([starts, after]))
        ok, bad = line._rows("ok", ends) - self.ok[:-1], line._rows("bad", ends) - self.bad[:-1]
        self.counts, self.some = (ok, bad), ok + bad > 0
        one = self.k_lo == self.k_hi
        # the ends of a block that the fold's file has no row in are rows of other files
        lo, hi = (self.some & (one | ~_among(at, edge)) for edge in (starts, ends - 1))
        self.sure = np.concatenate([self.k_lo[lo], self.k_hi[hi]])

    def sides(self):
        """Counts of blocks of one candidate, all on one side of it, which need not be opened:
        under it and over it, and the blocks left to open."""
        (ok, bad), one = self.counts, self.k_lo == self.k_hi
        under = one & (self.z_hi < self.k_lo / 1000.0)
        over = one & (self.z_lo >= self.k_lo / 1000.0)
        return (_before(ok * under), _before(bad * under), _before(ok * over), _before(bad * over),
                np.flatnonzero(self.some & ~(under | over)))


def _among(at, blocks):
    return np.searchsorted(at, blocks, "right") > np.searchsorted(at, blocks)


def _in_points(values, points):
    """Which of the ascending points are among the values."""
    at = np.minimum(points.searchsorted(values), len(points) - 1)
    out = np.zeros(len(points), bool)
    out[at[points[at] == values]] = True
    return out


def _frame(parts: list[dict]) -> pd.DataFrame:
    """One frame of parts whose columns are arrays, or one value for all rows of the part."""
    if not parts:  # no fold of the subset fell to this task
        return pd.DataFrame(columns=NAMES)
    sizes = [len(p["zone"]) for p in parts]
    blank = dict.fromkeys(NAMES, 0) | {"subset": "", "file_id": "", "cell": "", "kind": "", "mean": 0.0, "sd": 0.0}
    columns = {}
    for name in NAMES:
        values = [p.get(name, blank[name]) for p in parts]
        if any(isinstance(v, np.ndarray) for v in values):
            columns[name] = np.concatenate([v if isinstance(v, np.ndarray) else np.full(n, v) for v, n in zip(values, sizes)])
        else:
            columns[name] = np.repeat(np.array(values, object if isinstance(blank[name], str) else None), sizes)
    return pd.DataFrame(columns)


def _before(counts):
    return np.concatenate([[0], np.cumsum(counts)])


def fold_zones(fold, lines: dict, objective: str):
    """Columns of :data:`FOUND` for one fold: per remaining zone the rows counted from blocks
    (the one with ``k = zone - 1`` counts all below) and, where ``asks``, the blocks to open."""
    fit = {c: (m, s) for c, m, s in zip(fold.cells, fold.means, fold.sds)}
    has = fold.kind is not None
    kinds = np.asarray(fold.kind, dtype=object) if has else np.empty(0, object)
    at, own_ok, own_bad = (np.asarray(x if has else [], "int64") for x in (fold.block, fold.ok, fold.bad))
    fitted = {}
    for kind, table in lines.items():
        mine = kinds == kind
        fitted[kind] = _Line(table, at[mine], own_ok[mine], own_bad[mine], *fit.get(kind, fit[POOLED]))
    for cell in fit:
        parts = fitted if cell == POOLED else {cell: fitted[cell]} if cell in fitted else {}
        for part in _cell_zones(parts, objective):
            yield part | {"subset": fold.subset, "file_id": fold.file_id, "cell": cell}


def _cell_zones(lines: dict, objective: str):
    n_ok, n_bad = sum(p.n_ok for p in lines.values()), sum(p.n_bad for p in lines.values())
    if n_ok <= 0 or n_bad <= 0:  # one class: no cut
        yield dict(asks=False, zone=np.zeros(1, "int64"), last=0, k=-1, ok=n_ok, bad=n_bad, n_ok=n_ok, n_bad=n_bad)
        return
    # runs of blocks first: only where one of them may win are the blocks looked at
    a, c, keep, _, least = _bounded({kind: p.runs for kind, p in lines.items()}, None, -np.inf, n_ok, n_bad, objective)
    a, c = a[keep], c[keep]
    order = np.argsort(a)
    a, c = a[order], c[order]
    apart = np.flatnonzero(a[1:] > c[:-1] + 1)
    spans = a[np.concatenate([[0], apart + 1])], c[np.concatenate([apart, [len(c) - 1]])]
    parts = {kind: p.blocks(spans) for kind, p in lines.items()}
    a, c, keep, reach, _ = _bounded(parts, spans, least, n_ok, n_bad, objective)
    zone, last = a[keep], c[keep]
    base_ok, base_bad = (sum(getattr(p, side)[reach[kind][0][keep]] for kind, p in parts.items()) for side in ("ok", "bad"))
    yield dict(asks=False, zone=zone, last=last, k=zone - 1, ok=base_ok, bad=base_bad, n_ok=n_ok, n_bad=n_bad)
    for kind, p in parts.items():
        first, end = reach[kind][0][keep], reach[kind][1][keep]
        *sums, to_open = p.sides()
        lo_ok, lo_bad, over_ok, over_bad = (s[end] - s[first] for s in sums)
        ok, bad = lo_ok + over_ok, lo_bad + over_bad
        some = ok + bad > 0
        if some.any():
            yield dict(asks=False, zone=zone[some], last=last[some], k=zone[some], ok=ok[some], bad=bad[some],
                       lo_ok=lo_ok[some], lo_bad=lo_bad[some])
        start, stop = np.searchsorted(to_open, first), np.searchsorted(to_open, end)
        n = stop - start
        if not n.any():
            continue
        which = np.repeat(np.arange(len(keep)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield dict(asks=True, zone=zone[which], last=last[which], kind=kind,
                   block=p.block[to_open[start[which] + step]], mean=lines[kind].mean, sd=lines[kind].sd)


def _bounded(parts: dict, spans, least: float, n_ok: int, n_bad: int, objective: str):
    """Zones between the edges of ``parts`` (inside ``spans`` of candidates), which of them may
    hold the best cut, the blocks of each part that reach into them, and a value that some
    candidate surely attains."""
    points = np.sort(np.concatenate([*(e for p in parts.values() for e in (p.k_lo, p.k_hi)), *(spans or ())]))
    points = points[np.concatenate([[True], points[1:] != points[:-1]])]
    part_of = np.zeros(len(points), "int64")
    if spans:
        part_of = np.searchsorted(spans[0], points, "right") - 1
        inside = (part_of >= 0) & (points <= spans[1][part_of])
        points, part_of = points[inside], part_of[inside]
    gap = np.flatnonzero((np.diff(points) > 1) & (part_of[1:] == part_of[:-1]))
    a = np.concatenate([points, points[gap] + 1])
    c = np.concatenate([points, points[gap + 1] - 1])
    t_lo, t_hi, f_lo, f_hi = np.zeros((4, len(a)), "int64")
    reached, reach = np.zeros(len(a), bool), {}
    a_z, c_z = a / 1000.0, c / 1000.0
    for kind, p in parts.items():
        below, begun = p.z_hi.searchsorted(a_z), p.z_lo.searchsorted(c_z)
        t_lo, f_lo = t_lo + p.bad[below], f_lo + p.ok[below]
        t_hi, f_hi = t_hi + p.bad[begun], f_hi + p.ok[begun]
        reach[kind] = first, end = p.k_hi.searchsorted(a), p.k_lo.searchsorted(c, "right")
        reached |= end > first
    low, high = (objective_of(t, f, n_ok, n_bad, objective) for t, f in ((t_lo, f_hi), (t_hi, f_lo)))
    # a zone of one candidate that some row surely has: the points come first
    sure = np.flatnonzero(_in_points(np.concatenate([p.sure for p in parts.values()]), points))
    least = max(least, low[sure].max() if len(sure) else -np.inf)
    return a, c, np.flatnonzero(reached & (high >= least)), reach, least
