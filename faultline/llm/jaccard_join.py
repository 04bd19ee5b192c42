"""N-gram Jaccard join by prefix trees, exact at every group size.

1. A text becomes the set of its distinct k-word shingles (fingerprints). Equal sets are
   one set from here on.
2. Shingles are dealt over hash parts to learn in how many sets each occurs. A set can
   only have a partner if enough of its shingles occur elsewhere; all others end here,
   whatever passages or licence lines they share with the rest of the corpus.
3. The global order of shingles is (frequency, fingerprint). Two sets that link share one
   of the first |s| - ceil(t|s|) + 1 shingles of each (prefix filter), so sets meet in
   groups, one for each such shingle.
4. In a group every set is compared with its most central member (the one with the
   largest part of shared shingles). That is linear in the group and links nearly all
   that can be linked; components follow from those links.
5. Groups that still hold several components are joined exactly. Overlapping groups form
   families; a family of bounded size is one group from here on, a larger one where that
   compares fewer pairs than its overlapping groups would. Sets of a small group are stored in
   a prefix tree, a probe walks it once, shares the overlap counted so far between all
   sets below a node, leaves a subtree when the remaining lengths cannot reach the
   threshold, and skips what is already in its component. In a larger group the overlaps of
   all its pairs are one matrix: frequent shingles by a product, rarer ones pair by pair. The
   largest component is never probed with itself. Groups with the same members are joined
   once; large ones are cut into blocks of bounded size, each pair of blocks a task of its own.

Results: one row per document with its set size and component. Null or blank texts have
an empty set and are linked with nothing. A text with fewer than k words is one shingle.
Repeated rows and exact copies share a component. A null id counts as the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, pack, parts_of, pick, release, unpack
from .graph import connected
from .postings import by_group, deal, part_of, rows_of
from .textcode import U64, distinct_by_row, flat, mix, pieces, shingles, words

NULL_ID = -(1 << 63)
LOW_BYTES = U64((1 << 56) - 1)
#: sets and shingles of one side of a block pair
BLOCK_SETS, BLOCK_TOKENS = 2048, 1 << 21
KEY = ("whole", "token", "p", "t")
#: pairs from which a group's overlaps are a matrix; cells of it that a product fills in the
#: time of one pair; shingles of a product, and pairs counted, at once
MATRIX_PAIRS, CELLS_A_PAIR, PRODUCT, COUNTED = 1 << 12, 256, 1 << 10, 1 << 20


def _shingled(k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = flat(batch.column(1))
            for a, b, raw, off in pieces(data, offs):
                keys, blobs = [], []
                value, count = distinct_by_row(*shingles(*words(raw, off), k))
                row = np.repeat(np.arange(b - a), count)
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value))])
                ends = np.cumsum(count)
                sid = mix(sums[ends] - sums[ends - count] + count.astype(U64))
                sid[count == 0] = 0
                keys.append(-1 - int(part_of(mix(ids[a:a + 1].astype(U64)), parts)[0]))
                blobs.append(pack(ids[a:b], sid, count.astype(np.int64)))
                fresh = np.array([s not in sent for s in sid.tolist()], bool)
                if len(sent) < 1 << 20:
                    sent.update(sid.tolist())
                if not fresh.all():
                    keep = fresh[row]
                    value, row = value[keep], row[keep]
                for part, r, n, at in deal(value, row, parts):
                    keys.append(part)
                    blobs.append(pack(sid[r], count[r].astype(np.int32), n.astype(np.int32), value[at] & LOW_BYTES))
                yield rows_of(keys, blobs)
    return run


def _shared(parts: int, group: pa.Table) -> pa.Table:
    """Of one hash part: the shingles that several sets have, with their frequency, dealt
    by set. Rows about documents pass through."""
    key = group.column("key")[0].as_py()
    blobs = group.column("blob").to_pylist()
    if key < 0:
        return pa.Table.from_batches([rows_of([key] * len(blobs), blobs, [1] * len(blobs))])
    parts_in = [unpack(b, U64, np.int32, np.int32, U64) for b in blobs]
    sid, size, count, value = (np.concatenate(x) for x in zip(*parts_in))
    first = np.zeros(len(sid), bool)
    first[np.unique(sid, return_index=True)[1]] = True
    value = value[np.repeat(first, count)] | U64(key << (64 - parts.bit_length() + 1) >> 56 << 56)
    sid, size, count = sid[first], size[first], count[first]
    _, inverse, times = np.unique(value, return_inverse=True, return_counts=True)
    times = times[inverse]
    several = times > 1
    row = np.repeat(np.arange(len(sid)), count)[several]
    value, times = value[several], times[several].astype(np.uint32)
    keys, out = [], []
    for part, r, n, at in deal(sid[row], row, parts):
        keys.append(part)
        out.append(pack(sid[r], size[r], n.astype(np.int32), value[at], times[at]))
    return pa.Table.from_batches([rows_of(keys, out, [0] * len(keys))])


def _sets(percent: int, group: pa.Table) -> pa.Table:
    """Of one part of sets: those that enough shared shingles leave a partner, with these
    shingles in global order and the length of their prefix."""
    got = [unpack(b, U64, np.int32, np.int32, U64, np.uint32) for b in group.column("blob").to_pylist()]
    sid, size, count, value, times = (np.concatenate(x) for x in zip(*got))
    names, at, inverse = np.unique(sid, return_index=True, return_inverse=True)
    size = size[at].astype(np.int64)
    row = np.repeat(inverse, count)
    shared = np.bincount(row, minlength=len(names))
    alive = 100 * shared >= percent * size
    keep = alive[row]
    row, value, times = row[keep], value[keep], times[keep]
    order = np.lexsort((value, times, row))
    names, size, shared = names[alive], size[alive], shared[alive]
    need = -(-percent * size // 100)
    offsets = np.concatenate([[0], np.cumsum(shared)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order].view(np.int64)))
    return pa.table({"sid": names.view(np.int64), "n": size, "shared": shared,
                     "prefix": shared - need + 1, "tokens": tokens})


def document_sets(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str
                  ) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, n_shingles) of every document, and the sets that may have partners."""
    src = pick(docs, doc_id=id_col, text=text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    # a power of two, 256 at least: the part says the leading byte, which is not sent
    parts = 1 << max(8, (parts_of(src, "text", 6) - 1).bit_length())
    stored = cut_lineage(src.mapInArrow(_shingled(k, parts), "key long, blob binary")
                         .groupBy("key").applyInArrow(by_group(_shared, parts), "kind int, key long, blob binary"))
    release(docs.sparkSession)
    rows = stored.where("kind = 1").select("blob").mapInArrow(_documents, "doc_id long, sid long, n_shingles long")
    sets = cut_lineage(stored.where("kind = 0").select("key", "blob").groupBy("key").applyInArrow(
        by_group(_sets, percent), "sid long, n long, shared long, prefix long, tokens array<long>"))
    release(docs.sparkSession)
    return rows, sets


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            doc, sid, n = unpack(blob, np.int64, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sid), pa.array(n)],
                                             names=["doc_id", "sid", "n_shingles"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity reaches the threshold. The set of ``a``,
    of which there may be many pairs, is joined while the rows are still narrow."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"))


class PrefixTree:
    """Token sequences in lexicographic order, with the length each shares with the one
    before it: a prefix tree in arrays. A sequence adds one edge (what it does not share);
    ``end`` is the first sequence outside the branch that starts with this edge."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        ordered = [sequences[i] for i in self.order]
        n = len(ordered)
        self.common = [0] * n
        for i, (x, y) in enumerate(zip(ordered, ordered[1:]), 1):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            self.common[i] = int(differ[0]) if len(differ) else m
        own = [s[c:] for s, c in zip(ordered, self.common)]
        self.edge = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.start = np.cumsum([0, *[len(o) for o in own]]).tolist()
        self.end, self.longest = [n] * n, [len(s) for s in ordered]
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n and self.common[j] > self.common[i]:
                self.longest[i] = max(self.longest[i], self.longest[j])
                j = self.end[j]
            self.end[i] = j

    def walk(self, member: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """(sequence, overlap with the probe) wherever the overlap can reach ``least``;
        ``member`` tells of every token whether the probe has it."""
        counted = np.concatenate([[0], np.cumsum(member[self.edge])]).tolist()
        path: list[tuple[int, int, int]] = []  # depth where an edge starts, overlap so far, edge
        i, n = 0, len(self.common)
        while i < n:
            depth = self.common[i]
            while path and path[-1][0] >= depth:
                path.pop()
            overlap = 0
            if path:
                above, so_far, e = path[-1]
                overlap = so_far + counted[self.start[e] + depth - above] - counted[self.start[e]]
            if overlap + self.longest[i] - depth < least:
                i = self.end[i]
                continue
            path.append((depth, overlap, i))
            total = overlap + counted[self.start[i + 1]] - counted[self.start[i]]
            if total >= least:
                yield self.order[i], total
            i += 1


class Roots:
    """Components that links have joined."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def tree_join(sid: np.ndarray, size: np.ndarray, comp: np.ndarray, probe: np.ndarray, target: np.ndarray,
              tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components of one group: enough of them to connect
    whatever the group's links connect."""
    counts = [len(t) for t in tokens]
    _, code, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    by_frequency = np.empty(len(times), np.int64)
    by_frequency[np.argsort(-times, kind="stable")] = np.arange(len(times))
    sequences = [np.sort(c) for c in np.split(by_frequency[code], np.cumsum(counts)[:-1])]
    of_target = np.flatnonzero(target)
    tree = PrefixTree([sequences[i] for i in of_target])
    links, roots, smallest = [], Roots(), int(size[of_target].min()) if len(of_target) else 0
    member = np.zeros(len(times), bool)
    names, comps, sizes = sid.tolist(), comp.tolist(), size.tolist()
    for i in np.flatnonzero(probe).tolist():
        member[sequences[i]] = True
        n = sizes[i]
        least = -(-percent * (n + max(smallest, -(-percent * n // 100))) // (100 + percent))
        for j, overlap in tree.walk(member, least):
            j = int(of_target[j])
            if 100 * overlap >= percent * (n + sizes[j] - overlap) and roots.join(comps[i], comps[j]):
                links.append((names[i], names[j]))
        member[sequences[i]] = False
    return links


def overlaps(probes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Tokens that each of ``probes`` shares with each of ``targets``."""
    rows, cols = len(probes), len(targets)
    _, code = np.unique(np.concatenate([*probes, *targets]), return_inverse=True)
    kinds = int(code.max()) + 1 if len(code) else 0
    side = []
    for sets, codes in ((probes, code[:sum(map(len, probes))]), (targets, code[sum(map(len, probes)):])):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(codes, kind="stable")
        times = np.bincount(codes, minlength=kinds)
        side.append((owner[order], codes[order], times, np.cumsum(times) - times))
    (p, p_code, p_times, _), (t, t_code, t_times, t_first) = side
    pairs = p_times * t_times
    frequent = pairs * CELLS_A_PAIR > rows * cols
    # exact in floats: an overlap is far below 2^24
    got = np.zeros((rows, cols), np.float32)
    column = np.cumsum(frequent) - 1
    for a in range(0, int(frequent.sum()), PRODUCT):
        inside = frequent & (column >= a) & (column < a + PRODUCT)
        sheets = []
        for owner, codes, height in ((p, p_code, rows), (t, t_code, cols)):
            here = inside[codes]
            sheet = np.zeros((height, int(inside.sum())), np.float32)
            sheet[owner[here], column[codes[here]] - a] = 1
            sheets.append(sheet)
        got += sheets[0] @ sheets[1].T
    rare = np.flatnonzero((~frequent & (pairs > 0))[p_code])
    repeat = t_times[p_code[rare]]
    ends = np.cumsum(repeat)
    flat, at = got.reshape(-1), 0
    while at < len(rare):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, "right")))
        own, n = rare[at:stop], repeat[at:stop]
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(t_first[p_code[own]], n)
        np.add.at(flat, np.repeat(p[own], n) * cols + t[other], np.float32(1))
        at = stop
    return got


def matrix_join(sid: np.ndarray, size: np.ndarray, comp: np.ndarray, probe: np.ndarray, target: np.ndarray,
                tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """As :func:`tree_join`, by the matrix of overlaps."""
    of_probe, of_target = np.flatnonzero(probe), np.flatnonzero(target)
    both = overlaps([tokens[i] for i in of_probe], [tokens[j] for j in of_target])
    links, roots = [], Roots()
    for i, row in zip(of_probe.tolist(), both):
        shared = row.astype(np.int64)
        hit = of_target[(100 * shared >= percent * (size[i] + size[of_target] - shared)) & (comp[of_target] != comp[i])]
        # one link to each component is enough
        for j in hit[np.unique(comp[hit], return_index=True)[1]].tolist():
            if roots.join(int(comp[i]), int(comp[j])):
                links.append((int(sid[i]), int(sid[j])))
    return links


def _join_groups(percent: int):
    """Rows sorted by (group, p, t), one task of the join after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            col = {c: table.column(c).to_numpy() for c in ("p", "t", "p0", "t0", "probe", "sid", "n", "comp")}
            tokens = [np.asarray(x, np.int64) for x in table.column("tokens").combine_chunks().to_numpy(zero_copy_only=False)]
            target = col["t0"] == col["t"]
            probe = col["probe"].astype(bool) & (col["p0"] == col["p"])
            join = matrix_join if int(probe.sum()) * int(target.sum()) >= MATRIX_PAIRS else tree_join
            links = join(col["sid"], col["n"], col["comp"], probe, target, tokens, percent)
            a, b = (list(x) for x in zip(*links)) if links else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in KEY]
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            if held:
                last = held[-1].slice(held[-1].num_rows - 1)
                change[0] = any(last.column(last.schema.names.index(c))[0].as_py() != k[0]
                                for c, k in zip(KEY, keys))
            edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
            at = 0
            for e in edges:
                if e > at:
                    held.append(batch.slice(at, e - at))
                if e < batch.num_rows and held:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                at = e
        if held:
            yield solve(pa.Table.from_batches(held))
    return run


def components(sets: DataFrame, percent: int, block_sets: int = BLOCK_SETS) -> DataFrame:
    """sid -> comp for the sets that link with another."""
    prefix = sets.select("sid", "n", F.col("shared").alias("weight"), (F.col("shared") / F.col("n")).alias("central"),
                         F.explode(F.slice("tokens", F.lit(1), F.col("prefix").cast("int"))).alias("token"))
    leader = (prefix.groupBy("token")
              .agg(F.max_by(F.struct("sid", "n"), F.struct("central", "sid")).alias("lead"), F.count(F.lit(1)).alias("c"))
              .where("c > 1").select("token", F.col("lead.sid").alias("lead"), F.col("lead.n").alias("lead_n")))
    near = (prefix.join(leader, "token")
            .where((F.col("sid") != F.col("lead"))
                   & (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")))
            .select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct())
    first = cut_lineage(connected(_links(near, sets, percent)))
    del near
    release(sets.sparkSession)

    comp_of = lambda df: df.join(first.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("label", "sid")).drop("label")
    member = comp_of(prefix.select("token", "sid", "weight"))
    # per (token, component) first, so that a hot shingle is summed before it meets
    per_comp = member.groupBy("token", "comp").agg(
        F.count(F.lit(1)).alias("c"), F.min("sid").alias("hub"),
        F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"))
    mixed = (per_comp.groupBy("token")
             .agg(F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
                  F.count(F.lit(1)).alias("comps"), F.min("hub").alias("hub"))
             .where("comps > 1")
             .groupBy("c", "x", "y").agg(F.min(F.struct("token", "hub")).alias("g")).select("g.token", "g.hub"))
    mixed = cut_lineage(member.join(mixed, "token"))
    # groups that overlap form a family; one of bounded size is joined as one group, a larger one
    # as one group or as those it is made of, whichever compares fewer pairs
    family = connected(mixed.select(F.col("sid").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct())
    family = family.join(sets.select(F.col("sid").alias("node"), F.col("shared").alias("weight")), "node")
    fits = (family.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("w"))
            .select(F.col("label").alias("hub"), ((F.col("c") <= block_sets) & (F.col("w") <= BLOCK_TOKENS)).alias("fits")))
    family = family.join(fits.withColumnRenamed("hub", "label"), "label").withColumnsRenamed({"label": "family", "node": "sid"})
    whole = comp_of(family.select("family", "sid", "weight"))
    apart = mixed.join(family.where("not fits").select("family", "sid"), "sid")
    grouped = cut_lineage(whole.select("family", F.col("family").alias("token"), "sid", "comp", "weight", F.lit(True).alias("whole")).union(
        apart.select("family", "token", "sid", "comp", "weight", F.lit(False))))
    block = lambda c, w: F.ceil(F.greatest(F.col(c) / block_sets, F.col(w) / BLOCK_TOKENS)).cast("int")
    of_group = (grouped.groupBy("family", "whole", "token", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("w"))
                .groupBy("family", "whole", "token").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("c", "w", "comp")).alias("g"))
                .withColumns({"pc": F.col("c") - F.col("g.c"), "pw": F.col("w") - F.col("g.w")}).where("pc > 0"))
    fewest = (of_group.groupBy("family", "whole").agg(F.sum(F.col("c") * F.col("pc")).alias("pairs"))
              .groupBy("family").agg(F.min_by("whole", F.struct("pairs", ~F.col("whole"))).alias("whole")))
    blocks = of_group.join(fewest, ["family", "whole"]).select(
        "whole", "token", F.col("g.comp").alias("largest"), block("c", "w").alias("kt"), block("pc", "pw").alias("kp"))
    placed = (grouped.join(blocks, ["whole", "token"])
              .withColumn("probe", F.col("comp") != F.col("largest"))
              .withColumn("p0", F.when(F.col("probe"), F.pmod(F.xxhash64("sid"), "kp")).otherwise(-1).cast("int"))
              .withColumn("t0", F.pmod(F.xxhash64("sid"), "kt").cast("int"))
              .withColumn("at", F.explode(F.array_distinct(F.concat(
                  F.transform(F.sequence(F.lit(0), F.col("kp") - 1), lambda p: F.struct(p.alias("p"), F.col("t0").alias("t"))),
                  F.when(F.col("probe"), F.transform(F.sequence(F.lit(0), F.col("kt") - 1),
                                                     lambda t: F.struct(F.col("p0").alias("p"), t.alias("t"))))
                  .otherwise(F.array().cast("array<struct<p:int,t:int>>")))))))
    rows = placed.select("whole", "token", "at.p", "at.t", "p0", "t0", "probe", "sid", "comp").join(sets.select("sid", "n", "tokens"), "sid")
    more = cut_lineage(rows.repartition("whole", "token", "p", "t").sortWithinPartitions("whole", "token", "p", "t")
                       .mapInArrow(_join_groups(percent), "a long, b long"))
    if more.isEmpty():
        return first.select(F.col("node").alias("sid"), F.col("label").alias("comp"))
    # the components met so far are the nodes of the second graph
    start = lambda c: first.select(F.col("node").alias(c), F.col("label").alias(f"{c}_comp"))
    joined = (more.join(start("a"), "a", "left").join(start("b"), "b", "left")
              .select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b"))
    second = connected(joined)
    old = first.select(F.col("node").alias("sid"), "label").union(
        joined.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(first.select(F.col("node").alias("sid")), "sid", "left_anti")
        .select("sid", F.col("sid").alias("label")))
    return old.join(second.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select(
        "sid", F.coalesce("to", "label").alias("comp"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id",
                       text_col: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach, its own included.
    Documents link when 100 * intersection >= percent * union of their shingle sets."""
    rows, sets = document_sets(docs, k, percent, id_col, text_col)
    comp = components(sets, percent, block_sets)
    per_set = rows.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    best = (per_set.join(comp, "sid", "left")
            .select("sid", "least", F.coalesce("comp", "sid").alias("comp")))
    lowest = best.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = best.join(lowest, "comp").select("sid", "component_id")
    unmark = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return (rows.join(named, "sid", "left")
            .select(unmark("doc_id"), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("component_id", unmark("component_id")))
