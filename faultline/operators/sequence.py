"""Ordered computation over trajectories of any length.

A trajectory (or any other key) may hold a large share of all rows, so nothing
here sorts an unbounded key inside one task:

* step-level work is distributed on ``(subset, file_id, block)``, where a block
  is a fixed run of consecutive steps. Prefix quantities are a window inside the
  block plus a carry taken from the table of block totals, which has one row per
  block. Corpora whose longest trajectory fits one block (checked, see
  :func:`resolve`) skip the blocks: one shuffle on the trajectory key serves
  every window and join.
* rows ordered by something other than a step index go through
  :func:`running_total`, a prefix scan over range partitions that no key can fill.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import K
from ..session import cut_lineage

AUTO = -1
BLOCK_STEPS = 65_536
BLK = "_blk"


def resolve(steps: DataFrame, block: int | None = AUTO, idx: str = "step_idx") -> int | None:
    """Block size to use: ``None`` when no trajectory reaches the default block.

    The check reads one column and stops at the first long trajectory.
    """
    if block != AUTO:
        return block
    return None if steps.filter(F.col(idx) >= BLOCK_STEPS).isEmpty() else BLOCK_STEPS


def block_keys(block: int | None, keys=K) -> list[str]:
    return [*keys, BLK] if block else [*keys]


def with_block(df: DataFrame, block: int | None, idx: str = "step_idx") -> DataFrame:
    if not block:
        return df
    return df.withColumn(BLK, F.floor(F.col(idx) / F.lit(block)).cast("int"))


def spread(files: DataFrame, block: int | None, n: str = "n_steps") -> DataFrame:
    """One row per trajectory -> one row per block of it, the small side of a
    join on ``(K, block)``. Short trajectories stay a single row."""
    if not block:
        return files
    last = F.greatest(F.floor((F.col(n) - 1) / F.lit(block)), F.lit(0)).cast("int")
    return files.withColumn(BLK, F.explode(F.sequence(F.lit(0), last)))


def join_files(steps: DataFrame, files: DataFrame, how: str = "inner",
               block: int | None = AUTO, n: str = "n_steps") -> DataFrame:
    """Join per-trajectory columns onto steps without gathering a trajectory."""
    block = resolve(steps, block)
    return with_block(steps, block).join(spread(files, block, n), block_keys(block), how).drop(BLK)


def with_halo(df: DataFrame, before: int = 0, after: int = 0, block: int | None = None) -> DataFrame:
    """Copy the rows next to a block edge into the neighbouring block, so that a
    bounded frame (lag, lead, last n) is complete inside ``(K, block)``.
    Copies carry ``_core = false`` and are dropped after the window."""
    if not block:
        return df.withColumn("_core", F.lit(True))
    own = F.floor(F.col("step_idx") / F.lit(block)).cast("int")
    offset = F.col("step_idx") % F.lit(block)
    reach_b, reach_a = -(-before // block), -(-after // block)
    shifts = [F.lit(0)]
    for i in range(1, reach_b + 1):
        shifts.append(F.when(offset >= i * block - before, F.lit(i)))
    for i in range(1, reach_a + 1):
        shifts.append(F.when((offset < after - (i - 1) * block) & (own >= i), F.lit(-i)))
    return (
        df.withColumn("_shift", F.explode(F.array_compact(F.array(*shifts))))
        .withColumn(BLK, own + F.col("_shift"))
        .withColumn("_core", F.col("_shift") == 0)
        .drop("_shift")
    )


def block_window(block: int | None, *extra: str):
    return Window.partitionBy(*block_keys(block, [*K, *extra])).orderBy("step_idx")


def block_carry(df: DataFrame, totals: dict[str, Column], keys, combine) -> DataFrame:
    """Per ``(keys, block)``: the combination of every *earlier* block."""
    per_block = df.groupBy(*keys, BLK).agg(*[c.alias(n) for n, c in totals.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = per_block.select(
        *keys, BLK, *[combine(n).over(earlier).alias(f"{n}_carry") for n in totals]
    )
    return out.filter(F.col(BLK) > 0)


def running_max(df: DataFrame, value: Column, out: str, keys=K, block: int | None = AUTO,
                inclusive: bool = False) -> DataFrame:
    """Greatest ``value`` among earlier steps of the same key (nulls ignored)."""
    block = resolve(df, block)
    work = with_block(df, block).withColumn("_v", value)
    inside = (
        Window.partitionBy(*block_keys(block, keys)).orderBy("step_idx")
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    if not block:
        return work.withColumn(out, F.max("_v").over(inside)).drop("_v")
    carry = block_carry(work, {"_m": F.max("_v")}, keys, F.max)
    return (
        work.withColumn("_in", F.max("_v").over(inside))
        .join(carry, [*keys, BLK], "left")
        .withColumn(out, F.greatest("_in", "_m_carry"))
        .drop("_in", "_m_carry", "_v", BLK)
    )


def running_sums(df: DataFrame, values: dict[str, Column], keys=K, block: int | None = AUTO,
                 idx: str = "step_idx") -> DataFrame:
    """Inclusive running sums over steps of the same key, several at once."""
    block = resolve(df, block, idx)
    work = with_block(df, block, idx)
    for out, value in values.items():
        work = work.withColumn(f"_v_{out}", value)
    inside = (
        Window.partitionBy(*block_keys(block, keys)).orderBy(idx)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    drop = [f"_v_{out}" for out in values]
    got = work.select("*", *[F.sum(f"_v_{out}").over(inside).alias(out) for out in values])
    got = got.drop(*drop)
    if not block:
        return got
    carry = block_carry(work, {c: F.sum(c) for c in drop}, keys, F.sum)
    got = got.join(carry, [*keys, BLK], "left")
    for out in values:
        got = got.withColumn(out, F.col(out) + F.coalesce(F.col(f"_v_{out}_carry"), F.lit(0)))
    return got.drop(BLK, *[f"{c}_carry" for c in drop])


def file_frame(scores: DataFrame, value: str = "p", keys=K, block: int | None = None) -> DataFrame:
    """Steps with trajectory-level ``n, mean, sd, m2`` and the carries needed for
    prefix sums of the centred value.

    With blocks: one shuffle of the steps and one of their map-side reduced block
    totals. Without: windows over a single shuffle on the trajectory.
    """
    whole = Window.partitionBy(*keys)
    if not block:
        # ordered like the prefix windows that follow, so that one sort serves all
        full = whole.orderBy("step_idx").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        n, mean, sd = F.count(value).over(full), F.avg(value).over(full), F.stddev_pop(value).over(full)
        return scores.select(
            "*", n.alias("n"), mean.alias("mean"), sd.alias("sd"), (sd * sd * n).alias("m2"),
            F.lit(0).cast("long").alias("n_carry"), F.lit(0.0).alias("c_carry"),
            F.lit(0.0).alias("q_carry"))
    s = with_block(scores, block)
    per_block = s.groupBy(*keys, BLK).agg(
        F.count(value).alias("_n"), F.sum(value).alias("_s"),
        (F.var_pop(value) * F.count(value)).alias("_q"),
    )
    earlier = whole.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    centred = F.col("_q") + F.col("_n") * F.pow(F.col("_s") / F.col("_n") - F.col("mean"), 2)
    totals = (
        per_block
        .withColumn("n", F.sum("_n").over(whole))
        .withColumn("mean", F.sum("_s").over(whole) / F.col("n"))
        .withColumn("_q", centred)
        .select(
            *keys, BLK, "n", "mean",
            F.sum("_q").over(whole).alias("m2"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("n_carry"),
            F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s_carry"),
            F.coalesce(F.sum("_q").over(earlier), F.lit(0.0)).alias("q_carry"),
        )
        .withColumn("sd", F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n")))
        .withColumn("c_carry", F.col("_s_carry") - F.col("n_carry") * F.col("mean"))
        .drop("_s_carry")
    )
    return s.join(totals, [*keys, BLK])


def running_total(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str],
                  parts: int | None = None) -> DataFrame:
    """Inclusive running sums of columns over ``order`` within ``keys``: a prefix scan over
    range partitions, the same plan for keys of any size.

    Rows are range-partitioned and sorted by (keys, order) and written with their place.
    Inside a partition a key's rows are summed in that order; one total per partition and
    key is scanned over the partitions, and what came before is added. A key of any size is
    thus spread over as many partitions as its rows need (``parts`` of them in all, else as
    many as the session plans). Rows that agree in all of keys and order stay together, so
    callers count equal values first. Null keys are a key.
    """
    place = cut_lineage(
        (df.repartitionByRange(parts, *keys, *order) if parts else df.repartitionByRange(*keys, *order))
        .sortWithinPartitions(*keys, *order).withColumn("_scan_pos", F.monotonically_increasing_id())
    ).withColumn("_scan_part", F.shiftright("_scan_pos", 33))
    inside = (
        Window.partitionBy("_scan_part", *keys).orderBy("_scan_pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    names = [f"_scan_k{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, names)]
    earlier = Window.partitionBy(*names).orderBy("_scan_from").rowsBetween(Window.unboundedPreceding, -1)
    # only the first key of a partition goes on from one before it: one row per partition
    first = place.groupBy("_scan_part").agg(F.min_by(F.struct(*own), "_scan_pos").alias("_k")).select("_k.*").distinct()
    held = place.withColumnsRenamed({"_scan_part": "_scan_from"}).select("_scan_from", *own, *[F.col(c).alias(f"_scan_t_{o}") for o, c in sums.items()])
    again = first.select(*[F.col(n).alias(f"{n}_") for n in names])
    held = held.join(F.broadcast(again), reduce(and_, [held[n].eqNullSafe(again[f"{n}_"]) for n in names]), "left_semi")
    carry = (
        held.groupBy("_scan_from", *names).agg(*[F.sum(f"_scan_t_{o}").alias(f"_scan_t_{o}") for o in sums], F.count(F.lit(1)).alias("_scan_n"))
        .select("*", F.sum("_scan_n").over(earlier).alias("_scan_before"), *[F.sum(f"_scan_t_{o}").over(earlier).alias(f"_scan_c_{o}") for o in sums])
        .where("_scan_before IS NOT NULL").select("_scan_from", *names, *[f"_scan_c_{o}" for o in sums])
    )
    same = F.col("_scan_part") == F.col("_scan_from")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
    out = place.select("*", *[F.sum(c).over(inside).alias(o) for o, c in sums.items()]).join(F.broadcast(carry), same, "left")
    for o in sums:
        out = out.withColumn(o, F.when(F.col(f"_scan_c_{o}").isNull(), F.col(o)).otherwise(
            F.coalesce(F.col(o), F.lit(0)) + F.col(f"_scan_c_{o}")))
    return out.select(*df.columns, *sums)


def dense_position(df: DataFrame, keys: list[str], order: list[str], out: str = "step_idx",
                   parts: int | None = None, size: str | None = None) -> DataFrame:
    """0-based rank of each row in ``order`` within ``keys`` (order must be total). Where no key
    fills a block (checked), one shuffle on the keys; else a prefix scan (``parts``: always).
    The one shuffle also counts the rows of the key (column ``size``); the scan does not."""
    if parts is None and df.groupBy(*keys).count().filter(F.col("count") > BLOCK_STEPS).isEmpty():
        each = Window.partitionBy(*keys).orderBy(*order)
        whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        got = df.withColumn(out, (F.row_number().over(each) - 1).cast("bigint"))
        return got.withColumn(size, F.count(F.lit(1)).over(whole)) if size else got
    one = df.withColumn("_one", F.lit(1))
    got = running_total(one, keys, order, {out: "_one"}, parts)
    return got.withColumn(out, (F.col(out) - 1).cast("bigint")).drop("_one")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float],
                    parts: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key, exact for groups of any size.

    Meant for report cells (a handful of keys with very many rows each): equal
    values are counted before anything is ordered, and only the two order
    statistics around each fraction are kept.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_w")
    )
    run = running_total(counted, keys, [value], {"_upto": "_w"}, parts)
    sizes = counted.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    asked = sizes.select(*keys, F.array(*[
        F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(q)).alias("at"))
        for name, q in fractions.items()]).alias("_asked"))

    def covers(pos):
        return (F.col("_upto") - F.col("_w") <= pos) & (pos < F.col("_upto"))

    hit = F.explode(F.filter("_asked", lambda a: covers(F.floor(a["at"])) | covers(F.ceil(a["at"]))))
    at = F.col("_hit.at")
    # `asked` has one row per cell
    near = (
        run.join(asked, keys).withColumn("_hit", hit)
        .groupBy(*keys, F.col("_hit.name").alias("_name"), at.alias("_at")).agg(
            F.max(F.when(covers(F.floor(at)), F.col(value))).alias("_a"),
            F.max(F.when(covers(F.ceil(at)), F.col(value))).alias("_b"))
        .withColumn("_v", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at")))
    )
    return near.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in fractions]
    )
