"""Evidence assembly: what a step is judged on.

Window-shaped evidence (turn blocks, look-ahead, last-n context) is computed on
``(trajectory, block)`` with halo rows, so no trajectory is gathered. Whole
prefix texts are one string per step by definition and are built only on
request; their budget decisions run on lengths, not on text.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import fixed_values as V
from ..functions.text import _col, strip
from ..functions.typing import is_coordination, is_near_empty
from ..schema import K
from ..session import cut_lineage
from .prefix import FIXED, BlankedPrefix, CostTree, SlidingPrefix
from .sequence import (
    AUTO, BLK, BLOCK_STEPS, block_keys, block_window, join_files, resolve, running_max, running_sums,
    running_total, spread, with_block, with_halo,
)


# --- rendering (column expressions) -----------------------------------------

def _text(content) -> Column:
    return F.coalesce(_col(content), F.lit(""))


def render_preamble(query, ground_truth, with_gt: bool = False) -> Column:
    """Task header, with the reference answer in the answer-shown setting."""
    def recorded(c):
        return F.when(_text(c) == "", F.lit(V.NOT_RECORDED)).otherwise(_text(c))

    parts = [F.lit("[task]"), recorded(query)]
    if with_gt:
        parts += [F.lit(""), F.lit("[reference answer]"), recorded(ground_truth)]
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def _elide(content: Column, cap: int | None) -> Column:
    """The middle goes where a text passes ``cap`` characters (None: whole)."""
    if cap is None:
        return content
    half = cap // 2
    n = F.length(content)
    return F.when(n > cap, F.concat(
        F.substring(content, 1, half), F.lit("\n…["), (n - cap).cast("string"),
        F.lit(" chars elided]…\n"), F.right(content, F.lit(half)))).otherwise(content)


def step_header(idx="step_idx", agent="agent", kind="type_norm") -> Column:
    return F.concat(F.lit("[step "), _col(idx).cast("string"), F.lit(" | agent="), _col(agent),
                    F.lit(" | type="), _col(kind), F.lit("]\n"))


def render_step(idx="step_idx", agent="agent", kind="type_norm", content="content",
                max_chars: int | None = None) -> Column:
    return F.concat(step_header(idx, agent, kind), _elide(_text(content), max_chars), F.lit("\n"))


def render_demoted(idx="step_idx", agent="agent", kind="type_norm", content="content") -> Column:
    """A demoted step: its row survives, its detail does not."""
    body = F.substring(F.replace(strip(_text(content)), F.lit("\n"), F.lit(" ")), 1, V.HEADER_CHARS)
    held = F.greatest(F.length(_text(content)) - V.HEADER_CHARS, F.lit(0)).cast("string")
    return F.concat(step_header(idx, agent, kind), body, F.lit("… ["), held,
                    F.lit(" chars withheld — old execution detail]\n"))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def render_question(idx="step_idx", agent="agent", kind="type_norm", readout: str = "ptrue") -> Column:
    """Rubric by step type, the question, and the readout's instruction."""
    if readout not in V.INSTRUCTION:
        raise ValueError(f"unknown readout {readout!r}")
    rubric = F.coalesce(F.try_element_at(_literal_map(V.RUBRIC), _col(kind)),
                        F.lit(V.RUBRIC["unknown"]))
    return F.concat(
        F.lit("\n"), rubric, F.lit("\nQuestion: Is step "), _col(idx).cast("string"),
        F.lit(" by '"), _col(agent),
        F.lit("' correct and appropriate given the context above? "),
        F.lit(V.INSTRUCTION[readout]))


# --- structure --------------------------------------------------------------

def turn_blocks(steps: DataFrame, block: int | None = AUTO) -> DataFrame:
    """``turn``: rises at a coordination step that follows a non-coordination one."""
    block = resolve(steps, block)
    coord = is_coordination("type_norm")
    opens = coord & ~F.coalesce(F.lag(coord, 1).over(block_window(block)), F.lit(True))
    marked = (
        with_halo(steps, before=1, block=block)
        .withColumn("_opens", opens.cast("int")).filter("_core").drop("_core", BLK)
    )
    return running_sums(marked, {"turn": F.col("_opens")}, block=block).drop("_opens").withColumn(
        "turn", F.col("turn").cast("int"))


def strip_types(steps: DataFrame) -> DataFrame:
    return steps.withColumn("type_norm", F.lit("unknown"))


def _terse_execute() -> Column:
    return (F.col("type_norm") == "execute") & is_near_empty("content")


def clipped(text: Column, n: int | None) -> Column:
    """The first n characters, or the whole text."""
    return text if n is None else F.substring(text, 1, n)


def subtask_pointer(steps: DataFrame, block: int | None = AUTO, max_chars: int | None = None) -> DataFrame:
    """For each terse execute step: the nearest earlier coordination step that
    names its agent, or the delegation right before it.

    The search is per distinct agent, not per pair of steps: a coordination step
    is matched against the agents that have terse steps, then the nearest
    earlier mention is a running maximum.
    """
    block = resolve(steps, block)
    prev = F.lag(F.when(F.col("type_norm") == "delegate", F.col("step_idx"))).over(
        block_window(block))
    s = steps.select(*K, "step_idx", "agent", "role_raw", "content", "type_norm")
    targets = (
        with_halo(s, before=1, block=block).withColumn("_direct", prev)
        .filter(F.col("_core") & _terse_execute())
        .select(*K, "step_idx", "agent", "_direct")
    )
    wanted = targets.groupBy(*K, "agent").agg(F.max("step_idx").alias("n_steps")).filter(
        F.col("n_steps") > 0).withColumnRenamed("agent", "_who")
    coord = with_block(s.filter(is_coordination("type_norm")), block)
    # RLIKE on a quoted name: an agent is matched as a whole word, ignoring case
    word = F.concat(F.lit("(?iU)\\b\\Q"), F.replace("_who", F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                    F.lit("\\E\\b"))
    mentions = (
        coord.join(spread(wanted, block), block_keys(block))
        .filter(F.rlike(_text("content"), word) | F.rlike(_text("role_raw"), word))
        .select(*K, F.col("_who").alias("agent"), "step_idx",
                F.col("step_idx").alias("_mention"), F.lit(False).alias("_asks"),
                F.lit(None).cast("int").alias("_direct"))
    )
    asks = targets.select(*K, "agent", "step_idx", F.lit(None).cast("int").alias("_mention"),
                          F.lit(True).alias("_asks"), "_direct")
    found = running_max(mentions.unionByName(asks), F.col("_mention"), "_near",
                        [*K, "agent"], block).filter("_asks")
    at = found.select(*K, "step_idx", "agent", F.coalesce("_direct", "_near").alias("pointer_idx"))
    source = s.select(*K, F.col("step_idx").alias("pointer_idx"),
                      clipped(strip(_text("content")), max_chars).alias("pointer_text"))
    return at.filter(F.col("pointer_idx").isNotNull()).join(source, [*K, "pointer_idx"])


def peer_pointers(steps: DataFrame, block: int | None = AUTO, max_chars: int | None = None) -> DataFrame:
    """For each terse execute step: the last two earlier non-empty steps of the
    same turn block by other agents (``rank`` 1 is the nearest).

    "Previous step by somebody else" is carried forward from the last change of
    speaker, so no pairs of steps are formed.
    """
    block = resolve(steps, block)
    s = turn_blocks(steps, block)
    spoken = strip(_text("content")) != ""
    s = s.select(*K, "turn", "step_idx", "agent", _terse_execute().alias("_asks"),
                 spoken.alias("_spoken"))
    said = F.col("_spoken")

    def latest(df, value, out, inclusive=False):
        # structs lead with a step index, so the greatest one is the latest one
        got = running_max(df, value, out, [*K, "turn"], block, inclusive)
        return cut_lineage(got) if block else got

    s = latest(s, F.when(said, F.struct("step_idx", "agent")), "_p")
    change = said & (F.col("_p.agent") != F.col("agent"))
    s = latest(s, F.when(change, F.col("_p")), "_o", True)
    s = latest(s, F.when(said, F.col("_o")), "_po")
    # a full node: itself, the step before it, the last step by someone else
    node = F.struct("step_idx", "agent", F.col("_p").alias("p"), F.col("_po").alias("po"))
    s = latest(s, F.when(said, node), "_pn")
    s = latest(s, F.when(change, F.col("_pn")), "_on", True)
    s = latest(s, F.when(said, F.col("_on")), "_pon")
    mine = F.col("agent")
    first = F.when(F.col("_pn.agent") != mine, F.col("_pn")).otherwise(F.col("_pon"))
    asked = s.withColumn("_first", first).filter(F.col("_asks") & F.col("_first").isNotNull())
    second = F.when(F.col("_first.p.agent") != mine, F.col("_first.p.step_idx")).otherwise(
        F.when(F.col("_first.po.agent") != mine, F.col("_first.po.step_idx")))
    pairs = asked.select(*K, "step_idx", F.explode(F.array_compact(F.array(
        F.struct(F.lit(1).alias("rank"), F.col("_first.step_idx").alias("peer_idx")),
        F.when(second.isNotNull(), F.struct(F.lit(2).alias("rank"), second.alias("peer_idx"))),
    ))).alias("e")).select(*K, "step_idx", "e.*")
    peers = steps.select(
        *K, F.col("step_idx").alias("peer_idx"), F.col("agent").alias("peer_agent"),
        F.col("type_norm").alias("peer_type"),
        clipped(strip(_text("content")), max_chars).alias("peer_text"))
    return pairs.join(peers, [*K, "peer_idx"])


def augmentation(steps: DataFrame, subtask: bool = True, peers: bool = True,
                 block: int | None = AUTO, max_chars: int | None = None) -> DataFrame:
    """Context text for terse execute steps: assigned subtask, then peers, each whole or
    its first ``max_chars`` characters (the published runs use MAX_POINTER_CHARS)."""
    parts = []
    if subtask:
        parts.append(subtask_pointer(steps, block, max_chars).select(
            *K, "step_idx", F.lit(-1).alias("ord"),
            F.concat(F.lit("assigned subtask for "), "agent", F.lit(":\n"), "pointer_text")
            .alias("text")))
    if peers:
        parts.append(peer_pointers(steps, block, max_chars).select(
            *K, "step_idx", F.col("peer_idx").alias("ord"),
            F.concat(F.lit("peer step "), F.col("peer_idx").cast("string"), F.lit(" ("),
                     "peer_agent", F.lit(", "), "peer_type", F.lit("):\n"), "peer_text")
            .alias("text")))
    if not parts:
        raise ValueError("switch on at least one of subtask and peers")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # at most three rows per step
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))),
                                    lambda x: x["text"]), "\n\n")
    return rows.groupBy(*K, "step_idx").agg(F.concat(
        F.lit("\n[context for a terse step — within-trajectory only]\n"), text, F.lit("\n"))
        .alias("augment"))


def lookahead_window(steps: DataFrame, mode: str = "resp", block: int | None = AUTO) -> DataFrame:
    """``window``: the steps shown after each step.

    ``resp``: the run of following steps by others, at most two. ``own``: that
    plus the actor's next appearance. ``deleg``: up to five after a delegation.
    """
    if mode not in ("none", "resp", "own", "deleg"):
        raise ValueError(f"unknown lookahead {mode!r}")
    fields = ["step_idx", "agent", "type_norm", "content"]
    item = F.struct(*fields)
    if mode == "none":
        return steps.withColumn("window", F.array().cast(
            "array<struct<step_idx:int,agent:string,type_norm:string,content:string>>"))
    cap = V.DELEG_CAP if mode == "deleg" else V.RESP_CAP
    block = resolve(steps, block)
    frame = block_window(block).rowsBetween(1, cap)
    s = (
        with_halo(steps, after=cap, block=block)
        .withColumn("_next", F.collect_list(item).over(frame)).filter("_core").drop("_core", BLK)
    )
    limit = F.when(F.col("type_norm") == "delegate", F.lit(V.DELEG_CAP)).otherwise(
        F.lit(V.RESP_CAP)) if mode == "deleg" else F.lit(V.RESP_CAP)
    agent = F.col("agent")
    # the run ends at the actor's own return
    own_at = F.array_position(F.transform("_next", lambda x: x["agent"] == agent), F.lit(True))
    run = F.when(own_at == 0, F.size("_next")).otherwise(own_at - 1)
    s = s.withColumn("window", F.slice("_next", F.lit(1), F.least(run, limit).cast("int"))).drop("_next")
    if mode != "own":
        return s
    nxt = next_own_step(steps, block)
    follow = steps.select(*K, F.col("step_idx").alias("next_own_idx"), item.alias("_own"))
    nxt = nxt.filter(F.col("next_own_idx").isNotNull()).join(follow, [*K, "next_own_idx"])
    s = s.join(nxt.select(*K, "step_idx", "_own"), [*K, "step_idx"], "left")
    return s.withColumn("window", F.when(F.col("_own").isNull(), F.col("window")).otherwise(
        F.concat("window", F.array("_own")))).drop("_own")


def next_own_step(steps: DataFrame, block: int | None = AUTO) -> DataFrame:
    """Next step index of the same agent, looked up inside the block first and in
    the table of block firsts beyond it."""
    block = resolve(steps, block)
    s = with_block(steps.select(*K, "step_idx", "agent"), block)
    inside = F.lead("step_idx").over(block_window(block, "agent"))
    if not block:
        return s.select(*K, "step_idx", inside.alias("next_own_idx"))
    firsts = s.groupBy(*K, "agent", BLK).agg(F.min("step_idx").alias("_first"))
    later = firsts.select(*K, "agent", BLK, F.lead("_first").over(
        Window.partitionBy(*K, "agent").orderBy(BLK)).alias("_later"))
    return (
        s.withColumn("_in", inside)
        .join(later.filter(F.col("_later").isNotNull()), [*K, "agent", BLK], "left")
        .select(*K, "step_idx", F.coalesce("_in", "_later").alias("next_own_idx"))
    )


def render_lookahead(window="window", max_chars: int | None = None) -> Column:
    """Heading and the fully rendered window; empty for an empty window."""
    body = F.array_join(F.transform(_col(window), lambda x: render_step(
        x["step_idx"], x["agent"], x["type_norm"], x["content"], max_chars)), "")
    return F.when(F.size(_col(window)) > 0, F.concat(
        F.lit("\n[what happened next — realized response]\n"), body)).otherwise(F.lit(""))


# --- context text -----------------------------------------------------------

def prefix_window(steps: DataFrame, n: int, block: int | None = AUTO,
                  max_chars: int | None = None) -> DataFrame:
    """``context``: the last n rendered steps up to and including this one."""
    block = resolve(steps, block)
    frame = block_window(block).rowsBetween(-(n - 1), 0)
    return (
        with_halo(steps, before=n - 1, block=block)
        .withColumn("context", F.array_join(F.collect_list(render_step(max_chars=max_chars)).over(frame), ""))
        .filter("_core").drop("_core", BLK)
    )


def contradiction_pairs(steps: DataFrame, premise_steps: int = V.PREMISE_STEPS,
                        tail_chars: int | None = None, block: int | None = AUTO,
                        content_chars: int | None = None) -> DataFrame:
    """(premise, hypothesis) per step after the first. The premise is the last few
    steps before it and, when cut, keeps its tail. Steps count whole unless
    ``content_chars`` is given (the published runs use COHERENCE_CHARS)."""
    clip = clipped(_text("content"), content_chars)
    block = resolve(steps, block)
    frame = block_window(block).rowsBetween(-premise_steps, -1)
    premise = F.array_join(F.col("_before"), "\n")
    if tail_chars is not None:
        premise = F.right(premise, F.lit(tail_chars))
    return (
        with_halo(steps, before=premise_steps, block=block)
        .withColumn("_before", F.collect_list(clip).over(frame))
        .filter(F.col("_core") & (F.col("step_idx") > 0))
        .select(*K, "step_idx", "agent", premise.alias("premise"), clip.alias("hypothesis"))
    )


#: characters of context held for one output batch
CONTEXT_BATCH_CHARS = 1 << 23


def bounded(pdf: pd.DataFrame, results: Iterator[tuple[int, str, int]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of ``pdf`` with (row, context, n_demoted), in batches of bounded text."""
    at, contexts, demoted, held = [], [], [], 0

    def out() -> pd.DataFrame:
        return pdf.iloc[at].assign(context=contexts, n_demoted=np.int32(demoted))[names]

    for i, context, n in results:
        at.append(i)
        contexts.append(context)
        demoted.append(n)
        held += len(context)
        if held >= CONTEXT_BATCH_CHARS:
            yield out()
            at, contexts, demoted, held = [], [], [], 0
    if at:
        yield out()


def with_context(schema: T.StructType, *gone: str) -> T.StructType:
    kept = [f for f in schema.fields if f.name not in gone]
    return T.StructType([*kept, T.StructField("context", T.StringType()), T.StructField("n_demoted", T.IntegerType())])


def windowed_contexts(rows: DataFrame, n: int, budget: int, block: int | None = AUTO) -> DataFrame:
    """``context`` and ``n_demoted`` of rows that carry ``head``, ``_full``, ``_short`` and
    ``_coord``, which go: the last n steps under the retention policy. Blocks are walked
    in parallel, each with the n - 1 steps before it; n steps of text are held."""
    block = resolve(rows, block)
    by = block_keys(block)
    work = with_halo(rows, before=n - 1, block=block)
    schema = with_context(rows.schema, "head", "_full", "_short", "_coord")
    names, keys = schema.fieldNames(), by

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def results(pdf: pd.DataFrame) -> Iterator[tuple[int, str, int]]:
            nonlocal key, state
            cols = [pdf[c] for c in ("head", "_full", "_short", "_coord", "_core")]
            for i, (own, (head, full, short, coord, core)) in enumerate(zip(zip(*[pdf[k] for k in keys]), zip(*cols))):
                if own != key:
                    key, state = own, SlidingPrefix(n, budget, head)
                if core:
                    yield i, *state.add(full, short, bool(coord))
                else:
                    state.enter(full, short, bool(coord))

        for pdf in batches:
            yield from bounded(pdf, results(pdf), names)

    return work.repartition(*by).sortWithinPartitions(*by, "step_idx").mapInPandas(walk, schema)


def joined_pieces(steps: DataFrame, spec: DataFrame, piece: Column, by: list[str], block: int | None) -> DataFrame:
    """``by``, ``text``: the pieces of each spec row's steps below its ``upto``, in order.
    ``piece`` may use columns of both. A trajectory's steps meet a spec row block by block,
    so that no task takes a whole trajectory."""
    wide = block or BLOCK_STEPS
    parts = spec.where(F.col("upto") > 0).withColumn(
        BLK, F.explode(F.sequence(F.lit(0), F.floor((F.col("upto") - 1) / F.lit(wide)).cast("int"))))
    met = with_block(steps, wide).join(parts, [*K, BLK]).where(F.col("step_idx") < F.col("upto"))

    def glued(order: str, text: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), "")

    return (met.groupBy(*by, BLK).agg(glued("step_idx", piece).alias("_part"))
            .groupBy(*by).agg(glued(BLK, F.col("_part")).alias("text")))


def retained_steps(steps: DataFrame, heads: DataFrame, budget: int | None = None) -> DataFrame:
    """(K, step_idx, full, short, coord, verbatim): which steps of a whole trajectory stay
    verbatim under a budget (None: all).

    Coordination is verbatim; the rest are upgraded newest first, skipping any that does
    not fit (so a running sum would be wrong). What one step hands to the next is the room
    that is left: lengths stream through a task, newest first, and a batch is decided by a
    search for the next cost that fits.
    """
    sized = steps.select(*K, "step_idx", F.length(render_step()).cast("long").alias("full"),
                         F.length(render_demoted()).cast("long").alias("short"), is_coordination("type_norm").alias("coord"))
    if budget is None:
        return sized.withColumn("verbatim", F.lit(True))
    least = sized.groupBy(*K).agg((F.max("step_idx") + 1).alias("n_steps"),
                                  F.sum(F.when(F.col("coord"), F.col("full")).otherwise(F.col("short"))).alias("_least"))
    room = least.join(heads.select(*K, F.length("head").alias("_head")), K).select(
        *K, "n_steps", (F.lit(budget) - F.col("_least") - F.col("_head")).alias("_room"))
    rows = join_files(sized, room).drop("n_steps")
    schema = T.StructType([*sized.schema.fields, T.StructField("verbatim", T.BooleanType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left = None, 0
        for pdf in batches:
            keys = list(zip(pdf["subset"], pdf["file_id"]))
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            coord = pdf["coord"].to_numpy(bool)
            cost, keep = np.where(coord, FIXED, (pdf["full"] - pdf["short"]).to_numpy(np.int64)), coord.copy()
            for a, b in zip(edges, [*edges[1:], len(keys)]):
                if keys[a] != key:
                    key, left = keys[a], int(pdf["_room"].iat[a])
                taken, left = CostTree.of(cost[a:b][::-1]).upgrade(left)
                keep[b - 1 - np.array(taken, int)] = True
            yield pdf.drop(columns="_room").assign(verbatim=keep)

    return rows.repartition(*K).sortWithinPartitions(*K, F.desc("step_idx")).mapInPandas(walk, schema)


def retained_context(steps: DataFrame, heads: DataFrame, budget: int | None = None,
                     with_text: bool = False, block: int | None = AUTO) -> DataFrame:
    """Whole trajectory under the retention policy (the hindsight evidence): n_steps, used,
    n_kept (upgraded ones), n_demoted and, if asked for, the text, one string a trajectory."""
    plan = retained_steps(steps, heads, budget)
    plan = cut_lineage(plan) if with_text else plan
    used = F.sum(F.when(F.col("verbatim"), F.col("full")).otherwise(F.col("short")))
    out = plan.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n_steps"), used.alias("_body"), F.count_if(F.col("verbatim") & ~F.col("coord")).alias("n_kept"),
        F.count_if(~F.col("verbatim")).alias("n_demoted")).join(heads.select(*K, "head"), K)
    out = out.withColumn("used", F.col("_body") + F.length("head")).drop("_body")
    if not with_text:
        return out.drop("head")
    pieces = steps.join(plan.select(*K, "step_idx", "verbatim"), [*K, "step_idx"]).select(
        *K, "step_idx", F.when(F.col("verbatim"), render_step()).otherwise(render_demoted()).alias("_piece"))
    text = joined_pieces(pieces, out.select(*K, F.col("n_steps").alias("upto")), F.col("_piece"), K, resolve(steps, block))
    return out.join(text, K).withColumn("text", F.concat("head", "text")).drop("head")


def hindsight(steps: DataFrame, heads: DataFrame, budget: int | None = None, block: int | None = AUTO) -> DataFrame:
    """Every step beside the one whole-trajectory evidence text of its file. The text is
    sent once to each block of the trajectory and handed to the steps as they stream by."""
    block = resolve(steps, block)
    by = block_keys(block)
    text = retained_context(steps, heads, budget, True, block).select(*K, "n_steps", "n_demoted", F.col("text").alias("_text"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in steps.schema if f.name not in (*K, "step_idx")]
    first = spread(text, block).select(*by, F.lit(-1).alias("step_idx"), *blank, "n_steps", "_text", F.col("n_demoted").cast("int").alias("_gone"))
    rows = with_block(steps, block).select(
        *by, "step_idx", *[f.name for f in steps.schema if f.name not in (*K, "step_idx")], F.lit(None).cast("long").alias("n_steps"),
        F.lit(None).cast("string").alias("_text"), F.lit(None).cast("int").alias("_gone"))
    schema = with_context(T.StructType([*steps.schema.fields, T.StructField("n_steps", T.LongType())]))
    names = schema.fieldNames()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, gone, n = "", 0, 0
        for pdf in batches:
            def results():
                nonlocal text, gone, n
                for i, (at, own, m, k) in enumerate(zip(pdf["step_idx"], pdf["_text"], pdf["_gone"], pdf["n_steps"])):
                    if at < 0:
                        text, gone, n = own, int(m), int(k)
                    else:
                        counts.append(n)
                        yield i, text, gone

            counts: list[int] = []
            done = 0
            for out in bounded(pdf, results(), [c for c in names if c != "n_steps"]):
                out["n_steps"] = np.int64(counts[done:done + len(out)])
                done += len(out)
                yield out[names]

    return rows.unionByName(first).repartition(*by).sortWithinPartitions(*by, "step_idx").mapInPandas(walk, schema)


def oldest_first_text(steps: DataFrame, cap: int | None = None, step_chars: int | None = None,
                      block: int | None = AUTO, heads: DataFrame | None = None) -> DataFrame:
    """(K, step_idx, context, n_blanked): each step's own prefix with its oldest steps blanked,
    after ``head`` if given.

    The blank mark only moves on, so a block is walked alone from the mark at its start:
    it gets the text before the mark as one piece and the open steps after it, at most
    what ``cap`` leaves unblanked. A step costs its new text and what it prints.
    """
    block = resolve(steps, block)
    by = block_keys(block)
    marks = cut_lineage(oldest_first_blanking(steps, cap, step_chars, block).select(*K, "step_idx", "n_blanked"))
    rows = (steps.select(*K, "step_idx", render_clean_step(step_chars=step_chars).alias("_full"), render_blanked_step().alias("_blank"))
            .join(marks, [*K, "step_idx"]))
    core = with_block(rows, block).select(*by, "step_idx", "_full", "_blank", "n_blanked", F.lit(True).alias("_core"))
    at_start = F.col("step_idx") % F.lit(block or BLOCK_STEPS) == 0 if block else F.col("step_idx") == 0
    starts = with_block(marks.where(at_start), block).select(*by, F.col("step_idx").alias("_from"), F.col("n_blanked").alias("upto"))
    work = core
    if block:
        halo = (starts.withColumnRenamed(BLK, "_to").where("_from > 0")
                .withColumn(BLK, F.explode(F.sequence(F.floor(F.col("upto") / block).cast("int"), F.col("_to") - 1))))
        work = core.unionByName(
            with_block(rows, block).join(halo, [*K, BLK]).where((F.col("step_idx") >= F.col("upto")) & (F.col("step_idx") < F.col("_from")))
            .select(*K, F.col("_to").alias(BLK), "step_idx", "_full", "_blank", "n_blanked", F.lit(False).alias("_core")))
    opened = starts.join(joined_pieces(rows.select(*K, "step_idx", "_blank"), starts.withColumnRenamed(BLK, "_own") if block else starts,
                                       F.col("_blank"), [*K, "_own"] if block else K, block).withColumnsRenamed({"_own": BLK}), by, "left")
    if heads is not None:
        opened = opened.join(heads.select(*K, "head"), K, "left").withColumn("text", F.concat("head", F.coalesce("text", F.lit(""))))
    first = opened.select(*by, F.lit(-1).alias("step_idx"), F.coalesce("text", F.lit("")).alias("_full"), F.lit("").alias("_blank"),
                          F.col("upto").cast("int").alias("n_blanked"), F.lit(False).alias("_core"))
    schema = "subset string, file_id string, step_idx int, n_blanked int, context string"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            def results():
                nonlocal state
                for i, (at, full, blank, n, core) in enumerate(zip(*[pdf[c] for c in ("step_idx", "_full", "_blank", "n_blanked", "_core")])):
                    if at < 0:
                        state = BlankedPrefix(full, int(n))
                    else:
                        state.push(full, blank)
                        if core:
                            yield i, state.move(int(n)), 0

            yield from bounded(pdf, results(), ["subset", "file_id", "step_idx", "n_blanked", "context"])

    return work.unionByName(first).repartition(*by).sortWithinPartitions(*by, "step_idx").mapInPandas(walk, schema)


def oldest_first_blanking(steps: DataFrame, cap: int | None = None, step_chars: int | None = None,
                          block: int | None = AUTO) -> DataFrame:
    """How many of the oldest steps are blanked in each step's own prefix (no ``cap``: none;
    the published runs use PTRUE_PREFIX_CHARS and PTRUE_STEP_CHARS).

    The prefix of step t is blanked from the oldest on until it fits, never the
    judged step. With F = running full length and S = running saving, the count
    is the number of steps whose saving so far is still short of F(t) - cap: a
    merge of two increasing sequences, done by a running count, not per pair.
    """
    full = F.length(render_clean_step(step_chars=step_chars)).cast("long")
    saving = full - F.length(render_blanked_step()).cast("long")
    block = resolve(steps, block)
    s = steps.select(*K, "step_idx", full.alias("_full"), saving.alias("_save"))
    if cap is None:
        return running_sums(s, {"total": F.col("_full")}, block=block).select(*K, "step_idx", "total", F.lit(0).alias("n_blanked"))
    s = running_sums(s, {"total": F.col("_full"), "_saved": F.col("_save")}, block=block)
    # savings may be negative for a short step, so the target is the first prefix
    # of savings that reaches the excess: a running maximum makes them monotone
    s = running_max(s, F.col("_saved"), "_peak", block=block, inclusive=True)
    # four narrow branches read this; cutting here keeps the text read to one pass
    over = cut_lineage(s.select(*K, "step_idx", "total", "_peak",
                                (F.col("total") - cap).alias("_excess")))
    marks = over.select(*K, F.col("_peak").alias("_at"), F.lit(1).alias("_mark"),
                        F.lit(None).cast("int").alias("step_idx"), F.lit(None).cast("long").alias("total"))
    asks = over.filter(F.col("_excess") > 0).select(
        *K, F.col("_excess").alias("_at"), F.lit(0).alias("_mark"), "step_idx", "total")
    # a mark strictly below the excess leaves the prefix too long; equal is enough
    merged = running_total(marks.unionByName(asks), K, ["_at", "_mark"], {"_below": "_mark"})
    blanked = merged.filter(F.col("step_idx").isNotNull()).select(
        *K, "step_idx", F.least(F.col("_below") + 1, F.col("step_idx")).cast("int").alias("n_blanked"))
    return over.select(*K, "step_idx", "total").join(blanked, [*K, "step_idx"], "left").withColumn(
        "n_blanked", F.coalesce("n_blanked", F.lit(0)))


def render_clean_step(idx="step_idx", agent="agent", content="content",
                      step_chars: int | None = None) -> Column:
    return F.concat(F.lit("[step "), _col(idx).cast("string"), F.lit(" | agent="), _col(agent),
                    F.lit("]\n"), _elide(_text(content), step_chars), F.lit("\n"))


def render_blanked_step(idx="step_idx", agent="agent") -> Column:
    return F.concat(F.lit("[step "), _col(idx).cast("string"), F.lit(" | agent="), _col(agent),
                    F.lit("]\n" + V.OMITTED + "\n"))
