"""Splitting a long trajectory or a hot key must not change any answer."""

import hashlib
import random
import time

import numpy as np
import pytest
from steps import SCHEMA, as_set
from pyspark.sql import Window, functions as F

from faultline.operators import baselines as B, evidence as E, metrics as M, rules as R, scoring as S
from faultline.operators import normalize as N, sequence as Q, typing as TY
from faultline.operators.prefix import FIXED, CostTree
from faultline.schema import K

def asked(s):
    return s.select(*K).distinct().withColumn("query", F.lit("q")).withColumn("ground_truth", F.lit("g"))


def shown(s, block, **options):
    return S.build_prompts(s, asked(s), policy=options.pop("policy", "plain"), block=block, **options).select(
        *K, "step_idx", "context", "n_demoted")


STEPWISE = {
    "growing_text": lambda s, lab, b: shown(s, b),
    "growing_text_under_budget": lambda s, lab, b: shown(s, b, budget=400),
    "window_under_budget": lambda s, lab, b: shown(s, b, prefix_steps=6, budget=300),
    "hindsight_text": lambda s, lab, b: shown(s, b, policy="hindsight", budget=500),
    "oldest_first_text": lambda s, lab, b: E.oldest_first_text(s, 300, 60, b),
    "oldest_first_whole": lambda s, lab, b: E.oldest_first_text(s, None, None, b),
    "attribute": lambda s, lab, b: R.attribute(s, block=b).select(*K, "method", "pred_step", "pred_agent", "reason"),
    "two_stage": lambda s, lab, b: R.two_stage(s, block=b),
    "majority_agent": lambda s, lab, b: B.majority_agent(s, block=b),
    "random_expectation": lambda s, lab, b: B.uniform_random_expectation(s, lab, block=b),
    "turn_blocks": lambda s, lab, b: E.turn_blocks(s, b).select(*K, "step_idx", "turn"),
    "subtask_pointer": lambda s, lab, b: E.subtask_pointer(s, b).select(*K, "step_idx", "pointer_idx"),
    "peer_pointers": lambda s, lab, b: E.peer_pointers(s, b).select(*K, "step_idx", "rank", "peer_idx"),
    "lookahead_resp": lambda s, lab, b: E.lookahead_window(s, "resp", b).select(
        *K, "step_idx", F.transform("window", lambda x: x["step_idx"]).alias("w")),
    "lookahead_own": lambda s, lab, b: E.lookahead_window(s, "own", b).select(
        *K, "step_idx", F.transform("window", lambda x: x["step_idx"]).alias("w")),
    "lookahead_deleg": lambda s, lab, b: E.lookahead_window(s, "deleg", b).select(
        *K, "step_idx", F.transform("window", lambda x: x["step_idx"]).alias("w")),
    "next_own": lambda s, lab, b: E.next_own_step(s, b),
    "prefix_window": lambda s, lab, b: E.prefix_window(s, 7, b).select(*K, "step_idx", "context"),
    "contradiction_pairs": lambda s, lab, b: E.contradiction_pairs(s, block=b),
    "oldest_first": lambda s, lab, b: E.oldest_first_blanking(s, 300, block=b).select(*K, "step_idx", "n_blanked"),
    "splitter_prompts": lambda s, lab, b: TY.splitter_prompts(s, block=b).select(*K, "step_idx", "prompt"),
    "rule_verdicts": lambda s, lab, b: TY.rule_verdicts(s, b).select(*K, "step_idx", "rule"),
    "step_labels": lambda s, lab, b: N.step_labels(s, lab, block=b).select(*K, "step_idx", "correct"),
    "per_file_auroc": lambda s, lab, b: M.per_file_auroc(s, lab, True, b),
    "recall": lambda s, lab, b: M.recall_at_k(s, lab, block=b),
}


@pytest.mark.parametrize("name", sorted(STEPWISE))
def test_blocks_do_not_change_results(steps, labels, name):
    op = STEPWISE[name]
    whole = as_set(op(steps, labels, None))
    assert whole
    assert as_set(op(steps, labels, 4)) == whole


def test_embed_divergence_in_blocks(spark):
    rng = random.Random(1)
    rows = [("alg", f"f{f}", i, [rng.gauss(0, 1) for _ in range(5)]) for f in range(3) for i in range(11)]
    v = spark.createDataFrame(rows, "subset string, file_id string, step_idx int, vector array<double>")
    whole = as_set(S.embed_divergence(v, block=None), 8)
    assert as_set(S.embed_divergence(v, block=3), 8) == whole
    assert sum(1 for r in whole if r[0] is False) == 3
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # blocks over many batches
    try:
        assert as_set(S.embed_divergence(v, block=None), 8) == whole
        assert as_set(S.embed_divergence(v, block=3), 8) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hot_keys_are_split_exactly(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else [None, f"k{i % 30}"][i % 2], rng.choice([1.0, 2.0, None, rng.random()]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    inside = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = as_set(df.withColumn("pos", F.count(F.lit(1)).over(inside) - 1).withColumn("t", F.sum("v").over(inside)))
    for parts in (None, 1, 7, 40):
        got = Q.running_total(Q.dense_position(df, ["k"], ["v", "id"], "pos", parts), ["k"], ["v", "id"], {"t": "v"}, parts)
        assert as_set(got) == want
    q = {"a": 0.05, "m": 0.5, "z": 0.95}
    want = df.groupBy("k").agg(*[F.percentile("v", f).alias(n) for n, f in q.items()])
    assert as_set(Q.exact_quantiles(df, ["k"], "v", q, parts=9).na.drop(subset=["k"])) == as_set(want.na.drop(subset=["k"]))


def test_one_key_of_equal_values(spark):
    """One key holds all rows, one value most of them."""
    df = spark.range(3000).select(F.lit("k").alias("k"), F.when(F.col("id") < 2500, 0.5).otherwise(F.col("id") / 3000).alias("v"), "id")
    got = Q.dense_position(df, ["k"], ["v", "id"], "pos", parts=16)
    assert [r.pos for r in got.orderBy("v", "id").collect()] == list(range(3000))
    counted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))
    assert Q.running_total(counted, ["k"], ["v"], {"upto": "w"}, 16).agg(F.max("upto"), F.min("upto")).first() == (3000, 2500)


def test_auroc_counts_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0.1, 0.2, 0.3]), rng.random() > 0.6) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r.g: r.auroc for r in M.auroc(df, ["g"], "s", "y").collect()}
    for g in "ab":
        pos = [s for k, s, y in rows if k == g and y]
        neg = [s for k, s, y in rows if k == g and not y]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[g] == pytest.approx(wins / len(pos) / len(neg))


@pytest.mark.parametrize("objective", ["f1", "youden"])
def test_fold_thresholds_match_a_refit(spark, steps, labels, objective):
    lab = N.step_labels(steps, labels)
    stats = N.fit_loo_stats(lab, labels, min_per_type=3)
    rows = [r.asDict() for r in lab.collect()]
    fit = {}
    for r in stats.collect():
        fit.setdefault((r.subset, r.file_id), {})[r.cell] = (r["mean"], max(r.sd, 1e-3))
    want = {}
    for key, cells in fit.items():
        train = [r for r in rows if r["subset"] == key[0] and r["file_id"] != key[1]]
        z = [(r["type_norm"], (r["p_raw"] - cells.get(r["type_norm"], cells[""])[0])
              / cells.get(r["type_norm"], cells[""])[1], r["correct"]) for r in train]
        for cell in cells:
            part = [(x, y) for t, x, y in z if cell in ("", t)]
            want[(*key, cell)] = refit(part, objective)
    for blocks, per_task in ((10**6, 512), (7, 2), (2, 1), (1, 3)):  # a block per score, opened blocks
        got = {(r.subset, r.file_id, r.cell): r.threshold
               for r in N.fit_loo_thresholds(lab, stats, objective, blocks=blocks, folds_per_task=per_task).collect()}
        assert got == pytest.approx(want)


def refit(part, objective):
    bad, ok = sum(not y for _, y in part), sum(y for _, y in part)
    if not bad or not ok:
        return 0.0
    best, at = -1.0, 0.0
    for c in sorted({round(x, 3) for x, _ in part}):
        tp = sum(x < c and not y for x, y in part)
        fp = sum(x < c and y for x, y in part)
        v = 2 * tp / (2 * tp + fp + bad - tp) if objective == "f1" else tp / bad - fp / ok
        if v > best:
            best, at = v, c
    return at


def test_rate_interval_brackets_the_rate(spark):
    cells = spark.createDataFrame([(30, 100), (0, 50), (1, 1)], "hits int, n int")
    rows = M.with_rate_ci(cells, "hits", "n", "acc").collect()
    assert rows[0].acc_lo < 0.3 < rows[0].acc_hi and 0.15 < rows[0].acc_hi - rows[0].acc_lo < 0.22
    assert (rows[1].acc_lo, rows[1].acc_hi) == (0.0, 0.0) and rows[2].acc_lo is None


def test_prefix_walk_matches_a_plain_one(spark, steps):
    heads = steps.select(*K).distinct().withColumn("head", F.lit("[task]\nq\n"))
    budget = 400
    got = {(r.subset, r.file_id, r.step_idx): (r.used, r.n_demoted) for r in
           S.stream_prefixes(steps, heads, budget).collect()}
    sized = steps.select(*K, "step_idx", F.length(E.render_step()).alias("a"),
                         F.length(E.render_demoted()).alias("b"), F.col("type_norm").isin("plan", "delegate").alias("c"))
    files = {}
    for r in sized.collect():
        files.setdefault((r.subset, r.file_id), []).append((r.step_idx, r.a, r.b, r.c))
    for key, rows in files.items():
        used, demoted, seen = 9, 0, []
        for i, full, short, coord in sorted(rows):
            seen.append((full, short, coord))
            if used + full > budget:
                used = 9 + sum(f if c else s for f, s, c in seen)
                demoted = sum(not c for *_, c in seen)
                for f, s, c in reversed(seen):
                    if not c and used + f - s <= int(budget * 0.8):
                        used, demoted = used + f - s, demoted - 1
            else:
                used += full
            assert got[(*key, i)] == (used, demoted)


def test_contexts_have_the_lengths_of_the_walk(spark, steps):
    heads = steps.select(*K).distinct().withColumn("query", F.lit("q")).withColumn("ground_truth", F.lit("g"))
    shown = heads.select(*K, E.render_preamble("query", "ground_truth").alias("head"))
    want = {tuple(r)[:3]: (r.used, r.n_demoted) for r in S.stream_prefixes(steps, shown, 400).collect()}
    got = S.build_prompts(steps, heads, policy="plain", budget=400).collect()
    assert {(r.subset, r.file_id, r.step_idx): (len(r.context), r.n_demoted) for r in got} == want
    whole = {(r.subset, r.file_id, r.step_idx): r.context for r in S.build_prompts(steps, heads, policy="plain").collect()}
    for (s, f, i), text in whole.items():
        assert i == 0 or text.startswith(whole[s, f, i - 1])


def pieces(steps):
    out = {}
    rows = steps.select(*K, "step_idx", E.render_step().alias("full"), E.render_demoted().alias("short"),
                        E.render_clean_step(step_chars=60).alias("clean"), E.render_blanked_step().alias("blank"),
                        F.col("type_norm").isin("plan", "delegate").alias("coord"))
    for r in sorted(rows.collect(), key=lambda r: (r.subset, r.file_id, r.step_idx)):
        out.setdefault((r.subset, r.file_id), []).append(r)
    return out


def greedy(head, rows, budget):
    """Text of rows under the retention policy, and how many were demoted."""
    verbatim = [r.coord for r in rows]
    used = len(head) + sum(len(r.full if v else r.short) for r, v in zip(rows, verbatim))
    for i in reversed(range(len(rows))):
        more = len(rows[i].full) - len(rows[i].short)
        if not verbatim[i] and used + more <= budget:
            used, verbatim[i] = used + more, True
    return head + "".join(r.full if v else r.short for r, v in zip(rows, verbatim)), verbatim.count(False)


def test_windows_and_whole_trajectories_under_a_budget(steps):
    head, files = "[task]\nq\n", pieces(steps)
    window = {tuple(r[:3]): (r.context, r.n_demoted) for r in shown(steps, 4, prefix_steps=5, budget=300).collect()}
    whole = {tuple(r[:3]): (r.context, r.n_demoted) for r in shown(steps, 4, policy="hindsight", budget=700).collect()}
    for key, rows in files.items():
        for t in range(len(rows)):
            assert window[(*key, t)] == greedy(head, rows[max(0, t - 4):t + 1], 300)
            assert whole[(*key, t)] == greedy(head, rows, 700)
    assert any(n for _, n in window.values()) and any(n for _, n in whole.values())


def test_oldest_first_text(steps):
    got = {tuple(r[:3]): r.context for r in E.oldest_first_text(steps, 300, 60, 4).select(*K, "step_idx", "context").collect()}
    blanked = 0
    for key, rows in pieces(steps).items():
        for t in range(len(rows)):
            body, i = [r.clean for r in rows[:t + 1]], 0
            while sum(map(len, body)) > 300 and i < t:
                body[i] = rows[i].blank
                i += 1
            blanked += i
            assert got[(*key, t)] == "".join(body)
    assert blanked


def test_long_steps_are_shown_whole_unless_asked(spark):
    rows = [("alg", "f", 0, "A", "A", "x" * 9000, "execute", "parsed", 0.5, True)]
    s = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (S.build_prompts(s, asked(s), policy="plain", max_chars=c).first().context for c in (None, 4000))
    assert "x" * 9000 in whole and "x" * 2001 not in cut and "5000 chars elided" in cut


def test_cost_tree_is_greedy():
    rng = random.Random(8)
    for n in [1, 2, 63, 64, 65, 200, 4097] * 4:
        costs = [rng.choice([FIXED, rng.randrange(-5, 60), rng.randrange(400)]) for _ in range(n)]
        grown, made = CostTree(), CostTree.of(np.array(costs))
        for c in costs:
            grown.append(c)
        room, first = rng.randrange(-20, 3000), rng.randrange(n)
        want, left = [], room
        for i in reversed(range(first, n)):
            if costs[i] <= left:
                want.append(i)
                left -= costs[i]
        assert grown.upgrade(room, first) == made.upgrade(room, first) == (want, left)


def test_a_million_steps_are_decided_at_once():
    costs = np.arange(1_000_000) * 7919 % 1000
    start = time.perf_counter()
    taken, left = CostTree.of(costs).upgrade(50_000_000)
    assert 0 <= left < 1000 and len(taken) > 90_000 and time.perf_counter() - start < 10


def test_transcripts_past_the_first_fit(spark):
    """An emptied line may be longer than its content: the text fits, then no longer."""
    texts = ["x" * 60, "y", "z" * 20, "w" * 30]
    rows = [("alg", "f", i, "A", "A", t, "plan", "parsed", 0.5, True) for i, t in enumerate(texts)]
    s = spark.createDataFrame(rows, SCHEMA)
    full, gone = [f"A: {t}" for t in texts], "A: [omitted for length]"
    for resume, want in ((False, [gone, *full[1:]]), (True, [gone, full[1], gone, full[3]])):
        got = S.transcripts(s, asked(s), cap=90, resume=resume).first()
        assert got.transcript == "\n".join(want)


def test_two_stage_sums_in_step_order(spark):
    """A step that equals its agent's mean is on the same side of it in any order of the rows."""
    values = [0.3, 0.1, 0.2, 0.1, 0.5, 0.3, 0.6, 0.3]
    rows = [("alg", f"f{f}", i, "A", "A", "t", "plan", "parsed", v / 491, True)
            for f in range(40) for i, v in enumerate([sum(values) / len(values), *values])]
    want = {}
    for f in range(40):
        ps = [r[8] for r in rows if r[1] == f"f{f}"]
        mu = 0.0
        for p in ps:
            mu += p
        want[f"f{f}"] = next(i for i, p in enumerate(ps) if p < mu / len(ps))
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = R.two_stage(spark.createDataFrame(rows, SCHEMA).repartition(7), ["mean"])
        assert {r.file_id: r.pred_step for r in got.collect()} == want


def test_fold_search_looks_at_few_blocks():
    """Runs of blocks are bounded first: most blocks of an index are never laid out for a fold."""
    import types

    from faultline.operators import fold_index as FI

    rng = np.random.default_rng(5)
    p = np.unique(rng.random(16_000))
    bad = (rng.random(len(p)) < np.where(p < 0.3, 0.6, 0.05)).astype(int)
    table, seen = FI._Kind(p, p, 1 - bad, bad), []
    fold = types.SimpleNamespace(subset="s", file_id="f", kind=np.array(["a"], object), block=np.array([7]),
                                 ok=1 - bad[[7]], bad=bad[[7]], cells=["a", ""], means=[0.5, 0.5], sds=[0.29, 0.29])
    blocks = FI._Line.blocks
    try:
        FI._Line.blocks = lambda self, spans: seen.append(blocks(self, spans)) or seen[-1]
        found = FI._frame(list(FI.fold_zones(fold, {"a": table}, "f1")))
    finally:
        FI._Line.blocks = blocks
    assert len(seen) == 2 and max(len(b.block) for b in seen) < len(p) / 5
    own = np.arange(len(p)) != 7
    z = ((p - 0.5) / 0.29)[own]
    k = np.unique(np.rint(z * 1000))
    tp, fp = (np.concatenate([[0], np.cumsum(x[own])])[np.searchsorted(z, k / 1000)] for x in (bad, 1 - bad))
    best = int(k[np.argmax(2 * tp / (2 * tp + fp + bad[own].sum() - tp))])
    kept = found[(found.cell == "a") & ~found.asks.astype(bool)]
    assert ((kept.zone <= best) & (best <= kept["last"])).any()


def test_points_that_rows_surely_have():
    from faultline.operators import fold_index as FI

    rng = np.random.default_rng(2)
    points, values = np.unique(rng.integers(0, 90, 40)), rng.integers(-5, 99, 60)
    assert (FI._in_points(values, points) == np.isin(points, values)).all() and not FI._in_points(values[:0], points).any()


def test_stored_folds_are_fitted_once(spark, monkeypatch):
    from faultline.catalog import stores as C

    plans = []
    monkeypatch.setattr(C.ST, "save_folds", lambda stats, thresholds, path: plans.extend(
        df._jdf.queryExecution().optimizedPlan().toString() for df in (stats, thresholds)))
    monkeypatch.setattr(C.ST, "load_folds", lambda spark, path: None)
    C._stored_folds(spark, "/root/testdata/sf0.001")
    assert len(plans) == 4 and not any("Aggregate" in p or "Join" in p for p in plans)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_positions_and_labels_in_one_shuffle(spark, steps):
    """Where no key fills a block: one shuffle for the position, one for the labels."""
    from faultline.sources.views import labelled_steps

    placed = Q.dense_position(steps.select(*K, "p_raw", "step_idx"), K, ["p_raw", "step_idx"], "pos")
    assert _shuffles(placed) == 1 and "Scan parquet" not in placed._jdf.queryExecution().executedPlan().toString()
    assert as_set(placed) == as_set(Q.dense_position(steps.select(*K, "p_raw", "step_idx"), K, ["p_raw", "step_idx"], "pos", 7))
    keyed = steps.withColumn("key", F.substring("file_id", 2, 9).cast("long") * 17 + 6)
    got = labelled_steps(keyed)
    assert _shuffles(got) == 1
    assert as_set(got) == as_set(labelled_steps(keyed, block=4))


def test_lengths_spare_the_shuffle_of_labels(spark, steps):
    from faultline.sources.views import SIZE, labelled_steps

    keyed = steps.withColumn("key", F.substring("file_id", 2, 9).cast("long") * 17 + 6)
    sized = Q.dense_position(keyed.withColumnRenamed("step_idx", "at"), K, ["at"], size=SIZE)
    assert _shuffles(sized) == 1 and _shuffles(labelled_steps(sized.localCheckpoint())) == 0
    assert as_set(labelled_steps(sized)) == as_set(labelled_steps(keyed))


def test_ownership_counts_steps_by_agent(spark, steps, labels):
    from faultline.operators import reports as P

    want = {}
    gold = {(r.subset, r.file_id): r for r in labels.collect()}
    for r in steps.collect():
        g = gold[r.subset, r.file_id]
        want.setdefault((r.subset, r.file_id), {})[r.step_idx] = r.agent.lower() == g.mistake_agent.lower()
    for row in P.position_ownership(steps, labels).collect():
        files = [w for (s, _), w in want.items() if s == row.subset]
        mean = lambda xs: sum(xs) / len(xs)
        assert row.mean_share == pytest.approx(mean([mean(w.values()) for w in files]))
        assert row.step_1 == pytest.approx(mean([w[1] for w in files if 1 in w]))
        assert row.last_step == pytest.approx(mean([w[max(w)] for w in files]))
    plan = P.position_ownership(steps, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("count(1) AS n#")  # counted below the join


def test_draws_are_not_grouped_in_one_task(spark, steps, labels, monkeypatch):
    """Bootstrap draws are dealt over tasks and summed by replicate; random steps are counted in
    the row of their file."""
    units = spark.range(60).select(F.lit("k").alias("k"), (F.col("id") / 7).alias("v"))
    monkeypatch.setattr(M, "DRAWS_PER_TASK", 500)
    got = M.bootstrap_ci(units, ["k"], "v", 100)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan and "AS _w#" not in plan
    values = [i / 7 for i in range(60)]
    h = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) / 2**32
    means = sorted(sum(values[int(h(f"0|{b}|{j}") * 60)] for j in range(60)) / 60 for b in range(100))
    lo, hi = M.ci_positions(100)
    row = got.first()
    assert (row.lo, row.hi) == (pytest.approx(means[lo]), pytest.approx(means[hi]))
    drawn = B.uniform_random_expectation(steps, labels, draws=50)
    assert "count(1) AS _w" not in drawn._jdf.queryExecution().analyzed().toString()
    agents = {(r.subset, r.file_id, r.step_idx): r.agent for r in steps.collect()}
    want = {}
    for r in labels.collect():
        at = [int(h(f"0|{r.subset}|{r.file_id}|{d}") * r.n_steps) for d in range(50)]
        want[r.subset, r.file_id] = (sum(agents[r.subset, r.file_id, i].lower() == r.mistake_agent.lower() for i in at) / 50,
                                     sum(i == r.mistake_step for i in at) / 50)
    assert {(r.subset, r.file_id): (r.agent_rate, r.step_rate) for r in drawn.collect()} == want


def test_bootstrap_query_draws_the_published_number(spark):
    """The query's interval is taken from 2,000 resamples, as its SQL's is."""
    import __spark_entry__ as entry
    from faultline.catalog import tables as T

    sf = "/root/testdata/sf0.001"
    values = {}
    for r in M.per_file_auroc(*T.events(spark, sf)).collect():
        values.setdefault(r.subset, []).append(r.auroc)
    h = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) / 2**32
    lo, hi = M.ci_positions(2000)
    assert "range(2000)" in entry.oracle_sql()["bootstrap_ci"]
    for row in entry.queries()["bootstrap_ci"](spark, sf).collect():
        v = sorted(values[row.subset])
        means = sorted(sum(v[int(h(f"0|{b}|{j}") * len(v))] for j in range(len(v))) / len(v) for b in range(2000))
        assert (row.n, row.lo, row.hi) == (len(v), pytest.approx(means[lo], abs=1e-9), pytest.approx(means[hi], abs=1e-9))


def test_draws_are_never_broadcast(spark, steps, labels):
    """Draws stay in their file's row: what the planner takes for a small table may hold a
    hundred draws a file. Blocks give the same rates."""
    whole = B.uniform_random_expectation(steps, labels, draws=50, block=None)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    blocks = B.uniform_random_expectation(steps, labels, draws=50, block=4)
    assert "Broadcast" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert as_set(whole) == as_set(blocks) and whole.count() == labels.count()
