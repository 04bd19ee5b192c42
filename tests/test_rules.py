"""Hand-computed picks and a plain-Python comparison of the regime rule."""

import math
import statistics as st

import pytest
from steps import make_steps

from faultline.operators import rules as R


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("method,ps,step,check", [
    ("first_crossing", [0.9, 0.2, 0.05], 1, lambda r: r.crossed),
    ("first_crossing", [0.9, 0.8], 1, lambda r: not r.crossed and r.fallback),
    ("argmin", [0.9, 0.2, 0.05], 2, lambda r: True),
    ("argmin", [0.3, 0.1, 0.1], 1, lambda r: True),
    ("changepoint", [0.9] * 5 + [0.1] * 5, 5, lambda r: r.split == 5),
    ("changepoint", [0.9, 0.1, 0.5], 1, lambda r: r.reason == "degenerate"),
    ("relative_crossing@1", [0.9, 0.1, 0.05, 0.9, 0.9], 1, lambda r: r.crossed),
    ("relative_crossing@2", [0.5, 0.5, 0.5], 0, lambda r: r.reason == "degenerate"),
    ("changepoint_single", [0.9] * 5 + [0.1] * 5, 5, lambda r: not r.fallback),
    ("changepoint_single", [0.9] * 3 + [0.0] + [0.9] * 6 + [0.4] * 10, 10, lambda r: not r.fallback),
    ("changepoint_single", [0.9] * 6 + [0.1, 0.1], 6, lambda r: r.reason == "boundary"),
    ("changepoint_single", [0.5] * 8, 0, lambda r: r.reason == "no_variation"),
    ("changepoint_single", [0.9, 0.5, 0.1], 2, lambda r: r.reason == "too_short"),
])
def test_golden_picks(score_rows, method, ps, step, check):
    r = one(R.attribute(score_rows(ps), [method], 0.5))
    assert r.pred_step == step
    assert check(r)


def test_boundary_fallback_can_be_switched_off(score_rows):
    r = one(R.attribute(score_rows([0.9] * 6 + [0.1, 0.1]), [R.PRIMARY], boundary_fallback=False))
    assert (r.pred_step, r.fallback) == (6, False)


def test_low_contrast(score_rows):
    r = one(R.attribute(score_rows([0.5, 0.6, 0.4, 0.55, 0.45, 0.52]), [R.PRIMARY], min_contrast=100,
                        boundary_fallback=False))
    assert r.reason == "low_contrast"


def test_agent_first_prefers_the_agent_whose_best_step_is_worst(score_rows):
    s = score_rows([0.95, 0.05, 0.90, 0.40, 0.35], ["O", "W", "W", "C", "C"])
    assert one(R.attribute(s, ["agent_first"], 0.5)).pred_agent == "C"


def test_threshold_map_by_type(score_rows):
    s = score_rows([0.3, 0.3], types=["plan", "final"])
    assert one(R.attribute(s, ["first_crossing"], {"final": 0.5, "": 0.1})).pred_step == 1


def test_unknown_rules_are_refused():
    with pytest.raises(KeyError):
        R.resolve_method("best_guess")
    with pytest.raises(KeyError):
        R.resolve_method("argmin@2")


def brute(ps):
    n = len(ps)
    low = min(range(n), key=lambda i: (ps[i], i))
    if n < 4:
        return low, "too_short"
    scale = st.pstdev(ps)
    if scale <= 1e-12:
        return low, "no_variation"
    best, arg = -math.inf, 2
    for k in range(2, n - 1):
        a, b = ps[:k], ps[k:]
        var = (st.pvariance(a) * k + st.pvariance(b) * (n - k)) / n
        c = (st.fmean(a) - st.fmean(b)) / (max(math.sqrt(var), 1e-6 * scale) * math.sqrt(1 / k + 1 / (n - k)))
        if c > best:
            best, arg = c, k
    if arg in (2, n - 2):
        return low, "boundary"
    if best < 1.0:
        return low, "low_contrast"
    return arg, None


@pytest.mark.parametrize("block", [None, 4])
def test_regime_rule_matches_plain_python(spark, steps, block):
    files = {}
    for s, f, i, *_, p, _ok in make_steps():
        files.setdefault((s, f), {})[i] = p
    want = {k: brute([v[i] for i in sorted(v)]) for k, v in files.items()}
    got = {(r.subset, r.file_id): (r.pred_step, r.reason)
           for r in R.attribute(steps, [R.PRIMARY], block=block).collect()}
    assert got == want


def test_rules_ignore_null_scores_and_survive_empty_input(spark, steps):
    from pyspark.sql import functions as F

    nothing = R.attribute(steps.filter("false"))
    assert nothing.count() == 0
    some = steps.withColumn("p_raw", F.when(F.col("step_idx") > 0, F.col("p_raw")))
    assert R.attribute(some, ["argmin"]).filter("pred_step = 0").count() == 0
