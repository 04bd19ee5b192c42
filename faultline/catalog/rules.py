"""Registered queries: attribution rules and judge-free baselines."""

from pyspark.sql import functions as F

from ..operators import baselines as B, rules as R
from . import tables as T
from .base import EV_LAB, EVENTS, KEY, LI_LAB, LINES, collapse, h, query

PICK = "subset:s file_id:s pred_step:i pred_agent:s"
BY = "PARTITION BY subset, file_id"

# per-trajectory frame: running sums of the centred score before each step
FRAME = """fr AS (
  SELECT *, p_raw AS p, count(*) OVER f AS n, avg(p_raw) OVER f AS mean, stddev_pop(p_raw) OVER f AS sd
  FROM {src} WINDOW f AS (PARTITION BY subset, file_id)),
fs AS (
  SELECT *, row_number() OVER o - 1 AS k,
    coalesce(sum(p - mean) OVER b, 0.0) AS cs, coalesce(sum((p - mean) * (p - mean)) OVER b, 0.0) AS cq
  FROM fr WINDOW o AS (PARTITION BY subset, file_id ORDER BY step_idx),
    b AS (PARTITION BY subset, file_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cp AS (
  SELECT *, CASE WHEN k >= 2 AND k <= n - 2 THEN cs / k + cs / (n - k) END AS gap,
    CASE WHEN k >= 2 AND k <= n - 2 AND sd > 1e-12 THEN (cs / k + cs / (n - k)) /
      (greatest(sqrt(greatest(sd * sd * n - cs * cs / k - cs * cs / (n - k), 0.0) / n), 1e-6 * sd)
        * sqrt(1.0 / k + 1.0 / (n - k))) END AS contrast
  FROM fs)"""


def frame(src: str) -> str:
    return FRAME.replace("{src}", src)


def primary_sql(extra: str = "") -> str:
    """Two-regime split with its fallbacks, one row per trajectory, from ``cp``."""
    return f"""SELECT {KEY}, CASE WHEN reason IS NULL THEN s.step_idx ELSE lo.step_idx END AS pred_step,
      CASE WHEN reason IS NULL THEN s.agent ELSE lo.agent END AS pred_agent,
      CASE WHEN reason IS NULL THEN s.p ELSE lo.p END AS score,
      reason IS NOT NULL AS fallback, reason, s.k AS split, s.contrast AS contrast{extra}
    FROM (SELECT *, CASE WHEN n < 4 THEN 'too_short' WHEN sd <= 1e-12 THEN 'no_variation'
        WHEN s.k = 2 OR s.k = n - 2 THEN 'boundary' WHEN s.contrast < 1.0 THEN 'low_contrast' END AS reason
      FROM (SELECT {KEY}, first(n) AS n, first(sd) AS sd,
          arg_min({{'step_idx': step_idx, 'agent': agent, 'p': p}}, row(p, step_idx)) AS lo,
          arg_max({{'step_idx': step_idx, 'agent': agent, 'p': p, 'k': k, 'contrast': contrast}},
            row(contrast, -k)) FILTER (contrast IS NOT NULL) AS s
        FROM cp GROUP BY {KEY}))"""


def _rule(method):
    return lambda spark, sf: R.attribute(T.event_steps(spark, sf), [method])


query("rule_argmin", PICK + " score:d",
      f"""SELECT {KEY}, arg_min(step_idx, row(p_raw, step_idx)) AS pred_step,
        arg_min(agent, row(p_raw, step_idx)) AS pred_agent, min(p_raw) AS score FROM ev GROUP BY {KEY}""",
      EVENTS)(_rule("argmin"))


@query("rule_argmin_ties", PICK + " score:d",
       f"""SELECT {KEY}, arg_min(step_idx, row(p_tied, step_idx)) AS pred_step,
         arg_min(agent, row(p_tied, step_idx)) AS pred_agent, min(p_tied) AS score FROM li GROUP BY {KEY}""",
       LINES)
def _(spark, sf):
    """Equal lowest scores go to the earliest step; many short trajectories."""
    return R.attribute(T.line_steps(spark, sf).withColumn("p", F.col("p_tied")), ["argmin"])


_THR = {"plan": 0.02, "delegate": 0.05, "": 0.01}


@query("rule_first_crossing", PICK + " crossed:b",
       f"""SELECT {KEY}, coalesce(c.step_idx, l.step_idx) AS pred_step, coalesce(c.agent, l.agent) AS pred_agent,
         c IS NOT NULL AS crossed FROM (SELECT {KEY},
           arg_min({{'step_idx': step_idx, 'agent': agent}}, step_idx) FILTER (p_raw < CASE type_norm
             WHEN 'plan' THEN 0.02 WHEN 'delegate' THEN 0.05 ELSE 0.01 END) AS c,
           arg_min({{'step_idx': step_idx, 'agent': agent}}, row(p_raw, step_idx)) AS l
         FROM ev GROUP BY {KEY})""", EVENTS)
def _(spark, sf):
    return R.attribute(T.event_steps(spark, sf), ["first_crossing"], _THR)


def _crossing_sql(cut: str) -> str:
    return f"""SELECT {KEY}, coalesce(c.step_idx, l.step_idx) AS pred_step, coalesce(c.agent, l.agent) AS pred_agent,
         c IS NOT NULL AS crossed FROM (SELECT {KEY},
           arg_min({{'step_idx': step_idx, 'agent': agent}}, step_idx) FILTER (sd > 0 AND p < {cut}) AS c,
           arg_min({{'step_idx': step_idx, 'agent': agent}}, row(p, step_idx)) AS l FROM fr GROUP BY {KEY})"""


for _k in (1.5, 2.0, 2.5):
    query(f"rule_relative_crossing_{str(_k).replace('.', '_')}", PICK + " crossed:b",
          _crossing_sql(f"mean - {_k} * sd"), LINES + ", " + frame("li"))(
        lambda spark, sf, k=_k: R.attribute(T.line_steps(spark, sf), [f"relative_crossing@{k}"]))

query("rule_mean_crossing", PICK + " crossed:b", _crossing_sql("mean"), EVENTS + ", " + frame("ev"))(
    _rule("mean_crossing"))

query("rule_changepoint", PICK + " split:i gap:d reason:s",
      f"""SELECT {KEY}, coalesce(s.step_idx, l.step_idx) AS pred_step, coalesce(s.agent, l.agent) AS pred_agent,
        s.k AS split, s.gap AS gap, CASE WHEN s IS NULL THEN 'degenerate' END AS reason FROM (SELECT {KEY},
          arg_max({{'step_idx': step_idx, 'agent': agent, 'k': k, 'gap': gap}}, row(gap, -k))
            FILTER (gap IS NOT NULL) AS s,
          arg_min({{'step_idx': step_idx, 'agent': agent}}, row(p, step_idx)) AS l FROM cp GROUP BY {KEY})""",
      LINES + ", " + frame("li"))(
    lambda spark, sf: R.attribute(T.line_steps(spark, sf), ["changepoint"]))

for _name, _src, _cte, _load in (("rule_changepoint_single", "ev", EVENTS, T.event_steps),
                                 ("rule_changepoint_single_short", "li", LINES, T.line_steps)):
    query(_name, PICK + " score:d fallback:b reason:s split:i bounded_contrast:d",
          primary_sql(", s.contrast / (1 + abs(s.contrast)) AS bounded_contrast"),
          _cte + ", " + frame(_src))(
        # a perfect split has a huge contrast, so it is compared on a bounded scale
        lambda spark, sf, load=_load: R.attribute(load(spark, sf), [R.PRIMARY]).withColumn(
            "bounded_contrast", F.col("contrast") / (1 + F.abs("contrast"))))

query("rule_agent_first", PICK + " crossed:b",
      f"""SELECT {KEY}, coalesce(w.c.step_idx, w.l.step_idx) AS pred_step, coalesce(w.c.agent, w.l.agent) AS pred_agent,
        w.c IS NOT NULL AS crossed FROM (SELECT {KEY}, arg_min({{'c': c, 'l': l}}, row(top, f)) AS w FROM (
          SELECT {KEY}, agent, max(p_raw) AS top, min(step_idx) AS f,
            arg_min({{'step_idx': step_idx, 'agent': agent}}, step_idx) FILTER (p_raw < 0.01) AS c,
            arg_min({{'step_idx': step_idx, 'agent': agent}}, row(p_raw, step_idx)) AS l
          FROM ev GROUP BY {KEY}, agent) GROUP BY {KEY})""", EVENTS)(
    lambda spark, sf: R.attribute(T.event_steps(spark, sf), ["agent_first"], 0.01))


@query("attribute_all_rules", "method:s subset:s n:i mean_step:d fallbacks:i",
       f"""SELECT method, subset, count(*) AS n, avg(pred_step) AS mean_step, count(*) FILTER (fb) AS fallbacks FROM (
         SELECT 'changepoint_single' AS method, subset, pred_step, fallback AS fb FROM ({primary_sql()})
         UNION ALL SELECT 'argmin', subset, arg_min(step_idx, row(p, step_idx)), FALSE FROM cp GROUP BY {KEY}
         UNION ALL SELECT 'changepoint', subset, coalesce(arg_max(step_idx, row(gap, -k)) FILTER (gap IS NOT NULL),
           arg_min(step_idx, row(p, step_idx))), count(gap) = 0 FROM cp GROUP BY {KEY}
         UNION ALL SELECT 'first_crossing', subset, coalesce(min(step_idx) FILTER (p < 0.0),
           arg_min(step_idx, row(p, step_idx))), count(*) FILTER (p < 0.0) = 0 FROM cp GROUP BY {KEY}
         UNION ALL SELECT 'relative_crossing@' || kk, subset, coalesce(min(step_idx) FILTER (sd > 0 AND p < mean - kk * sd),
           arg_min(step_idx, row(p, step_idx))), count(*) FILTER (sd > 0 AND p < mean - kk * sd) = 0
           FROM cp, (VALUES (1.5::DOUBLE), (2.0::DOUBLE), (2.5::DOUBLE)) v(kk) GROUP BY {KEY}, kk)
       GROUP BY 1, 2""", LINES + ", " + frame("li"))
def _(spark, sf):
    p = R.attribute(T.line_steps(spark, sf))
    return p.groupBy("method", "subset").agg(F.count(F.lit(1)).alias("n"), F.avg("pred_step").alias("mean_step"),
                                             F.count_if("fallback").alias("fallbacks"))


@query("two_stage", "subset:s file_id:s method:s pred_step:i pred_agent:s",
       f"""SELECT {KEY}, 'two_stage@' || name AS method, coalesce(min(step_idx) FILTER (p_raw < cut), first(low)) AS pred_step,
         first(agent) AS pred_agent FROM (
         SELECT m.*, unnest(['mean', 'median', 'mean-0.5sd', 'mean-1sd']) AS name,
           unnest([mu, med, mu - 0.5 * sd, mu - sd]) AS cut FROM (
           SELECT e.*, low, avg(p_raw) OVER w AS mu, median(p_raw) OVER w AS med, stddev_pop(p_raw) OVER w AS sd
           FROM ev e JOIN (SELECT {KEY}, arg_min(agent, row(p_raw, step_idx)) AS who,
               arg_min(step_idx, row(p_raw, step_idx)) AS low FROM ev GROUP BY {KEY}) a
             ON a.subset = e.subset AND a.file_id = e.file_id AND a.who = e.agent
           WINDOW w AS (PARTITION BY e.subset, e.file_id)) m)
       GROUP BY {KEY}, name""", EVENTS)
def _(spark, sf):
    return R.two_stage(T.event_steps(spark, sf))


_SEL = ["min", "max", "mean", "median", "mean_two_worst", "fraction_low", "count_low", "total_suspicion"]


@query("agent_selector", "subset:s file_id:s method:s pred_step:i pred_agent:s",
       f"""SELECT {KEY}, 'agent_selector@' || name AS method, arg_min(low, row(v, f)) AS pred_step,
         arg_min(agent, row(v, f)) AS pred_agent FROM (
         SELECT {KEY}, agent, f, low, unnest([{', '.join(repr(s) for s in _SEL)}]) AS name,
           unnest([mn, mx, mean, med, two, fl, cl, ts]) AS v FROM (
           SELECT {KEY}, agent, min(step_idx) AS f, arg_min(step_idx, row(q, step_idx)) AS low, min(q) AS mn,
             max(q) AS mx, avg(q) AS mean, median(q) AS med, avg(q) FILTER (r <= 2) AS two,
             -avg(CAST(q < 0.5 AS INTEGER)) AS fl, CAST(-count(*) FILTER (q < 0.5) AS DOUBLE) AS cl, -sum(1 - q) AS ts
           FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}, agent ORDER BY q, step_idx) AS r
             FROM (SELECT *, p_raw * 20 AS q FROM ev)) GROUP BY {KEY}, agent))
       GROUP BY {KEY}, name""", EVENTS)
def _(spark, sf):
    s = T.event_steps(spark, sf)
    return R.agent_selector(s.withColumn("p", F.col("p_raw") * 20))


@query("rank_steps", "subset:s file_id:s rank:i step_idx:i agent:s p:d",
       f"""SELECT *, p_raw AS p FROM (SELECT *, row_number() OVER ({BY} ORDER BY p_raw, step_idx) AS rank FROM ev)
       WHERE rank <= 5""", EVENTS)
def _(spark, sf):
    return R.rank_steps(T.event_steps(spark, sf), 5)


# --- baselines --------------------------------------------------------------

def naive_sql(src: str, naming: str = "") -> str:
    return f"""SELECT {KEY}, 'prior_position' AS method, step_idx AS pred_step, agent AS pred_agent FROM
        (SELECT *, count(*) OVER ({BY}) AS n FROM {src}) WHERE step_idx = round_even(0.33::DOUBLE * (n - 1), 0)
      UNION ALL SELECT {KEY}, 'first_step', min(step_idx), arg_min(agent, step_idx) FROM {src} GROUP BY {KEY}
      UNION ALL SELECT {KEY}, 'last_step', max(step_idx), arg_max(agent, step_idx) FROM {src} GROUP BY {KEY}
      UNION ALL SELECT {KEY}, 'majority_agent', arg_min(mid, row(-n, agent)), arg_min(agent, row(-n, agent)) FROM
        (SELECT {KEY}, agent, count(*) AS n, CAST(floor(median(step_idx)) AS INTEGER) AS mid
         FROM {src} GROUP BY {KEY}, agent) GROUP BY {KEY}"""


def _one(method, fn):
    query(method, PICK, f"SELECT * FROM ({naive_sql('ev')}) WHERE method = '{method}'", EVENTS)(
        lambda spark, sf: fn(T.event_steps(spark, sf)).filter(F.col("method") == method))


_one("prior_position", B.prior_position)
_one("first_step", B.first_and_last)
_one("last_step", B.first_and_last)
_one("majority_agent", B.majority_agent)


@query("busiest_agents", "subset:s file_id:s rank:i step_idx:i agent:s",
       f"""SELECT {KEY}, r AS rank, f AS step_idx, agent FROM (SELECT *, row_number() OVER ({BY} ORDER BY n DESC, f) AS r
         FROM (SELECT {KEY}, agent, count(*) AS n, min(step_idx) AS f FROM ev GROUP BY {KEY}, agent)) WHERE r <= 2""",
       EVENTS)
def _(spark, sf):
    return B.busiest_agents(T.event_steps(spark, sf), 2)


@query("uniform_random_exact", "subset:s file_id:s agent_rate:d step_rate:d",
       f"""SELECT e.subset, e.file_id, avg(CAST({collapse('e.agent')} = {collapse('l.mistake_agent')} AS INTEGER)) AS agent_rate,
         avg(CAST(e.step_idx = l.mistake_step AS INTEGER)) AS step_rate
       FROM li e JOIN lab l USING ({KEY}) GROUP BY 1, 2""", LI_LAB)
def _(spark, sf):
    return B.uniform_random_expectation(*T.lines(spark, sf, scored=False))


@query("uniform_random_draws", "subset:s file_id:s agent_rate:d step_rate:d",
       f"""SELECT subset, file_id, sum(w * CAST(ea = ga AS INTEGER)) / 100.0 AS agent_rate,
         sum(w * CAST(step_idx = mistake_step AS INTEGER)) / 100.0 AS step_rate FROM (
           SELECT subset, file_id, ga, mistake_step, step_idx, count(*) AS w FROM (
             SELECT subset, file_id, ga, mistake_step,
               CAST(floor({h("concat_ws('|', '0', subset, file_id, i)")} * n_steps) AS INTEGER) AS step_idx
             FROM (SELECT subset, file_id, mistake_step, n_steps, {collapse('mistake_agent')} AS ga,
               unnest(range(100)) AS i FROM lab)) GROUP BY ALL)
         JOIN (SELECT subset, file_id, step_idx, {collapse('agent')} AS ea FROM ev) USING (subset, file_id, step_idx)
       GROUP BY subset, file_id""", EV_LAB)
def _(spark, sf):
    return B.uniform_random_expectation(*T.events(spark, sf), draws=100)
