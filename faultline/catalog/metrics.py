"""Registered queries: evaluation metrics and report tables."""

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.stats import p_true_from_logprobs
from ..functions.text import hash_fraction
from ..operators import metrics as M, reports as P, rules as R
from ..plans import flows
from ..schema import K
from . import tables as T
from .base import CV_LAB, EV_LAB, EVENTS, KEY, LI_LAB, collapse, h, loose, query, strip
from .normalize import FOLDS, auroc_sql, normed
from .rules import frame, naive_sql, primary_sql

METHODS = ["changepoint_single", "argmin"]


def preds_sql(src: str) -> str:
    return frame(src) + f""",
pr AS (SELECT {KEY}, 'changepoint_single' AS method, pred_step, pred_agent, score, fallback, reason FROM ({primary_sql()})
  UNION ALL SELECT {KEY}, 'argmin', arg_min(step_idx, row(p, step_idx)), arg_min(agent, row(p, step_idx)), min(p),
    FALSE, NULL FROM cp GROUP BY {KEY}),
jd AS ({judged_sql('pr')})"""


def judged_sql(preds: str) -> str:
    return f"""SELECT p.*, l.n_steps, l.mistake_step, l.mistake_agent, l.key, l.out_of_range, l.mismatch,
    pred_agent IS NOT NULL AND {collapse('pred_agent')} = {collapse('mistake_agent')} AS ae,
    coalesce(contains(lower({strip('pred_agent')}), lower({strip('mistake_agent')})), FALSE) AS asub,
    coalesce(pred_step = mistake_step, FALSE) AS se, coalesce(abs(pred_step - mistake_step) <= 1, FALSE) AS s1,
    coalesce(abs(pred_step - mistake_step) <= 2, FALSE) AS s2,
    coalesce(contains(CAST(pred_step AS VARCHAR), CAST(mistake_step AS VARCHAR)), FALSE) AS ssub
  FROM {preds} p JOIN lab l USING ({KEY})"""


EV_PREDS = EV_LAB + ",\n" + preds_sql("ev")
LI_PREDS = LI_LAB + ",\n" + preds_sql("li")
ROLE = f"CASE WHEN {collapse('mistake_agent')} = 'orchestrator' THEN 'orchestrator' ELSE 'worker' END"
# view stands in for the orchestrator where a fault split needs both roles
VIEW_LEAD = EV_LAB.replace("event_type AS agent", "CASE event_type WHEN 'view' THEN 'Orchestrator' ELSE event_type END AS agent")
VIEW_PREDS = VIEW_LEAD + ",\n" + preds_sql("ev")


def _preds(s, methods=METHODS):
    return R.attribute(s, methods)


def _events(spark, sf):
    s, lab = T.events(spark, sf)
    return s, lab, _preds(s)


def _lead_events(spark, sf):
    s = T.event_steps(spark, sf)
    s = s.withColumn("agent", F.when(F.col("agent") == "view", F.lit("Orchestrator")).otherwise(F.col("agent")))
    lab = T.flagged_labels(s)
    return s, lab, _preds(s)


MATCH = "agent_exact:b agent_substring:b step_exact:b step_tol1:b step_tol2:b step_substring:b"


@query("match_predicates", "subset:s file_id:s method:s " + MATCH,
       f"""SELECT {KEY}, method, ae AS agent_exact, asub AS agent_substring, se AS step_exact, s1 AS step_tol1,
         s2 AS step_tol2, ssub AS step_substring FROM jd""", LI_PREDS)
def _(spark, sf):
    s, lab = T.lines(spark, sf)
    return M.judged(_preds(s), lab)


def table_sql(src: str = "jd", by: str = "method") -> str:
    return f"""SELECT {by}, subset, scorer, slice, count(*) AS n, count(*) FILTER (a) AS agent_hits,
      count(*) FILTER (st) AS step_hits, avg(CAST(a AS INTEGER)) AS agent_acc, avg(CAST(st AS INTEGER)) AS step_acc,
      avg(CAST(a AND st AS INTEGER)) AS both_acc FROM (
      SELECT {by}, subset, slice, unnest(['exact', 'tol1', 'tol2', 'substring']) AS scorer,
        unnest([ae, ae, ae, asub]) AS a, unnest([se, s1, s2, ssub]) AS st FROM (
        SELECT *, unnest(['all', CASE WHEN NOT mismatch THEN 'excl_flagged' END,
          CASE WHEN anya AND NOT out_of_range THEN 'excl_anomalous' END,
          CASE WHEN anya AND NOT mismatch AND NOT out_of_range THEN 'excl_all_excluded' END]) AS slice
        FROM (SELECT j.*, anya FROM {src} j JOIN (SELECT subset, bool_or(out_of_range) AS anya FROM lab GROUP BY 1) USING (subset)))
      WHERE slice IS NOT NULL) GROUP BY {by}, subset, scorer, slice"""


TABLE = "method:s subset:s scorer:s slice:s n:i agent_hits:i step_hits:i agent_acc:d step_acc:d both_acc:d"


@query("score_table", TABLE, table_sql(), LI_PREDS)
def _(spark, sf):
    s, lab = T.lines(spark, sf)
    return M.score_table(_preds(s), lab)


# flagship: folds -> z-scores -> rules -> accuracy
_FLAG = FOLDS + f",\nnz AS (SELECT * EXCLUDE (p_raw), p_norm AS p_raw FROM ({normed('ev')})),\n" + preds_sql("nz")


@query("primary_accuracy", TABLE, table_sql(), _FLAG)
def _(spark, sf):
    """Leave-one-out normalization, primary rule and argmin, accuracy by scorer and slice."""
    return flows.primary_accuracy(*T.events(spark, sf), METHODS)


@query("conversation_accuracy", TABLE, table_sql(),
       CV_LAB.replace("st AS (SELECT *,", f"st AS (SELECT *, {h('text')} AS p_raw,").replace(
           "l.mistake_step < 0 OR l.mistake_step >= l.n_steps AS out_of_range",
           "l.mistake_step >= l.n_steps OR EXISTS (SELECT 1 FROM st b WHERE b.subset = l.subset AND b.file_id = l.file_id AND b.tx = '') AS out_of_range")
       + ",\n" + preds_sql("st"))
def _(spark, sf):
    """Typed conversations, hash score of the text, rules on the raw score."""
    s, lab = T.conversations(spark, sf)
    return M.score_table(_preds(s.withColumn("p_raw", hash_fraction("text"))), lab)


@query("score_table_intervals", "method:s subset:s scorer:s slice:s n:i ordered:b inside:b",
       f"""SELECT method, subset, scorer, slice, n, TRUE AS ordered, TRUE AS inside FROM ({table_sql()})""", EV_PREDS)
def _(spark, sf):
    """Binomial bootstrap intervals bracket their points."""
    _, lab, p = _events(spark, sf)
    t = M.score_table(p, lab, n_boot=2000)
    inside = (F.col("step_lo") <= F.col("step_acc")) & (F.col("step_acc") <= F.col("step_hi")) & (
        F.col("agent_lo") <= F.col("agent_acc")) & (F.col("agent_acc") <= F.col("agent_hi"))
    return t.withColumn("ordered", F.col("agent_lo") <= F.col("agent_hi")).withColumn("inside", inside)


# per-file AUROC: pairwise definition
PF = EV_LAB + f""",
pf AS (SELECT g.subset, g.file_id, any_value(g.p_raw) AS gold_p, count(*) AS n_other, sum(o.p_raw) AS sum_other,
    avg(CASE WHEN o.p_raw > g.p_raw THEN 1.0 WHEN o.p_raw = g.p_raw THEN 0.5 ELSE 0.0 END) AS auroc
  FROM ev g JOIN lab l ON l.subset = g.subset AND l.file_id = g.file_id AND l.mistake_step = g.step_idx
  JOIN ev o ON o.subset = g.subset AND o.file_id = g.file_id AND o.step_idx <> g.step_idx GROUP BY 1, 2)"""


@query("per_file_auroc", "subset:s file_id:s gold_p:d n_other:i sum_other:d auroc:d", "SELECT * FROM pf", PF)
def _(spark, sf):
    return M.per_file_auroc(*T.events(spark, sf))


@query("within_file_auroc", "subset:s n_files:i within_file_auroc:d mean_gold:d mean_other:d pooled_auroc:d",
       f"""SELECT subset, n_files, within_file_auroc, mean_gold, mean_other, a.auroc AS pooled_auroc FROM (
         SELECT subset, count(*) AS n_files, avg(auroc) AS within_file_auroc, avg(gold_p) AS mean_gold,
           sum(sum_other) / sum(n_other) AS mean_other FROM pf GROUP BY 1) JOIN ({auroc_sql('subset', '-p_raw', 'y',
           '(SELECT e.subset, e.p_raw, e.step_idx = l.mistake_step AS y FROM ev e JOIN lab l USING (subset, file_id) WHERE NOT l.out_of_range)')}) a
         USING (subset)""", PF)
def _(spark, sf):
    return M.within_file_auroc(*T.events(spark, sf))


def boot_sql(src: str, value: str, n_boot: int) -> str:
    lo, hi = M.ci_positions(n_boot)
    return f"""SELECT subset, n, point, s[{lo + 1}] AS lo, s[{hi + 1}] AS hi FROM (
      SELECT subset, any_value(n) AS n, any_value(pt) AS point, list_sort(list(m)) AS s FROM (
        SELECT z.subset, b, any_value(z.n) AS n, any_value(pt) AS pt, avg(u.v) AS m
        FROM (SELECT subset, count(*) AS n, avg({value}) AS pt FROM {src} GROUP BY 1) z
        CROSS JOIN range({n_boot}) r(b) JOIN LATERAL (SELECT unnest(range(z.n)) AS j) ON TRUE
        JOIN (SELECT subset, {value} AS v, row_number() OVER (PARTITION BY subset ORDER BY {value}) - 1 AS i FROM {src}) u
          ON u.subset = z.subset AND u.i = CAST(floor({h("concat_ws('|', '0', b, j)")} * z.n) AS BIGINT)
        GROUP BY z.subset, b) GROUP BY subset)"""


@query("bootstrap_ci", "subset:s n:i point:d lo:d hi:d", boot_sql("pf", "auroc", V.N_BOOT), PF)
def _(spark, sf):
    per = M.per_file_auroc(*T.events(spark, sf))
    return M.bootstrap_ci(per.select("subset", "auroc"), ["subset"], "auroc")




@query("reliability", "lang:s bin:i n:i mean_p:d frac_pos:d ece:d mce:d brier:d n_total:i",
       f"""SELECT t.lang, b.i AS bin, coalesce(c.n, 0) AS n, mean_p, frac_pos, ece, mce, brier, n_total FROM (
         SELECT lang, sum(n) AS n_total, sum(n * gap) FILTER (bin IS NOT NULL) / sum(n) AS ece,
           max(gap) FILTER (bin IS NOT NULL) AS mce, sum(sq) / sum(n) AS brier FROM rb GROUP BY 1) t
       CROSS JOIN range(10) b(i) LEFT JOIN rb c ON c.lang = t.lang AND c.bin = b.i""",
       f"""rb AS (SELECT lang, bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS frac_pos, abs(avg(y) - avg(p)) AS gap,
         sum((p - y) * (p - y)) AS sq FROM (SELECT lang, p, y, CASE
           {' '.join(f'WHEN p >= {i}::DOUBLE * 0.1::DOUBLE AND p {"<=" if i == 9 else "<"} {i + 1}::DOUBLE * 0.1::DOUBLE THEN {i}' for i in range(10))} END AS bin
         FROM (SELECT d.lang, {h('d.text')} * 1.2 AS p, CAST(l.quality AS DOUBLE) AS y FROM documents d JOIN labels l USING (doc_id)))
       GROUP BY 1, 2)""")
def _(spark, sf):
    """Document hash scores against quality labels; values above 1 fall in no bin."""
    d = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id")
    rows = d.select("lang", (hash_fraction("text") * 1.2).alias("p"), (F.col("quality") == 1).alias("y"))
    return M.reliability(rows, "p", "y", ["lang"])


@query("auroc", "lang:s n:i n_pos:i auroc:d",
       auroc_sql("lang", "s", "y", f"(SELECT d.lang, floor({h('d.text')} * 20) AS s, l.quality = 1 AS y FROM documents d JOIN labels l USING (doc_id))"))
def _(spark, sf):
    d = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id")
    rows = d.select("lang", F.floor(hash_fraction("text") * 20).cast("double").alias("s"), (F.col("quality") == 1).alias("y"))
    return M.auroc(rows, ["lang"], "s", "y")


_SIGNAL = EV_PREDS + f""",
mg AS (SELECT {KEY}, max(p_raw) FILTER (r = 1) AS a, max(p_raw) FILTER (r = 2) AS b FROM (SELECT *,
  row_number() OVER (PARTITION BY {KEY} ORDER BY p_raw, step_idx) AS r FROM ev) GROUP BY 1, 2),
sg AS (SELECT j.*, ae AND se AS ok, e.p_raw AS delta, mg.a - mg.b AS margin, CAST(n_steps AS DOUBLE) AS len
  FROM jd j JOIN ev e ON e.subset = j.subset AND e.file_id = j.file_id AND e.step_idx = j.pred_step
  JOIN mg ON mg.subset = j.subset AND mg.file_id = j.file_id)"""

for _by, _col in (("delta", "delta"), ("margin", "margin"), ("n_steps", "len")):
    query(f"risk_coverage_{_by}", "method:s fraction:d n_selected:i n:i coverage:d accuracy:d",
          f"""SELECT method, f AS fraction, any_value(t) AS n_selected, any_value(k) AS n, any_value(k) / any_value(t) AS coverage,
            count(*) FILTER (ok AND r <= k) / any_value(k) AS accuracy FROM (
            SELECT method, ok, f, r, t, greatest(1, CAST(round_even(f * t, 0) AS BIGINT)) AS k FROM (
              SELECT *, row_number() OVER (PARTITION BY method ORDER BY {_col}, subset, file_id) AS r,
                count(*) OVER (PARTITION BY method) AS t FROM sg),
              (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) v(f)) GROUP BY 1, 2""", _SIGNAL)(
        lambda spark, sf, by=_by: (lambda s, lab, p: M.risk_coverage(M.selection_signal(p, s, by), lab))(*_events(spark, sf)))


@query("selective_prediction", "method:s n_selected:i n_correct:i mean_when_correct:d mean_when_wrong:d auroc_correct_vs_wrong:d",
       f"""SELECT b.*, a.auroc AS auroc_correct_vs_wrong FROM (SELECT method, count(*) AS n_selected, count(*) FILTER (ok) AS n_correct,
         avg(delta) FILTER (ok) AS mean_when_correct, avg(delta) FILTER (NOT ok) AS mean_when_wrong FROM sg GROUP BY 1) b
       LEFT JOIN ({auroc_sql('method', '-delta', 'ok', 'sg')}) a USING (method)""", _SIGNAL)
def _(spark, sf):
    s, lab, p = _events(spark, sf)
    return M.selective_prediction(M.selection_signal(p, s), lab)


def _dis(strata: str) -> str:
    return f"""SELECT a.subset, stratum, count(*) AS n, avg(CAST(a.pred_step IS DISTINCT FROM b.pred_step AS INTEGER)) AS step_disagree,
      avg(CAST(a.pred_agent IS DISTINCT FROM b.pred_agent AS INTEGER)) AS agent_disagree
    FROM (SELECT * FROM pr WHERE method = 'changepoint_single') a JOIN (SELECT * FROM pr WHERE method = 'argmin') b USING (subset, file_id)
    JOIN (SELECT {KEY}, unnest(['all', {strata}]) AS stratum FROM pr JOIN ev USING (subset, file_id)
      WHERE method = 'changepoint_single' AND step_idx = pred_step) USING (subset, file_id) GROUP BY 1, 2"""


_DIS = "subset:s stratum:s n:i step_disagree:d agent_disagree:d"


@query("disagreement_by_type", _DIS, _dis("type_norm"), EV_PREDS)
def _(spark, sf):
    s, _, p = _events(spark, sf)
    a, b = (p.filter(F.col("method") == m) for m in METHODS)
    return M.disagreement(a, b, M.type_strata(a, s))


@query("disagreement_by_role", _DIS, _dis(f"CASE WHEN {collapse('pred_agent')} = 'orchestrator' THEN 'orchestrator' ELSE 'worker' END"),
       VIEW_PREDS)
def _(spark, sf):
    _, _, p = _lead_events(spark, sf)
    a, b = (p.filter(F.col("method") == m) for m in METHODS)
    return M.disagreement(a, b, M.role_strata(a))


@query("position_table", "method:s n:i gold_mean:d gold_median:d pred_mean:d pred_median:d delta_mean:d delta_median:d late:d pred_first_fifth:d gold_first_fifth:d",
       """SELECT method, count(*) AS n, round(avg(g), 4) AS gold_mean, round(median(g), 4) AS gold_median, round(avg(p), 4) AS pred_mean,
         round(median(p), 4) AS pred_median, round(avg(p - g), 4) AS delta_mean, round(median(p - g), 4) AS delta_median,
         round(avg(CAST(p - g > 0 AS INTEGER)), 4) AS late, round(avg(CAST(p < 0.2 AS INTEGER)), 4) AS pred_first_fifth,
         round(avg(CAST(g < 0.2 AS INTEGER)), 4) AS gold_first_fifth
       FROM (SELECT method, pred_step / (n_steps - 1) AS p, mistake_step / (n_steps - 1) AS g FROM jd WHERE n_steps > 1) GROUP BY 1""",
       EV_PREDS)
def _(spark, sf):
    _, lab, p = _events(spark, sf)
    return M.position_table(p, lab)


def recall_sql(src: str, ks, same: str, where: str, reach: str = "TRUE") -> str:
    vals = ", ".join(f"({k})" for k in ks)
    return f"""SELECT subset, k, count(*) AS n, avg(s) AS step_recall, avg(a) AS agent_recall, avg(c) AS agents_covered,
      avg(rs) AS random_step, avg(ra) AS random_agent FROM (
      SELECT subset, file_id, k, max(CAST(step_idx = mistake_step AND r <= k AS INTEGER)) AS s,
        max(CAST({same} AND r <= k AS INTEGER)) AS a, count(DISTINCT {collapse('agent')}) FILTER (r <= k) AS c,
        CASE WHEN max(CAST({reach} AS INTEGER)) = 1 THEN least(k, any_value(cnt)) / any_value(cnt) ELSE 0.0 END AS rs,
        CASE WHEN any_value(own) = 0 THEN 0.0 ELSE 1.0 - list_reduce(list_transform(range(least(k, any_value(cnt))),
          lambda i: CAST(greatest(any_value(cnt) - any_value(own) - i, 0) AS DOUBLE) / (any_value(cnt) - i)),
          lambda x, y: x * y) END AS ra
      FROM (SELECT e.*, l.mistake_step, l.mistake_agent, row_number() OVER w AS r, count(*) OVER f AS cnt,
          count(*) FILTER ({same.replace('agent)', 'agent)')}) OVER f AS own
        FROM {src} e JOIN lab l USING (subset, file_id)
        WINDOW w AS (PARTITION BY subset, file_id ORDER BY p_raw, step_idx), f AS (PARTITION BY subset, file_id)),
        (VALUES {vals}) v(k) WHERE cnt >= 2 AND {where} GROUP BY subset, file_id, k) GROUP BY 1, 2"""


RECALL = "subset:s k:i n:i step_recall:d agent_recall:d agents_covered:d random_step:d random_agent:d"
_SAME = f"{collapse('agent')} = {collapse('mistake_agent')}"


@query("recall_at_k", RECALL, recall_sql("ev", (1, 2, 3, 5), _SAME, "mistake_step < cnt"), EV_LAB)
def _(spark, sf):
    return M.recall_at_k(*T.events(spark, sf))


@query("candidate_recall", RECALL,
       recall_sql("(SELECT * FROM ev WHERE step_idx > 0)", (1, 2), loose('mistake_agent', 'agent'), "TRUE", "step_idx = mistake_step"), EV_LAB)
def _(spark, sf):
    """Step 0 is no candidate; a gold step 0 stays a miss."""
    s, lab = T.events(spark, sf)
    return P.candidate_recall(s.withColumn("candidate", F.col("step_idx") > 0), lab, "p_raw")


@query("content_free_top_k", "subset:s method:s k:i n:i step_acc:d agent_acc:d",
       f"""SELECT subset, method, k, count(*) AS n, avg(s) AS step_acc, avg(a) AS agent_acc FROM (
         SELECT subset, file_id, method, k, CAST(bool_or(step_idx = mistake_step) AS INTEGER) AS s, CAST(bool_or(hit) AS INTEGER) AS a
         FROM (SELECT *, {loose('mistake_agent', 'agent')} AS hit FROM pk) JOIN (VALUES (1), (2)) v(k) ON r <= k GROUP BY 1, 2, 3, 4
         UNION ALL SELECT subset, file_id, 'random', k, least(k, cnt) / cnt, CASE WHEN own = 0 THEN 0.0 ELSE
           1.0 - CAST(cnt - own AS DOUBLE) / cnt * CASE WHEN k = 2 THEN CAST(greatest(cnt - own - 1, 0) AS DOUBLE) / (cnt - 1) ELSE 1.0 END END
         FROM (SELECT DISTINCT subset, file_id, cnt, own FROM fx), (VALUES (1), (2)) v(k)) GROUP BY 1, 2, 3""",
       EV_LAB + f""",
fx AS (SELECT * FROM (SELECT e.*, l.mistake_step, l.mistake_agent, count(*) OVER f AS cnt, bool_or(e.step_idx = l.mistake_step) OVER f AS reach,
    count(*) FILTER ({loose('l.mistake_agent', 'e.agent')}) OVER f AS own FROM ev e JOIN lab l USING (subset, file_id)
  WINDOW f AS (PARTITION BY subset, file_id)) WHERE cnt >= 2 AND reach),
pk AS (SELECT {KEY}, 'field' AS method, step_idx, agent, mistake_step, mistake_agent, row_number() OVER (PARTITION BY {KEY} ORDER BY p_raw, step_idx) AS r FROM fx
  UNION ALL SELECT {KEY}, 'first', step_idx, agent, mistake_step, mistake_agent, step_idx + 1 FROM fx
  UNION ALL SELECT {KEY}, 'last', step_idx, agent, mistake_step, mistake_agent, row_number() OVER (PARTITION BY {KEY} ORDER BY step_idx DESC) FROM fx
  UNION ALL SELECT {KEY}, 'busiest', f, agent, mistake_step, mistake_agent, row_number() OVER (PARTITION BY {KEY} ORDER BY n DESC, f) FROM
    (SELECT {KEY}, agent, count(*) AS n, min(step_idx) AS f, any_value(mistake_step) AS mistake_step, any_value(mistake_agent) AS mistake_agent
     FROM fx GROUP BY {KEY}, agent))""")
def _(spark, sf):
    return P.content_free_top_k(*T.events(spark, sf))


# --- reports ----------------------------------------------------------------

@query("stratified_accuracy", "method:s dimension:s stratum:s n:i agent_acc:d step_acc:d",
       f"""SELECT method, dimension, stratum, count(*) AS n, avg(CAST(ae AS INTEGER)) AS agent_acc, avg(CAST(se AS INTEGER)) AS step_acc FROM (
         SELECT method, ae, se, unnest(['gold_step_type', 'gold_role', 'trajectory_length', 'subset', 'level']) AS dimension,
           unnest([coalesce(e.type_norm, 'out_of_range'), {ROLE}, CASE WHEN n_steps < 10 THEN 'short (<10)' WHEN n_steps < 40 THEN
             'medium (10-39)' ELSE 'long (40+)' END, j.subset, 'absent']) AS stratum
         FROM jd j LEFT JOIN ev e ON e.subset = j.subset AND e.file_id = j.file_id AND e.step_idx = j.mistake_step) GROUP BY 1, 2, 3""",
       VIEW_PREDS)
def _(spark, sf):
    s, lab, p = _lead_events(spark, sf)
    return P.stratified_accuracy(p, lab, s)


_NAIVE = VIEW_LEAD + f",\npr AS ({naive_sql('ev')}),\njd AS ({judged_sql('pr')})"


@query("base_rate_audit", "subset:s method:s fault:s n:i agent_acc:d step_acc:d",
       f"""SELECT subset, method, {ROLE} AS fault, count(*) AS n, avg(CAST(ae AS INTEGER)) AS agent_acc,
         avg(CAST(se AS INTEGER)) AS step_acc FROM jd GROUP BY 1, 2, 3""", _NAIVE)
def _(spark, sf):
    s, lab, _ = _lead_events(spark, sf)
    return P.base_rate_audit(s, lab)[0]


@query("gold_agent_share", "subset:s fault:s n:i mean_share:d",
       f"""SELECT subset, {ROLE} AS fault, count(*) AS n, avg(sh) AS mean_share FROM (SELECT e.subset, e.file_id, any_value(mistake_agent) AS mistake_agent,
         avg(CAST({_SAME} AS INTEGER)) AS sh FROM ev e JOIN lab l USING (subset, file_id) GROUP BY 1, 2) GROUP BY 1, 2""", VIEW_LEAD)
def _(spark, sf):
    s, lab, _ = _lead_events(spark, sf)
    return P.base_rate_audit(s, lab)[1]


@query("score_by_gold_position", "subset:s bin:i n:i mean_score:d",
       """SELECT subset, least(CAST(floor(mistake_step / (n_steps - 1) * 5) AS INTEGER), 4) AS bin, count(*) AS n, avg(p_raw) AS mean_score
       FROM ev JOIN lab USING (subset, file_id) WHERE type_norm = 'final' AND NOT out_of_range AND n_steps >= 2 GROUP BY 1, 2""", EV_LAB)
def _(spark, sf):
    return P.score_by_gold_position(*T.events(spark, sf))


@query("type_composition", "method:s subset:s type_norm:s gold:i pred:i",
       """SELECT method, subset, t AS type_norm, count(*) FILTER (side = 'g') AS gold, count(*) FILTER (side = 'p') AS pred FROM (
         SELECT method, j.subset, unnest([coalesce(g.type_norm, 'out_of_range'), CASE WHEN g.type_norm IS NOT NULL THEN p.type_norm END]) AS t,
           unnest(['g', 'p']) AS side FROM jd j
         LEFT JOIN ev g ON g.subset = j.subset AND g.file_id = j.file_id AND g.step_idx = j.mistake_step
         LEFT JOIN ev p ON p.subset = j.subset AND p.file_id = j.file_id AND p.step_idx = j.pred_step) WHERE t IS NOT NULL GROUP BY 1, 2, 3""", EV_PREDS)
def _(spark, sf):
    s, lab, p = _events(spark, sf)
    return P.type_composition(p, lab, s)


@query("tolerance_curve", "subset:s exact:d tol1:d tol2:d",
       """SELECT subset, avg(CAST(se AS INTEGER)) AS exact, avg(CAST(s1 AS INTEGER)) AS tol1, avg(CAST(s2 AS INTEGER)) AS tol2
       FROM jd WHERE method = 'changepoint_single' GROUP BY 1""", LI_PREDS)
def _(spark, sf):
    s, lab = T.lines(spark, sf)
    return P.tolerance_curve(M.score_table(_preds(s, [R.PRIMARY]), lab))


@query("position_ownership", "subset:s step_0:d step_1:d step_2:d last_step:d mean_share:d",
       f"""SELECT subset, avg(o0) AS step_0, avg(o1) AS step_1, avg(o2) AS step_2, avg(ol) AS last_step, avg(sh) AS mean_share FROM (
         SELECT e.subset, e.file_id, max(own) FILTER (step_idx = 0) AS o0, max(own) FILTER (step_idx = 1) AS o1,
           max(own) FILTER (step_idx = 2) AS o2, max(own) FILTER (step_idx = n_steps - 1) AS ol, avg(own) AS sh
         FROM (SELECT e.*, l.n_steps, CAST({_SAME} AS INTEGER) AS own FROM li e JOIN lab l USING (subset, file_id)) e GROUP BY 1, 2) GROUP BY 1""",
       LI_LAB)
def _(spark, sf):
    return P.position_ownership(*T.lines(spark, sf, scored=False))


@query("depth_accuracy", "method:s subset:s depth:s n:i agent_acc:d",
       """SELECT method, subset, CASE WHEN pred_step = 0 THEN '0' WHEN pred_step = 1 THEN '1' WHEN pred_step < 5 THEN '2-4' ELSE '5+' END AS depth,
         count(*) AS n, avg(CAST(ae AS INTEGER)) AS agent_acc FROM jd GROUP BY 1, 2, 3""", LI_PREDS)
def _(spark, sf):
    s, lab = T.lines(spark, sf)
    return P.depth_accuracy(_preds(s), lab)


@query("fallback_rate", "subset:s reason:s n:i n_files:i rate:d",
       """SELECT *, round(sum(CASE WHEN reason <> 'regime_found' THEN n ELSE 0 END) OVER (PARTITION BY subset) / n_files, 4) AS rate FROM (
         SELECT subset, coalesce(reason, 'regime_found') AS reason, count(*) AS n, sum(count(*)) OVER (PARTITION BY subset) AS n_files
         FROM pr WHERE method = 'changepoint_single' GROUP BY 1, 2)""", LI_PREDS)
def _(spark, sf):
    return P.fallback_rate(_preds(T.line_steps(spark, sf), [R.PRIMARY]))


@query("fallback_by_length", "length:s n:i fallback:d",
       """SELECT CASE WHEN n_steps < 10 THEN '< 10' WHEN n_steps < 20 THEN '10-20' WHEN n_steps < 50 THEN '20-50' ELSE '50+' END AS length,
         count(*) AS n, avg(CAST(fallback AS INTEGER)) AS fallback FROM jd WHERE method = 'changepoint_single' GROUP BY 1""", LI_PREDS)
def _(spark, sf):
    s, lab = T.lines(spark, sf)
    return P.fallback_by_length(_preds(s), lab)


@query("fault_split", "method:s subset:s fault:s n:i agent_acc:d step_acc:d",
       f"""SELECT method, subset, {ROLE} AS fault, count(*) AS n, avg(CAST(ae AS INTEGER)) AS agent_acc, avg(CAST(se AS INTEGER)) AS step_acc
       FROM jd GROUP BY 1, 2, 3 HAVING count(*) >= 2""", VIEW_PREDS)
def _(spark, sf):
    _, lab, p = _lead_events(spark, sf)
    return P.fault_split(p, lab)


# stored predictions of several judges and methods, derived from the event table
GRID = EV_LAB + f""",
gr AS (SELECT CASE WHEN e.event_id % 3 = 0 THEN 'small' ELSE 'large' END AS judge,
    CASE e.event_id % 5 WHEN 0 THEN 'all_at_once' WHEN 1 THEN 'step_by_step' ELSE 'binary_search' END AS method, e.event_id % 2 = 0 AS with_gt,
    e.subset, CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE e.step_idx END AS pred_step, CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE e.agent END AS pred_agent,
    e.step_idx + 1 AS n_calls, CASE e.event_id % 4 WHEN 0 THEN 'upper>lower' WHEN 1 THEN 'lower' WHEN 2 THEN 'upper>ambiguous' ELSE '' END AS raw,
    l.mistake_step AS gold_step, l.mistake_agent AS gold_agent FROM ev e JOIN lab l USING (subset, file_id))"""


def _grid(spark, sf):
    s, lab = T.events(spark, sf)
    e = F.col("event_id")
    gone = e % 7 == 0
    j = s.join(lab.select(*K, F.col("mistake_step").alias("gold_step"), F.col("mistake_agent").alias("gold_agent")), K)
    return j.select(
        F.when(e % 3 == 0, F.lit("small")).otherwise(F.lit("large")).alias("judge"),
        F.when(e % 5 == 0, F.lit("all_at_once")).when(e % 5 == 1, F.lit("step_by_step")).otherwise(F.lit("binary_search")).alias("method"),
        (e % 2 == 0).alias("with_gt"), *K, F.when(~gone, F.col("step_idx")).alias("pred_step"), F.when(~gone, F.col("agent")).alias("pred_agent"),
        (F.col("step_idx") + 1).alias("n_calls"),
        F.when(e % 4 == 0, F.lit("upper>lower")).when(e % 4 == 1, F.lit("lower")).when(e % 4 == 2, F.lit("upper>ambiguous")).otherwise(F.lit("")).alias("raw"),
        "gold_step", "gold_agent")


@query("method_grid", "judge:s method:s with_gt:b subset:s n:i step_acc:d agent_acc:d no_answer:i calls_per_log:d",
       f"""SELECT judge, method, with_gt, subset, count(*) AS n, avg(CAST(coalesce(pred_step = gold_step, FALSE) AS INTEGER)) AS step_acc,
         avg(CAST({loose('pred_agent', 'gold_agent')} AS INTEGER)) AS agent_acc, count(*) FILTER (pred_step IS NULL AND pred_agent IS NULL) AS no_answer,
         avg(n_calls) AS calls_per_log FROM gr GROUP BY 1, 2, 3, 4""", GRID)
def _(spark, sf):
    return P.method_grid(_grid(spark, sf))


@query("search_directions", "judge:s with_gt:b n:i lower_share:d upper_share:d unreadable:i converged_to_0:i",
       """SELECT judge, with_gt, count(*) AS n, sum(l) / sum(t) AS lower_share, sum(u) / sum(t) AS upper_share, sum(t - l - u) AS unreadable,
         count(*) FILTER (pred_step = 0) AS converged_to_0 FROM (SELECT *, len(string_split(raw, '>')) AS t,
           len(list_filter(string_split(raw, '>'), lambda x: x = 'lower')) AS l, len(list_filter(string_split(raw, '>'), lambda x: x = 'upper')) AS u
         FROM gr WHERE method = 'binary_search' AND raw <> '') GROUP BY 1, 2""", GRID)
def _(spark, sf):
    return P.search_directions(_grid(spark, sf))


@query("varied_axes", "axis:s n_values:i",
       """SELECT * FROM (SELECT unnest(['subset', 'readout', 'with_gt', 'lookahead']) AS axis, unnest([count(DISTINCT subset), 1,
         count(DISTINCT event_id % 2), 1]) AS n_values FROM ev) WHERE n_values > 1""", EVENTS)
def _(spark, sf):
    s = T.event_steps(spark, sf)
    return P.varied_axes(s.select("subset", F.lit("ptrue").alias("readout"), (F.col("event_id") % 2 == 0).alias("with_gt"),
                                  F.lit("none").alias("lookahead")))


@query("master_table", "field:s arm:s subset:s method:s n:i agent_acc:d step_acc:d status:s",
       f"""SELECT g.*, t.n, t.agent_acc, t.step_acc, CASE WHEN t.n IS NULL THEN 'not run' ELSE 'run' END AS status FROM (
         SELECT * FROM (SELECT unnest(['raw', 'missing']) AS field), (SELECT unnest(['off', 'on']) AS arm), (SELECT unnest(['alg', 'hc']) AS subset),
           (SELECT unnest(['changepoint_single', 'argmin']) AS method)) g
       LEFT JOIN (SELECT 'raw' AS field, 'off' AS arm, * FROM ({table_sql()}) WHERE scorer = 'exact' AND slice = 'all') t
         USING (field, arm, subset, method)""", EV_PREDS)
def _(spark, sf):
    _, lab, p = _events(spark, sf)
    t = M.score_table(p, lab).withColumn("arm", F.lit("off"))
    return P.master_table({"raw": t}, ["raw", "missing"], ["off", "on"], ["alg", "hc"], METHODS)


@query("smoke_sample", "subset:s file_id:s reason:s",
       f"""SELECT {KEY}, reason FROM (
         SELECT {KEY}, 'hc_long' AS reason, 0 AS pri FROM c1 UNION ALL SELECT {KEY}, 'alg_early_error', 1 FROM c2
         UNION ALL SELECT {KEY}, 'hc_orchestrator_fault', 2 FROM c3
         UNION ALL SELECT b.subset, b.file_id, 'balance', 10 FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY d, file_id) AS r FROM c4) b
           WHERE r <= 10 - (SELECT count(*) FROM ch WHERE ch.subset = b.subset))""",
       VIEW_LEAD + f""",
sm AS (SELECT *, {h("concat_ws('|', '0', subset, file_id)")} AS d FROM lab),
c1 AS (SELECT * FROM sm WHERE subset = 'hc' AND n_steps > 80 ORDER BY d, file_id LIMIT 1),
c2 AS (SELECT * FROM sm WHERE subset = 'alg' AND mistake_step <= 1 ORDER BY d, file_id LIMIT 1),
c3 AS (SELECT * FROM sm WHERE subset = 'hc' AND {collapse('mistake_agent')} = 'orchestrator' AND file_id NOT IN (SELECT file_id FROM c1)
  ORDER BY d, file_id LIMIT 1),
ch AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
c4 AS (SELECT * FROM sm WHERE (subset, file_id) NOT IN (SELECT (subset, file_id) FROM ch))""")
def _(spark, sf):
    _, lab, _ = _lead_events(spark, sf)
    return P.smoke_sample(lab, 20)


@query("curve_points", "subset:s file_id:s n_steps:i mistake_step:i gold_p:d p_min:d p_max:d rank:i",
       """SELECT e.subset, e.file_id, l.n_steps, l.mistake_step, any_value(g.p_raw) AS gold_p, min(e.p_raw) AS p_min, max(e.p_raw) AS p_max,
         CASE WHEN any_value(g.p_raw) IS NOT NULL THEN count(*) FILTER (e.p_raw < g.p_raw) + 1 END AS rank
       FROM ev e JOIN lab l USING (subset, file_id) LEFT JOIN ev g ON g.subset = e.subset AND g.file_id = e.file_id AND g.step_idx = l.mistake_step
       GROUP BY 1, 2, 3, 4""", EV_LAB)
def _(spark, sf):
    return P.curve_points(*T.events(spark, sf))


HEALTH = EVENTS + """,
hl AS (SELECT *, CASE WHEN event_id % 40 = 0 THEN NULL ELSE t / (t + f) END AS p_true, CASE WHEN event_id % 40 = 0 THEN 0.0 ELSE t + f END AS mass,
    CASE WHEN event_id % 40 = 0 THEN 'Maybe' ELSE 'True' END AS top_token
  FROM (SELECT *, exp(-0.5 - p_raw) + exp(-2.0) AS t, exp(-1.5) AS f FROM ev))"""


def _health(spark, sf):
    s = T.event_steps(spark, sf)

    def tok(t, lp):
        return F.struct(F.lit(t).alias("token"), lp.alias("logprob"))

    full = F.array(tok("True", F.lit(-0.5) - F.col("p_raw")), tok(" true", F.lit(-2.0)), tok("False", F.lit(-1.5)), tok("Maybe", F.lit(-0.1)))
    none = F.array(tok("Maybe", F.lit(-0.1)))
    s = s.withColumn("top_k", F.when(F.col("event_id") % 40 == 0, none).otherwise(full))
    return s.withColumn("_p", p_true_from_logprobs("top_k")).select(*K, "step_idx", "_p.*")


@query("p_true_from_logprobs", "subset:s file_id:s step_idx:i p:d mass_on_answer:d miss:b top_token:s",
       f"SELECT {KEY}, step_idx, coalesce(p_true, 0.5) AS p, mass AS mass_on_answer, p_true IS NULL AS miss, top_token FROM hl", HEALTH)
def _(spark, sf):
    return _health(spark, sf)


@query("readout_health", "subset:s n:i n_missing:i mass_mean:d mass_min:d mass_median:d top_token:s top_count:i",
       """SELECT subset, count(*) AS n, count(*) FILTER (p_true IS NULL) AS n_missing, avg(mass) FILTER (p_true IS NOT NULL) AS mass_mean,
         min(mass) FILTER (p_true IS NOT NULL) AS mass_min, median(mass) FILTER (p_true IS NOT NULL) AS mass_median, mode(top_token) AS top_token,
         count(*) FILTER (top_token = 'True') AS top_count FROM hl GROUP BY 1""", HEALTH)
def _(spark, sf):
    return P.readout_health(_health(spark, sf))


@query("parse_rates", "readout:s subset:s n:i readable:d",
       "SELECT 'binary' AS readout, subset, count(*) AS n, avg(CAST(parse_ok AS INTEGER)) AS readable FROM ev GROUP BY 1, 2", EVENTS)
def _(spark, sf):
    return P.parse_rates(T.event_steps(spark, sf).withColumn("readout", F.lit("binary")))


@query("unparseable_rates", "method:s subset:s n_gold:i n_unparsed:i rate:d",
       """SELECT m AS method, subset, count(*) AS n_gold, count(*) FILTER (key % 5 = 0 OR m = 'never') AS n_unparsed,
         count(*) FILTER (key % 5 = 0 OR m = 'never') / count(*) AS rate FROM lab, (SELECT unnest(['argmin', 'never']) AS m) GROUP BY 1, 2""", EV_LAB)
def _(spark, sf):
    s, lab = T.events(spark, sf)
    p = R.attribute(s, ["argmin"]).join(lab.select(*K, "key"), K)
    gone = F.col("key") % 5 == 0
    p = p.withColumn("pred_step", F.when(~gone, F.col("pred_step"))).withColumn("pred_agent", F.when(~gone, F.col("pred_agent")))
    return P.unparseable_rates(p, lab, ["argmin", "never"])


@query("naive_table", "method:s subset:s scorer:s slice:s n:i agent_acc:d step_acc:d",
       f"""SELECT method, subset, scorer, slice, n, agent_acc, step_acc FROM ({table_sql()})
       UNION ALL SELECT 'uniform_random_step', subset, 'expectation', 'all', count(*), avg(a), avg(s) FROM (
         SELECT e.subset, e.file_id, avg(CAST({_SAME} AS INTEGER)) AS a, avg(CAST(step_idx = mistake_step AS INTEGER)) AS s
         FROM ev e JOIN lab l USING (subset, file_id) GROUP BY 1, 2) GROUP BY 2""",
       EV_LAB + f",\npr AS ({naive_sql('ev')}),\njd AS ({judged_sql('pr')})")
def _(spark, sf):
    return P.naive_table(*T.events(spark, sf))
