"""Registered queries: leave-one-out normalization."""

from pyspark.sql import functions as F

from ..operators import normalize as N
from ..schema import K
from ..sources.stores import fingerprint
from . import tables as T
from .base import EV_LAB, KEY, query

LABELLED = EV_LAB + f""",
lb AS (SELECT e.*, l.n_steps, l.mistake_step, e.step_idx < l.mistake_step AS correct
  FROM ev e JOIN lab l USING ({KEY}) WHERE e.step_idx <= l.mistake_step)"""

# brute force: every fold refitted over the rows of all other files
FOLDS = LABELLED + f""",
fo AS (SELECT h.subset, h.file_id, c.cell, avg(p_raw) AS mean, stddev_pop(p_raw) AS sd, count(*) AS n,
    any_value(h.nf) - 1 AS n_train_files
  FROM (SELECT *, count(*) OVER (PARTITION BY subset) AS nf FROM lab) h JOIN lb ON lb.subset = h.subset AND lb.file_id <> h.file_id
  CROSS JOIN (SELECT unnest(['', 'plan', 'delegate', 'execute', 'final', 'unknown']) AS cell) c
  WHERE c.cell = '' OR c.cell = lb.type_norm GROUP BY 1, 2, 3 HAVING c.cell = '' OR count(*) >= 50)"""


def normed(rows: str, where: str = "TRUE") -> str:
    return f"""SELECT s.*, (s.p_raw - coalesce(t.mean, g.mean)) / greatest(coalesce(t.sd, g.sd), 0.001) AS p_norm
  FROM {rows} s JOIN fo g ON g.subset = s.subset AND g.file_id = s.file_id AND g.cell = ''
  LEFT JOIN fo t ON t.subset = s.subset AND t.file_id = s.file_id AND t.cell = s.type_norm WHERE {where}"""


ZFOLD = FOLDS + f""",
zt AS (SELECT h.subset, h.file_id, lb.type_norm, lb.correct, t.cell AS typed,
    (lb.p_raw - coalesce(t.mean, g.mean)) / greatest(coalesce(t.sd, g.sd), 0.001) AS z
  FROM lab h JOIN lb ON lb.subset = h.subset AND lb.file_id <> h.file_id
  JOIN fo g ON g.subset = h.subset AND g.file_id = h.file_id AND g.cell = ''
  LEFT JOIN fo t ON t.subset = h.subset AND t.file_id = h.file_id AND t.cell = lb.type_norm),
zs AS (SELECT {KEY}, '' AS cell, correct, z FROM zt UNION ALL
  SELECT {KEY}, typed, correct, z FROM zt WHERE typed IS NOT NULL),
zc AS (SELECT {KEY}, cell, correct, CAST(round_even(z * 1000, 0) AS BIGINT) AS k,
    z < round_even(z * 1000, 0) / 1000 AS below FROM zs)"""


def cut_sql(keys: str, src: str, objective: str = "f1") -> str:
    v = ("2.0 * tp / (2 * tp + fp + (nb - tp))" if objective == "f1" else "tp / nb - fp / nk")
    return f"""SELECT {keys}, CASE WHEN max(nb) > 0 AND max(nk) > 0 THEN arg_max(k, row({v}, -k)) / 1000.0 ELSE 0.0 END AS threshold
    FROM (SELECT *, coalesce(sum(bad) OVER w, 0) + lo_bad AS tp, coalesce(sum(ok) OVER w, 0) + lo_ok AS fp,
        sum(bad) OVER a AS nb, sum(ok) OVER a AS nk
      FROM (SELECT {keys}, k, count(*) FILTER (correct) AS ok, count(*) FILTER (NOT correct) AS bad,
          count(*) FILTER (correct AND below) AS lo_ok, count(*) FILTER (NOT correct AND below) AS lo_bad
        FROM {src} GROUP BY {keys}, k)
      WINDOW w AS (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        a AS (PARTITION BY {keys})) GROUP BY {keys}"""


THRESHOLDS = ZFOLD + f",\nth AS ({cut_sql(KEY + ', cell', 'zc')})"


def _fit(spark, sf):
    s, lab = T.events(spark, sf)
    labelled = N.step_labels(s, lab)
    return s, lab, labelled, N.fit_loo_stats(labelled, lab)


for _policy, _cond, _correct in (("prefix", "e.step_idx <= l.mistake_step", "e.step_idx < l.mistake_step"),
                                 ("point", "TRUE", "e.step_idx <> l.mistake_step")):
    query(f"step_labels_{_policy}", "subset:s file_id:s step_idx:i correct:b",
          f"SELECT e.subset, e.file_id, e.step_idx, {_correct} AS correct FROM ev e JOIN lab l USING ({KEY}) WHERE {_cond}",
          EV_LAB)(lambda spark, sf, p=_policy: N.step_labels(*T.events(spark, sf), p))

query("fit_loo_stats", "subset:s file_id:s cell:s mean:d sd:d n:i n_train_files:i", "SELECT * FROM fo", FOLDS)(
    lambda spark, sf: _fit(spark, sf)[3])


@query("apply_folds", "subset:s file_id:s step_idx:i p_norm:d", normed("ev"), FOLDS)
def _(spark, sf):
    s, _, _, stats = _fit(spark, sf)
    return N.apply_folds(s, stats)


@query("apply_folds_pooled", "subset:s file_id:s step_idx:i p_norm:d",
       f"""SELECT s.subset, s.file_id, s.step_idx, (s.p_raw - g.mean) / greatest(g.sd, 0.001) AS p_norm
       FROM ev s JOIN fo g ON g.subset = s.subset AND g.file_id = s.file_id AND g.cell = ''""", FOLDS)
def _(spark, sf):
    s, _, _, stats = _fit(spark, sf)
    return N.apply_folds(s, stats, typed=False)


@query("scale_counts", "subset:s normalized:b n_steps:i n_files:i",
       "SELECT subset, subset = 'alg' AS normalized, count(*) AS n_steps, count(DISTINCT file_id) AS n_files FROM ev GROUP BY 1, 2", FOLDS)
def _(spark, sf):
    """Folds of one subset withheld: which rows are left on the raw scale."""
    s, _, _, stats = _fit(spark, sf)
    return N.scale_counts(N.apply_folds(s, stats.filter("subset = 'alg'"), strict=False))


for _obj in ("f1", "youden"):
    query(f"choose_threshold_{_obj}", "subset:s type_norm:s threshold:d",
          cut_sql("subset, type_norm", """(SELECT subset, type_norm, correct,
            CAST(round_even(p_raw * 1000, 0) AS BIGINT) AS k, p_raw < round_even(p_raw * 1000, 0) / 1000 AS below FROM lb)""",
                  _obj), LABELLED)(
        lambda spark, sf, o=_obj: N.choose_threshold(
            N.step_labels(*T.events(spark, sf)), ["subset", "type_norm"], "p_raw", objective=o))


@query("fit_loo_thresholds", "subset:s file_id:s cell:s threshold:d", "SELECT * FROM th", THRESHOLDS)
def _(spark, sf):
    _, _, labelled, stats = _fit(spark, sf)
    return N.fit_loo_thresholds(labelled, stats)


@query("fit_loo_thresholds_binned", "subset:s file_id:s cell:s threshold:d", "SELECT * FROM th",
       THRESHOLDS.replace("SELECT e.*, l.n_steps", "SELECT e.* EXCLUDE (p_raw), round_even(e.p_raw * 256, 0) / 256 AS p_raw, l.n_steps"))
def _(spark, sf):
    """Scores rounded to 256 levels: bounded histogram, same scan."""
    s, lab = T.events(spark, sf)
    s = s.withColumn("p_raw", F.rint(F.col("p_raw") * 256) / 256)
    labelled = N.step_labels(s, lab)
    return N.fit_loo_thresholds(labelled, N.fit_loo_stats(labelled, lab), bins=256)


@query("thresholds_for", "subset:s file_id:s n_cells:i overall:d plan:d",
       f"""SELECT {KEY}, count(*) AS n_cells, max(threshold) FILTER (cell = '') AS overall,
         max(threshold) FILTER (cell = 'plan') AS plan FROM th GROUP BY {KEY}""", THRESHOLDS)
def _(spark, sf):
    _, _, labelled, stats = _fit(spark, sf)
    t = N.thresholds_for(N.fit_loo_thresholds(labelled, stats))
    m = F.col("thresholds")
    return t.select(*K, F.size(m).alias("n_cells"), F.try_element_at(m, F.lit("")).alias("overall"),
                    F.try_element_at(m, F.lit("plan")).alias("plan"))


def _cv(c: str) -> str:
    return (f"CASE WHEN count({c}) < 2 THEN 0.0 WHEN avg(abs({c})) < 0.001 THEN CASE WHEN stddev_pop({c}) < 0.001 "
            f"THEN 0.0 ELSE 'inf'::DOUBLE END ELSE stddev_pop({c}) / avg(abs({c})) END")


STABILITY = f"""SELECT s.subset, s.cell, n_folds, mean_cv, sd_cv, threshold_mean, threshold_sd, threshold_min, threshold_max,
    CASE WHEN s.cell = '' OR nt > 1 THEN tcv END AS threshold_cv FROM
   (SELECT subset, cell, count(*) AS n_folds, {_cv('mean')} AS mean_cv, {_cv('sd')} AS sd_cv FROM fo GROUP BY 1, 2) s
   LEFT JOIN (SELECT subset, cell, count(*) AS nt, avg(threshold) AS threshold_mean, stddev_pop(threshold) AS threshold_sd,
     min(threshold) AS threshold_min, max(threshold) AS threshold_max, {_cv('threshold')} AS tcv FROM th GROUP BY 1, 2) t
   USING (subset, cell)"""


def _stability(spark, sf):
    _, _, labelled, stats = _fit(spark, sf)
    return N.fold_stability(stats, N.fit_loo_thresholds(labelled, stats))


query("fold_stability", "subset:s cell:s n_folds:i mean_cv:d sd_cv:d threshold_mean:d threshold_sd:d "
      "threshold_min:d threshold_max:d threshold_cv:d", STABILITY, THRESHOLDS)(_stability)

query("worst_threshold_cv", "cell:s cv:d",
      f"""SELECT arg_max(nm, row(threshold_cv, nm)) AS cell, max(threshold_cv) AS cv FROM
        (SELECT subset || '/' || CASE WHEN cell = '' THEN 'global' ELSE cell END AS nm, threshold_cv FROM ({STABILITY}))
      WHERE threshold_cv IS NOT NULL""", THRESHOLDS)(
    lambda spark, sf: N.worst_threshold_cv(_stability(spark, sf)))


def auroc_sql(keys: str, score: str, label: str, src: str) -> str:
    """Mid-rank form by pairwise counts over distinct scores."""
    return f"""SELECT {keys}, sum(pos) + sum(neg) AS n, sum(pos) AS n_pos,
      CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auroc
    FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {keys}, {score} AS s, count(*) FILTER ({label}) AS pos, count(*) FILTER (NOT ({label})) AS neg
        FROM {src} GROUP BY {keys}, {score})) GROUP BY {keys}"""


@query("field_sanity", "subset:s type_norm:s n:i mean:d sd:d min:d p05:d median:d p95:d max:d "
       "saturated_fraction:d n_distinct:i n_labelled:i auroc_vs_labels:d undersized:b degenerate:s",
       f"""SELECT b.*, a.n AS n_labelled, a.auroc AS auroc_vs_labels, b.n < 20 AS undersized,
         concat_ws(', ', CASE WHEN b.n >= 20 AND sd < 0.001 THEN 'constant' END,
           CASE WHEN b.n >= 20 AND n_distinct <= 2 THEN 'near-binary' END,
           CASE WHEN saturated_fraction >= 0.95 THEN 'saturated' END) AS degenerate
       FROM (SELECT subset, type_norm, count(*) AS n, avg(p_raw) AS mean, stddev_pop(p_raw) AS sd, min(p_raw) AS min,
           quantile_cont(p_raw, 0.05) AS p05, quantile_cont(p_raw, 0.5) AS median, quantile_cont(p_raw, 0.95) AS p95,
           max(p_raw) AS max, avg(CAST(p_raw <= 0.001 OR p_raw >= 0.999 AS INTEGER)) AS saturated_fraction,
           count(DISTINCT round_even(p_raw * 1000000, 0)) AS n_distinct FROM ev GROUP BY 1, 2) b
       LEFT JOIN ({auroc_sql('subset, type_norm', 'p_raw', 'correct', 'lb')}) a USING (subset, type_norm)""", LABELLED)
def _(spark, sf):
    return N.field_sanity(*T.events(spark, sf))


@query("folds_fingerprint", "n_hashes:i length:i same:b", "SELECT 1 AS n_hashes, 16 AS length, TRUE AS same")
def _(spark, sf):
    """The content hash does not depend on row order or partitioning."""
    _, _, _, stats = _fit(spark, sf)
    a = fingerprint(stats)
    b = fingerprint(stats.repartition(7, "mean"))
    both = a.unionByName(b)
    return both.agg(F.countDistinct("content_hash").alias("n_hashes"),
                    F.max(F.length("content_hash")).alias("length")).withColumn(
        "same", F.col("n_hashes") == 1)
