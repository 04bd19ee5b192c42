"""Registered queries: stored tables, written and read back."""

import uuid

from pyspark.sql import functions as F

from ..operators import normalize as N
from ..schema import K
from ..session import checkpoint_dir, cut_lineage
from ..sources import stores as ST, trajectories as TR
from . import tables as T
from .base import CV_LAB, EV_LAB, query
from .normalize import FOLDS, THRESHOLDS

STEP = "subset:s file_id:s step_idx:i "


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("records_store", STEP + "agent:s role_raw:s content:s type_norm:s type_source:s",
       "SELECT * FROM st", CV_LAB)
def _(spark, sf):
    """Nested trajectories, written by subset and read back."""
    steps, labels = T.conversations(spark, sf)
    path = _folder(spark, "records")
    ST.write_records(TR.assemble_trajectories(steps, labels), path)
    return ST.read_records(spark, path).select(*K, F.explode("steps").alias("s")).select(*K, "s.*")


@query("scores_store", STEP + "agent:s type_norm:s p_raw:d parse_ok:b", "SELECT * FROM ev", EV_LAB)
def _(spark, sf):
    """Step scores as JSON lines under the explicit schema."""
    path = _folder(spark, "scores")
    ST.write_scores(T.event_steps(spark, sf), path)
    return ST.read_scores(spark, path)


@query("configs_store", "with_gt:b lookahead:s n:i n_files:i mean:d most:d",
       """SELECT with_gt, lookahead, count(*) AS n, count(DISTINCT subset || '/' || file_id) AS n_files, avg(p_raw) AS mean, max(p_raw) AS most
       FROM (SELECT subset, file_id, FALSE AS with_gt, 'none' AS lookahead, p_raw FROM ev
         UNION ALL SELECT subset, file_id, TRUE, 'resp', p_raw / 2 FROM ev WHERE step_idx % 2 = 0) GROUP BY 1, 2""", EV_LAB)
def _(spark, sf):
    """Two score files of different configurations, told apart by their own columns."""
    s = T.event_steps(spark, sf)
    arms = [s.withColumns({"with_gt": F.lit(False), "lookahead": F.lit("none")}),
            s.filter("step_idx % 2 = 0").withColumns(
                {"with_gt": F.lit(True), "lookahead": F.lit("resp"), "p_raw": F.col("p_raw") / 2})]
    paths = [_folder(spark, "config") for _ in arms]
    for arm, path in zip(arms, paths):
        ST.write_scores(arm, path)
    return ST.read_configs(spark, paths).groupBy("with_gt", "lookahead").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(*K).alias("n_files"), F.avg("p_raw").alias("mean"),
        F.max("p_raw").alias("most"))


def _stored_folds(spark, sf):
    """An older snapshot of one subset lies beside the committed one."""
    s, lab = T.events(spark, sf)
    labelled = N.step_labels(s, lab)
    # both snapshots are written from the tables, not fitted again
    stats = cut_lineage(N.fit_loo_stats(labelled, lab))
    thresholds = cut_lineage(N.fit_loo_thresholds(labelled, stats))
    path = _folder(spark, "folds")
    ST.save_folds(stats.filter("subset = 'alg'"), thresholds.filter("subset = 'alg'"), path)
    ST.save_folds(stats, thresholds, path)
    return ST.load_folds(spark, path)


query("folds_store", "subset:s file_id:s cell:s mean:d sd:d n:i n_train_files:i", "SELECT * FROM fo", FOLDS)(
    lambda spark, sf: _stored_folds(spark, sf)[0])

query("thresholds_store", "subset:s file_id:s cell:s threshold:d", "SELECT * FROM th", THRESHOLDS)(
    lambda spark, sf: _stored_folds(spark, sf)[1])


_HASHED = """SELECT which, substr(sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))), 1, 16) AS content_hash
  FROM (SELECT which, count(*) AS n, sum(CAST('0x' || substr(hx, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(hx, 16, 15) AS BIGINT)) AS b
    FROM (SELECT which, sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS hx FROM src) GROUP BY which)"""


@query("content_fingerprint", "which:s content_hash:s refused:b",
       f"SELECT *, which = 'edited' AS refused FROM ({_HASHED})",
       """src AS (SELECT 'whole' AS which, conv_id, turn, role FROM conversations
         UNION ALL SELECT 'edited', conv_id, CASE WHEN conv_id % 50 = 0 THEN turn + 1 ELSE turn END, role FROM conversations)""")
def _(spark, sf):
    """The content hash of a table and of the same table with some rows edited; the edited
    one is refused where the first is the committed one."""
    turns = T.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    edited = turns.withColumn("turn", F.when(F.col("conv_id") % 50 == 0, F.col("turn") + 1).otherwise(F.col("turn")))
    path = _folder(spark, "turns")
    ST.save_snapshot(spark, path, turns=turns)
    committed = ST.load_snapshot(spark, path)["turns"]
    both = [ST.fingerprint(t).withColumn("which", F.lit(w))
            for w, t in (("whole", committed.repartition(7, "role")), ("edited", edited))]
    return both[0].unionByName(both[1]).join(
        ST.fingerprint(committed).withColumnRenamed("content_hash", "_want")).withColumn(
        "refused", F.col("content_hash") != F.col("_want"))
