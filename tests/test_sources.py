"""Loading, policies, stores, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.operators import quality as Q, normalize as N, scoring as S
from faultline.plans import flows
from faultline.schema import K, TRAJECTORY
from faultline.sources import stores, trajectories as TR
from faultline.streaming.incremental import read_stream_scores, score_stream, steps_of


# name: (label step, label agent, transcript); one line per turn, "speaker :: text"
NAMED_RUNS = {
    "bridge": ("2", "Analyst", """Lead :: Plan: collect the spans, rank them, report.
        Finder :: Three tables list spans in metres and feet.
        Analyst :: Read feet as metres, so the second one wins.
        Scribe :: Draft written from the ranking.
        Lead :: The answer is the second bridge."""),
    "gap": ("0", "Lead", "Lead :: Plan: ask once.\nFinder ::    \nScribe :: The answer is unknown."),
    "stranger": ("1", "Nobody", "Lead :: Plan: look it up.\nFinder :: Opened the atlas at page nine."),
    "clean": ("3", "Scribe", "Lead :: Plan: two checks.\nFinder :: First check holds.\nFinder :: Second check holds.\nScribe :: The answer is no."),
}
ROLE_RUNS = {
    "ferry": ("3", "FileSurfer", """Orchestrator (thought) :: The timetable is in the attachment.
        Orchestrator (-> FileSurfer) :: FileSurfer, open the timetable.
        FileSurfer :: Opened page 2 of 7.
        FileSurfer :: Took the winter column.
        Orchestrator (thought) :: That settles it.
        Orchestrator (final answer) :: The answer is 18:40."""),
    "beyond": ("41", "Coder", "Orchestrator (-> Coder) :: Coder, add the rows.\nCoder :: exitcode: 0, total 12"),
    "short": ("0", "Orchestrator", "Orchestrator (final answer) :: The answer is 3."),
}


def release_object(subset, name):
    """One run as the released files spell it: speakers are names or compound roles."""
    step, agent, script = (NAMED_RUNS if subset == "alg" else ROLE_RUNS)[name]
    turns = [line.lstrip().partition(" :: ")[::2] for line in script.split("\n")]
    speaker = (lambda who: {"role": "assistant", "name": who}) if subset == "alg" else (lambda who: {"role": who})
    truth = "ground_truth" if subset == "alg" else "groundtruth"
    return {"question": f"question of {name}", truth: f"truth of {name}", "level": "2", "mistake_step": step, "mistake_agent": agent,
            "mistake_reason": "", "history": [{**speaker(who), "content": text} for who, text in turns]}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("traj")
    for subset, runs in (("alg", NAMED_RUNS), ("hc", ROLE_RUNS)):
        (root / subset).mkdir()
        for name in runs:
            (root / subset / f"{name}.json").write_text(json.dumps(release_object(subset, name)))
    (root / "alg" / ".hidden.json").write_text("[]")
    return root


def load(spark, folders, subset, policy="flag"):
    raw = TR.read_trajectories_json(spark, str(folders / subset))
    return TR.load_corpus(TR.records_from_json(raw, subset), policy)


def test_json_folder(spark, folders):
    steps, labels = load(spark, folders, "alg")
    flags = {r.file_id: r.flags for r in labels.collect()}
    assert flags == {"bridge": [], "gap": ["empty_step_content"], "clean": [], "stranger": ["agent_step_mismatch"]}
    row = labels.filter("file_id = 'bridge'").first()
    assert (row.mistake_step, row.ground_truth, row.level, row.level_scale) == (2, "truth of bridge", "2", "numeric")
    first = steps.filter("file_id = 'bridge'").orderBy("step_idx").collect()
    assert [r.agent for r in first] == ["Lead", "Finder", "Analyst", "Scribe", "Lead"]
    assert first[-1].type_norm == "final"


def test_compound_roles_are_parsed_not_guessed(spark, folders):
    steps, labels = load(spark, folders, "hc")
    rows = steps.filter("file_id = 'ferry'").orderBy("step_idx").collect()
    assert [(r.agent, r.type_norm) for r in rows] == [
        ("Orchestrator", "plan"), ("Orchestrator", "delegate"), ("FileSurfer", "execute"), ("FileSurfer", "execute"),
        ("Orchestrator", "plan"), ("Orchestrator", "final")]
    assert {r.type_source for r in rows} == {"parsed"}
    flags = {r.file_id: r.flags for r in labels.collect()}
    assert flags == {"beyond": ["mistake_step_out_of_range"], "ferry": [], "short": []}
    assert labels.filter("file_id = 'short'").first().ground_truth == "truth of short"


def test_policies(spark, folders):
    with pytest.raises(Q.QualityError):
        load(spark, folders, "hc", "fail")
    steps, labels = load(spark, folders, "hc", "drop")
    assert {r.file_id for r in labels.collect()} == {"ferry", "short"}
    assert steps.filter("file_id = 'beyond'").count() == 0
    with pytest.raises(Q.QualityError):
        load(spark, folders, "hc", "repair")


def test_parquet_shape_and_ids(spark, tmp_path):
    rows = [dict(release_object("alg", name), question_ID=name) for name in ("bridge", "clean", "stranger")]
    df = spark.createDataFrame(
        [(r["question_ID"], r["question"], r["ground_truth"], r["mistake_agent"], r["mistake_step"], r["mistake_reason"],
          [(h["role"], h["name"], h["content"]) for h in r["history"]]) for r in rows],
        "question_ID string, question string, ground_truth string, mistake_agent string, mistake_step string, "
        "mistake_reason string, history array<struct<role:string,name:string,content:string>>")
    df.write.parquet(str(tmp_path / "ok"))
    rec = TR.records_from_parquet(TR.read_trajectories_parquet(spark, str(tmp_path / "ok")), "alg")
    steps, labels = TR.load_corpus(rec, "flag")
    assert steps.count() == 11 and labels.count() == 3
    df.unionByName(df.limit(1)).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(TR.SourceError):
        TR.read_trajectories_parquet(spark, str(tmp_path / "twice"))
    nested = TR.assemble_trajectories(steps, labels)
    stores.write_records(nested, str(tmp_path / "records"))
    assert stores.read_records(spark, str(tmp_path / "records")).count() == 3


def test_unreadable_labels_fail_hard(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps(dict(release_object("alg", "clean"), mistake_step="soon")))
    raw = TR.read_trajectories_json(spark, str(tmp_path))
    with pytest.raises(TR.SourceError, match="uncastable"):
        TR.load_corpus(TR.records_from_json(raw, "alg"))


def test_empty_folder_and_non_object_root(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("[1, 2]")
    with pytest.raises(TR.SourceError, match="object"):
        TR.read_trajectories_json(spark, str(tmp_path / "a"))


def test_score_files(spark, steps, labels, tmp_path):
    rows = steps.select(*K, "step_idx", "agent", "type_norm", "p_raw", "parse_ok", F.lit("none").alias("lookahead"),
                        F.lit("x").alias("unknown_field"))
    stores.write_scores(rows, str(tmp_path / "s"))
    back = stores.read_scores(spark, str(tmp_path / "s"))
    assert back.count() == steps.count() and "unknown_field" not in back.columns
    stats = N.fit_loo_stats(N.step_labels(steps, labels), labels)
    assert stores.read_configs(spark, [str(tmp_path / "s")], stats).filter("p_norm is null").count() == 0
    stores.write_results(back.limit(3), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_grid_rows_keep_the_first(spark, tmp_path):
    row = {"judge": "j", "method": "m", "with_gt": False, "subset": "hc", "file_id": "f", "pred_step": 1}
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(dict(row, pred_step=s)) for s in (4, 5)))
    (tmp_path / "b.jsonl").write_text(json.dumps(dict(row, pred_step=6)) + "\n" + json.dumps(dict(row, file_id="g")))
    (tmp_path / "backup").mkdir()
    (tmp_path / "backup" / "c.jsonl").write_text(json.dumps(dict(row, file_id="h")))
    got = {r.file_id: r.pred_step for r in stores.read_grid_rows(spark, str(tmp_path), "/backup/").collect()}
    assert got == {"f": 4, "g": 1}
    assert {r.file_id for r in stores.read_grid_rows(spark, str(tmp_path)).collect()} == {"f", "g", "h"}


def test_folds_refuse_edits(spark, steps, labels, tmp_path):
    lab = N.step_labels(steps, labels)
    stats = N.fit_loo_stats(lab, labels)
    thr = N.fit_loo_thresholds(lab, stats)
    path = str(tmp_path / "folds")
    stores.save_folds(stats, thr, path)
    a, b = stores.load_folds(spark, path)
    assert a.count() == stats.count() and b.count() == thr.count()
    with pytest.raises(N.NormalizationError, match="no committed"):
        stores.load_folds(spark, str(tmp_path / "nothing"))
    # a commit that stopped before its manifest row is not seen; an older version stays
    thr.limit(1).write.parquet(path + "/unfinished/thresholds")
    stores.save_folds(stats, thr.limit(2), path)
    assert stores.load_folds(spark, path)[1].count() == 2
    assert stores.load_snapshot(spark, path, version=1)["thresholds"].count() == thr.count()
    stores.save_folds(stats, thr, path)
    last = max(stores._manifest(spark, path), key=lambda r: r["version"])
    b.withColumn("threshold", F.lit(99.0)).write.mode("overwrite").parquet(f"{path}/{last['folder']}/thresholds")
    with pytest.raises(N.NormalizationError, match="mismatch"):
        stores.load_folds(spark, path)


def test_strict_folds_and_single_file_subsets(spark, steps, labels):
    stats = N.fit_loo_stats(N.step_labels(steps, labels), labels).filter("file_id <> 'f9'")
    with pytest.raises(N.NormalizationError, match="no fold"):
        N.apply_folds(steps, stats)
    mixed = N.scale_counts(N.apply_folds(steps, stats, strict=False)).filter("not normalized").collect()
    assert [r.n_files for r in mixed] == [1]
    with pytest.raises(N.NormalizationError, match="at least 2"):
        N.require_folds(labels.filter("file_id = 'f1'"))
    with pytest.raises(N.NormalizationError, match="at least 2"):
        flows.primary_accuracy(steps.filter("file_id = 'f1'"), labels.filter("file_id = 'f1'"))


def test_prediction_text_file(spark, labels, tmp_path):
    text = ("intro\nPrediction for out/1.json:\nAgent Name: Web\nStep Number: 2\n\nPrediction for 2.json:\nnothing\n"
            "Prediction for out/1.json:\nAgent Name: Code\nStep Number: 3\n")
    (tmp_path / "r.txt").write_text(text)
    blocks = stores.read_prediction_blocks(spark, str(tmp_path / "r.txt"), "hc")
    ids = spark.createDataFrame([("1", "f0"), ("2", "f2")], "stem string, file_id string")
    got = {r.file_id: (r.pred_step, r.pred_agent) for r in
           stores.resolve_predictions(blocks, ids, labels.filter("subset = 'hc'"), "m").collect()}
    assert got["f0"] == (3, "Code") and got["f2"] == (None, None) and len(got) == 5


def test_delta_rejections(spark, steps):
    base = steps.select(*K, "step_idx", "agent", "type_norm", "p_raw", "parse_ok", F.lit(False).alias("with_gt"),
                        F.lit("none").alias("lookahead"), F.lit(0).alias("n_lookahead"))
    arm = base.withColumn("lookahead", F.lit("resp"))
    assert S.delta_field(base, arm).filter("abs(p_raw) > 0").count() == 0
    for broken in (arm.filter("step_idx > 0"), arm.withColumn("agent", F.lit("zz")), arm.withColumn("with_gt", F.lit(True)), base):
        with pytest.raises(S.ScoringError):
            S.delta_field(base, broken)


def test_stream_scores_only_what_is_new(spark, steps, labels, tmp_path):
    lab = labels.select(*K, "mistake_step", "mistake_agent")
    nested = TR.assemble_trajectories(steps, lab)
    for f in TRAJECTORY.fieldNames():
        if f not in nested.columns:
            nested = nested.withColumn(f, F.lit(None).cast(TRAJECTORY[f].dataType))
    nested = nested.select(*TRAJECTORY.fieldNames())
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))

    def score(s):
        return s.select(*K, "step_idx", F.lit(0.5).alias("p_raw"))

    nested.filter("file_id < 'f5'").write.parquet(src)
    score_stream(spark, src, out, chk, score)
    nested.filter("file_id >= 'f5'").write.mode("append").parquet(src)
    score_stream(spark, src, out, chk, score)
    all_steps = steps_of(spark.read.schema(TRAJECTORY).parquet(src))
    assert read_stream_scores(spark, out, all_steps).count() == steps.count()


def test_whole_run(spark, steps, labels):
    run = flows.attribution_run(steps, labels, n_boot=200)
    assert run["accuracy"].filter("agent_lo is not null").count() > 0
    assert {r.method for r in run["predictions"].select("method").distinct().collect()} >= {"changepoint_single", "first_crossing"}
    for name in ("positions", "fallback", "disagreement", "stability"):
        assert run[name].count() > 0
