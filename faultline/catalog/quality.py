"""Registered queries: sources, quality, typing."""

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import collapse_agent, is_orchestrator, level_scale, loose_agent_match, speaker
from ..functions.typing import parse_compound_role
from ..operators import quality as Q, typing as TY
from ..schema import K
from ..sources import stores, trajectories as TR
from . import tables as T
from .base import (
    CONVERSATIONS, CV_LAB, EV_LAB, EVENTS, KEY, TYPED, collapse, h, loose, query,
    quote, speaker as speaker_sql, strip,
)


def _records(spark, sf):
    """conversations as nested release-shaped rows, then back through the loader."""
    raw = T.W.conversation_history(spark, sf)
    return raw.groupBy(*K, "key").agg(F.array_sort(F.collect_list(F.struct(
        "step_idx", F.lit("").alias("name"), F.col("role_raw").alias("role"), "content")))
        .alias("history"))


@query("explode_steps", "subset:s file_id:s step_idx:i agent:s role_raw:s type_norm:s type_source:s",
       f"SELECT {KEY}, step_idx, agent, role_raw, type0 AS type_norm, source0 AS type_source FROM cv",
       CONVERSATIONS)
def _(spark, sf):
    return TR.explode_steps(_records(spark, sf))


@query("assemble_trajectories", "subset:s file_id:s n_steps:i first_agent:s last_type:s n_chars:i",
       f"""SELECT {KEY}, max(n_steps) AS n_steps, arg_min(agent, step_idx) AS first_agent,
         arg_max(type_norm, step_idx) AS last_type, sum(length(content)) AS n_chars
       FROM st GROUP BY {KEY}""", TYPED)
def _(spark, sf):
    s, lab = T.conversations(spark, sf)
    t = TR.assemble_trajectories(s, lab)
    return t.select(*K, F.size("steps").alias("n_steps"), F.col("steps")[0]["agent"].alias("first_agent"),
                    F.element_at("steps", -1)["type_norm"].alias("last_type"),
                    F.aggregate("steps", F.lit(0), lambda a, x: a + F.length(x["content"])).alias("n_chars"))


@query("trajectory_ids", "problem_id:s n:i",
       """SELECT coalesce(CAST(nullif(user_id, 0) AS VARCHAR), nullif(event_type, '')) AS problem_id,
         count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    """Id resolution by alias order and the duplicate-id check."""
    e = T.table(spark, sf, "events").select(
        F.col("user_id").alias("question_ID"), F.col("event_type").alias("id"))
    return TR.id_problems(TR.with_file_id(e)).select(F.col("file_id").alias("problem_id"), "n")


@query("coalesce_aliases", "doc_id:i picked:s",
       """SELECT doc_id, coalesce(CASE WHEN lang <> '' THEN lang END, CASE WHEN source <> '' THEN source END)
         AS picked FROM documents""")
def _(spark, sf):
    d = T.table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("question"), F.col("source").alias("query"))
    return d.select("doc_id", TR.pick(d, V.QUERY_KEYS).alias("picked"))


@query("content_as_text", "conv_id:i turn:i as_text:s",
       """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN 'a' || chr(10) || 'b' || chr(10) || role || chr(10) || CAST(turn AS VARCHAR)
         WHEN 2 THEN role ELSE '' END AS as_text FROM conversations""")
def _(spark, sf):
    """Text of string, nested list, object and null payloads."""
    c = T.table(spark, sf, "conversations")
    role, turn = F.col("role"), F.col("turn").cast("string")
    q = F.lit('"')
    json = (
        F.when(F.col("turn") % 4 == 0, F.concat(q, role, q))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit('[[["a", ["b"]], ["", []]], {"text": "'), role, F.lit('"}, "", '), turn, F.lit("]")))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit('{"x": 1, "content": "'), role, F.lit('"}')))
        .otherwise(F.lit("null")))
    return c.select("conv_id", "turn", TR.variant_as_text(F.parse_json(json)).alias("as_text"))


@query("content_as_text_deep", "conv_id:i turn:i as_text:s",
       """SELECT conv_id, turn, repeat('a]b"[c' || chr(10) || role || chr(10), CAST(conv_id % 23 + 1 AS INTEGER)) || 't' AS as_text
       FROM conversations""")
def _(spark, sf):
    """Lists nested up to 23 deep, with brackets and quotes inside their strings."""
    c = T.table(spark, sf, "conversations")
    depth = (F.col("conv_id") % 23 + 1).cast("int")
    opened = F.concat(F.lit('["a]b\\"[c", [], "'), F.col("role"), F.lit('", null, '))
    json = F.concat(F.repeat(opened, depth), F.lit('{"text": "t"}'), F.repeat(F.lit("]"), depth))
    return c.select("conv_id", "turn", TR.variant_as_text(F.parse_json(json)).alias("as_text"))


@query("enrich_levels", "subset:s file_id:s level:s level_scale:s",
       f"""SELECT l.{KEY.replace(', ', ', l.')}, coalesce(CAST(b.item_id % 3 + 1 AS VARCHAR), '') AS level,
         CASE WHEN b.item_id IS NULL THEN 'absent' ELSE 'numeric' END AS level_scale
       FROM lab l LEFT JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = l.file_id""", EV_LAB)
def _(spark, sf):
    _, lab = T.events(spark, sf)
    src = T.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("question_ID"),
        (F.col("item_id") % 3 + 1).cast("string").alias("level"))
    return TR.enrich_levels(lab, src)


@query("level_scale", "orderkey:i level:s level_scale:s",
       """SELECT o_orderkey AS orderkey, CASE o_orderkey % 3 WHEN 0 THEN substr(o_orderpriority, 1, 1)
         WHEN 1 THEN trim(substr(o_orderpriority, 3)) ELSE '' END AS level,
         CASE o_orderkey % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'verbal' ELSE 'absent' END AS level_scale
       FROM orders""")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    m = F.col("o_orderkey") % 3
    raw = F.when(m == 0, F.substring("o_orderpriority", 1, 1)).when(
        m == 1, F.substring("o_orderpriority", 3, 20))
    lv = level_scale(raw)
    return o.select(F.col("o_orderkey").alias("orderkey"), lv["level"].alias("level"),
                    lv["level_scale"].alias("level_scale"))


@query("keep_first_rows", "user_id:i event_type:s event_id:i value:d",
       """SELECT user_id, event_type, arg_min(event_id, row(ts, event_id)) AS event_id,
         arg_min(value, row(ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def _(spark, sf):
    """Repeated cells keep their first row (the grid reader's rule)."""
    e = T.table(spark, sf, "events").withColumn("_id", F.col("event_id"))
    return stores.keep_first(e, ["user_id", "event_type"], ["ts", "_id"])


@query("result_rows", "arm:s with_gt:b file:s step:i type:s agent:s p_raw:d is_mistake_step:i",
       """SELECT 'none' AS arm, FALSE AS with_gt, e.subset || '/' || e.file_id AS file, e.step_idx AS step,
         e.type_norm AS type, e.agent, e.p_raw, CAST(e.step_idx = l.mistake_step AS INTEGER) AS is_mistake_step
       FROM ev e JOIN lab l USING (subset, file_id)""", EV_LAB)
def _(spark, sf):
    from ..operators.reports import curve_rows

    return curve_rows(*T.events(spark, sf))


@query("anomaly_flags", "subset:s file_id:s flags:s",
       f"""SELECT {KEY}, concat_ws(',', CASE WHEN e THEN 'empty_step_content' END,
         CASE WHEN out_of_range THEN 'mistake_step_out_of_range' END) AS flags
       FROM lab JOIN (SELECT {KEY}, bool_or(tx = '') AS e FROM st GROUP BY {KEY}) USING ({KEY})""", CV_LAB)
def _(spark, sf):
    s = T.typed_conversations(spark, sf)
    return Q.anomaly_flags(s, T.W.labels_for(s)).withColumn("flags", F.array_join("flags", ","))


@query("agent_step_mismatch", "subset:s file_id:s mismatch:b",
       f"SELECT {KEY}, mismatch FROM lab", EV_LAB)
def _(spark, sf):
    _, lab = T.events(spark, sf)
    return lab.withColumn("mismatch", F.array_contains("flags", V.FLAG_MISMATCH))


@query("cast_mistake_step", "orderkey:i step:i",
       """SELECT o_orderkey AS orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 50 END AS step
       FROM orders""")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    m, k = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 50).cast("string")
    raw = F.when(m == 0, F.concat(F.lit(" "), k)).when(m == 1, k).when(
        m == 2, F.concat(k, F.lit(".5"))).otherwise(F.lit("n/a"))
    return o.select(F.col("o_orderkey").alias("orderkey"), Q.cast_mistake_step(raw).alias("step"))


@query("validate_records", "subset:s file_id:s rule:s detail:s",
       f"""SELECT {KEY}, 'unflagged_out_of_range' AS rule, '' AS detail FROM lab WHERE out_of_range
       UNION ALL SELECT {KEY}, 'unflagged_empty_content', '' FROM st WHERE tx = '' GROUP BY {KEY}
       UNION ALL SELECT {KEY}, 'bad_type_norm', 'step ' || step_idx FROM st WHERE step_idx = 3
       UNION ALL SELECT {KEY}, 'empty_mistake_agent', '' FROM lab WHERE mistake_agent = 'ghost'""", CV_LAB)
def _(spark, sf):
    s = T.typed_conversations(spark, sf)
    lab = T.W.labels_for(s).withColumn("flags", F.array().cast("array<string>")).withColumn(
        "mistake_agent", F.when(F.col("mistake_agent") != "ghost", F.col("mistake_agent")).otherwise(""))
    broken = s.withColumn("type_norm", F.when(F.col("step_idx") == 3, F.lit("tool"))
                          .otherwise(F.col("type_norm")))
    return Q.validate_records(broken, lab)


@query("anomaly_policy_drop", "subset:s file_id:s n_steps:i",
       f"""SELECT {KEY}, n_steps FROM lab WHERE NOT out_of_range AND ({KEY}) NOT IN
         (SELECT ({KEY}) FROM st WHERE tx = '')""", CV_LAB)
def _(spark, sf):
    _, lab = T.conversations(spark, sf)
    return Q.apply_anomaly_policy(lab, "drop")


@query("check_expectations", "subset:s what:s expected:d observed:d",
       """SELECT * FROM (SELECT w.subset, w.what, w.expected, coalesce(o.observed, 0) AS observed FROM
         (VALUES ('alg', 'files', 126.0), ('alg', 'flagged', 3.0), ('hc', 'files', 58.0),
           ('hc', 'flagged', 3.0), ('all', 'steps', 4092.0)) w(subset, what, expected)
         LEFT JOIN (SELECT subset, 'files' AS what, count(*) AS observed FROM lab GROUP BY 1
           UNION ALL SELECT subset, 'flagged', count(*) FILTER (mismatch) FROM lab GROUP BY 1
           UNION ALL SELECT 'all', 'steps', count(*) FROM ev) o USING (subset, what))
       WHERE observed <> expected""", EV_LAB)
def _(spark, sf):
    s, lab = T.events(spark, sf)
    return Q.check_expectations(lab, s, expected_steps=V.EXPECTED_TOTAL_STEPS)


@query("corpus_stats", "subset:s stat:s item:s value:i",
       f"""WITH_FLAGS
       SELECT subset, 'n_files' AS stat, '' AS item, count(*) AS value FROM lab GROUP BY 1
       UNION ALL SELECT subset, 'n_steps', '', count(*) FROM st GROUP BY 1
       UNION ALL SELECT subset, 'steps_max', '', max(n_steps) FROM lab GROUP BY 1
       UNION ALL SELECT subset, 'flags', 'mistake_step_out_of_range', count(*) FROM lab WHERE out_of_range GROUP BY 1
       UNION ALL SELECT subset, 'flags', 'agent_step_mismatch', count(*) FROM lab WHERE mismatch GROUP BY 1
       UNION ALL SELECT subset, 'flags', 'empty_step_content', count(DISTINCT file_id) FROM st WHERE tx = '' GROUP BY 1
       UNION ALL SELECT subset, 'type_norm', type_norm, count(*) FROM st GROUP BY 1, 3
       UNION ALL SELECT subset, 'type_source', type_source, count(*) FROM st GROUP BY 1, 3
       UNION ALL SELECT subset, 'n_agents', '', count(DISTINCT agent) FROM st GROUP BY 1
       UNION ALL SELECT subset, 'top_agents', agent, n FROM (SELECT subset, agent, count(*) AS n,
           row_number() OVER (PARTITION BY subset ORDER BY count(*) DESC, min(row(file_id, step_idx))) AS r
         FROM st GROUP BY 1, 2) WHERE r <= 10""".replace("WITH_FLAGS\n", ""), CV_LAB)
def _(spark, sf):
    return Q.corpus_stats(*T.conversations(spark, sf))


@query("load_counters", "subset:s event:s n:i",
       f"""SELECT subset, event, count(*) AS n FROM (
         SELECT subset, 'rule_' || rule AS event FROM st WHERE subset = 'alg'
         UNION ALL SELECT subset, 'missing_name_fallback_role' FROM st WHERE subset = 'alg'
         UNION ALL SELECT subset, 'delegate_parsed' FROM st WHERE type0 = 'delegate'
         UNION ALL SELECT subset, 'final_promoted' FROM st WHERE promoted
         UNION ALL SELECT subset, 'mistake_step_out_of_range' FROM lab WHERE out_of_range
         UNION ALL SELECT subset, 'agent_step_mismatch' FROM lab WHERE mismatch
         UNION ALL SELECT subset, 'empty_step_content' FROM st WHERE tx = '' GROUP BY subset, file_id)
       GROUP BY 1, 2""", CV_LAB)
def _(spark, sf):
    typed = TY.apply_type_rules(TR.explode_steps(_records(spark, sf)))
    _, lab = T.conversations(spark, sf)
    return Q.load_counters(typed, lab)


@query("slices", "subset:s file_id:s slice:s",
       f"""SELECT {KEY}, slice FROM (SELECT {KEY}, unnest(['all',
           CASE WHEN NOT mismatch THEN 'excl_flagged' END,
           CASE WHEN anya AND NOT a THEN 'excl_anomalous' END,
           CASE WHEN anyh AND NOT hd THEN 'excl_held_aside' END,
           CASE WHEN (anya OR anyh) AND NOT mismatch AND NOT a AND NOT hd THEN 'excl_all_excluded' END]) AS slice
         FROM (SELECT *, bool_or(a) OVER (PARTITION BY subset) AS anya,
             bool_or(hd) OVER (PARTITION BY subset) AS anyh
           FROM (SELECT *, out_of_range AS a, key % 11 = 0 AND subset = 'alg' AS hd FROM lab)))
       WHERE slice IS NOT NULL""", EV_LAB)
def _(spark, sf):
    _, lab = T.events(spark, sf)
    held = (F.col("key") % 11 == 0) & (F.col("subset") == "alg")
    return Q.slices(lab.withColumn("held_aside", held)).select(*K, F.explode("slices").alias("slice"))


# --- typing -----------------------------------------------------------------

_ROLES = [
    "Orchestrator (thought)", "Orchestrator (-> WebSurfer)", "Orchestrator (final answer)", "WebSurfer",
    "orchestrator", "Lead Planner (planning)", "Helper", "Helper (unsure)",
]
_ROLE_PARSES = {
    "Orchestrator (thought)": ("Orchestrator", "plan", None),
    "Orchestrator (-> WebSurfer)": ("Orchestrator", "delegate", "WebSurfer"),
    "Orchestrator (final answer)": ("Orchestrator", "final", None),
    "WebSurfer": ("WebSurfer", "execute", None), "orchestrator": ("orchestrator", "plan", None),
    "Lead Planner (planning)": ("Lead Planner", "plan", None), "Helper": ("Helper", "unknown", None),
    "Helper (unsure)": ("Helper", "unknown", None),
}


def _role_of(key):
    out = F.lit(_ROLES[-1])
    for i, r in enumerate(_ROLES[:-1]):
        out = F.when(key % 8 == i, F.lit(r)).otherwise(out)
    return out


_ROLE_SQL = "CASE event_id % 8 " + " ".join(
    f"WHEN {i} THEN {quote(r)}" for i, r in enumerate(_ROLES)) + " END"


@query("parse_compound_role", "event_id:i agent:s type_norm:s target:s",
       "SELECT event_id, " + ", ".join(
           f"CASE role {' '.join(f'WHEN {quote(r)} THEN {quote(p[j]) if p[j] else chr(78) + chr(85) + chr(76) + chr(76)}' for r, p in _ROLE_PARSES.items())} END AS {n}"
           for j, n in enumerate(("agent", "type_norm", "target"))) +
       f" FROM (SELECT event_id, {_ROLE_SQL} AS role FROM events)")
def _(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", _role_of(F.col("event_id")).alias("role"))
    return e.select("event_id", parse_compound_role("role").alias("r")).select("event_id", "r.*")


@query("collapse_agent", "event_id:i collapsed:s lead:b",
       f"SELECT event_id, {collapse('role')} AS collapsed, {collapse('role')} = 'orchestrator' AS lead "
       f"FROM (SELECT event_id, {_ROLE_SQL} AS role FROM events)")
def _(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", _role_of(F.col("event_id")).alias("role"))
    return e.select("event_id", collapse_agent("role").alias("collapsed"), is_orchestrator("role").alias("lead"))


@query("loose_agent_match", "event_id:i speaker:s hit:b",
       f"SELECT event_id, {speaker_sql('role')} AS speaker, {loose('event_type', 'role')} AS hit FROM "
       f"(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'surf' WHEN event_id % 3 = 1 THEN 'Orchestrator' "
       f"ELSE event_type END AS event_type, {_ROLE_SQL} AS role FROM events)")
def _(spark, sf):
    m = F.col("event_id") % 3
    gold = F.when(m == 0, F.lit("surf")).when(m == 1, F.lit("Orchestrator")).otherwise(F.col("event_type"))
    e = T.table(spark, sf, "events").select("event_id", gold.alias("gold"),
                                            _role_of(F.col("event_id")).alias("role"))
    return e.select("event_id", speaker("role").alias("speaker"), loose_agent_match("gold", "role").alias("hit"))


@query("classify_steps", "subset:s file_id:s step_idx:i rule:s rule_type:s",
       f"SELECT {KEY}, step_idx, rule, rule_type FROM ty", TYPED)
def _(spark, sf):
    return T.conversation_verdicts(spark, sf)


@query("typed_steps", "subset:s file_id:s step_idx:i type_norm:s type_source:s promoted:b",
       f"SELECT {KEY}, step_idx, type_norm, type_source, promoted FROM st", TYPED)
def _(spark, sf):
    return T.typed_conversations(spark, sf)


@query("plan_json", "subset:s file_id:s step_idx:i plan:b",
       f"""SELECT {KEY}, step_idx, CASE key % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE
         WHEN 3 THEN FALSE WHEN 4 THEN FALSE ELSE FALSE END AS plan FROM ev""", EVENTS)
def _(spark, sf):
    """Object with a key in any case, other object, broken text quoting a key, JSON
    array, closing before opening, no braces."""
    from ..functions.typing import is_plan_json

    e = T.event_steps(spark, sf)
    m = F.col("key") % 6
    text = (
        F.when(m == 0, F.lit('note {"Next_Speaker": "x"} end')).when(m == 1, F.lit('{"other": 1}'))
        .when(m == 2, F.lit('say {\\"analyst_task\\": broken}')).when(m == 3, F.lit('{"other": [1, 2]}'))
        .when(m == 4, F.lit("} then {")).otherwise(F.lit("plain")))
    return e.select(*K, "step_idx", is_plan_json(text).alias("plan"))


@query("answer_emission", "doc_id:i answers:b",
       f"""SELECT doc_id, tx <> '' AND (regexp_matches(tx, {quote('(?i)' + V.RE_ANSWER)}) OR
         regexp_matches(tx, {quote('(?i)' + V.RE_TERMINATE)}) OR
         regexp_matches(tx, {quote(V.RE_BARE_CHOICE)})) AS answers
       FROM (SELECT doc_id, {strip("CASE doc_id % 4 WHEN 0 THEN 'So the answer is ' || text WHEN 1 THEN text || ' TERMINATE' WHEN 2 THEN '(C).' ELSE text END")} AS tx FROM documents)""")
def _(spark, sf):
    from ..functions.typing import is_answer_emission

    m = F.col("doc_id") % 4
    text = F.when(m == 0, F.concat(F.lit("So the answer is "), "text")).when(
        m == 1, F.concat("text", F.lit(" TERMINATE"))).when(m == 2, F.lit("(C).")).otherwise(F.col("text"))
    return T.table(spark, sf, "documents").select("doc_id", is_answer_emission(text).alias("answers"))


@query("rule_coverage", "subset:s n:i coverage:d",
       """SELECT subset, count(*) AS n, avg(CAST(rule NOT IN ('fallback', 'empty_content') AS INTEGER)) AS coverage
       FROM ty GROUP BY 1""", TYPED)
def _(spark, sf):
    return TY.rule_coverage(T.conversation_verdicts(spark, sf))


_PARSED = "(SELECT * FROM ty WHERE source0 = 'parsed')"


@query("type_rule_gate", "subset:s n_steps:i agreement:d coverage:d passes_gate:b",
       """SELECT subset, n_steps, coalesce(agree / nullif(n_steps, 0), 0) AS agreement, coverage,
         coalesce(agree / nullif(n_steps, 0), 0) >= 0.9 AS passes_gate FROM (
         SELECT subset, count(*) FILTER (source0 = 'parsed') AS n_steps,
           count(*) FILTER (source0 = 'parsed' AND type0 = rule_type) AS agree,
           avg(CAST(rule NOT IN ('fallback', 'empty_content') AS INTEGER)) AS coverage
         FROM ty GROUP BY 1)""", TYPED)
def _(spark, sf):
    return TY.type_rule_gate(T.conversation_verdicts(spark, sf))


@query("type_confusion", "subset:s parsed:s plan:i delegate:i execute:i final:i unknown:i",
       f"""SELECT s.subset, t.parsed, {', '.join(f"count(*) FILTER (p.rule_type = '{x}') AS {x if x != 'final' else 'final'}" for x in V.TYPE_NORMS)}
       FROM (SELECT DISTINCT subset FROM {_PARSED}) s
       CROSS JOIN (SELECT unnest([{', '.join(quote(x) for x in V.TYPE_NORMS)}]) AS parsed) t
       LEFT JOIN {_PARSED} p ON p.subset = s.subset AND p.type0 = t.parsed GROUP BY 1, 2""", TYPED)
def _(spark, sf):
    return TY.confusion_matrix(T.conversation_verdicts(spark, sf))


@query("rule_accuracy", "subset:s rule:s n:i correct:i",
       f"""SELECT subset, rule, count(*) AS n, count(*) FILTER (type0 = rule_type) AS correct
       FROM {_PARSED} GROUP BY 1, 2""", TYPED)
def _(spark, sf):
    return TY.rule_accuracy(T.conversation_verdicts(spark, sf))


@query("audit_sample", "subset:s file_id:s step_idx:i rule_type:s rule:s parsed_type:s content:s",
       f"""SELECT {KEY}, step_idx, rule_type, rule, CASE WHEN source0 = 'parsed' THEN type0 END AS parsed_type,
         content
       FROM ty ORDER BY {h("concat_ws('|', '0', subset, file_id, step_idx)")}, {KEY}, step_idx LIMIT 100""", TYPED)
def _(spark, sf):
    return TY.audit_sample(T.conversation_verdicts(spark, sf), 100)


def _split_sql() -> str:
    return ("CASE WHEN CAST('0x' || substr(sha256('0|' || subset || '/' || file_id || '|' || step_idx), 1, 2) "
            "AS BIGINT) % 2 = 1 THEN 'delegate' ELSE 'plan' END")


@query("split_coordination", "subset:s file_id:s step_idx:i type_norm:s",
       f"""SELECT {KEY}, step_idx, CASE WHEN type_source = 'classified' AND type_norm IN ('plan', 'delegate')
         THEN {_split_sql()} ELSE type_norm END AS type_norm FROM st""", TYPED)
def _(spark, sf):
    s = T.typed_conversations(spark, sf)
    return TY.split_coordination(s, TY.hash_splitter(s))


@query("splitter_gate", "subset:s n:i agreement:d majority_baseline:d rules_agreement:d coarse_agreement:d "
       "passes_gate:b plan_plan:i plan_delegate:i delegate_plan:i delegate_delegate:i",
       f"""SELECT *, agreement >= 0.9 AND agreement > majority_baseline AS passes_gate FROM (
         SELECT subset, count(*) FILTER (c) AS n,
           coalesce(count(*) FILTER (c AND type0 = sp) / nullif(count(*) FILTER (c), 0), 0) AS agreement,
           coalesce(greatest(count(*) FILTER (type0 = 'plan'), count(*) FILTER (type0 = 'delegate'))
             / nullif(count(*) FILTER (c), 0), 0) AS majority_baseline,
           coalesce(count(*) FILTER (c AND type0 = rule_type) / nullif(count(*) FILTER (c), 0), 0) AS rules_agreement,
           avg(CAST((CASE WHEN c THEN 'k' ELSE type0 END) = (CASE WHEN rule_type IN ('plan', 'delegate')
             THEN 'k' ELSE rule_type END) AS INTEGER)) AS coarse_agreement,
           count(*) FILTER (type0 = 'plan' AND sp = 'plan') AS plan_plan,
           count(*) FILTER (type0 = 'plan' AND sp = 'delegate') AS plan_delegate,
           count(*) FILTER (type0 = 'delegate' AND sp = 'plan') AS delegate_plan,
           count(*) FILTER (type0 = 'delegate' AND sp = 'delegate') AS delegate_delegate
         FROM (SELECT *, type0 IN ('plan', 'delegate') AS c, {_split_sql()} AS sp FROM {_PARSED}) GROUP BY 1)""",
       TYPED)
def _(spark, sf):
    v = T.conversation_verdicts(spark, sf)
    return TY.splitter_gate(v, TY.hash_splitter(v))


@query("splitter_prompts", "subset:s file_id:s step_idx:i prompt:s",
       f"""SELECT {KEY}, step_idx, {' || '.join([
           quote(V.SPLITTER_PROMPT.split('{query}')[0]), quote(V.NOT_RECORDED),
           quote(V.SPLITTER_PROMPT.split('{query}')[1].split('{prev_agent}')[0]), "coalesce(pa, '—')",
           quote(', '), "coalesce(pt, '—')", quote('): '), "CASE WHEN pa IS NULL THEN '(none)' ELSE pc END",
           quote(V.SPLITTER_PROMPT.split('{prev}')[1].split('{agent}')[0]), 'agent',
           quote(V.SPLITTER_PROMPT.split('{agent}')[1].split('{content}')[0]), 'content',
           quote(V.SPLITTER_PROMPT.split('{content}')[1])])} AS prompt
       FROM (SELECT *, lag(agent) OVER w AS pa, lag(type_norm) OVER w AS pt, lag(content) OVER w AS pc FROM st
         WINDOW w AS (PARTITION BY {KEY} ORDER BY step_idx)) WHERE type_norm IN ('plan', 'delegate')""", TYPED)
def _(spark, sf):
    return TY.splitter_prompts(T.typed_conversations(spark, sf))


@query("split_answers", "doc_id:i split_type:s split_parsed:b",
       r"""SELECT doc_id, CASE WHEN m = '' THEN 'plan' ELSE lower(m) END AS split_type, m <> '' AS split_parsed
       FROM (SELECT doc_id, regexp_extract(CASE doc_id % 3 WHEN 0 THEN 'Delegate. ' || text
         WHEN 1 THEN text || ' PLAN' ELSE text END, '(?i)\b(PLAN|DELEGATE)\b', 1) AS m FROM documents)""")
def _(spark, sf):
    m = F.col("doc_id") % 3
    d = T.table(spark, sf, "documents").select("doc_id", F.when(m == 0, F.concat(F.lit("Delegate. "), "text"))
                                               .when(m == 1, F.concat("text", F.lit(" PLAN")))
                                               .otherwise(F.col("text")).alias("answer"))
    return TY.parse_split_answers(d)


