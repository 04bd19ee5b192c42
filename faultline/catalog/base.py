"""Query registry and the SQL building blocks of the reference statements.

Each query is registered with a column spec (``name:kind``, kind s, i, d or b)
that both sides are cast to, and, where plain SQL can say the same thing, the
statement that must give the same rows.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 10


def tidy(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        c = F.col(name)
        out.append({
            "s": lambda: c.cast("string"), "i": lambda: c.cast("bigint"),
            "b": lambda: c.cast("boolean"),
            "d": lambda: F.round(c.cast("double"), PLACES) + F.lit(0.0),
        }[kind]().alias(name))
    return df.select(*out)


def final(sql: str, spec: str, ctes: str = "") -> str:
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        out.append({
            "s": f"CAST({name} AS VARCHAR) AS {name}", "i": f"CAST({name} AS BIGINT) AS {name}",
            "b": f"CAST({name} AS BOOLEAN) AS {name}",
            "d": f"round(CAST({name} AS DOUBLE), {PLACES}) + 0.0 AS {name}",
        }[kind])
    head = f"WITH {ctes}\n" if ctes else ""
    return f"{head}SELECT {', '.join(out)} FROM (\n{sql}\n) AS result"


def query(name: str, spec: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(configure(spark), sf_dir), spec)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = final(sql, spec, ctes)
        return fn

    return register


# --- SQL expressions --------------------------------------------------------

def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def h(x: str) -> str:
    """First 8 hex digits of sha256 over 2^32."""
    return f"(CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT) / 4294967296.0)"


WS = quote(" \t\n\r\x0b\x0c")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    b = f"translate(regexp_replace(lower({strip(f'coalesce({x}, {quote(str())})')}), '\\s*\\(.*?\\)\\s*$', ''), '- ', '__')"
    return (f"(CASE WHEN contains({b}, 'orchestr') OR {b} IN {in_list(V.ORCHESTRATOR_NAMES)} "
            f"THEN 'orchestrator' ELSE {b} END)")


def speaker(x: str) -> str:
    return f"lower({strip(f'''regexp_replace(coalesce({x}, ''), '\\s*\\(.*?\\)\\s*', '', 'g')''')})"


def loose(gold: str, picked: str) -> str:
    g, p = f"lower({strip(f'''coalesce({gold}, '')''')})", speaker(picked)
    return f"({g} <> '' AND {p} <> '' AND (contains({p}, {g}) OR contains({g}, {p})))"


def matches(x: str, pattern: str, icase: bool = True) -> str:
    return f"regexp_matches({x}, {quote(('(?i)' if icase else '') + pattern)})"


def case_map(x: str, mapping: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + " END"


# --- common tables ----------------------------------------------------------

SUBSET = "CASE WHEN {k} % 2 = 0 THEN 'alg' ELSE 'hc' END"

EVENTS = f"""ev AS (
  SELECT {SUBSET.format(k='user_id')} AS subset, CAST(user_id AS VARCHAR) AS file_id, user_id AS key,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step_idx,
    event_type AS agent,
    {case_map('event_type', {'view': 'plan', 'click': 'delegate', 'purchase': 'execute',
                             'error': 'execute', 'signup': 'final'})} AS type_norm,
    value / 491.0 AS p_raw, event_id % 50 <> 0 AS parse_ok, event_id
  FROM events)"""

LINES = f"""li AS (
  SELECT *, {h("concat_ws('|', file_id, step_idx, l_partkey)")} AS p_raw FROM (
    SELECT {SUBSET.format(k='l_orderkey')} AS subset, CAST(l_orderkey AS VARCHAR) AS file_id,
      l_orderkey AS key, l_partkey,
      CAST(row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS INTEGER) AS step_idx,
      l_returnflag AS agent,
      {case_map('l_returnflag', {'A': 'plan', 'N': 'execute', 'R': 'final'})} AS type_norm,
      l_discount * 10 AS p_tied
    FROM lineitem))"""

_M = "(conv_id + turn) % 8"
_CONTENT = f"""CASE WHEN conv_id % 29 = 0 AND turn = 1 THEN '   '
      WHEN {_M} = 1 THEN 'Final answer: ' || text
      WHEN {_M} = 2 THEN '{{"plan": 1}} ' || text
      WHEN {_M} = 3 THEN 'WebSurfer, find ' || text
      WHEN {_M} = 4 THEN 'please proceed ' || text
      WHEN {_M} = 5 THEN 'exitcode: 0 ' || text
      WHEN {_M} = 6 THEN 'Step 1: ' || text
      WHEN {_M} = 7 THEN 'B' ELSE text END"""

# roles in the driver table are user, system and assistant, so the compound roles
# are the three fixed ones and their parse can be stated directly
CONVERSATIONS = f"""cv AS (
  SELECT {SUBSET.format(k='conv_id')} AS subset, CAST(conv_id AS VARCHAR) AS file_id, conv_id AS key,
    CAST(turn AS INTEGER) AS step_idx, text,
    CASE WHEN conv_id % 2 = 0 THEN role ELSE {case_map('role', {
        'user': 'Orchestrator (thought)', 'system': 'Orchestrator (-> WebSurfer)',
        'assistant': 'WebSurfer'})} END AS role_raw,
    CASE WHEN conv_id % 2 = 0 THEN role ELSE {case_map('role', {
        'user': 'Orchestrator', 'system': 'Orchestrator', 'assistant': 'WebSurfer'})} END AS agent,
    CASE WHEN conv_id % 2 = 0 THEN 'unknown' ELSE {case_map('role', {
        'user': 'plan', 'system': 'delegate', 'assistant': 'execute'})} END AS type0,
    CASE WHEN conv_id % 2 = 0 THEN 'classified' ELSE 'parsed' END AS source0,
    {_CONTENT} AS content,
    count(*) OVER (PARTITION BY conv_id) AS n_steps
  FROM conversations)"""


def _classify() -> str:
    t = "tx"
    lead = f"{collapse('agent')} = 'orchestrator'"
    ans = (f"({matches(t, V.RE_ANSWER)} OR {matches(t, V.RE_TERMINATE)} OR "
           f"{matches(t, V.RE_BARE_CHOICE, False)})")
    blob = f"substr({t}, instr({t}, '{{'), length({t}) - instr(reverse({t}), '}}') + 2 - instr({t}, '{{'))"
    keys = "[" + ", ".join(quote(k) for k in V.PLAN_JSON_KEYS) + "]"
    quoted = " OR ".join(f"contains(replace({blob}, '\\\"', '\"'), {quote(chr(34) + k + chr(34))})"
                         for k in V.PLAN_JSON_KEYS)
    plan_json = (
        f"CASE WHEN instr({t}, '{{') = 0 OR instr({t}, '}}') = 0 OR "
        f"length({t}) - instr(reverse({t}), '}}') + 1 <= instr({t}, '{{') THEN FALSE "
        f"WHEN json_valid({blob}) THEN coalesce(list_has_any(list_transform(json_keys({blob}), "
        f"lambda k: lower(k)), {keys}), FALSE) ELSE ({quoted}) END")
    rules = [
        (f"{t} = ''", "empty_content"),
        (f"{ans} AND (is_last OR {matches(t, V.RE_TERMINATE)})", "answer_emission_last"),
        (plan_json, "plan_json"),
        (f"{lead} AND {matches(t, V.RE_ARROW, False)}", "orchestrator_arrow"),
        (matches(t, V.RE_HANDOFF), "handoff_language"),
        (f"{lead} AND {matches(t, V.RE_ADDRESSED, False)}", "addressed_agent"),
        (f"lower(role_raw) IN {in_list(V.TOOL_ROLES)} OR {matches(t, V.RE_TOOL_OUTPUT)}", "tool_output"),
        (matches(t, V.RE_PLAN), "plan_language"),
        (f"{lead} AND NOT is_last", "orchestrator_default"),
        (ans, "answer_emission"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {quote(r)}" for c, r in rules) + " ELSE 'fallback' END"


RULE_TYPES = {
    "empty_content": "unknown", "answer_emission_last": "final", "plan_json": "plan",
    "orchestrator_arrow": "delegate", "handoff_language": "delegate",
    "addressed_agent": "delegate", "tool_output": "execute", "plan_language": "plan",
    "orchestrator_default": "plan", "answer_emission": "final", "fallback": "execute"}

TYPED = CONVERSATIONS + f""",
cl AS (SELECT *, {_classify()} AS rule FROM (
  SELECT *, {strip('content')} AS tx, step_idx = n_steps - 1 AS is_last FROM cv)),
ty AS (SELECT *, {case_map('rule', RULE_TYPES)} AS rule_type,
    subset = 'hc' AND is_last AND tx <> '' AND ({matches('tx', V.RE_ANSWER)} OR
      {matches('tx', V.RE_TERMINATE)} OR {matches('tx', V.RE_BARE_CHOICE, False)}) AS promoted
  FROM cl),
st AS (SELECT *, CASE WHEN promoted THEN 'final' WHEN source0 = 'classified' THEN rule_type
      ELSE type0 END AS type_norm,
    CASE WHEN promoted THEN 'parsed' ELSE source0 END AS type_source FROM ty)"""


def labels_sql(steps: str, name: str = "lab") -> str:
    return f"""{name}0 AS (
  SELECT z.subset, z.file_id, z.key, z.n_steps, z.mistake_step,
    CASE WHEN z.key % 17 = 0 THEN 'ghost' ELSE s.agent END AS mistake_agent
  FROM (SELECT subset, file_id, key, CAST(count(*) AS INTEGER) AS n_steps,
      CAST(CASE WHEN key % 23 = 0 THEN count(*) + 5 ELSE key % count(*) END AS INTEGER) AS mistake_step,
      CAST(CASE WHEN key % 23 = 0 THEN 0 ELSE key % count(*) END AS INTEGER) AS at
    FROM {steps} GROUP BY subset, file_id, key) z
  JOIN {steps} s ON s.subset = z.subset AND s.file_id = z.file_id AND s.step_idx = z.at),
{name} AS (
  SELECT l.*, l.mistake_step < 0 OR l.mistake_step >= l.n_steps AS out_of_range,
    s.agent IS NOT NULL AND {collapse('l.mistake_agent')} <> {collapse('s.agent')} AS mismatch
  FROM {name}0 l LEFT JOIN {steps} s ON s.subset = l.subset AND s.file_id = l.file_id
    AND s.step_idx = l.mistake_step)"""


EV_LAB = EVENTS + ",\n" + labels_sql("ev")
CV_LAB = TYPED + ",\n" + labels_sql("st")
LI_LAB = LINES + ",\n" + labels_sql("li")
KEY = "subset, file_id"
