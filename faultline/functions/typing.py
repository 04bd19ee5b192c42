"""Step-typing column functions: role parsing and the ordered type rules."""

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import _col, icase, is_orchestrator, strip


def parse_compound_role(role) -> Column:
    """``Head (qualifier)`` -> struct(agent, type_norm, target).

    A handoff ``(-> X)`` keeps the head as the acting agent.
    """
    raw = F.coalesce(_col(role), F.lit(""))
    head = strip(F.regexp_extract(raw, V.RE_COMPOUND, 1))
    qualifier = strip(F.regexp_extract(raw, V.RE_COMPOUND, 2))
    target = strip(F.regexp_extract(qualifier, V.RE_ROLE_ARROW, 1))
    type_map = F.create_map(*[F.lit(x) for pair in V.QUALIFIER_TYPES.items() for x in pair])
    mapped = F.try_element_at(type_map, F.lower(qualifier))
    low = F.lower(head)
    matched = raw.rlike(V.RE_COMPOUND)

    def out(agent, kind, to=None):
        return F.struct(
            agent.alias("agent"),
            F.lit(kind).alias("type_norm") if isinstance(kind, str) else kind.alias("type_norm"),
            (F.lit(None).cast("string") if to is None else to).alias("target"),
        )

    orchestrator = F.when(head == "", F.lit("Orchestrator")).otherwise(head)
    unknown = F.when(head == "", F.lit("unknown")).otherwise(head)
    bare = F.when(strip(raw) == "", F.lit("unknown")).otherwise(strip(raw))
    return (
        F.when(~matched, out(bare, "unknown"))
        .when(target != "", out(orchestrator, "delegate", target))
        .when((qualifier != "") & mapped.isNotNull(), out(orchestrator, mapped))
        .when(qualifier != "", out(unknown, "unknown"))
        .when(low.isin(V.WORKERS), out(head, "execute"))
        .when(low.startswith("orchestr"), out(head, "plan"))
        .otherwise(out(unknown, "unknown"))
    )


def is_plan_json(content) -> Column:
    """An embedded JSON object that assigns work, or unparsable text quoting an
    assignment key."""
    text = strip(content)
    lo = F.locate("{", text)
    hi = F.length(text) - F.locate("}", F.reverse(text)) + F.lit(1)
    blob = F.substring(text, lo, hi - lo + F.lit(1))
    keys = F.array(*[F.lit(k) for k in V.PLAN_JSON_KEYS])
    by_key = F.arrays_overlap(F.transform(F.json_object_keys(blob), F.lower), keys)
    unescaped = F.replace(blob, F.lit('\\"'), F.lit('"'))
    quoted = F.lit(False)
    for k in V.PLAN_JSON_KEYS:
        quoted = quoted | unescaped.contains(f'"{k}"')
    return (
        F.when((lo == 0) | (F.locate("}", text) == 0) | (hi <= lo), F.lit(False))
        .when(F.try_parse_json(blob).isNotNull(), F.coalesce(by_key, F.lit(False)))
        .otherwise(quoted)
    )


def _terminates(text) -> Column:
    return text.rlike(icase(V.RE_TERMINATE))


def is_answer_emission(content) -> Column:
    text = strip(F.coalesce(_col(content), F.lit("")))
    return (text != "") & (
        text.rlike(icase(V.RE_ANSWER)) | _terminates(text) | text.rlike(V.RE_BARE_CHOICE)
    )


def is_near_empty(content) -> Column:
    return F.length(strip(F.coalesce(_col(content), F.lit("")))) < V.NEAR_EMPTY_CHARS


def is_coordination(type_norm) -> Column:
    return _col(type_norm).isin(V.COORDINATION)


def coarse_type(type_norm) -> Column:
    return F.when(is_coordination(type_norm), F.lit("coordination")).otherwise(_col(type_norm))


def classify_step(content, agent, is_last, role_raw) -> Column:
    """Ordered rules -> struct(type_norm, rule); the first that holds decides."""
    text = strip(F.coalesce(_col(content), F.lit("")))
    lead = is_orchestrator(agent)
    answers = is_answer_emission(text)
    tool_role = F.lower(strip(F.coalesce(_col(role_raw), F.lit("")))).isin(V.TOOL_ROLES)
    last = _col(is_last)

    def verdict(kind, rule):
        return F.struct(F.lit(kind).alias("type_norm"), F.lit(rule).alias("rule"))

    return (
        F.when(text == "", verdict("unknown", "empty_content"))
        .when(answers & (last | _terminates(text)), verdict("final", "answer_emission_last"))
        .when(is_plan_json(text), verdict("plan", "plan_json"))
        .when(lead & text.rlike("(?U)" + V.RE_ARROW), verdict("delegate", "orchestrator_arrow"))
        .when(text.rlike(icase(V.RE_HANDOFF)), verdict("delegate", "handoff_language"))
        .when(lead & text.rlike("(?U)" + V.RE_ADDRESSED), verdict("delegate", "addressed_agent"))
        .when(tool_role | text.rlike(icase(V.RE_TOOL_OUTPUT)), verdict("execute", "tool_output"))
        .when(text.rlike(icase(V.RE_PLAN)), verdict("plan", "plan_language"))
        .when(lead & ~last, verdict("plan", "orchestrator_default"))
        .when(answers, verdict("final", "answer_emission"))
        .otherwise(verdict("execute", "fallback"))
    )


def rule_covered(rule) -> Column:
    """A positive rule fired, rather than the residual."""
    return ~_col(rule).isin("fallback", "empty_content")
