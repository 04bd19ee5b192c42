"""Column expressions that read scores and predictions out of response text."""

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import _col, icase, strip

_ENDS = " .*():,"


def parse_readout(text, kind: str) -> Column:
    """Generated text -> struct(p, parse_ok). A closed think block is removed; an
    unclosed one, or anything unreadable, scores 0.5 and is flagged."""
    t = strip(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "(?is)" + V.RE_THINK, ""))
    open_block = F.lower(t).contains("<think>")

    def out(p, ok):
        return F.struct(p.cast("double").alias("p"), F.lit(ok).alias("parse_ok"))

    bad = out(F.lit(0.5), False)
    low = F.lower(t)
    if kind == "binary":
        return (
            F.when(open_block, bad)
            .when(low.startswith("true") | low.startswith("yes"), out(F.lit(1.0), True))
            .when(low.startswith("false") | low.startswith("no"), out(F.lit(0.0), True))
            .otherwise(bad)
        )
    number = F.regexp_extract(t, V.RE_NUMBER, 1)
    v = number.try_cast("double")
    v = F.when(v > 1.0, v / 100.0).otherwise(v)
    clamped = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.when(open_block | (number == ""), bad).otherwise(out(clamped, True))


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return _blank_to_null(F.regexp_extract(text, pattern, group))


def json_blob(text) -> Column:
    """The outermost braces of a text, or null."""
    text = _col(text)
    lo = F.locate("{", text)
    hi = F.length(text) - F.locate("}", F.reverse(text)) + F.lit(1)
    found = (lo > 0) & (F.locate("}", text) > 0) & (hi > lo)
    return F.when(found, F.substring(text, lo, hi - lo + F.lit(1)))


def parse_freeform_answer(text) -> Column:
    """Reply -> struct(agent, step): an embedded JSON object, else the first
    ``agent ...`` and ``step ...`` in the text."""
    t = F.coalesce(_col(text), F.lit(""))
    blob = json_blob(t)
    obj = F.try_parse_json(blob)
    is_object = F.schema_of_variant(obj).startswith("OBJECT")

    def field(name, kind="string"):
        return F.try_variant_get(obj, f"$.{name}", kind)

    def truthy(name):
        # null, "", 0 and false count as absent
        v = field(name)
        return F.when(~v.isin("", "0", "false"), v)

    j_agent = F.coalesce(truthy("agent"), truthy("mistake_agent"))
    keys = F.json_object_keys(blob)
    raw = F.when(F.array_contains(keys, "step"), field("step")).otherwise(field("mistake_step"))
    raw = F.when(raw.isin("true", "false"), F.when(raw == "true", F.lit("1")).otherwise(F.lit("0"))
                 ).otherwise(raw)
    # text must be an integer; a JSON number is truncated
    quoted = F.schema_of_variant(F.try_variant_get(obj, F.lit("$.step"), "variant")) == "STRING"
    j_step = F.when(strip(raw).rlike(r"^[+-]?\d+$"), strip(raw).try_cast("int")).when(
        ~F.coalesce(quoted, F.lit(False)), F.floor(raw.try_cast("double")).cast("int"))
    t_agent = strip(_extract(t, icase(V.RE_FREE_AGENT)))
    t_step = _extract(t, icase(V.RE_FREE_STEP)).try_cast("int")
    parsed = F.coalesce(is_object, F.lit(False))
    return F.struct(
        F.when(parsed, j_agent).otherwise(t_agent).alias("agent"),
        F.when(parsed, j_step).otherwise(t_step).alias("step"))


def parse_labelled_answer(text) -> Column:
    """Reply -> struct(agent, step) from labelled or numbered lines, tolerating
    markdown emphasis."""
    t = F.coalesce(_col(text), F.lit(""))
    agent = F.coalesce(
        _extract(t, "(?iU)" + V.RE_LABEL_AGENT), _extract(t, "(?mU)" + V.RE_NUMBERED_AGENT))
    step = F.coalesce(
        _extract(t, "(?iU)" + V.RE_LABEL_STEP), _extract(t, "(?mU)" + V.RE_NUMBERED_STEP),
        _extract(t, "(?iU)" + V.RE_PROSE_STEP)).try_cast("int")
    tidy = F.btrim(F.btrim(strip(agent), F.lit("*")), F.lit(_ENDS))
    bold = _extract(t, V.RE_BOLD)
    short = F.btrim(F.coalesce(bold, F.element_at(F.split(tidy, r"\s+"), 1)), F.lit(_ENDS))
    return F.struct(
        _blank_to_null(F.when(F.length(tidy) > 60, short).otherwise(tidy)).alias("agent"),
        step.alias("step"))


def starts_with_word(text, word: str) -> Column:
    return F.lower(strip(F.coalesce(_col(text), F.lit("")))).startswith(word)
