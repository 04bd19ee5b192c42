"""Text, agent-name and rounding column functions."""

from pyspark.sql import Column, functions as F

from ..fixed_values import ORCHESTRATOR_NAMES

# The characters Python's str.strip() removes, for trim(BOTH chars FROM text).
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def icase(pattern: str) -> str:
    """Case-insensitive with Unicode word and space classes."""
    return "(?iU)" + pattern


def collapse_agent(c) -> Column:
    """Comparable agent name; every spelling of the orchestrator becomes one."""
    low = F.lower(strip(F.coalesce(_col(c), F.lit(""))))
    base = F.when(low.endswith(")"), F.regexp_replace(low, r"\s*\(.*?\)\s*$", "")).otherwise(low)
    name = F.translate(base, "- ", "__")
    return F.when(
        name.contains("orchestr") | name.isin(ORCHESTRATOR_NAMES), F.lit("orchestrator")
    ).otherwise(name)


def is_orchestrator(c) -> Column:
    return collapse_agent(c) == "orchestrator"


def fault_role(c) -> Column:
    return F.when(is_orchestrator(c), F.lit("orchestrator")).otherwise(F.lit("worker"))


def speaker(c) -> Column:
    """Who speaks, with every parenthesis removed."""
    return F.lower(strip(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s*\(.*?\)\s*", "")))


def loose_agent_match(gold, picked) -> Column:
    g = F.lower(strip(F.coalesce(_col(gold), F.lit(""))))
    p = speaker(picked)
    return (g != "") & (p != "") & (p.contains(g) | g.contains(p))


def hash_fraction(c) -> Column:
    """First 8 hex digits of sha256 as a fraction of 2^32: a seeded, engine
    independent stand-in score."""
    return F.conv(F.substring(F.sha2(_col(c), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rounded(c, places: int = 6) -> Column:
    return F.round(_col(c), places) + F.lit(0.0)


def half_even(c, scale: int = 1) -> Column:
    """Half-to-even rounding to 1/scale."""
    return F.rint(_col(c) * F.lit(float(scale))) / F.lit(float(scale))


def length_bin(n) -> Column:
    from ..fixed_values import LENGTH_BINS

    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(LENGTH_BINS):
        inside = _col(n) >= lo if hi is None else (_col(n) >= lo) & (_col(n) < hi)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def level_scale(c) -> Column:
    """(level, scale) with numeric and verbal difficulty kept apart."""
    raw = _col(c).cast("string")
    text = strip(raw)
    absent = raw.isNull() | (raw == "")
    return F.struct(
        F.when(absent, F.lit("")).otherwise(text).alias("level"),
        F.when(absent, F.lit("absent"))
        .when(text.rlike(r"^\d+$"), F.lit("numeric"))
        .otherwise(F.lit("verbal"))
        .alias("level_scale"),
    )


def normalized_position(step, n_steps) -> Column:
    return F.when(_col(n_steps) > 1, _col(step) / (_col(n_steps) - F.lit(1)))
