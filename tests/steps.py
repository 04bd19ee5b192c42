"""Rows and comparisons that several test modules share."""

import random

SCHEMA = ("subset string, file_id string, step_idx int, agent string, role_raw string, content string, "
          "type_norm string, type_source string, p_raw double, parse_ok boolean")


def make_steps(seed=0, sizes=(1, 2, 3, 4, 5, 7, 9, 12, 20, 33)):
    """Random trajectories as plain tuples in the order of SCHEMA."""
    rng = random.Random(seed)
    rows = []
    for f, n in enumerate(sizes):
        for i in range(n):
            agent = rng.choice(["Boss", "Web", "Code", "Check"])
            kind = rng.choice(["plan", "delegate", "execute", "execute", "final"])
            text = rng.choice(["ok", "  ", "Web, look at this please", "ask code now", "x" * rng.randint(1, 90)])
            rows.append(("alg" if f % 2 else "hc", f"f{f}", i, agent, agent, text, kind, "parsed",
                         rng.choice([0.1, 0.25, 0.5, rng.random(), rng.random()]), rng.random() > 0.1))
    rng.shuffle(rows)
    return rows


def as_set(df, digits=9):
    def norm(v):
        return round(v, digits) if isinstance(v, float) else (tuple(map(norm, v)) if isinstance(v, list) else v)

    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
