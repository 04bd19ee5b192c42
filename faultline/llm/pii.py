"""Personal data: generous generators, boosted trees, calibrated thresholds.

1. Generators propose overlapping spans of four kinds. The strict ones (``base_spans``)
   are formats that need no model; the loose ones also take written-out addresses, numbers
   without a plus sign, other separators and bracketed dots.
2. Boosted trees score loose candidates on their format and context. They learn from every
   strict span of every document: strict spans rewritten in loose form are the positives;
   strings of the same alphabet with another meaning (failed check digits, versions, dates,
   serial numbers), set in the same places, are the negatives. Loose candidates found as they
   are have no label and are not learned from. The examples stay in their tasks; a job for
   each level of a tree sums their gradients. A caller who gives ``sample_docs`` or
   ``sample_windows`` learns from a bounded sample for each kind instead (the documents with
   the smallest hash among those that hold a strict span of it; a quarter of each bound).
3. A threshold for each kind is the lowest at which the scores of a held-out third reach
   the asked precision; a kind that never reaches it adds nothing. A kind with too few
   positives to tell takes the threshold of all kinds together. Candidates over a strict span
   are dropped: that text is covered.

Offsets are code points, end exclusive. Null and empty texts have no spans. Every row is
judged alone, so copies and repeated rows get equal results, and no row leaves its task.
All patterns run in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.sequence import running_total
from .boosting import Boosted, cuts_of, fit, fit_spread
from .common import cut_lineage, pick
from .textcode import flat, pieces

KINDS = ("email", "ip", "card", "phone")

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
# a match inside a run of digits could also start at the run's first digit
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LABEL, _DOT = "[A-Za-z0-9-]{1,63}", r"(?: ?[\[(] ?dot ?[\])] ?| dot )"
LOOSE = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:(?:@| @ | ?[\[(] ?at ?[\])] ?){_LABEL}(?:(?:\.| \. |{_DOT}){_LABEL}){{1,4}}"
                        rf"| at {_LABEL}(?:{_DOT}{_LABEL}){{1,4}})", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{2,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])"),
}
HINTS = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|login", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|telefon|llam|appel", re.I),
}
OTHER = re.compile(r"version|isbn|issn|doi|order|invoice|page|chapter|section|date|price|serial|no\.|nr\.|\bv$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def strict_matches(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, kind, whether it passes its check), left to right for each kind."""
    end = 0
    for m in _HOST.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and _LOCAL_TAIL.match(text, start - 1):
            start -= 1
        if start < m.start():
            yield start, m.end(), "email", True
            end = m.end()
    for m in _IP.finditer(text):
        yield m.start(), m.end(), "ip", all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        yield m.start(), m.end(), "card", 14 <= len(d) <= 19 and luhn(d)
    for m in _PHONE.finditer(text) if "+" in text else ():
        yield m.start(), m.end(), "phone", 10 <= len(_digits(m[0])) <= 15


def ordered(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    return ordered((s, e, k) for s, e, k, good in strict_matches(text) if good)


def loose_spans(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), k) for k, p in LOOSE.items() for m in p.finditer(text)]


def clear_of(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that touch no base span."""
    out, taken = [], sorted((s, e) for s, e, _ in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else []
    for s in spans:
        i = int(np.searchsorted(starts, s[1], "left"))
        if i == 0 or reach[i - 1] <= s[0]:
            out.append(s)
    return out


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    start, end, kind = span
    s, left, right = text[start:end], text[max(0, start - 32):start], text[end:end + 32]
    runs = [len(r) for r in re.findall("[0-9]+", s)] or [0]
    d = _digits(s)
    seps = set(re.sub(r"[A-Za-z0-9]", "", s))
    tail = re.split(r"[^A-Za-z]+", s)[-1]
    around = left + right
    return [
        *[float(kind == k) for k in KINDS], len(s), len(d), sum(c.isalpha() for c in s), len(runs), max(runs), min(runs),
        len(seps), float(seps <= {" "}), float("." in seps), float("-" in seps), float("(" in seps or "[" in seps), float("/" in seps),
        float("@" in s), float(bool(re.search(r"\bat\b", s, re.I))), float(bool(re.search(r"\bdot\b", s, re.I))),
        float(14 <= len(d) <= 19 and luhn(d)), float(len(runs) == 4 and all(int(r) <= 255 for r in re.findall("[0-9]{1,9}", s))),
        len(tail), float(left[-1:].isalnum()), float(right[:1].isalnum()), float(bool(HINTS[kind].search(left))),
        float(bool(HINTS[kind].search(right))), float(bool(OTHER.search(left[-16:]))),
        sum(c.isdigit() for c in around) / max(1, len(around)), float(s[:1] == "0"), float(len(set(d)) <= 2),
    ]


def loosened(s: str, kind: str, rng: np.random.Generator) -> str:
    """A strict span in a form that only the loose generators take."""
    if kind == "email":
        at, dot = [("[at]", "[dot]"), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", " . ")][rng.integers(5)]
        name, host = s.split("@", 1)
        if rng.random() < 0.5:  # not all addresses have digits
            name, host = re.sub("[0-9]", "", name).strip("._%+-") or "jo", re.sub("[0-9]", "", host)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", ["[.]", "(.)", " . "][rng.integers(3)])
    if kind == "card":
        d, sep = _digits(s), [".", "/", " - ", "_"][rng.integers(4)]
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4))
    d, sep = _digits(s)[-10:], ["-", ".", " "][rng.integers(3)]
    head = f"({d[:3]}) " if rng.random() < 0.3 else d[:3] + sep
    return head + d[3:6] + sep + d[6:]


def decoy(s: str, kind: str, rng: np.random.Generator) -> str:
    """A string of the same alphabet with another meaning."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == "email":
        word = re.sub("[^a-z]", "", s.split("@")[0]) or "it"
        return [f"look at {word} dot afterwards", f"{word} (at) {word}-{num(2)} . {num(3)}", f"meet at {num(2)} dot {num(2)}",
                f"{num(3)} @ {num(1)}.{num(2)}"][rng.integers(4)]
    if kind == "ip":
        return ["version ", "v", "section "][rng.integers(3)] + " . ".join(num(rng.integers(1, 3)) for _ in range(4))
    if kind == "card":
        d = _digits(s)
        d = d[:-1] + str((int(d[-1]) + int(rng.integers(1, 10))) % 10)
        return ".".join(d[i:i + 4] for i in range(0, len(d), 4))
    return [f"20{num(2)}-{num(2)}-{num(2)}", f"isbn {num(3)}-{num(2)}-{num(4)}-{num(3)}", f"{num(1)}.{num(3)}.{num(3)}",
            f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(4)}/{num(2)}/{num(2)}"][rng.integers(5)]


def examples(texts: list[str], spans: list | None = None, seed=7, forms: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of training candidates, from the texts' strict spans or
    those given for each text; ``forms`` rewritten spans and as many decoys for each."""
    rng = np.random.default_rng(seed)
    rows, labels, kinds = [], [], []

    def take(text: str, at: int, size: int, kind: str, label: int) -> None:
        for s in loose_spans(text[max(0, at - 200):at + size + 200]):
            a, b = s[0] + max(0, at - 200), s[1] + max(0, at - 200)
            if s[2] == kind and a < at + size and b > at:
                rows.append(features(text, (a, b, kind)))
                labels.append(label)
                kinds.append(KINDS.index(kind))

    hints = {"email": "mail: ", "ip": "server address ", "card": "card no. ", "phone": "phone "}
    for i, text in enumerate(texts):
        for start, end, kind in base_spans(text) if spans is None else spans[i]:
            for make, label in [(loosened, 1)] * forms + [(decoy, 0)] * forms:
                new = make(text[start:end], kind, rng)
                lead = hints[kind] if label and (kind == "phone" or rng.random() < 0.5) else ""
                changed = text[max(0, start - 60):start] + lead + new + text[end:end + 60]
                take(changed, min(start, 60) + len(lead), len(new), kind, label)
    return np.array(rows, float).reshape(len(rows), -1 if rows else 1), np.array(labels, float), np.array(kinds, int)


def lowest_bound(margin: np.ndarray, label: np.ndarray, precision: float, least_hits: int) -> float | None:
    """The lowest margin that reaches the precision (half way to the next candidate below)."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(label[order])
    ok = np.flatnonzero((hits / np.arange(1, len(label) + 1) >= precision) & (hits >= least_hits))
    if not len(ok):
        return None
    last, after = margin[order][ok[-1]], margin[order][ok[-1] + 1:ok[-1] + 2]
    return max(0.0, float(last if not len(after) else (last + after[0]) / 2))


def train(texts: list[str], precision: float = 0.99, least_hits: int = 10, spans: list | None = None) -> tuple[Boosted | None, dict[str, float]]:
    """The trees and, for each kind that reaches the precision on the held-out third, the
    lowest margin that does. A kind with fewer than ``least_hits`` positives there takes the
    margin that all kinds together need."""
    x, y, kind = examples(texts, spans)
    if len(y) < 2 or y.min() == y.max():
        return None, {}
    out = np.arange(len(y)) % 3 == 2
    model = fit(x[~out], y[~out], trees=40, depth=4)
    margin, bounds = model.margin(x), {}
    pooled = lowest_bound(margin[out], y[out], precision, max(1, min(least_hits, int(y[out].sum()))))
    for i, name in enumerate(KINDS):
        held = out & (kind == i)
        few = y[held].sum() < least_hits
        bound = pooled if few else lowest_bound(margin[held], y[held], precision, least_hits)
        if bound is not None:
            bounds[name] = bound
    return model, bounds


def all_spans(text: str, model: Boosted | None, bounds: dict[str, float]) -> tuple[list, list]:
    base = base_spans(text)
    if model is None:
        return base, base
    extra = [s for s in clear_of(loose_spans(text), base) if s[2] in bounds]
    if extra:
        margin = model.margin(np.array([features(text, s) for s in extra], float))
        sure = sorted((-m, s) for s, m in zip(extra, margin.tolist()) if m >= bounds[s[2]])
        extra = []
        for _, s in sure:  # of overlapping candidates the surest
            extra += clear_of([s], extra)
    return base, ordered([*base, *extra])


def learn(docs: DataFrame, sample_docs: int | None, sample_windows: int | None, id_col: str, text_col: str) -> tuple[Boosted | None, dict[str, float]]:
    """From all strict spans, or from a sample where a bound is given."""
    if sample_docs is None and sample_windows is None:
        return learn_all(docs, id_col, text_col)
    return learn_sampled(docs, sample_docs or 20_000, sample_windows or 80_000, id_col, text_col)


#: examples in a block; a block is what a task holds of them at a time
BLOCK_ROWS = 1 << 16
#: rewritten forms, and decoys, that a span teaches: a kind with few spans shows most of its forms
FORMS = 4


def learn_all(docs: DataFrame, id_col: str, text_col: str, precision: float = 0.99, least_hits: int = 10) -> tuple[Boosted | None, dict[str, float]]:
    """From every strict span of every document. The driver holds the cuts, the trees and a
    number for each kind; equal examples are one row with a count."""
    cases = cut_lineage(training_cases(docs, id_col, text_col))
    # every feature is a count or a share within a bounded window: few distinct values each
    values: dict[int, list] = {}
    for r in cases.where("NOT held").select(F.posexplode("x")).groupBy("pos", "col").count().orderBy("pos", "col").collect():
        values.setdefault(r["pos"], []).append((r["col"], r["count"]))
    cuts = [cuts_of(*map(np.array, zip(*values[j]))) for j in sorted(values)]
    if not cuts:
        return None, {}
    rows = cut_lineage(cases.mapInArrow(_binned(cuts), "bins binary, kind int, label int, held boolean")
                       .groupBy("bins", "kind", "label", "held").agg(F.count(F.lit(1)).alias("n")))
    sizes = {(r["held"], r["label"]): r for r in rows.groupBy("held", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    if (False, 0) not in sizes or (False, 1) not in sizes:
        return None, {}
    parts = -(-sum(sizes[False, y]["rows"] for y in (0, 1)) // BLOCK_ROWS)
    taught = rows.where("NOT held").select("bins", "label", "n").repartition(max(4, parts))
    model = fit_spread(taught.rdd.mapPartitions(lambda rows: _blocks(rows, len(cuts))), cuts, trees=40, depth=4)
    scored = cut_lineage(rows.where("held").mapInArrow(_margins(model, cuts), "kind int, label int, n long, over double"))
    return model, kind_bounds(scored, precision, least_hits)


def training_cases(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """kind, label, held and features x of the candidates that every strict span teaches. A
    third of them is held out; which ones follows from the window alone."""
    src = pick(docs, doc_id=id_col, text=text_col).select(F.xxhash64("doc_id", "text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = _windows(batch, None)
            while some := list(islice(windows, 1024)):
                cols = [[], [], [], []]
                for kind, h, nth, window, start, end in some:
                    x, y, kinds = examples([window], [[(start, end, kind)]], [h % (1 << 64), nth, KINDS.index(kind)], FORMS)
                    held = (np.arange(len(y)) + zlib.crc32(window.encode("utf-8", "replace"))) % 3 == 2
                    for col, more in zip(cols, (kinds.tolist(), y.astype(int).tolist(), held.tolist(), x.tolist() if len(y) else [])):
                        col += more
                types = [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "label", "held", "x"])

    return src.mapInArrow(run, "kind int, label int, held boolean, x array<double>")


def _binned(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), *batch.columns[:3]], names=["bins", "kind", "label", "held"])
    return run


def _blocks(rows, features: int):
    rows = iter(rows)
    while block := list(islice(rows, BLOCK_ROWS)):
        x = np.frombuffer(b"".join(bytes(r[0]) for r in block), np.uint8).reshape(-1, features)
        yield x, np.array([r[1] for r in block], float), np.array([r[2] for r in block], float)


def _margins(model: Boosted, cuts: list[np.ndarray]):
    # a bin stands for all its values: the cut over it lies on the same side of every bound
    tops = [np.append(c, np.inf) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(cuts))
            x = np.stack([t[bins[:, j]] for j, t in enumerate(tops)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:3], batch.column(4), pa.array(-model.margin(x))], names=["kind", "label", "n", "over"])
    return run


def kind_bounds(scored: DataFrame, precision: float, least_hits: int) -> dict[str, float]:
    """:func:`lowest_bound` of each kind and of all together (kind -1) from rows of kind, label,
    count and negated margin; equal margins are taken together."""
    each = scored.withColumn("kind", F.explode(F.array("kind", F.lit(-1)))).groupBy("kind", "over").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hit"))
    run = cut_lineage(running_total(each, ["kind"], ["over"], {"seen": "n", "hits": "hit"}))
    positives = {r["kind"]: r["p"] for r in run.groupBy("kind").agg(F.max("hits").alias("p")).collect()}
    least = {k: max(1, min(least_hits, p)) if k < 0 else least_hits for k, p in positives.items()}
    if not least:
        return {}
    need = F.create_map(*[F.lit(v) for kv in least.items() for v in kv])[F.col("kind")]
    last = run.where((F.col("hits") / F.col("seen") >= precision) & (F.col("hits") >= need)).groupBy("kind").agg(F.max("over").alias("last"))
    found = {r["kind"]: max(0.0, -(r["last"] if r["next"] is None else (r["last"] + r["next"]) / 2)) for r in
             run.join(last, "kind").groupBy("kind", "last").agg(F.min(F.when(F.col("over") > F.col("last"), F.col("over"))).alias("next")).collect()}
    bounds = {}
    for i, name in enumerate(KINDS):
        bound = found.get(-1 if positives.get(i, 0) < least_hits else i)
        if bound is not None:
            bounds[name] = bound
    return bounds


def learn_sampled(docs: DataFrame, sample_docs: int, sample_windows: int, id_col: str, text_col: str) -> tuple[Boosted | None, dict[str, float]]:
    """From the documents of each kind with the smallest hash of id and text. Equal ranges of
    the hash are counted first, so that about as many windows as are asked for are sorted."""
    n_docs, n_windows = max(1, sample_docs // len(KINDS)), max(1, sample_windows // len(KINDS))
    src = pick(docs, doc_id=id_col, text=text_col).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    found = cut_lineage(src.mapInArrow(_strict_windows(n_windows), "kind string, h long, nth long, window string, start long, end long")
                        .withColumn("part", F.shiftright("h", 52)))
    counts = found.groupBy("kind", "part").agg(F.count_if(F.col("nth") == 0).alias("docs"), F.count(F.lit(1)).alias("windows")).orderBy("part").collect()
    rows = []
    for kind in KINDS:
        docs_in = windows_in = 0
        last = None
        for r in counts:
            if r["kind"] == kind and docs_in < n_docs and windows_in < n_windows:
                docs_in, windows_in, last = docs_in + r["docs"], windows_in + r["windows"], r["part"]
        if last is None:
            continue
        first = found.where((F.col("kind") == kind) & (F.col("part") <= last)).orderBy("h", "nth", "window", "start").limit(n_windows).collect()
        wanted = set(sorted({r["h"] for r in first})[:n_docs])
        rows += [r for r in first if r["h"] in wanted]
    return train([r["window"] for r in rows], spans=[[(r["start"], r["end"], r["kind"])] for r in rows])


def _windows(batch: pa.RecordBatch, most: int | None) -> Iterator[tuple]:
    """kind, hash, number, window, start and end of every strict span, or of the first ``most``
    of a kind and document, with all of its surroundings that examples() looks at."""
    for h, text, plain in zip(batch.column(0).to_pylist(), batch.column(1), _plain(batch.column(1)).tolist()):
        text, n = "" if plain else text.as_py() or "", dict.fromkeys(KINDS, 0)
        for s, e, k in base_spans(text):
            if most is None or n[k] < most:
                yield k, h, n[k], text[max(0, s - 60):e + 60], min(s, 60), min(s, 60) + e - s
                n[k] += 1


def _strict_windows(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_windows(batch, most))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "h", "nth", "window", "start", "end"])
    return run


#: without a digit or an at sign a candidate needs one of these, whatever its case
_WRITTEN = re.compile(rb"dot|[\[(] ?at ?[\])]", re.I)


def _plain(column: pa.Array) -> np.ndarray:
    """Rows that hold neither a digit, an at sign, a bracketed at nor a written-out dot: no
    candidate."""
    data, offs = flat(column)
    marks = np.zeros(256, bool)
    marks[[*range(48, 58), 64]] = True
    plain = np.ones(len(offs) - 1, bool)
    for a, b, raw, off in pieces(data, offs):
        plain[a:b] = np.bincount(np.searchsorted(off, np.flatnonzero(marks[raw]), "right") - 1, minlength=b - a) == 0
    for i in np.flatnonzero(plain).tolist():
        plain[i] = not _WRITTEN.search(data[offs[i]:offs[i + 1]].tobytes())
    return plain


def _spans(model: Boosted | None, bounds: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_out, all_out = [], []
            for text, plain in zip(batch.column(1), _plain(batch.column(1)).tolist()):
                base, every = ([], []) if plain else all_spans(text.as_py() or "", model, bounds)
                base_out.append([{"kind": k, "start": s, "end": e} for s, e, k in base])
                all_out.append([{"kind": k, "start": s, "end": e} for s, e, k in every])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, kind), pa.array(all_out, kind)],
                                             names=["doc_id", "base", "spans"])
    return run


def personal_spans(docs: DataFrame, sample_docs: int | None = None, id_col: str = "doc_id", text_col: str = "text", sample_windows: int | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) by start, then kind."""
    model, bounds = learn(docs, sample_docs, sample_windows, id_col, text_col)
    src = pick(docs, doc_id=id_col, text=text_col)
    kind = "array<struct<kind:string,start:long,end:long>>"
    return src.mapInArrow(_spans(model, bounds), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, base {kind}, spans {kind}")


def redact(docs: DataFrame, sample_docs: int | None = None, id_col: str = "doc_id", text_col: str = "text", sample_windows: int | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are one."""
    model, bounds = learn(docs, sample_docs, sample_windows, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(at), []
            for i, plain in enumerate(_plain(texts).tolist()):
                text = texts[i].as_py()
                out.append(text if plain else masked(text, all_spans(text, model, bounds)[1]))
            cols = [pa.array(out, pa.string()) if j == at else c for j, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, end = [], 0
    for s, e, kind in spans:
        if s >= end:
            parts += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*parts, text[end:]])


def digest(spans: list) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
