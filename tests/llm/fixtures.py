"""Small tables with the cases every operator must define, and plain versions of what the
operators compute."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: columns beside the expected ones that an operator might make for itself
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, tid long, n long, key long, "
          "sid long, uid long, score double, blob binary, words array<string>, doc string, kept boolean")


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "Ähre", "ñu", "sea", "in", "of", "the"]) + str(rng.randint(0, 60)) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    far[5:115:6] = ["x%d" % i for i in range(len(far[5:115:6]))]
    line = "this line is shared by many of the texts and is longer than a hundred bytes, which makes it a repeat to remove"
    return [
        base, None, "", "   \t\n ", "one", "one two three", base, " ".join(near), " ".join(far), "ONE two Three", "one two three",
        sentence(rng, 90) + "\n" + line + "\n" + sentence(rng, 40), sentence(rng, 70) + "\n" + line + "\n" + sentence(rng, 30),
        line, "a" * 5000, "ab " * 1500, sentence(rng, 3000), "\n".join(["same line again"] * 40),
        "é" * 130 + " tail", "é" * 130 + " tail two", base + " and more words at the end of it",
        "### $$$ %%% " * 30 + sentence(rng, 20), " | ".join(sentence(rng, 60).split()),
    ]


def rows(seed=1):
    out = []
    for i, t in enumerate(texts(seed)):
        out.append((i * 3 % 23, t, [None, "en", "de"][i % 3], ["hot", "hot", None, "b"][i % 4], None, i, 1, 2, 3, 4, 0.5, b"x", ["w"], "d", True))
    return out


def words(t, lower=True):
    return WORD.findall((t or "").translate(LOWER) if lower else (t or ""))


def shingles(t, k=5):
    w = words(t)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard_components(docs, k=5, percent=75):
    """{id: (set size, smallest id reachable)} for unique ids."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed(docs, length=100):
    """{id: (bytes, removed, runs, sha256 of the rest)} for unique ids."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def rule_counts(t):
    """words, letters, symbols, repeated lines, words in repeated 3-word windows."""
    w, t = words(t, lower=False), t or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i:i + 3])].append(i)
    covered = {i + o for at in seen.values() if len(at) > 1 for i in at for o in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def personal(t):
    """Strict spans, straight from the patterns."""
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def check(d):
        r = [int(c) for c in d][::-1]
        return (sum(r[0::2]) + sum(sum(divmod(2 * x, 10)) for x in r[1::2])) % 10 == 0

    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and check(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return [(s, e, k) for s, _, e, k in sorted(out)]
