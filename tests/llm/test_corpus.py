"""Importance resampling, phrase collocations and token records against plain versions."""

import collections
import hashlib
import math
import os
import random
import re
import struct
import zlib

import fixtures as X
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import importance as I, phrases as P, record_files as R, token_ids as T
from faultline.llm.queries import tokenizer_path

BPE = "byte_bpe_50k.json"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BPE))


# ---- importance resampling --------------------------------------------------------------

def features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent=5, least=20):
    """{id: [features, weight, score, rank]} for unique ids."""
    found = {i: features(t) for i, t in docs}
    s, t = collections.Counter(), collections.Counter()
    for _, f in found.values():
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)]
    out = {}
    for i, (_, f) in found.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out[i] = [len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    order = sorted((-out[i][2], i) for i, (n_words, _) in found.items() if n_words >= least)
    for rank, (_, i) in enumerate(order[:percent * len(order) // 100], 1):
        out[i][3] = rank
    return out


@pytest.mark.parametrize("percent", [5, 40, 100, 0])
def test_resampling(spark, docs, plain, percent):
    target = ["alpha1 beta2 gamma3 the the", None, "", "SEA4 of in"]
    bench = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, weight int")
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in I.resample(docs, bench, percent).collect()}
    assert got == resampled(plain, target, percent)


def test_words_of_any_length():
    """Words longer than the common steps, other alphabets, a row without words."""
    texts = ["x" * 300 + " é" * 70 + " ÄB" + "日本" * 40, "", " .,- ", "a", "Z9 z9"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    bucket, row, n_words = I.feature_buckets(data, offs, 3, 10000)
    want = [features(t) for t in texts]
    assert n_words.tolist() == [n for n, _ in want]
    for i, (_, f) in enumerate(want):
        assert sorted(bucket[row == i].tolist()) == sorted(f)


def test_resampling_of_repeats_nulls_and_nothing(spark, docs, none):
    text = " ".join(f"word{i}" for i in range(30))
    rows = spark.createDataFrame([(7, text)] * 30 + [(None, text)] * 30 + [(5, text)], "doc_id long, text string")
    got = I.resample(rows, rows.where("1 = 0"), 50).collect()
    assert len(got) == 61 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31))
    first = {r["rank"]: r.score for r in got if r["rank"]}
    assert all(first[k] >= first[k + 1] for k in range(1, 30))
    assert I.resample(none, rows).collect() == []
    with pytest.raises(TypeError):
        I.resample(rows.select(F.lit("a").alias("doc_id"), "text"), rows)


def test_cutoff_takes_exactly_k(spark):
    rng = random.Random(5)
    values = [(rng.choice([-5, 0, 0, 0, 10**15]), rng.choice([1, 1, 2, -9]), i) for i in range(200)]
    rows = spark.createDataFrame(values, "a long, b long, c long").cache()
    for k in (0, 1, 50, 120, 199, 200):
        got = rows.where(I.take_first(rows, ["a", "b", "c"], k, ways=4)).collect()
        assert sorted(map(tuple, got)) == sorted(values)[:k]


# ---- phrase collocations ------------------------------------------------------------------

def collocated(rows, least, cover=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i:i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if any(100 * b >= cover * a for q, b in cand.items() if len(q) == 4 and len(p) == 3 and q[0] == lang and w in (q[1:3], q[2:4])):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    res, seen = [], collections.Counter()
    for lang, s, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            res.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(res)


def corpus():
    rng = random.Random(11)
    words = [f"W{i}" for i in range(12)] + ["é", "New", "York", "city", "日本", "a b"]
    rows = []
    for i in range(300):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None]), t + rng.choice(["", " new york city", "! New York"])))
    return rows + [("en", None), (None, ""), ("fr", "only here"), ("de", "  . ,; ")] + [("en", "copy of this text")] * 15


@pytest.mark.parametrize("least,top,shard", [(3, 2000, 1 << 20), (10, 7, 64), (2, 50, 700)])
def test_collocations(spark, least, top, shard):
    rows = corpus()
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, id long, word string").repartition(5)
    got = P.collocations(df, least=least, top=top, shard_bytes=shard)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == collocated(rows, least, top=top)
    assert P.collocations(df.where("1 = 0"), least=least).collect() == []


def test_index_counts_and_parents():
    rng = np.random.default_rng(3)
    for sigma, depth in ((4, 3), (2, 5), (900, 3), (1 << 22, 3)):
        seq = np.append(rng.integers(0, min(sigma, 40), 500), 0).astype(np.int32)
        before = None
        for k, (words, count, left, right) in enumerate(P.FMIndex(seq, sigma, depth).levels(depth), 1):
            want = collections.Counter(tuple(seq[i:i + k].tolist()) for i in range(len(seq) - k + 1) if (seq[i:i + k] > 0).all())
            assert {tuple(w): c for w, c in zip(words.tolist(), count.tolist())} == want
            if k > 1:
                assert (before[left] == words[:, 1:]).all() and (before[right] == words[:, :-1]).all()
            before = words


# ---- token records --------------------------------------------------------------------------

def plain_crc32c(raw):
    c = 0xFFFFFFFF
    for x in raw:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    assert plain_crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(2)
    count = np.array([1, 2, 3, 4, 5, 17, 64, 100, 1, 1000])
    words = rng.integers(0, 1 << 32, count.sum(), dtype=np.uint32)
    edges = np.concatenate([[0], np.cumsum(count)])
    assert R.crc32c(words, count).tolist() == [plain_crc32c(words[a:b].tobytes()) for a, b in zip(edges, edges[1:])]


def test_units_have_the_ids_of_the_text(bpe):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "　", " ", "'s", "'ll", "1", "22", "!", "<|endoftext|>", "日", " ", "\x1c",
             "\x85", "😀", " the", " word", "it's.", ",", " ."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None, "", " ", ".", "a" * 3000]
    encode, got = T.Encoder(tokenizer_path(BPE), most=300), []
    for _, ids, count in encode(pa.array(texts), 0, 3000):
        edges = np.concatenate([[0], np.cumsum(count)])
        got += [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]
    assert got == [bpe.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def written(spark, docs, folder, **options):
    R.write_records(docs, str(folder), tokenizer_path(BPE), **options)
    return R.read_records(spark, str(folder), range_bytes=2048)


def ids_of(r):
    return np.frombuffer(r.ids, "<u4").tolist()


def test_records(spark, docs, plain, bpe, tmp_path):
    got = written(spark, docs, tmp_path / "a").collect()
    at = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), sorted(plain), strict=True):
        ids = bpe.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, ids_of(r)) == (i, at, len(ids), ids)
        at += len(ids)
    # frames as any reader of the format sees them
    records = 0
    for name in sorted(os.listdir(tmp_path / "a")):
        raw, at = (tmp_path / "a" / name).read_bytes() if name.endswith(".rec") else b"", 0
        while at < len(raw):
            size, check = struct.unpack_from("<QI", raw, at)
            mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
            assert check == mask(plain_crc32c(raw[at:at + 8]))
            if records < 6:
                assert struct.unpack_from("<I", raw, at + 12 + size)[0] == mask(plain_crc32c(raw[at + 12:at + 12 + size]))
            at, records = at + 16 + size, records + 1
    assert records == len(plain)


def test_records_in_a_shuffled_order(spark, docs, tmp_path):
    whole = written(spark, docs, tmp_path / "a").collect()
    orders = [[(r.doc_id, r.start) for r in R.read_records(spark, str(tmp_path / "a"), seed=s, range_bytes=1 << 20).collect()] for s in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    assert {tuple(o) for o in orders[0]} == {tuple(o) for o in orders[2]} == {(r.doc_id, r.start) for r in whole}


def test_records_of_repeats_nulls_and_nothing(spark, none, tmp_path):
    rows = [(None, "b b"), (3, "x"), (3, "y"), (3, "y"), (None, None), (-4, "z")]
    got = sorted(written(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [-4, 3, 3, 3, None, None] and sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    assert written(spark, none, tmp_path / "b").collect() == []
    with pytest.raises(TypeError):
        R.write_records(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path / "c"), tokenizer_path(BPE))


def test_damage_is_found(spark, docs, tmp_path):
    frame = written(spark, docs, tmp_path / "a")
    name = next(n for n in sorted(os.listdir(tmp_path / "a")) if n.endswith(".rec"))
    raw = bytearray((tmp_path / "a" / name).read_bytes())
    raw[len(raw) // 2] ^= 1
    (tmp_path / "a" / name).write_bytes(raw)
    with pytest.raises(Exception, match="damaged|do not fit"):
        frame.collect()


def test_wide_ids():
    doc, known, count = np.array([5, -1]), np.array([True, False]), np.array([3, 0])
    ids = np.array([1, 70000, 2], np.uint32)
    words, size = R.frames(doc, known, ids, count, False)
    got = R.unframed(words, size)
    assert [x.tolist() for x in got] == [[5, -1], [True, False], [1, 70000, 2], [3, 0]]
