"""Every registered query of the subpackage on the smallest tables, against its SQL or a
plain version."""

import hashlib
import os
import zlib

import fixtures as X
import numpy as np
import pytest
from oracle_check import compare, duck

import corpus_pipeline
from faultline import llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def ask(spark):
    return lambda name: llm.all_queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_one_query_for_each_operator():
    names = sorted(int(n.split("_")[0][2:]) for n in llm.all_queries())
    assert names == list(range(1, 14))
    assert set(llm.all_oracles()) <= set(llm.all_queries())


@pytest.mark.parametrize("name", sorted(llm.all_oracles()))
def test_sql(spark, name):
    df = llm.all_queries()[name](spark, SF)
    cur = duck(SF).execute(llm.all_oracles()[name])
    cols = [d[0] for d in cur.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], cols, cur.fetchall()) == ""


def test_packing(ask, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for (i, _), e in zip(texts, bpe.encode_batch([t or "" for _, t in texts], add_special_tokens=False)):
        ids = np.array(e.ids + [0], "<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update({(i, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))})
    got = ask("op1_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 2048 and len(room) <= 1.05 * sum(room.values()) / 2048 + 1


def test_personal_data(ask, texts):
    got = {r.doc_id: r for r in ask("op4_candidate_boosted_pii")}
    for i, t in texts:
        spans = X.personal(t)
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, _, k in spans) for n in ("email", "ip", "card", "phone"))
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_main_text(ask, spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = ask("op5_dom_boosted_text")
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        assert r.n_chars == len(r.text) and "track(" not in r.text and "<" not in r.text


def test_scores(ask, texts):
    import math

    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count, ends = {}, 0
    for i, t in texts:
        if not held(i):
            ends += 1
            for w in X.words(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + ends, len(count) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    got = {r.doc_id: r for r in ask("op6_context_tree_scores")}
    for i, t in texts:
        w, r = X.words(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w) + 1, sum(x in count for x in w) + 1, n)
        assert abs(r.base_score - sum(log(count.get(x, 0)) for x in w) - log(ends)) < 1e-6 * (len(w) + 1)
        assert r.score < 0
    size = sum(len((t or "").encode()) + 1 for i, t in texts if held(i))
    assert -sum(r.score for r in got.values() if r.held_out) / math.log10(2) / size < 3.0  # bits a byte


def test_rollup(ask, texts, spark):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = {}
    for r in rows:
        if r.doc_id not in toxic:
            k = (r.source, r.lang, "byte_bpe" if r.lang == "en" else "byte_bpe_multi")
            docs[k] = docs.get(k, 0) + 1
    got = {(r.source, r.lang, r.tokenizer): r for r in ask("op7_token_rollup")}
    assert {k: r.n_docs for k, r in got.items()} == docs and all(r.n_tokens > 0 for r in got.values())


def test_quality_scores(ask, texts, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = ask("op8_rule_ensemble_quality")
    assert {r.doc_id for r in got} == {i for i, _ in texts}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_jaccard_join(ask, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ask("op9_ngram_jaccard_join")} == X.jaccard_components(texts)


def test_suffix_dedup(ask, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in ask("op10_suffix_array_dedup")}
    assert got == X.removed(texts)


def test_resampling(ask, texts, spark):
    from test_corpus import resampled

    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in ask("op11_importance_resampling")}
    assert got == resampled(texts, target)


def test_token_records(ask, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for i, t in sorted(texts):
        ids = np.array(bpe.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ask("op13_token_records")} == want


def test_pipeline(spark, texts):
    """Each stage keeps to its input and its decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, text = docs.columns, dict(texts)
    frames = {}
    from faultline.llm.common import scratch_path

    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        frames[name] = (before, docs)
    ids = {n: tuple({r[0] for r in f.select("doc_id").collect()} for f in pair) for n, pair in frames.items()}
    quality = {r.doc_id for r in llm.all_queries()["op3_host_quality_rules"](spark, SF).collect() if r.kept}
    assert ids["quality rules"][1] == quality
    groups = X.jaccard_components([(i, text[i]) for i in quality])
    assert ids["n-gram Jaccard join"][1] == {i for i, (_, c) in groups.items() if c == i}
    held = {r.doc_id for r in llm.all_queries()["op2_benchmark_decontamination"](spark, SF).collect()}
    assert ids["benchmark decontamination"][1] == ids["n-gram Jaccard join"][1] - held
    before, after = frames["personal data"]
    assert after.columns == columns and ids["personal data"][0] == ids["personal data"][1]
    for r in after.collect():
        assert not X.personal(r.text) and r.n_chars == len(r.text or "")
    assert ids["best-fit packing"][0] == ids["best-fit packing"][1]
