"""Operators that judge or rewrite one row at a time, against plain versions."""

import math
import re
import zlib

import fixtures as X
import numpy as np

from faultline.llm import html_text as H, pii
from faultline.llm.boosting import fit, lasso_logistic, paths
from faultline.llm.context_tree import ContextTree, log_gamma, tree_scores
from faultline.llm.packing import pack_documents, plan_packing
from faultline.llm.quality_rules import keep_good, quality_verdicts
from faultline.llm.queries import joined_spans, tokenizer_path
from faultline.llm.rule_ensemble import quality_scores
from faultline.llm.token_rollup import Rollup, deletes, inserts, revisions, token_counts
from faultline.llm.unigram import unigram_scores
from pyspark.sql import functions as F


def test_packing(docs, plain, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack_documents(docs, tokenizer_path(), 256).collect()
    want = {i: bpe.encode(t or "", add_special_tokens=False).ids + [0] for i, t in plain}
    back = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        assert r["start"] == len(back.get(r["doc_id"], [])) and r["length"] == len(r["ids"]) <= 256
        assert r["length"] == 256 or r["piece"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        back.setdefault(r["doc_id"], []).extend(r["ids"])
    assert back == want
    filled = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 256
    assert pack_documents(none, tokenizer_path(), 256).count() == 0


def test_plans_use_every_piece_and_few_sequences():
    rng = np.random.default_rng(3)
    for lengths in (np.arange(1, 513), np.array([512]), np.array([171, 175, 256]), np.arange(100, 512, 7), np.array([], int)):
        counts = rng.integers(1, 300, len(lengths))
        plan = plan_packing(lengths, counts, 512)
        assert plan[:, 2].sum() == counts.sum()
        room = {}
        for length, _, n, each, seq, off in plan.tolist():
            for i in range(-(-n // each)):
                room[seq + i] = room.get(seq + i, 0) + length * min(each, n - i * each)
        assert max(room.values(), default=0) <= 512
        if len(lengths) > 100:
            assert len(room) <= 1.03 * (lengths * counts).sum() / 512


def test_quality_counts(docs, plain, none):
    got = {r["doc_id"]: r for r in quality_verdicts(docs).collect()}
    for i, t in plain:
        n, letters, symbols, dup, rep = X.rule_counts(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, letters, symbols, dup, rep), i
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert got[0]["kept"]
    assert quality_verdicts(none).count() == 0
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_host_verdict_spares_clean_documents(spark):
    import random

    rng = random.Random(2)
    junk = lambda: " ".join(w + ("#" if k % 5 == 0 else "") for k, w in enumerate(X.sentence(rng, 80).split()))
    rows = [(i, junk() if h == "bad" and i % 10 else X.sentence(rng, 80), h) for i, h in enumerate(["bad", "good"] * 60)]
    rows += [(500, junk(), "good")]
    got = {r["doc_id"]: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, t, h in rows:
        assert got[i]["strict"] == (h == "bad")
        assert got[i]["kept"] == (h == "good" or "#" not in t)


def test_strict_spans():
    cases = ["a.b@c.de x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4012888888881881 4012 8888-8888 1881 49927398716", "+1 (555) 123-4567, +12 3",
             "é@x.y.z ü.b@c-d.e@f.g", "@@a@b.c..d", "1" * 3000 + ".2.3.4", "+" * 50 + "1234567890", "x" * 20000 + "@", "a@b.c@d.e@f", None, ""]
    for t in cases + X.texts():
        assert pii.base_spans(t or "") == X.personal(t), t


def test_personal_spans(spark, docs, none):
    people = [(100 + i, f"text {i} mail jo{i}@ex{i}.org then 10.0.{i}.7 and +1 (555) 010-{1000 + i} with 4012888888881881 end") for i in range(60)]
    df = spark.createDataFrame([*people, (1, None), (2, "phone 555-867-5309 or mail bob[at]site[dot]org")], "doc_id long, text string").unionByName(
        docs.where("doc_id > 2 AND doc_id < 100").select("doc_id", "text"))
    got = {r[0]: (r[1], r[2]) for r in pii.personal_spans(df).select("doc_id", joined_spans("base"), joined_spans("spans")).collect()}
    for r in df.collect():
        assert got[r["doc_id"]][0] == ",".join(f"{k}:{s}:{e}" for s, e, k in X.personal(r["text"]))
        assert set(filter(None, got[r["doc_id"]][0].split(","))) <= set(got[r["doc_id"]][1].split(","))
    assert "email" in got[2][1]
    assert pii.personal_spans(none).count() == 0
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert "[EMAIL]" in out[100] and "@" not in out[100] and out[1] is None
    assert pii.masked("abcdef", [(1, 4, "ip"), (2, 5, "card")]) == "a[IP]f"


def test_no_digit_free_candidate_is_skipped(spark):
    import pyarrow as pa

    texts = [f"write to jane{at}example{dot}org today" for at in ("[at]", "(at)", " [AT] ", " (at) ", "[ at ]", "( At )", "[at)", " at ", "@", " @ ")
             for dot in (".", " . ", "[dot]", " dot ", "(Dot)")] + ["nothing (here)", "look at this", "", None]
    for t, plain in zip(texts, pii._plain(pa.array(texts, pa.string())).tolist()):
        assert not (plain and (pii.loose_spans(t or "") or pii.base_spans(t or ""))), t
    assert pii._plain(pa.array(texts[-4:], pa.string())).all()
    model, bounds = pii.train([f"mail jo{i}@ex{i}.org or ann@site.org then 10.0.{i}.7" for i in range(60)])
    bounds = {"email": -9.0}  # every candidate counts: only the skip could lose one
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = next(pii._spans(model, bounds)(iter([batch]))).column(2).to_pylist()
    for t, spans in zip(texts, got):
        assert [(x["start"], x["end"], x["kind"]) for x in spans] == pii.all_spans(t or "", model, bounds)[1], t
    assert sum(map(bool, got)) >= 40


def test_rare_kinds_are_learned_and_bounds_hold(spark, monkeypatch):
    rows = [(i, f"text {i} host 10.0.{i % 250}.7 and +1 (555) 010-{1000 + i} end") for i in range(600)]
    rows += [(1000 + i, f"pay with 4012888888881881 for item {i} please") for i in range(40)]  # 1 in 16 documents
    rows += [(2000 + i, f"mail jo{i}@ex{i}.org now") for i in range(3)]  # too few for a threshold of its own
    rows += [(3000, "or mail bob[at]site[dot]org"), (3001, "my card no. 4012.8888.8888.1881 is new"), (None, "mail ann@ex.org too"), (3002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda **more: {r[0]: r[1] for r in pii.personal_spans(df, **more).select("doc_id", joined_spans("spans")).collect()}
    assert found()[3000] == "email:8:27" and found(sample_docs=200)[3001] == "card:12:31"
    taken = {}
    monkeypatch.setattr(pii, "train", lambda texts, spans: taken.update(cases=[(t, *s[0]) for t, s in zip(texts, spans, strict=True)]) or (None, {}))
    for docs_bound, windows_bound, most in ((200, 80_000, 50), (20_000, 80, 20), (20_000, 80_000, 10_000)):
        pii.personal_spans(df, sample_docs=docs_bound, sample_windows=windows_bound)
        n = {k: sum(c[3] == k for c in taken["cases"]) for k in pii.KINDS}
        assert n == {k: min(most, have) for k, have in (("email", 4), ("ip", 600), ("card", 40), ("phone", 600))}
        assert all((s, e, k) in pii.base_spans(t) for t, s, e, k in taken["cases"])


def test_every_strict_span_teaches(spark, monkeypatch):
    rows = [(i, f"text {i} call +1 (555) 01{i % 10}-{1000 + i} now") for i in range(5300)]  # a sample took 5,000 of them
    rows += [(9000 + i, f"mail jo{i}@ex{i}.org or 10.0.{i}.7 now") for i in range(60)] + [(9900, "or mail bob[at]site[dot]org"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    took = [pii.training_cases(df.repartition(n), "doc_id", "text").groupBy("kind", "held").count().orderBy("kind", "held").collect() for n in (2, 5)]
    n = {pii.KINDS[k]: sum(r["count"] for r in took[0] if r["kind"] == k) for k in {r["kind"] for r in took[0]}}
    assert took[0] == took[1] and n["phone"] > 2.5 * 5300 and n["email"] > 2.5 * 60 and len(n) == 3
    monkeypatch.setattr(pii, "train", None)  # the sampled way
    got = {r[0]: r[1] for r in pii.personal_spans(df).select("doc_id", joined_spans("spans")).collect()}
    assert got[9900] == "email:8:27" and got[9000].startswith("email:5:")


def test_trees_of_spread_rows_equal_those_of_arrays(spark):
    import numpy as np
    from faultline.llm import boosting as B

    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 9, 900), rng.integers(0, 90, 900), np.zeros(900)], axis=1).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 40) ^ (rng.random(900) < 0.1)).astype(float)
    cuts = [B.cuts_of(*np.unique(x[:, j], return_counts=True)) for j in range(3)]
    assert all(np.array_equal(c, B._cuts(x[:, j], 32)) for j, c in enumerate(cuts))
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
    n = rng.integers(1, 4, 900)
    want = B.fit(np.repeat(x, n, 0), np.repeat(y, n), trees=8, depth=4)
    wide = B._cuts(np.repeat(x, n, 0)[:, 1], 32)
    cuts[1], binned[:, 1] = wide, np.searchsorted(wide, x[:, 1])
    for parts in (1, 5):
        blocks = [(binned[i::parts], y[i::parts], n[i::parts].astype(float)) for i in range(parts)]
        got = B.fit_spread(spark.sparkContext.parallelize(blocks, parts), cuts, trees=8, depth=4)
        assert np.allclose(got.margin(x), want.margin(x), atol=1e-5)


PAGE = """<html><head><title>T</title><script>var t="</p>"</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Head &amp; more</h1><p>First   para,\n with words. It goes on. <b>bold<br><p>Second &eacute; one, and more.</p>
<div class="ad">Buy this now.</div></article><div class="comments"><div class="comment"><p>I agree, fine text.</p></div></div><footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h/{i}", PAGE.replace("First", f"Item{i}")) for i in range(30)] + [(98, None, None), (99, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in H.main_text(df).collect()}
    assert got[98] == got[99] == ""
    assert got[3] == "Head & more\n\nItem3 para, with words. It goes on. bold\n\nSecond é one, and more."
    assert H.main_text(df.limit(0)).count() == 0


def test_held_out_layouts_and_consistency():
    rng = np.random.default_rng(5)
    sentences = [X.sentence(__import__("random").Random(i), 12) + "." for i in range(80)]
    model = H.train([H.layout(sentences, rng) for _ in range(40)], layouts=300)
    wrong = total = 0
    for _ in range(60):
        page = H.Page(H.layout(sentences, rng))
        kept, want = page.keep(model.margin(page.features())), H.layout_labels(page).astype(bool)
        assert all(not kept[i] or kept[page.parent[i]] for i in range(1, len(kept)))
        size = np.array(page.chars)
        wrong, total = wrong + size[kept != want].sum(), total + size.sum()
    assert wrong / total < 0.06


def test_tree_reading_of_broken_pages():
    for s in ("<p>a<p>b", "<ul><li>a<li>b</ul>", "text <", "<a href='x", "<!-- open", "</p></div>x", "<table><tr><td>1<td>2<tr><td>3</table>", "<p>x</b></i>y", "<" * 2000):
        p = H.Page(s)
        assert isinstance(p.text(np.ones(len(p.tag), bool)), str)
    assert (lambda p: p.text(np.ones(len(p.tag), bool)))(H.Page("<ul><li>a<li>b &lt;c</ul>d")) == "a\n\nb <c\n\nd"


def test_only_hiding_attributes_hide(spark):
    text = lambda s: (lambda p: p.text(np.ones(len(p.tag), bool)))(H.Page(s))
    for attrs in ('style="overflow:hidden"', "style='overflow-x: hidden; display:block'", 'class="overflow-hidden"', "class=hidden", 'title="The hidden cost"',
                  'href="/hidden-gems"', "href=/hidden", 'data-hidden="1"', 'aria-hidden="false"', 'hidden="false"', 'alt=\'style="display:none"\'',
                  'data-style="display:none"', 'title="aria-hidden=true"', 'style="display:none;display:block"', 'style="/* display:none */ color:red"'):
        assert text(f"<div {attrs}><p>a <a {attrs}>b</a> c</p></div>") == "a b c", attrs
    for attrs in ("hidden", 'HIDDEN=""', "class=x hidden id=y", 'hidden="until-found"', 'aria-hidden="true"', "aria-hidden=TRUE", 'style="display:none"',
                  "style='color:red; DISPLAY : None !important'", 'style="display:none!important;display:block"', "style=display:none"):
        assert text(f"<p>a</p><div {attrs}><p>b</p></div>") == "a", attrs
    wrapped = PAGE.replace("<article>", '<article style="overflow:hidden" class="overflow-hidden">').replace("with words", '<a href="/hidden-gems" title="The hidden cost">with words</a>')
    rows = [(i, f"http://h/{i}", (wrapped if i == 3 else PAGE).replace("First", f"Item{i}")) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head & more\n\nItem3 para, with words. It goes on. bold\n\nSecond é one, and more."


def test_unigram(docs, plain, spark, none):
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"), (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0).alias("train"))
    count, ends = {}, sum(train(i) for i, _ in plain)
    for i, t in plain:
        for w in X.words(t) if train(i) else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + ends, len(count) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    # all words broadcast, some of them, none; a row that occurs twice
    for hot, frame in ((1 << 20, rows), (40, rows.union(rows.limit(5))), (1, rows)):
        scores = unigram_scores(frame, hot=hot)
        assert scores.count() == rows.count()
        if frame is not rows:
            continue
        got = {r["doc_id"]: r for r in rows.join(scores, "uid").collect()}
        for i, t in plain:
            want = sum(log(count.get(w, 0)) for w in X.words(t)) + log(ends)
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(X.words(t)) + 1, sum(w in count for w in X.words(t)) + 1, n)
            assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want))
    some = {r["doc_id"]: r for r in rows.join(unigram_scores(rows, hot=40), "uid").collect()}
    assert all(some[i]["n_known"] == got[i]["n_known"] and abs(some[i]["base_score"] - got[i]["base_score"]) < 1e-6 * abs(got[i]["base_score"]) for i, _ in plain)
    assert unigram_scores(rows.limit(0)).count() == 0


def brute_tree(texts, depth):
    """Log10 probability by the definition: nodes in dictionaries, one decision at a time."""
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    steps = lambda t: ((s[i - depth:i], s[i]) for s in [b"\xff" * depth + low(t) + b"\xff"] for i in range(depth, len(s)))
    node = {}
    for t in texts:
        for ctx, x in steps(t):
            for bit in range(8):
                for d in range(depth + 1):
                    c = node.setdefault((ctx[depth - d:], bit, x >> (8 - bit)), [0, 0])
                    c[(x >> (7 - bit)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = {}
    for k in node:
        if k[0]:
            children.setdefault((k[0][1:], k[1], k[2]), []).append(k)
    total, weight = {}, {}
    for k in sorted(node, key=lambda k: -len(k[0])):
        own = kt(*node[k])
        if len(k[0]) == depth:
            total[k], weight[k] = own, 1.0
        else:
            below = sum(total[c] for c in children[k])
            total[k] = np.logaddexp(own, below) - math.log(2)
            weight[k] = 1 / (1 + math.exp(min(700, below - own)))

    def score(t):
        out = 0.0
        for ctx, x in steps(t):
            for bit in range(8):
                up, p = (x >> (7 - bit)) & 1, None
                for d in range(depth, -1, -1):
                    k = (ctx[depth - d:], bit, x >> (8 - bit))
                    if k in node:
                        own = (node[k][up] + 0.5) / (sum(node[k]) + 1)
                        p = own if p is None else weight[k] * own + (1 - weight[k]) * p
                out += math.log10(0.5 if p is None else p)
        return out
    return score


def test_context_tree(spark, docs, plain, none):
    small = [(i, t) for i, t in plain if len(t or "") < 2000]
    df = spark.createDataFrame(small, "uid long, text string")
    training = df.where("uid % 4 <> 0").select("text")
    score = brute_tree([t for i, t in small if i % 4], 3)
    for shard in (1 << 22, 400):
        got = {r[0]: r[1] for r in tree_scores(df, training, depth=3, shard_grams=shard).collect()}
        assert set(got) == {i for i, _ in small}
        for i, t in small:
            assert abs(got[i] - score(t)) < 1e-6 * max(1, abs(score(t))), (i, shard)
    assert tree_scores(df.limit(0), training, depth=3).count() == 0
    even = {r[0]: r[1] for r in tree_scores(df, training.limit(0), depth=3).collect()}
    assert abs(even[small[0][0]] + 8 * math.log10(2) * (len((small[0][1] or "").encode()) + 1)) < 1e-6


def test_context_tree_is_a_distribution():
    g = np.array([0x616261, 0x616262, 0x626162, 0x616261], np.uint64)
    key, n = np.unique(g, return_counts=True)
    tree = ContextTree(key, n, 2)
    for ctx in (0x616200, 0x707000, 0x706200):
        p = 10 ** tree.log10(np.array([ctx + x for x in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9
    x = np.array([0.5, 1.0, 7.5, 1e6 + 0.5])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x])


def test_token_rollup(docs, plain, tmp_path, spark):
    versions = {"one": tokenizer_path(), "many": tokenizer_path("byte_bpe_multi_50k.tiktoken")}
    counted = token_counts(docs, versions, skip={"many": "en"}).cache()
    old, new = counted.where("tokenizer = 'one'"), counted.where("tokenizer = 'many'")
    book = Rollup(spark, str(tmp_path / "book"))
    book.commit("a", inserts(old))
    book.commit("b", deletes(old.where("doc_id < 5")))
    for _ in range(3):
        book.commit("c", revisions(old.where("doc_id >= 5 AND lang = 'de'"), new.where("doc_id >= 5 AND lang = 'de'")))
    want = {}
    for r in counted.collect():
        final = "many" if r["lang"] == "de" else "one"
        if r["doc_id"] >= 5 and r["tokenizer"] == final:
            k = (r["source"], r["lang"], final)
            n, t = want.get(k, (0, 0))
            want[k] = (n + 1, t + r["tokens"])
    assert {tuple(r)[:3]: tuple(r)[3:] for r in book.totals().collect()} == want and want


def test_rule_ensemble(spark, docs, none):
    rows = [(i, X.sentence(__import__("random").Random(i), 60) if i % 3 else " ".join(w + "!!" for w in X.sentence(__import__("random").Random(i), 60).upper().split()))
            for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(7000, 1), (None, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_scores(df, labels).collect()}
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(200, 300))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    plain = quality_scores(docs, labels.limit(0)).collect()
    assert len(plain) == docs.count() and {r["score"] for r in plain} == {0.5}
    assert quality_scores(none, labels).count() == 0


def test_trees_and_lasso():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    model = fit(x, y, trees=20, depth=3)
    assert ((model.margin(x) > 0) == y).mean() > 0.97
    rules = paths(model)
    assert all(len(set(r)) == len(r) for r in rules)
    z = np.column_stack([y, rng.integers(0, 2, 600)])
    b, w = lasso_logistic(z, y, 0.01)
    assert w[0] > 1 and abs(w[1]) < 0.2 and re.match("-", str(b))


def test_pages_with_omitted_and_broken_tags():
    """Valid pages without end tags, self-closed drawings, quotes that never close."""
    art = "<article><p>one two three.</p><p>four five six.</p></article>"
    cases = {
        "<html><head><title>t</title><body>" + art: "one two three.\n\nfour five six.",
        "<title>t</title>" + art: "one two three.\n\nfour five six.",
        "<head><meta charset=x><link rel=a><article><p>a</p></article>": "a",
        '<article><svg class="i"/><math/><p>one</p></article>': "one",
        "<article><svg><path d='x'/><text>no</text></svg><p>one</p></article>": "one",
        '<p title="abc>t</p><p>next "quoted" one</p>': 't\n\nnext "quoted" one',
        "<p title='abc>t</p><p>it's fine</p>": "t\n\nit's fine",
        '<p title="a > b">t</p><p title="a <b> c">u</p>': "t\n\nu",
    }
    for source, want in cases.items():
        page = H.Page(source)
        assert page.text(np.ones(len(page.tag), bool)) == want
