"""Jaccard join, containment search and suffix dedup against plain versions."""

import fixtures as X
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import suffix_dedup
from faultline.llm.decontaminate import contained_items, drop_contaminated
from faultline.llm.jaccard_join import PrefixTree, jaccard_components
from faultline.llm.suffix_dedup import remove_repeats


def test_unique_ids(plain):
    assert len({i for i, _ in plain}) == len(plain)


@pytest.mark.parametrize("block", [2048, 1])
def test_jaccard_components(docs, plain, block):
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(docs, block_sets=block).collect()}
    assert got == X.jaccard_components(plain)
    assert len({c for _, c in got.values()}) < len(got)


def test_jaccard_groups_of_near_copies(spark, docs):
    """Chains of near copies: members link to neighbours and not to the far end."""
    import random

    rng, rows = random.Random(5), []
    for f in range(4):
        w = X.sentence(rng, 80).split()
        for i in range(12):
            w = list(w)
            w[(i * 7 + f) % 80] = f"edit{f}_{i}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = X.jaccard_components(rows)
    for block in (2048, 2):
        assert {r[0]: (r[1], r[2]) for r in jaccard_components(df, block_sets=block).collect()} == want


def test_jaccard_empty_null_id_and_repeated_rows(spark, none):
    assert jaccard_components(none).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] or -1, r[1], r[2] or -1) for r in got) == [(-1, 2, -1), (7, 2, -1), (7, 2, -1), (8, 0, 8)]


def test_prefix_tree_counts_every_overlap():
    rng = np.random.default_rng(0)
    seqs = [np.unique(rng.integers(0, 30, rng.integers(1, 20))) for _ in range(60)]
    tree = PrefixTree(seqs)
    for _ in range(20):
        probe = np.unique(rng.integers(0, 30, 12))
        member = np.zeros(31, bool)
        member[probe] = True
        for least in (0, 3, 6):
            want = {i: int(member[s].sum()) for i, s in enumerate(seqs) if member[s].sum() >= least}
            assert dict(tree.walk(member, least)) == want


def test_containment(spark, docs, plain):
    base = X.texts()[0].split()
    items = [(0, " ".join(base[30:60])), (1, "two three"), (2, None), (3, ""), (4, "never seen anywhere at all in here"),
             (5, " ".join(base[30:50] + ["other", "words"])), (6, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in contained_items(docs, bench).collect()}
    want = {}
    for i, t in plain:
        w = [x.lower() for x in X.words(t)]
        for j, s in items:
            q = [x.lower() for x in X.words(s)]
            k = min(5, len(q))
            if k:
                sets = [{tuple(v[p:p + k]) for p in range(len(v) - k + 1)} for v in (q, w)]
                both = len(sets[0] & sets[1])
                if 100 * both >= 75 * len(sets[0]):
                    want[i, j] = (len(sets[0]), both)
    assert got == want and want
    left = {r["doc_id"] for r in drop_contaminated(docs, bench).collect()}
    assert left == {i for i, _ in plain} - {i for i, _ in want}
    assert drop_contaminated(docs, bench).columns == docs.columns


def test_containment_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained_items(none, bench).count() == 0
    assert contained_items(docs, bench.limit(0)).count() == 0


def test_containment_shuffled_join(spark, docs, monkeypatch):
    import faultline.llm.decontaminate as D

    bench = spark.createDataFrame([(0, " ".join(X.texts()[0].split()[:40]))], "item_id long, text string")
    want = sorted(map(tuple, contained_items(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, contained_items(docs, bench).collect())) == want and want


def test_difference_cover():
    cover, v = suffix_dedup.COVER, suffix_dedup.MODULUS
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_remove_repeats(docs, plain):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs).collect()}
    want = X.removed(plain)
    assert got == want and sum(v[1] for v in want.values()) > 500


def test_remove_repeats_text_and_edges(spark, none):
    assert remove_repeats(none).count() == 0
    t = "x" * 90 + "0123456789" * 5
    rows = [(1, t), (1, t), (2, t + "!"), (None, "zz"), (3, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"], bytes(r["kept"])) for r in got) == [
        (-1, 0, b"zz"), (1, 0, t.encode()), (1, 140, b""), (2, 140, b"!"), (3, 0, b"")]


def test_matrix_join_finds_what_the_tree_finds(monkeypatch):
    """Frequent and rare shingles, links below and above the threshold, one component given."""
    from faultline.llm import jaccard_join as J

    rng = np.random.default_rng(3)
    for seed, counted in ((0, 1 << 20), (1, 7)):
        base = rng.choice(1 << 40, 120, replace=False)
        sets = [np.unique(np.concatenate([rng.permutation(base)[:rng.integers(80, 120)], rng.integers(0, 400, rng.integers(0, 30))]))
                for _ in range(150)]
        want = [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:90]]
        monkeypatch.setattr(J, "COUNTED", counted)
        monkeypatch.setattr(J, "PRODUCT", 50)
        assert (J.overlaps(sets[:90], sets[20:]) == np.array(want)).all()
        sid, size = np.arange(150) + 1000, np.array([len(s) for s in sets])
        comp = np.where(np.arange(150) % 5 == 0, 1000, sid)
        probe, target = np.arange(150) % 3 > 0, np.arange(150) > 20
        found = []
        for join in (J.tree_join, J.matrix_join):
            roots = J.Roots()
            for a, b in join(sid, size, comp, probe, target, sets, 60):
                roots.join(int(comp[a - 1000]), int(comp[b - 1000]))
            found.append([roots.root(int(c)) for c in comp])
        assert found[0] == found[1] and 1 < len(set(found[0])) < 100


def test_large_families_are_joined_as_one_group(spark, monkeypatch):
    """A cluster of near copies just below the threshold: its overlapping groups would compare
    the same pairs again for each shingle that they share."""
    import random

    from faultline.llm import jaccard_join as J

    rng = random.Random(2)
    base, rows = X.sentence(rng, 120).split(), []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(0, 120, 5), 5):
            w[at] = f"edit{rng.randrange(6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    grouped, keep = [], J.cut_lineage

    def cut(frame):
        out = keep(frame)
        if "family" in out.columns:
            grouped.append(out)
        return out

    monkeypatch.setattr(J, "cut_lineage", cut)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(df, block_sets=8).collect()}
    assert got == X.jaccard_components(rows)
    sizes = {r.whole: (r.c, r.s) for r in grouped[0].groupBy("whole").agg(F.count("*").alias("c"), F.countDistinct("sid").alias("s")).collect()}
    assert sizes[True][1] > 8 and sizes[True][0] == sizes[True][1] < sizes[False][0]
