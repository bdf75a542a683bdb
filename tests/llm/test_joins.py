"""Operators 4, 5 and 9 against brute force."""
import hashlib
import random

import numpy as np
import pytest

from tessera.llm import components, curves, jaccard, substrings
from tessera.llm.common import joined


def repeats(rows, w=13):
    order = sorted(rows, key=lambda r: r[0])
    first, out = {}, []
    tokens = [(i, (t or "").encode().split()) for i, t in order]
    for i, t in tokens:
        for a in range(len(t) - w + 1):
            first.setdefault(tuple(t[a:a + w]), i)
    for i, t in tokens:
        gone = bytearray(len(t))
        for a in range(len(t) - w + 1):
            if first[tuple(t[a:a + w])] < i:
                gone[a:a + w] = b"\1" * w
        kept = b" ".join(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 2])
def test_substring_removal(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = sorted(map(tuple, substrings.remove_repeats(docs).collect()))
    assert got == repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in got) > 1000


def test_removed_texts(spark, odd_docs):
    out = substrings.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    want = {i: (n, gone, digest) for i, n, gone, digest in repeats([(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None])}
    kept = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for i, (n, gone, digest) in want.items():
        if gone == n and n:
            assert i not in kept
        elif gone:
            assert hashlib.sha256(kept[i].text.encode()).hexdigest() == digest and kept[i].n_chars == len(kept[i].text)
        else:
            assert kept[i].text == texts[i]


def test_suffix_automaton():
    rng = random.Random(0)
    for _ in range(60):
        auto, added = substrings.SuffixAutomaton(), []
        for _ in range(5):
            s = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
            runs = {tuple(a[i:j]) for a in added for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
            want = [max([n for n in range(1, e + 2) if tuple(s[e + 1 - n:e + 1]) in runs], default=0) for e in range(len(s))]
            assert auto.matches(s) == want
            auto.add(s)
            added.append(s)


def brute_groups(rows, k, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append((i, {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(x), find(i)) for i, x in sets)


def near_copies(n=90, seed=4):
    rng = random.Random(seed)
    base = [[f"b{rng.randrange(9000)}" for _ in range(80)] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9000)}"
        if rng.random() < 0.2:
            w = w[:rng.randrange(4, 20)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k,percent,block", [(4, 85, 1500), (4, 85, 5), (5, 80, 4)])
def test_jaccard_groups(spark, docs, k, percent, block):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.similar_groups(df, k, percent, block).collect())) == brute_groups(rows, k, percent)
    if block == 1500:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, jaccard.similar_groups(docs, k, percent).collect())) == brute_groups(rows, k, percent)


def test_links_through_rows_without_an_id(spark):
    w = [f"n{i}" for i in range(100)]
    mid, end = w[:30] + ["x"] + w[31:], w[:30] + ["x"] + w[31:70] + ["y"] + w[71:]
    far = [f"m{i}" for i in range(50)]
    rows = [(5, w), (None, mid), (None, mid), (9, end), (None, far), (None, far[:49] + ["z"]), (7, far[:3])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard.similar_groups(df).collect()), key=str)
    assert got == sorted([(5, 97, 5), (None, 97, 5), (None, 97, 5), (9, 97, 5), (None, 47, None), (None, 47, None), (7, 1, 7)], key=str)
    alone = df.filter("doc_id is not null")
    assert {r.component_id for r in jaccard.similar_groups(alone).collect()} == {5, 9, 7}


def test_components_of_stars_and_chains(spark, monkeypatch):
    rng = random.Random(2)
    links = [(0, i) for i in range(1, 3000)] + [(9000, i) for i in range(3000, 6000)] + [(i, i + 1) for i in range(20000, 20040)]
    links += [(2999, 5000)] + [(rng.randrange(30000, 30500), rng.randrange(30000, 30500)) for _ in range(300)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    want = sorted((x, find(x)) for x in linked)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    for hubs in (1000, 1):
        monkeypatch.setattr(components, "HUBS", hubs)
        assert sorted(map(tuple, components.components(df, "a", "b").collect())) == want


def test_a_hub_does_not_meet_its_links_in_one_task(spark):
    links = spark.createDataFrame([(0, i) for i in range(1, 10001)], "u long, v long").repartition(8)
    rows = components.with_least(links, 10000)
    assert rows.rdd.glom().map(len).filter(lambda n: n > 0).max() <= 1300
    assert rows.filter("m = 1").count() == 10000


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(8)
    for percent in (80, 85, 95):
        for n in (1, 2, 5, 7, 13, 40, 200, 1500):
            for _ in range(8):
                x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                drop = rng.integers(0, max(1, n * (100 - percent) // 100) + 1)
                y = np.concatenate([x[drop:], rng.integers(0, 2**63, 3 * n, dtype=np.uint64)])
                while 100 * (len(x) - drop) < percent * len(np.union1d(x, y)) and len(y) > len(x) - drop:
                    y = y[:-1]
                y = np.unique(y)
                if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
                    assert len(np.intersect1d(jaccard.signatures(x, percent), jaccard.signatures(y, percent)))


def test_similar_pairs_share_a_signature_in_any_order_of_shingles():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        for n in (1, 6, 20, 300):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = n * (100 - percent) // 200
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(x, y)) < percent * len(np.union1d(x, y)):
                continue
            every = np.union1d(x, y)
            for _ in range(5):
                level = rng.integers(1, 4, len(every))
                level[~np.isin(every, np.intersect1d(x, y))] = rng.integers(0, 2)  # 0: in one set only
                sign = [jaccard.signatures(s, percent, level[np.searchsorted(every, s)]) for s in (x, y)]
                assert len(np.intersect1d(*sign))
                assert all((level[np.searchsorted(every, s)] > 0).all() for s in sign)


def test_levels_count_the_texts_of_a_shingle(spark):
    rows = [(" ".join(f"{g}{j}" for j in range(9)),) for g, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 130)) for _ in range(n)]
    levels = jaccard.common_shingles(spark.createDataFrame(rows, "text string").repartition(3), 4)
    at = {t[0][0]: set(levels.of(jaccard.sets_of(*joined([t[0].encode()]), 4)[0]).tolist()) for t in rows}
    assert at == {"a": {0}, "b": {1}, "c": {1}, "d": {2}, "e": {4}}


def test_texts_that_only_share_a_passage_are_not_gathered(spark, monkeypatch):
    rng = random.Random(6)
    line = [f"line{i}" for i in range(16)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(70)] + line)) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " end") for i in range(10)]
    kept, publish = {}, jaccard.publish

    def counted(df, name):
        out = publish(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "publish", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.similar_groups(df).collect())) == brute_groups(rows, 4, 85)
    assert kept["cluster-members"] == 20


def test_a_family_is_linked_in_few_walks_of_the_tree(monkeypatch):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, len(base) - n, replace=False), rng.integers(0, 2**63, n, dtype=np.uint64)]))
            for n in rng.integers(0, 40, 250)]
    sets.sort(key=len)
    walks, similar = [], jaccard.PrefixTree.similar
    monkeypatch.setattr(jaccard.PrefixTree, "similar", lambda tree, s, wanted: walks.append(len(wanted)) or similar(tree, s, wanted))
    alike = np.array([[100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) for y in sets] for x in sets])
    for asks in (None, [i % 3 == 0 for i in range(250)]):
        walks.clear()
        groups = jaccard.link_all(sets, list(range(250)), 85, asks)
        want = jaccard.Groups(list(range(250)))
        for i, j in zip(*np.nonzero(alike)):
            if asks is None or asks[i] != asks[j]:
                want.join(int(i), int(j))
        assert [groups.find(i) for i in range(250)] == [want.find(i) for i in range(250)]
        assert 1 < groups.count < 250 and sum(walks) <= 250


def test_one_of_each(spark, odd_docs):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    want = sorted(i for i, _, g in brute_groups(rows, 5, 80) if i == g)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.filter("doc_id is null").count() == 2


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (7, 7)] + [(300, rng.randrange(301, 340)) for _ in range(60)]
    df = spark.createDataFrame(links + [(None, 5)], "a long, b long")
    got = dict(map(tuple, components.components(df, "a", "b").collect()))
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[100] == 100
    assert {got[b] for a, b in links if a == 300} == {300}


def nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0])**2).sum(1))
    d[ids == q] = np.inf
    order = np.lexsort((ids, d))
    return [(i, d[o]) for i, o in [(ids[o], o) for o in order[:k]] if np.isfinite(d[o])]


def test_curve_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 12))
    x = centres[rng.integers(0, 5, 400)] + 0.1 * rng.normal(size=(400, 12))
    x[50:120] = x[50]  # copies: ties
    ids = np.arange(400)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    bad = [(900, None), (1000, [0.0] * 12), (1100, [float("nan")] + [1.0] * 11), (1200, [None] + [1.0] * 11),
           (1300, [1.0, 2.0]), (None, [1.0] * 12), (1400, [float("inf")] + [1.0] * 11), (100, x[100].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    for options in ({}, {"block_rows": 60, "chunk_rows": 2}):
        got = curves.search(df, **options).collect()
        assert {r.query_id for r in got} == {0, 100, 200, 300}
        for q in (0, 100, 200, 300):
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            want = nearest(ids, x, q)
            assert [m[0] for m in mine] == list(range(1, 11)) and [m[1] for m in mine] == [w[0] for w in want]
            assert np.allclose([m[2] for m in mine], [w[1] for w in want], rtol=0, atol=1e-12)
    windows = curves.search(df, complete=False).collect()  # on clusters the windows do most of it
    found = sum(r.vec_id in {w[0] for w in nearest(ids, x, r.query_id)} for r in windows)
    assert found >= 0.5 * 40


def test_hilbert_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = curves.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_repeated_rows_share_one_list_of_spans(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    sizes = []
    for copies in (1, 50):
        rows = [(1, passage)] + [(2, passage + " own words")] * copies
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        spans = substrings.repeated_windows(substrings._keyed(df, "doc_id")).collect()
        sizes.append(sorted(len(r.spans) for r in spans))
        assert {r[2] for r in substrings.remove_repeats(df).collect()} == {0, 40}
    assert sizes[0] == sizes[1]
