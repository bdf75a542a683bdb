"""Operators 2, 3, 7 and 8: contracts, exact parts, held-out quality."""
import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, logbilinear, mixing, toxicity

SF01 = "/root/testdata/sf0.01"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def targets_by_hand(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("leaf", [4096, 3])
def test_mix(spark, docs, leaf, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = docs.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    got = mixing.mix(docs, leaf_rows=leaf).collect()
    assert len(got) == len(rows)
    want = targets_by_hand(sizes)
    source = {r.doc_id: r.source for r in rows}
    taken = collections.Counter()
    largest = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 * largest[s] + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7), leaf_rows=leaf).collect()))


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(0)
    size, part = rng.integers(1, 100, 40).astype(float), rng.random(40)
    mean = np.zeros(40)
    for seed in range(400):
        out, left = mixing.pivot(size, part, np.random.default_rng(seed).random(41))
        assert abs((size * out).sum() - (size * part).sum()) < 1e-6
        assert sum(0 < p < 1 for p in out) <= 1 and (left < 0 or 0 < out[left] < 1)
        mean += out / 400
    assert np.abs(mean - part).max() < 0.12


def test_settled_keeps_words_and_passes_long_rests_on():
    rng = np.random.default_rng(1)
    size = np.sort(np.concatenate([rng.integers(1, 100, 200), [9000, 5000, 700]]).astype(float))[::-1].copy()
    mean = np.zeros(len(size))
    for seed in range(400):
        draws, more = np.random.default_rng(seed).random((2, len(size) + 1))
        out = mixing.settled(size, np.full(len(size), 0.4), draws, more)
        assert abs((size * out).sum() - 0.4 * size.sum()) < 1e-6
        left = [i for i, p in enumerate(out) if 0 < p < 1]
        assert len(left) <= 1 and all(size[i] < 100 for i in left)
        mean += out / 400
    assert np.abs(mean[3:] - 0.4).max() < 0.15


@pytest.mark.parametrize("sf,off", [("sf0.001", 0.1), ("sf0.01", 0.01), ("sf0.1", 0.002)])
def test_mix_meets_its_targets(spark, sf, off):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = (mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source")
           .agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect())
    assert max(abs(r.taken - r.target) / r.target for r in got if r.target) <= off


def test_mixed_documents(spark, odd_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    copies = collections.Counter((r.doc_id, r.text) for r in out.collect())
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(odd_docs).collect() if r.doc_id is not None and r.size}
    rows = collections.Counter((r.doc_id, r.text) for r in odd_docs.collect())
    for (i, t), n in rows.items():
        if i in taken:
            assert copies[i, t] == n * taken[i][0] // taken[i][1]


def test_lm_counts_are_exact(spark, docs):
    rows = docs.collect()
    got = collections.defaultdict(list)
    for r in logbilinear.score(docs, rounds=1, frequent=50).collect():  # most words take the join
        got[r.doc_id].append(r)
    c, ends = collections.Counter(), 0
    tokens = {r.doc_id: (r.text or "").encode().translate(LOW).split() for r in rows}
    for r in rows:
        if crc(r.doc_id, 7) != 2:
            c.update(tokens[r.doc_id])
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    assert sum(map(len, got.values())) == len(rows)
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
            assert abs(r.base_score - base) < 1e-6 * (1 + abs(base)) and r.score < 0


def test_lm_is_normalised():
    rng = np.random.default_rng(3)
    share = rng.random(logbilinear.CLASSES)
    scorer = logbilinear.Scorer(logbilinear.Model.start(share / share.sum()))
    every = np.arange(logbilinear.CLASSES)
    for a, b in ((0, 1), (5, logbilinear.END)):
        p = 10 ** scorer.log10(every, np.full_like(every, a), np.full_like(every, b))
        assert abs(p.sum() - 1) < 1e-4


def test_lm_is_normalised_over_learned_words():
    rng = np.random.default_rng(4)
    shape = np.sort(np.concatenate([rng.integers(0, logbilinear.SHAPES, 300), np.full(200, 7)]))
    c = rng.integers(100, 1000, 500)
    tree = logbilinear.Tree.of(shape, c, np.bincount(shape, c + 1.0, logbilinear.SHAPES) + 5)
    share = rng.random(logbilinear.CLASSES)
    model = logbilinear.Model.start(share / share.sum())
    nodes = rng.normal(0, 0.3, tree.start(model).shape).astype(np.float32)
    scorer = logbilinear.Scorer(model, tree, nodes)
    word = np.concatenate([np.arange(logbilinear.CLASSES), logbilinear.CLASSES + np.arange(500)])
    cls = np.concatenate([np.arange(logbilinear.CLASSES), logbilinear.OWN + shape])
    for a, b in ((0, 1), (logbilinear.OWN + 7, logbilinear.END), (logbilinear.CLASSES + 3, 5), (2, logbilinear.CLASSES + 499)):
        p = 10 ** scorer.log10(cls, np.full_like(cls, a), np.full_like(cls, b), word)
        assert abs(p.sum() - 1) < 1e-4


def test_lm_scores_of_class_contexts_are_those_of_every_context():
    rng = np.random.default_rng(6)
    share = rng.random(logbilinear.CLASSES)
    scorer = logbilinear.Scorer(logbilinear.Model.start(share / share.sum()))
    x1, x2 = rng.integers(0, logbilinear.CLASSES, (2, 300))
    h = logbilinear._mixed(scorer.R[x1], scorer.R[x2], *scorer.c)
    assert np.allclose(scorer.pairs[x1, x2], np.log(np.exp((h @ scorer.Q.T).astype(np.float64)).sum(axis=1)), atol=1e-5)


def test_lm_lookup_and_sums():
    rng = np.random.default_rng(5)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500), [0, 1, 2, 3]]).astype(np.uint64) * np.uint64(2))
    hashes = np.append(hashes, np.uint64((1 << 64) - 1))
    asked = np.concatenate([hashes, hashes[:-1] + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    for some in (hashes, hashes[:1], hashes[:0]):
        spot, hit = logbilinear.Lookup(some).find(asked)
        assert hit.tolist() == np.isin(asked, some).tolist() and (some[spot[hit]] == asked[hit]).all()
    at = rng.integers(0, 50, 400) * 1000
    rows = rng.random((400, 17), dtype=np.float32)
    key, where, got, times = logbilinear._sparse_sums(at, rows)
    want = np.zeros((50, 17))
    np.add.at(want, at // 1000, rows)
    assert (at[where] == key).all() and np.allclose(got, want[key // 1000], rtol=1e-5)
    assert times.tolist() == np.bincount(at // 1000)[key // 1000].tolist()


def test_lm_sums_of_many_rows_and_of_both_context_positions():
    rng = np.random.default_rng(7)
    at = np.concatenate([np.full(300, 5), rng.integers(0, 400, 900), np.repeat(np.arange(500, 540), 15)])
    at, rows = rng.permutation(at), rng.random((len(at), 17), dtype=np.float32)
    times = rng.integers(1, 3, len(at))
    key, where, got, n = logbilinear._sparse_sums(at, rows.copy(), times)
    want = np.zeros((540, 17))
    np.add.at(want, at, rows)
    assert np.allclose(got, want[key], rtol=1e-4) and (at[where] == key).all()
    assert n.tolist() == np.bincount(at, times)[key].tolist()
    for x in ([3, 4, 4, 9, 3, 7], [3]):
        x1 = np.array(x)
        x2 = np.concatenate([[8], x1[:-1]])
        x2[len(x) // 2] = 8  # a text begins
        g1, g2 = rng.random((2, len(x), 16), dtype=np.float32)
        want = np.zeros((10, 16))
        np.add.at(want, np.concatenate([x1, x2]), np.concatenate([g1, g2]))
        number, g, times = logbilinear._merged(x1, x2, g1.copy(), g2.copy())
        got = np.zeros((10, 16))
        np.add.at(got, number, g)
        assert np.allclose(got, want) and len(number) < 2 * len(x) + (len(x) == 1)
        assert np.bincount(number, times, 10).tolist() == np.bincount(np.concatenate([x1, x2]), minlength=10).tolist()


def test_lm_context_totals_compute_each_word_once(monkeypatch):
    rng = np.random.default_rng(8)
    c = rng.integers(100, 1000, 300)
    shape = np.sort(rng.integers(0, logbilinear.SHAPES, 300))
    tree = logbilinear.Tree.of(shape, c, np.bincount(shape, c + 1.0, logbilinear.SHAPES) + 5)
    share = rng.random(logbilinear.CLASSES)
    model = logbilinear.Model.start(share / share.sum())
    nodes = rng.normal(0, 0.3, tree.start(model).shape).astype(np.float32)
    nodes[-40:, :logbilinear.WIDTH] *= 400  # contexts that go to extremes
    scorer = logbilinear.Scorer(model, tree, nodes)
    x1, x2 = rng.integers(0, logbilinear.CLASSES + 300, (2, 20_000))
    h = logbilinear._mixed(scorer.R[x1], scorer.R[x2], *scorer.c).astype(np.float64)
    s = h @ scorer.Q.T.astype(np.float64)
    want = np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1)
    assert abs(s).max() > 100
    made = []
    rows = scorer._factors
    monkeypatch.setattr(scorer, "_factors", lambda x, *a: (made.append(len(x)), rows(x, *a))[1])
    assert np.allclose(scorer.context_totals(x1, x2), want, rtol=1e-5, atol=1e-4)
    assert sum(made) <= 2 * (logbilinear.CLASSES + 300)  # 18,500 contexts hold a learned word
    monkeypatch.setattr(logbilinear, "WIDE", 50)
    monkeypatch.setattr(logbilinear, "NARROW", 7)
    assert np.allclose(scorer.context_totals(x1, x2), want, rtol=1e-5, atol=1e-4)
    none = np.empty(0, np.int64)
    assert len(scorer.context_totals(none, none)) == 0 and len(scorer.context_totals(none[:0] + 1, none)) == 0


def test_lm_beats_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    held = [r for r in logbilinear.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language(spark, docs):
    table = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.collect()}
    held = [r for r in language.identify(table).collect() if r.held_out]
    assert len(held) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id, 4) == 2) for r in held)


def test_language_mixtures(spark):
    table = spark.read.parquet(f"{SF01}/documents.parquet").filter("length(text) > 800")
    langs, probs = language.learn(table)
    pick = {r.lang: r.text.lower() for r in table.filter("lang in ('en', 'fr')").collect()}
    from tessera.llm.common import joined
    half = (pick["en"][:800] + " " + pick["fr"][:300]).encode()
    best, share, size = language.infer(*joined([half, pick["fr"][:800].encode()]), probs)
    assert langs[best[0]] == "en" and size[0] >= 2 and 0.5 < share[0] < 0.95
    assert langs[best[1]] == "fr" and size[1] == 1


def test_unknown_languages(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in language.identify(odd_docs).collect()}
    for i in (62, 63, 64):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    nothing = odd_docs.withColumn("lang", odd_docs.lang.substr(100, 0)).selectExpr("*").drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    toxic = {"idiot", "moron", "stupid", "pathetic", "worthless", "scum", "trash", "loser", "clown", "disgusting"}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    plain = {r.doc_id: sum(w.strip(".,!?;:") in toxic for w in r.text.lower().split()) for r in docs.collect()}
    held = [i for i in got if got[i].held_out and i in marked]
    assert all(got[i].held_out == (crc(i, 4) == 2) for i in got)
    assert all(got[i].predicted == (got[i].score >= 0.3) and 0 <= got[i].score <= 1 for i in got)
    caught = [got[i].predicted for i in held if marked[i] and plain[i] > 1]
    assert np.mean(caught) > 0.9
    assert np.mean([got[i].predicted for i in held if not marked[i]]) < 0.05


def test_hidden_words_and_trees():
    turn = toxicity.Features({b"idiot": 5.0})
    from tessera.llm.common import joined
    x = turn.rows(*joined([b"you 1d10t! now", b"an idiot, you say", b"plain words here"]))
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert x[0, at["hidden_lexicon"]] > 0 and x[0, at["lexicon"]] == 0 and x[0, at["near_second_person"]] > 0
    assert x[1, at["lexicon"]] > 0 and x[2, at["lexicon"]] == 0
    rng = np.random.default_rng(0)
    x = rng.random((600, len(toxicity.FEATURES)))
    y = ((x[:, 0] > 0.6) & (x[:, 3] > 0.3)).astype(float)
    trees = toxicity.train(x[:400], y[:400], np.ones(400))
    assert np.mean((trees.score(x[400:]) > 0.5) == y[400:]) > 0.93
    m, level = toxicity.isotonic(np.array([3., 1, 2, 4]), np.array([0., 0, 1, 1]), np.ones(4))
    assert (np.diff(level) > 0).all() and (np.diff(m) > 0).all()


def test_lm_own_words_grow_with_the_corpus(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    counts = logbilinear.count_words(docs)
    words = {n: (logbilinear.vocabulary(c, 1, learned=20).learned >= 0).sum() + logbilinear.OWN
             for n, c in (("all", counts), ("some", logbilinear.count_words(docs.filter("doc_id % 8 = 0"))))}
    assert words["all"] == counts.filter("c >= 20").count() > 2 * words["some"]
    held = [[r for r in logbilinear.score(docs, learned=k).collect() if r.held_out] for k in (20, 1 << 40)]
    # own vectors predict better than shares of a class by length and last byte
    assert sum(r.score for r in held[0]) > sum(r.score for r in held[1])


def test_lm_words_are_normalised():
    lb, rng = logbilinear, np.random.default_rng(4)
    shape = np.sort(rng.integers(0, 5, 900))
    c = rng.integers(20, 900, 900)
    sums = 1 + np.bincount(shape, c + 1.0, lb.SHAPES) + rng.integers(0, 99, lb.SHAPES)
    tree, share = lb.Tree.of(shape, c, sums), rng.random(lb.CLASSES)
    model = lb.Model.start(share / share.sum())
    nodes = tree.start(model) + rng.normal(0, 0.3, (len(tree.mass), 2 * lb.WIDTH + 1)).astype(np.float32)
    # every class (a shape class: its rare words' cell) and every learned word, after learned words
    x = np.concatenate([np.arange(lb.CLASSES), lb.CLASSES + np.arange(900)])
    w = np.concatenate([np.arange(lb.CLASSES), lb.OWN + shape])
    p = 10 ** lb.Scorer(model, tree, nodes).log10(w, np.full_like(w, lb.CLASSES + 7), np.full_like(w, lb.CLASSES + 800), x)
    assert abs(p.sum() - 1) < 1e-4
    # at the start a word has its smoothed share of the class
    q = 10 ** lb.Scorer(model, tree, tree.start(model)).log10(w, np.zeros_like(w), np.zeros_like(w), x)
    k = 10 ** lb.Scorer(model).log10(w, np.zeros_like(w), np.zeros_like(w))
    assert np.allclose(q[lb.CLASSES:] / k[lb.CLASSES:], (c + 1) / sums[shape], rtol=1e-3)


def test_language_sets_of_four(spark):
    table = spark.read.parquet(f"{SF01}/documents.parquet").filter("length(text) > 600")
    langs, probs = language.learn(table)
    pick = {r.lang: r.text.lower()[:600] for r in table.collect()}
    four = [i for i, name in enumerate(langs) if name in pick][:4]
    from tessera.llm.common import joined
    text = " ".join(pick[langs[i]] for i in four)
    best, score, size, shares = language.infer_sets(*joined([text.encode(), pick[langs[four[0]]].encode()]), probs)
    assert size.tolist() == [4, 1] and set(np.flatnonzero(shares[0])) == set(four)
    assert abs(shares[0].sum() - 1) < 1e-6 and shares[0][four].min() > 0.1 and shares[1][four[0]] == 1
    # leaving out texts that can't improve changes nothing: each text alone, every set tried
    rows = [r.text.lower().encode() for r in table.limit(60).collect()] + [text.encode()]
    together = language.infer_sets(*joined(rows), probs)[2]
    assert together.tolist() == [best_set(r, probs) for r in rows]
    got = language.identify(table.limit(30)).collect()
    assert all(len(r.langs) == len(r.proportions) == r.n_langs and abs(sum(r.proportions) - 1) < 1e-6 for r in got)
    assert all(r.langs[0] == r.lang_pred and r.proportions == sorted(r.proportions, reverse=True) for r in got)


def best_set(text, probs):
    grams, starts, _ = language.word_grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    like = np.add.reduceat(probs[grams], starts, axis=0).astype(np.float64)
    like = np.exp(like - like.max(axis=1, keepdims=True))
    n, words = like.shape[1], np.array([len(like)])
    full, _ = language._em(like, np.full((1, n), 1 / n), np.array([0]), words, language.STEPS)
    order, values = np.argsort(-full[0], kind="stable"), []
    for k in range(1, n + 1):
        share = np.zeros((1, n))
        share[0, order[:k]] = full[0, order[:k]] + 1e-6
        _, total = language._em(like, share / share.sum(), np.array([0]), words, language.SET_STEPS if k > 1 else 0)
        values.append(total[0] - language.PENALTY * (k - 1) * np.log(len(like) + 1))
    return 1 + int(np.argmax(values))


def test_lexicon_ignores_the_layout(spark):
    texts = [(1, f"rude{i} vile") for i in range(40)] + [(0, f"kind{i} words") for i in range(40)]
    texts += [(1, "a longer vile text with many words " * 3 + f"x{i % 3}") for i in range(9)] + [(1, ""), (0, "")]
    df = spark.createDataFrame(texts, "toxic int, text string")
    shares = [sorted(map(tuple, toxicity._word_shares(df.repartition(n)).collect())) for n in (1, 4, 40)]
    assert shares[0] == shares[1] == shares[2]
    assert {r[0]: r[1:] for r in shares[0]}["vile"][0] >= 40
