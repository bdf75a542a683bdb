"""Operators 11, 12 and 13 against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical, license_rules, licenses, periods
from tessera.llm.common import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- runs ------------------------------------------------------------------------------------

def runs_of(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)  # the smallest period of the stretch comes first
            i = max(j, i + 1)
    return sorted(((b, e, q) for (b, e), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def report(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    runs = runs_of(w)
    gone = {i for b, e, q in runs for i in range(b + q, e)}
    best = min(((b - e, b, q) for b, e, q in runs), default=None)
    listing = "".join(f"{b},{e - b},{q}\n" for b, e, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repetitive(rng):
    k = rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(k) for _ in range(rng.randrange(0, 200))]
    for _ in range(rng.randrange(0, 4)):
        p = rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 30, 31, 32, 33, 40, 63, 64, 65])
        base = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(p)]
        if rng.random() < 0.3:
            base = [0] * (p - 1) + [1]
        a = rng.randrange(len(w) + 1)
        w[a:a] = [base[i % p] for i in range(rng.randrange(3 * p, 7 * p + 3))]
    return w


def test_runs_of_words():
    rng = random.Random(11)
    for _ in range(150):
        docs = [repetitive(rng) for _ in range(rng.randrange(1, 5))]
        h = mix(np.array([x + 1 for d in docs for x in d], np.uint64))
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = [x.tolist() for x in periods.find_runs(h, first)]
        assert list(zip(*got)) == [(b + f, e + f, q) for d, f in zip(docs, first.tolist()) for b, e, q in runs_of(d)]


def test_synchronising_sets_agree_and_are_dense():
    rng = np.random.default_rng(3)
    for t in (8, 16, 32):
        word = rng.integers(0, 3, 400)
        h = np.concatenate([word, word[100:300], rng.integers(0, 3, 50), word])
        ids = mix(h.astype(np.uint64) + np.uint64(1))
        for step in (1, 2, 4, 8, 16, 32):
            if step < t:
                ids = periods._doubled(ids, step)
        sync = set(periods._synchronising(np.where(np.arange(len(h)) + t <= len(h), ids, periods._NONE), t).tolist())
        contexts = {}
        for i in range(len(h) - 2 * t + 1):
            assert contexts.setdefault(tuple(h[i:i + 2 * t]), i in sync) == (i in sync)
        for i in range(len(h) - 3 * t + 1):
            assert any(j in sync for j in range(i, i + t))
        assert len(sync) < 5 * len(h) / t


def test_run_report(spark, docs):
    rng = random.Random(5)
    extra = [(1000 + i, " ".join(f"v{x}" for x in repetitive(rng)), "en", "s", 0) for i in range(60)]
    extra += [(2000, "a " * 50000 + "b", "en", "s", 0), (2001, " ".join(map(str, range(3000))) * 6, "en", "s", 0),
              (2002, "x\ty z   " * 9, "en", "s", 0)]
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(5)
    got = sorted(map(tuple, periods.run_report(periods.with_planted_run(table)).collect()), key=str)
    want = sorted((report(r.doc_id, r.text) for r in table.collect()), key=str)
    assert got == want
    assert sum(r[1] for r in got) > 60 and max(r[4] or 0 for r in got) > 30


def test_collapse(spark):
    rows = [(1, "go " * 20 + "on", 61), (2, "a b c", 5), (3, None, None), (4, "", 0)]
    out = {r.doc_id: r for r in periods.collapse(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert out[1].text == "go on" and out[1].n_chars == 5
    assert out[2].text == "a b c" and out[3].text is None and out[4].text == ""


# ---- licenses --------------------------------------------------------------------------------

def base(doc_id, text):
    w = TERM.findall(low(text))
    at = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w))
                if w[i:i + len(p.split())] == p.split())
    return (doc_id, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None,
            ",".join(sorted({label for _, label in at})))


def all_hits(text):
    """Every rule on every text, without the keywords."""
    words = TERM.findall(low(text))
    normal = "".join(w + " " for w in words)
    starts, at = {}, 0
    for i, w in enumerate([*words, ""]):
        starts[at] = i
        at += len(w) + 1
    out, n = [], 0
    for level, group in enumerate(license_rules.GROUPS):
        for label, _, pattern in group:
            for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?= )", normal):
                out.append((starts[m.start()], starts[m.end() + 1], level, n, label))
            n += 1
    stays = []
    for h in sorted(out, key=lambda h: (h[2], h[0] - h[1], h[0], h[3])):
        if not any((o[0] <= h[0] and h[1] <= o[1]) or (o[0] < h[1] and h[0] < o[1] and o[2] < h[2]) for o in stays):
            stays.append(h)
    return sorted(stays)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0",
    "Released under the MIT License. mit license MIT licence",
    "This work is licensed under the GNU General Public License, version 3 or (at your option) any later version.",
    "CC BY-NC-SA 4.0 and CC BY 4.0; CC-BY, cc0 1.0; https://creativecommons.org/licenses/by-nd/4.0/",
    "SPDX-License-Identifier: GPL-2.0-or-later AND SPDX-License-Identifier: Foo-1",
    "Copyright (c) 2019 Nobody. All rights reserved. Proprietary and confidential",
    "GNU Lesser General Public License v2.1, LGPLv3, GPL-2.0+, AGPL-3.0, GNU GPL",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the University nor the names of its contributors may be used to endorse or promote products",
    "CC BY cc bÿ xcc by cc byx mit licenseé ünï mit license", "BSD 3-Clause License", "Mozilla Public License 2.0 MPL 2.0 mpl",
    "the name of the game with no hint", "gnu general gnu general public license general public license gnu", "", None,
]


def test_license_scan(spark, docs):
    rng = random.Random(2)
    rows = [(500 + i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    rows += [(600 + i, " ".join(rng.choice([*TEXTS[:12], "plain words in between"]) for _ in range(rng.randrange(2, 40))), "en", "s", 0) for i in range(30)]
    rows += [(700, "mit license cc by " * 3000, "en", "s", 0)]
    table = docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(4)
    texts = {r.doc_id: r.text for r in table.collect()}
    got = licenses.license_report(table).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((base(r.doc_id, r.text) for r in table.collect()), key=str)
    for r in got:
        labels = set(r.labels.split(",")) - {""}
        assert set(r.base_labels.split(",")) - {""} <= labels and 0 <= r.score <= 1 and (r.score > 0) >= (r.n_base > 0)
    for r in licenses.scan(table).filter("doc_id >= 500").collect():
        want = all_hits(texts[r.doc_id])
        assert [(h.start, h.end, h.priority, h.rule, h.label) for h in r.licenses] == want


def test_labels_of_the_method(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licenses.license_report(df).collect()}
    assert labels[0] == "apache,apache-2.0" and labels[1] == "mit"
    assert labels[2] == "gpl,gpl-3.0-or-later"
    assert labels[3] == "cc-by,cc-by-4.0,cc-by-nc-sa-4.0,cc-by-nd,cc0-1.0"
    assert labels[4] == "gpl-2.0-or-later,spdx-other"
    assert labels[5] == "all-rights-reserved,copyright,proprietary"
    assert labels[10] == "bsd-3-clause" and labels[12] == "" and labels[14] == "" and labels[15] == ""


def test_rules_are_sound():
    rules = [r for g in license_rules.GROUPS for r in g]
    assert len(rules) > 200 and len(license_rules.GROUPS) == len(license_rules.WEIGHTS)
    for label, keys, pattern in rules:
        # a keyword that stands in an optional part would hide matches
        plain = re.sub(r"\((?:\?:)?[^()]*\)[?]", " ", re.sub(r"\((?:\?:)?[^()]*(?:\([^()]*\)[^()]*)*\)[?]", " ", pattern))
        for k in keys.split():
            assert re.search(rf"(?<![a-z0-9]){k}(?![a-z0-9])", plain), (label, keys)


# ---- search ----------------------------------------------------------------------------------

def brute(items, rows, k=20):
    w = [(i, TERM.findall(low(t))) for i, t in rows]
    w = [(i, t, Counter(t)) for i, t in w if t]
    nn, ll = len(w), sum(len(t) for _, t, _ in w)
    df = Counter(x for _, _, c in w for x in c)
    out = []
    for item, text in items:
        want = Counter(TERM.findall(low(text)))
        scored = []
        for i, t, c in w:
            m = 75 + (25 * len(t) * nn) // ll
            s = sum(n * math.floor(1000 * math.log((2 * nn + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m))
                    for x, n in want.items() if x in c)
            if s > 0:
                scored.append((-s, i is None, i, s))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, rank, r[2], r[3]) for rank, r in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells,parts,block", [(1 << 22, 3, 1 << 20), (1, 7, 400)])
def test_search(spark, odd_docs, monkeypatch, cells, parts, block):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    rng = random.Random(4)
    items = [(i, " ".join(f"W{rng.randrange(60)}" for _ in range(rng.randrange(1, 40)))) for i in range(12)]
    items += [(i, " ".join(["w1 w2, w3"] * i)) for i in range(20, 24)]
    items += [(30, None), (31, ""), (32, "nowhere else"), (33, "x"), (33, "x"), (34, "wörter 日本語"), (None, "one w1")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as score", "2 as key", "3 as doc_id")
    got = sorted(map(tuple, lexical.search(table, odd_docs.repartition(parts)).collect()), key=str)
    assert got == brute(items, [(r.doc_id, r.text) for r in odd_docs.collect()])


def test_shared_sums():
    rng = random.Random(8)
    for _ in range(20):
        pool = [f"t{i}" for i in range(rng.choice([3, 20, 200]))]
        common = rng.sample(pool, min(len(pool), 6))
        texts = [" ".join(common[:rng.randrange(0, 7)] + rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 25))]
        plan = lexical.build_plan(texts)
        values = np.array([[rng.randrange(1000) for _ in range(3)] for _ in plan.words], np.int64)
        by_word = dict(zip(plan.words, values))
        want = [sum(by_word[w] for w in t.split()) for t in texts]
        assert np.array_equal(lexical.accumulate(plan, values), np.array(want))
    same = lexical.build_plan(["a b c d e f g h"] * 1 + ["a b c d e f g h x", "a b c d y"])
    assert len(same.left) + len(same.parts) < 8 + 9 + 5  # fewer additions than terms


def test_ties_and_copies(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300, 0, -1)] + [(None, "same words here")] * 3 + [(400, "other"), (401, "more of it"), (402, "it")],
                                 "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert [(r.rank, r.doc_id) for r in lexical.search(items, docs).orderBy("rank").collect()] == [(i, i) for i in range(1, 21)]
