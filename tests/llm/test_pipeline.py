"""The whole pipeline, ``run()``, stage by stage against plain Python on whole tables."""
import collections
import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import packing, toxicity

from .test_joins import brute_groups, repeats
from .test_models import targets_by_hand
from .test_sketches_tokens_packing import check_packing

SF001 = "/root/testdata/sf0.001"


def planted(spark):
    """The documents of sf0.001 and: exact and near copies, a passage of 60 words in three clean
    documents, a copy of a toxic text, and rows without text, words or source."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = [r.doc_id for r in labels.filter("toxic = 1").orderBy("doc_id").collect()]
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    clean = [word() for _ in range(200)]
    passage = [word() for _ in range(60)]
    near = clean[:90] + ["changed"] + clean[91:]
    rows = [(9000, clean), (9001, clean), (9002, near)]
    rows += [(9010 + i, [word() for _ in range(80)] + passage + [word() for _ in range(40)]) for i in range(3)]
    rows = [(i, " ".join(w), "en", "src1") for i, w in rows]
    rows += [(9020, texts[bad[0]], "en", "src2"), (9030, None, None, None), (9031, "", "en", "src3"), (9032, " \n", "en", None)]
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], docs.schema)
    return docs.unionByName(more), labels, 9020


def test_run_against_plain_python(spark, tmp_path, monkeypatch):
    docs, labels, toxic_copy = planted(spark)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs, steps, publish = spark.read.parquet(f"{sf}/documents.parquet"), {}, corpus_pipeline.publish

    def recorded(df, name):
        steps[name] = publish(df, name)
        return steps[name]

    monkeypatch.setattr(corpus_pipeline, "publish", recorded)
    out = corpus_pipeline.run(spark, sf).collect()
    assert list(steps) == [name for name, _ in corpus_pipeline.STAGES[:-1]]
    given = {r.doc_id: r for r in docs.collect()}
    rows = {name: df.collect() for name, df in steps.items()}
    assert all(df.columns == docs.columns for df in steps.values())

    # toxicity: those below the threshold stay as they are
    scores = {r.doc_id: r.score for r in toxicity.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(map(str, rows["toxicity"])) == sorted(str(r) for i, r in given.items() if scores[i] < toxicity.THRESHOLD)
    left = {r.doc_id for r in rows["toxicity"]}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    assert toxic_copy not in left and {9000, 9001, 9002, 9010, 9011, 9012, 9030, 9031, 9032} <= left
    assert sum(i not in left for i, t in marked.items() if t) >= 0.9 * sum(marked.values())
    assert sum(i in left for i, t in marked.items() if not t) >= 0.95 * sum(1 - t for t in marked.values())

    # near duplicates: the smallest id of each group, and all without words
    groups = brute_groups([(r.doc_id, r.text) for r in rows["toxicity"]], 5, 80)
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(i for i, _, c in groups if c == i)
    left = {r.doc_id for r in rows["near_duplicates"]}
    assert 9000 in left and not {9001, 9002} & left

    # passages: what a smaller id already has goes from the text
    kept = {r.doc_id: r for r in rows["repeated_passages"]}
    for i, n, gone, digest in repeats([(r.doc_id, r.text) for r in rows["near_duplicates"]]):
        if n and gone == n:
            assert i not in kept
        elif gone:
            assert hashlib.sha256(kept[i].text.encode()).hexdigest() == digest and kept[i].n_chars == len(kept[i].text)
        else:
            assert kept[i] == given[i]
    assert len(kept[9010].text.split()) == 180 and len(kept[9011].text.split()) == len(kept[9012].text.split()) == 120

    # mix: whole copies of what came in, near the targets
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    copies = collections.Counter(map(str, rows["source_mix"]))
    for r in kept.values():
        n = len((r.text or "").encode().split())
        sizes[r.source] += n
        taken[r.source] += n * copies.pop(str(r), 0)
        longest[r.source] = max(longest[r.source], n)
    assert not copies
    for s, want in targets_by_hand(sizes).items():
        assert abs(taken[s] - want) <= 0.5 * longest[s] + 1e-6

    # packing: every row's ids once, in sequences that hold them
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = {r.doc_id: r.text or "" for r in rows["source_mix"]}
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == collections.Counter(r.doc_id for r in rows["source_mix"])
    used = check_packing(out, mixed, tokenizer)
    assert used <= -(-sum(r.length for r in out) // packing.MAX_TOKENS) + 1
