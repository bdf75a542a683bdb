"""Every operator and stage on empty tables, odd rows and clashing columns; the registry."""
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import (
    curves,
    fingerprints,
    jaccard,
    language,
    lexical,
    licenses,
    logbilinear,
    mixing,
    packing,
    periods,
    substrings,
    token_counts,
    toxicity,
)
from tessera.llm.common import shared_path
from tessera.llm.queries import REGISTRY


def operators(spark, labels):
    return {
        "fingerprint_edits": fingerprints.fingerprint_edits,
        "fingerprint": fingerprints.fingerprint,
        "toxicity": lambda d: toxicity.classify(d, labels),
        "mix": mixing.mix,
        "repeats": substrings.remove_repeats,
        "tokens": lambda d: token_counts.count_tokens(d, shared_path(spark, "cache")),
        "lm": lambda d: logbilinear.score(d, rounds=1),
        "language": language.identify,
        "jaccard": jaccard.similar_groups,
        "runs": periods.periodic_runs,
        "collapse": periods.collapse,
        "run_report": lambda d: periods.run_report(periods.with_planted_run(d)),
        "licenses": licenses.scan,
        "license_report": licenses.license_report,
    }


NAMES = ["fingerprint_edits", "fingerprint", "toxicity", "mix", "repeats", "tokens", "lm", "language", "jaccard", "runs",
         "collapse", "run_report", "licenses", "license_report"]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, i % 3 == 0 and 1 or 0) for i in range(40)] + [(None, None, 1), (3, 0, None), (3, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "1 as score", "'x' as text")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd_docs, labels, name):
    out = operators(spark, labels)[name](odd_docs).collect()
    assert len(out) == odd_docs.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, no_docs, labels, name):
    assert operators(spark, labels.limit(0))[name](no_docs).collect() == []


def test_empty_packing_and_search(spark, no_docs, odd_docs):
    assert packing.pack_documents(no_docs).collect() == []
    assert packing.pack_documents(odd_docs).count() >= odd_docs.count()
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert curves.search(vectors).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>").selectExpr("*", "1 as key", "2 as block")
    assert curves.search(one).collect() == []


def test_empty_lexical_search(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one a b"), (3, "one a b")], "item_id int, text string").selectExpr("*", "1 as score", "2 as rank")
    assert lexical.search(items, no_docs).collect() == []
    assert lexical.search(items.limit(0), odd_docs).collect() == []
    got = lexical.search(items, odd_docs).collect()
    assert {r.item_id for r in got} == {3} and len(got) % 2 == 0


def test_stages(spark, odd_docs, no_docs, labels, tmp_path):
    sf = str(tmp_path)
    for docs in (odd_docs, no_docs):
        docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        labels.write.mode("overwrite").parquet(f"{sf}/labels.parquet")
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            out.write.mode("overwrite").parquet(f"{sf}/{name}")
            out = spark.read.parquet(f"{sf}/{name}")
            if name != "packing":
                assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
                if name != "source_mix":
                    assert out.count() <= rows.count()
                rows = out
        assert (out.count() > 0) == (docs.count() > 0)


def test_registry():
    names = list(REGISTRY)
    assert [n for n in names if n.startswith("op")] == names and {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert set(REGISTRY) | {"pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5
