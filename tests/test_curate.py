"""Prune, keep-last, containment and category rules (hand-written edge rows)."""

from tessera.operators import curate
from tessera.operators.common import keep_last


def test_prune_edge_rows(spark):
    labels = [None, "", " ab ", "998", "999", "0001", " 12 ", "²²²", "1" * 40, "abc", "  a  "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "ord int, ObjectLabel string")
    kept = {r.ord for r in curate.prune_rows(df).collect()}
    # null reads as 'nan' (kept); '' and ' ab ' too short; 998 and 0001 below 999;
    # ' 12 ' is not all digits unstripped but is short after strip; '²²²' is kept (no crash)
    assert kept == {0, 4, 7, 8, 9}
    assert curate.pruned_count(df).first().pruned == len(labels) - len(kept)


def test_keep_last_nulls_equal_and_idempotent(spark):
    rows = [(1, "a", None, "x1"), (2, "a", None, "x2"), (3, "a", "k", "x3"), (4, None, None, "x4"),
            (5, None, None, "x5"), (6, "a", "k", "x6"), (0, "a", "k", "x0")]
    df = spark.createDataFrame(rows, "ord int, k1 string, k2 string, v string")
    out = keep_last(df, ["k1", "k2"])
    assert sorted(r.v for r in out.collect()) == ["x2", "x5", "x6"]
    again = keep_last(out, ["k1", "k2"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert out.columns == df.columns


def _cat(spark, rows, **kw):
    df = spark.createDataFrame(rows, "PredicateLabel string, ObjectLabel string")
    return [r.Category for r in curate.categorize(df, **kw).collect()]


def test_category_rules_in_order(spark):
    rows = [(" Has Research Problem ", "anything"), ("p", "999"), ("p", "1000"), ("p", "2099"),
            ("p", "2100"), ("p", "http://x"), ("p", "HTTP://x"), ("has location", "Paris"),
            (" has location", "Paris"), ("p", "-1,234.5"), ("p", "1.2.3"), ("p", "DNA"),
            ("p", "5 mg"), ("p", "one two three four"), ("p", "one two three four five"),
            ("p", "a  b"), (None, "zzz"), ("p", None)]
    got = _cat(spark, rows)
    assert got == ["research problem", "number", "year/date", "year/date", "number", "url",
                   "unknown", "location", "unknown", "number", "unknown", "acronym",
                   "unknown", "unknown", "sentence", "unknown", "unknown", "unknown"]


def test_category_pos_lexicon_and_fixed_mode(spark):
    pos = spark.createDataFrame([("red", "ADJ"), ("dog", "NOUN"), ("g", "NOUN"), ("t", "ADJ")],
                                "token string, pos string")
    rows = [("p", "red"), ("p", "dog"), ("p", "big dog"), ("p", "red cat"), ("p", "5 mg")]
    strict = _cat(spark, rows, pos=pos)
    assert strict == ["adj", "noun", "noun phrase", "adj phrase", "noun phrase"]
    fixed = _cat(spark, rows, pos=pos, strict_reference=False)
    assert fixed == ["adj", "noun", "noun phrase", "unknown", "count/measurement"]


def test_containment_is_three_valued(spark):
    df = spark.createDataFrame([("AbC", "xxabcxx"), ("q", "abc"), (None, "a"), ("a", None), ("", "z")],
                               "ObjectLabel string, PaperAbstract string")
    flags = [r.ObjectInAbstract for r in curate.flag_object_in_abstract(df).collect()]
    assert flags == [True, False, None, None, True]
    assert curate.keep_contained(curate.flag_object_in_abstract(df)).count() == 2


def test_finalize_order(spark):
    rows = [(1, "p1", "has location", "Berlin", "A trip to berlin."),
            (2, "p1", "has location", "Berlin", "A trip to berlin."),
            (3, "p1", "x", "ab", "ab ab"),
            (4, "p2", "x", "zzz", "nothing here")]
    df = spark.createDataFrame(rows, "ord int, PaperId string, PredicateLabel string, "
                                     "ObjectLabel string, PaperAbstract string")
    out = curate.finalize(df).collect()
    assert [(r.ord, r.Category) for r in out] == [(2, "location")]


def test_tagger_tokens_endings_and_edges(spark):
    from collections import Counter

    from tessera.operators import tagger

    said = ([("Running", "VERB")] * 2 + [("running", "NOUN")] * 2 + [("walking", "VERB"), ("king", "NOUN"), ("red", "ADJ"), ("sacred", "ADJ")]
            + [("wanted", "VERB"), (None, "ADJ"), ("", "ADJ"), ("x", None), ("né", "ADJ")])
    labelled = spark.createDataFrame(said, "token string, pos string").repartition(4)
    asked = ["running", "RED", "barking", "bored", "zed", "zzé", "Q", "", None, "red", "red"]

    counts = {}
    for token, pos in said:
        if token and pos:
            w = token.lower()
            for key in {("w", w), (3, w[-3:]), (2, w[-2:]), (1, w[-1:]), (0, "")}:
                counts.setdefault(key, Counter())[pos] += 1

    def tag(token):
        w = token.lower()
        for key in (("w", w), (3, w[-3:]), (2, w[-2:]), (1, w[-1:]), (0, "")):
            if key in counts:
                return min(counts[key].items(), key=lambda c: (-c[1], c[0]))[0]

    model = tagger.train(labelled)
    tokens = spark.createDataFrame([(t,) for t in asked], "token string")
    got = [tuple(r) for r in tagger.lexicon(model, tokens).collect()]
    assert sorted(got) == sorted((t, tag(t)) for t in {t for t in asked if t})
    empty = tagger.train(labelled.limit(0))
    assert empty.count() == 0 and tagger.lexicon(empty, tokens).count() == 0
    assert tagger.lexicon(model, tokens.limit(0)).count() == 0


def test_tagged_query_gives_all_four_labels(spark):
    from tessera.plans.queries import REGISTRY

    from .conftest import SF001

    got = {r.Category for r in REGISTRY["categorize_tagged"](spark, SF001).select("Category").distinct().collect()}
    assert got >= {"adj", "noun", "adj phrase", "noun phrase"}
