"""Answer span and word flag vs. Python's re (label taken literally)."""
import re

from pyspark.sql import functions as F

from tessera.functions.spans import LABEL_PATTERN, answer_span, contains_word, token_index_at
from tessera.sources.fixtures import text_rows

from .conftest import SF001


def _py_span(label, text):
    if label is None or text is None:
        return None
    match = re.search(LABEL_PATTERN.format(re.escape(label)), text, re.I)
    return match.span() if match else None


CASES = [
    ("word", "a word here"), ("word", "swordfish word"), ("Word", "WORD"), ("x", "😀 x y"),
    ("cafe", "café cafe"), ("a_b", "a_b a"), ("c++", "I like c++ a lot"), ("c++", "c++x"),
    ("(b)", "a(b)c"), ("(b)", "a (b) c"), ("a\\Eb", "x a\\Eb y"), ("two", "one\ntwo"),
    ("end.", "the end. Next"), ("end.", "the end.x"), ("ab", "ab ab ab"), ("", "  hello"),
    ("", "!!!"), ("ſ", "s"), ("résumé", "RÉSUMÉ x"), ("é", "é é"), (None, "x"), ("x", None),
]


def test_span_edge_cases(spark):
    df = spark.createDataFrame(CASES, "l string, t string")
    got = df.select(answer_span("l", "t").alias("s"), contains_word("l", "t").alias("w")).collect()
    for (label, text), row in zip(CASES, got):
        want = _py_span(label, text)
        have = None if row.s is None else (row.s.start, row.s.end)
        assert have == want, (label, text)
        if label is not None and text is not None:
            assert row.w == (want is not None), (label, text)


def test_span_on_documents(spark):
    rows = text_rows(spark, SF001).select("ObjectLabel", "PaperAbstract",
                                          answer_span("ObjectLabel", "PaperAbstract").alias("s"))
    n = 0
    for r in rows.collect():
        want = _py_span(r.ObjectLabel, r.PaperAbstract)
        have = None if r.s is None else (r.s.start, r.s.end)
        assert have == want, r.ObjectLabel
        n += 1
    assert n == 400


def _py_tokens(text):
    return [(m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", text)]


def test_token_index_matches_python_tokens(spark):
    texts = ["Hello, world! It's 2024.", "  lead space", "a　b", "über-cool ok"]
    rows = []
    for t in texts:
        for p in range(-1, len(t) + 1):
            rows.append((t, p))
    df = spark.createDataFrame(rows, "t string, p int")
    got = df.select("t", "p", token_index_at(F.col("t"), F.col("p")).alias("k")).collect()
    for r in got:
        toks = _py_tokens(r.t)
        want = next((i for i, (s, e) in enumerate(toks) if s <= r.p < e), None)
        assert r.k == want, (r.t, r.p)


def test_raw_regex_mode_matches_python_re(spark):
    from tessera.functions.spans import LABEL_PATTERN, answer_span_regex, contains_word_regex

    cases = [("c++", "I like c++ a lot"), ("a.c", "xx abc yy"), ("(b", "a (b c"), ("wor.", "a word"),
             ("x", None), (None, "x"), ("ab|cd", "zz cd zz"), ("é", "É é")]
    df = spark.createDataFrame(cases, "l string, t string")
    got = df.select(answer_span_regex("l", "t").alias("s"), contains_word_regex("l", "t").alias("w")).collect()
    for (label, text), row in zip(cases, got):
        if label is None or text is None:
            assert row.s is None and row.w is None
            continue
        try:
            m = re.compile(r"\b({0})\b".format(label), flags=re.IGNORECASE).search(text)
        except re.error:
            m = None
        want = None if m is None else m.span()
        assert (None if row.s is None else (row.s.start, row.s.end)) == want, label
        assert row.w == (want is not None)
