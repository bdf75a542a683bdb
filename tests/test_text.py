"""Column string functions vs. the plain-Python definitions they stand for."""
import ast
import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T

WS = T.PY_WHITESPACE


def _rand_strings(n, seed=7):
    rnd = random.Random(seed)
    alphabet = list("abcXYZ 09.,;:-)(_+") + list(WS) + ["é", "ß", "İ", "ǆ", "​", "<jats:p>", "</jats:p>"]
    return [None, "", " ", "\t x 　"] + [
        "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def _col(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def _apply(spark, values, fn):
    rows = _col(spark, values).select("i", fn(F.col("v")).alias("r")).collect()
    return {r.i: r.r for r in sorted(rows)}


def test_py_strip_matches_python(spark):
    vals = _rand_strings(300)
    got = _apply(spark, vals, T.py_strip)
    for i, v in enumerate(vals):
        assert got[i] == (None if v is None else v.strip()), repr(v)


def test_token_count_matches_split(spark):
    vals = [v for v in _rand_strings(200) if v is not None]
    got = _apply(spark, vals, T.token_count)
    for i, v in enumerate(vals):
        assert got[i] == len(v.split(" ")), repr(v)


def test_capitalize_first_upper_rest_lower(spark):
    vals = ["what HAS x", "", "a", "ÉCOLE Normale", "1st THING"]
    got = _apply(spark, vals, T.capitalize)
    assert got[0] == "What has x"
    for i, v in enumerate(vals):
        assert got[i] == v.capitalize()


def _py_sanitize(x):
    if not x:
        return None
    x = re.sub(T.JATS_TAG, " ", x).strip()
    return " ".join(x.split())


def test_sanitize_matches_python(spark):
    vals = _rand_strings(300, seed=11) + ["<jats:p></jats:p>", "<jats:title>A</jats:title>  b\n\nc"]
    got = _apply(spark, vals, T.sanitize_abstract)
    for i, v in enumerate(vals):
        assert got[i] == _py_sanitize(v), repr(v)


def _py_clean(p):
    if p and p[-1] in T.ANSWER_TRAILING:
        return p[:-1].strip()
    return p


def test_clean_answer_matches_python(spark):
    vals = [v for v in _rand_strings(300, seed=3) if v is not None] + ["abc.", "abc. .", "x-", "(", "a b;"]
    got = _apply(spark, vals, T.clean_answer)
    for i, v in enumerate(vals):
        assert got[i] == _py_clean(v), repr(v)


def test_coerce_na_and_digits(spark):
    vals = ["NA", "nan", "", "x", None, "N/A"]
    got = _apply(spark, vals, T.coerce_na)
    assert [got[i] for i in range(len(vals))] == [None, None, None, "x", None, None]
    got = _apply(spark, ["123", "0001", "²²", "12a", "", " 1"], T.is_decimal_digits)
    assert [got[i] for i in range(6)] == [True, True, False, False, False, False]


def test_digits_of_every_script(spark):
    """Differential test over every number character."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nd", "No", "Nl")]
    labels = chars + [a + b for a, b in zip(chars, chars[7:])] + ["٢٠٢٠", "-²", "12", "x1", ""]
    decimal, digits = _apply(spark, labels, T.is_decimal_digits), _apply(spark, labels, T.is_digits)
    value = _apply(spark, labels, T.digits_value)
    for i, s in enumerate(labels):
        assert (decimal[i], digits[i]) == (s.isdecimal(), s.isdigit()), s
        if s.isdecimal():
            assert int(value[i]) == int(s)


LISTS = [["R1", "R2"], [], ["R'1", "R2"], ['a "b"'], ["it's \"x\"", "back\\slash"], ["é, ]", "['"], [None, "None"]]


def test_list_literals(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LISTS)], "i int, v array<string>")
    text = df.select("i", T.list_literal("v").alias("t"))
    assert all(ast.literal_eval(r.t) == LISTS[r.i] for r in text.collect())
    assert {r.i: r.v for r in text.select("i", T.parse_id_list("t").alias("v")).collect()} == dict(enumerate(LISTS))
    odd = spark.createDataFrame([("[ 'R1' , \"R2\", ]",), (None,)], "v string")
    assert [r[0] for r in odd.select(T.parse_id_list("v")).collect()] == [["R1", "R2"], None]
    with pytest.raises(Exception, match="not a list literal"):
        spark.createDataFrame([("['R1",)], "v string").select(T.parse_id_list("v")).collect()
