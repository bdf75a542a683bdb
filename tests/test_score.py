"""Scoring: per-row flags and metrics (E fixture values from FIXTURES.md)."""
from tessera.operators import score
from tessera.sources.fixtures import predictions

from .conftest import SF01


def test_fixture_metrics_strict_and_fixed(spark):
    rows = score.score_rows(predictions(spark, SF01))
    sums = rows.selectExpr("count_if(exact_match) e", "count_if(containment_match) c",
                           "count_if(no_answer) n", "sum(expected_tokens) x",
                           "sum(predicted_tokens) p", "sum(correct_exact_tokens) ce",
                           "sum(correct_containment_tokens) cc").first()
    assert tuple(sums) == (1200, 1600, 400, 4000, 800, 2400, 3200)
    m = score.metrics(rows).first()
    assert (m.accuracy, m.containment, m.no_answer) == (0.6, 0.8, 0.2)
    assert m.precision_exact == 3.0 and m.recall_exact == 0.6
    fixed = score.metrics(score.score_rows(predictions(spark, SF01), strict_reference=False)).first()
    assert fixed.precision_exact == 0.6


def test_no_correct_and_empty(spark):
    df = spark.createDataFrame([("a b", "zzz.")], "answer string, predict_answer string")
    m = score.metrics(score.score_rows(df)).first()
    assert (m.recall_exact, m.precision_exact, m.f1_score_exact) == (0.0, 0.0, 0.0)
    empty = spark.createDataFrame([], "answer string, predict_answer string")
    m = score.metrics(score.score_rows(empty)).first()
    assert m.accuracy is None and m.f1_score_exact == 0.0


def test_row_flags(spark):
    df = spark.createDataFrame([(" Dog ", " the DOG. "), ("dog", "dog;"), ("cat", ""), ("", "x")],
                               "answer string, predict_answer string")
    got = [(r.predict_answer, r.exact_match, r.containment_match, r.no_answer)
           for r in score.score_rows(df).collect()]
    assert got == [("the dog.", False, True, False), ("dog;", True, True, False),
                   ("", False, False, True), ("x", False, True, False)]


def test_rounded_metrics(spark):
    values = [0.0, 1.0, 1 / 3, 2 / 3, 0.0625, 0.1875, 0.3125, 0.4375, 0.0005, 0.1235, 0.9995, 0.5, 1e-9]
    rows = [tuple([v] * len(score.METRIC_COLUMNS)) for v in values] + [tuple([None] * len(score.METRIC_COLUMNS))]
    got = score.rounded_metrics(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in score.METRIC_COLUMNS)))
    assert "no answer" in got.columns
    want = [float("{:.3f}".format(v)) * 100 for v in values] + [None]
    assert [r["no answer"] for r in got.collect()] == want and [r["accuracy"] for r in got.collect()] == want


def test_missing_prediction_is_no_answer(spark):
    df = spark.createDataFrame([("a", None), ("a", "a")], "answer string, predict_answer string")
    rec = score.metrics(score.score_rows(df)).first()
    assert rec.no_answer == 0.5 and rec.accuracy == 0.5
