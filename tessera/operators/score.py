"""Prediction scoring: per-row matches and the aggregate metrics record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_answer, ends_with_trailing_mark, py_strip, token_count

METRIC_COLUMNS = ("accuracy", "containment", "no_answer", "recall_exact", "precision_exact",
                  "f1_score_exact", "recall_containment", "precision_containment",
                  "f1_score_containment")


def score_rows(df: DataFrame, answer: str = "answer", prediction: str = "predict_answer",
               strict_reference: bool = True) -> DataFrame:
    """Per row the normalised target and prediction, the no-answer, containment
    (target inside the uncleaned prediction) and exact (cleaned prediction equals target)
    flags, and the token counts the metrics add up.

    ``strict_reference``: predicted tokens are counted only for predictions that ended in a
    trailing mark (as the original did); ``False`` counts every non-empty prediction."""
    target = F.lower(py_strip(answer))
    pred = F.coalesce(F.lower(py_strip(prediction)), F.lit(""))  # a missing prediction is no answer
    out = (df.withColumn("target", target).withColumn(prediction, pred)
           .withColumn("_clean", clean_answer(F.col(prediction))))
    nonempty = F.col(prediction) != ""
    counted = (nonempty & ends_with_trailing_mark(F.col(prediction))) if strict_reference else nonempty
    n_target = token_count(F.col("target"))
    return (out
            .withColumn("no_answer", ~nonempty)
            .withColumn("containment_match", F.contains(F.col(prediction), F.col("target")))
            .withColumn("exact_match", F.col("_clean") == F.col("target"))
            .withColumn("expected_tokens", n_target)
            .withColumn("predicted_tokens", F.when(counted, token_count(F.col("_clean"))).otherwise(0))
            .withColumn("correct_exact_tokens", F.when(F.col("exact_match"), n_target).otherwise(0))
            .withColumn("correct_containment_tokens",
                        F.when(F.col("containment_match"), n_target).otherwise(0))
            .drop("_clean"))


def _prf(correct, expected, predicted):
    recall = F.try_divide(correct, expected)
    precision = F.try_divide(correct, predicted)
    f1 = F.try_divide(F.lit(2.0) * recall * precision, recall + precision)
    zero = correct == 0  # no correct token: (0, 0, 0) instead of the original crash
    z = F.lit(0.0)
    return (F.when(zero, z).otherwise(recall), F.when(zero, z).otherwise(precision),
            F.when(zero, z).otherwise(f1))


def metrics(scored: DataFrame) -> DataFrame:
    """One row with accuracy, containment and no-answer rates and micro
    token recall / precision / F1 for exact and containment matches.  Values are unrounded
    (see ``rounded_record``); a ratio over an empty denominator is NULL."""
    # Counters start at 0, as in a loop over the rows (a SUM over no rows is NULL).
    sums = scored.agg(
        F.count("*").alias("n"),
        F.count_if("exact_match").alias("exact"),
        F.count_if("containment_match").alias("contained"),
        F.count_if("no_answer").alias("empty"),
        F.coalesce(F.sum("expected_tokens"), F.lit(0)).alias("expected"),
        F.coalesce(F.sum("predicted_tokens"), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum("correct_exact_tokens"), F.lit(0)).alias("correct_exact"),
        F.coalesce(F.sum("correct_containment_tokens"), F.lit(0)).alias("correct_containment"))
    re_, pe, fe = _prf(F.col("correct_exact"), F.col("expected"), F.col("predicted"))
    rc, pc, fc = _prf(F.col("correct_containment"), F.col("expected"), F.col("predicted"))
    return sums.select(
        F.try_divide("exact", "n").alias("accuracy"),
        F.try_divide("contained", "n").alias("containment"),
        F.try_divide("empty", "n").alias("no_answer"),
        re_.alias("recall_exact"), pe.alias("precision_exact"), fe.alias("f1_score_exact"),
        rc.alias("recall_containment"), pc.alias("precision_containment"),
        fc.alias("f1_score_containment"))


def rounded_metrics(record: DataFrame) -> DataFrame:
    """The metrics as they are written: rounded to three decimals (half to even on
    the exact binary value, as Python formats it), times 100, ``no answer`` with a space.

    The value times 2^83 is put together from two long integers, so the rounding is exact."""
    def shown(name: str) -> F.Column:
        big = F.col(name) * F.lit(float(1 << 30))
        high, low = F.floor(big), F.floor((big - F.floor(big)) * F.lit(float(1 << 53)))
        whole = high.cast("decimal(20,0)") * F.lit(1 << 53).cast("decimal(17,0)") + low.cast("decimal(17,0)")
        scaled = whole * F.lit(1000).cast("decimal(5,0)")
        unit, half = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (83, 82))
        rest = scaled % unit
        below = ((scaled - rest) / unit).cast("bigint")
        up = (rest > half) | ((rest == half) & (below % 2 == 1))
        return ((below + up.cast("int")) / F.lit(1000.0) * 100).alias(name.replace("no_answer", "no answer"))

    return record.select(*[shown(c) for c in METRIC_COLUMNS])
