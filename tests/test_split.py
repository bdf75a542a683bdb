"""Stratified split: sizes per predicate, determinism, skew-safe ranking, variants."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import split as S


def _frame(spark, sizes):
    rows, k = [], 0
    for p, n in sizes.items():
        for _ in range(n):
            rows.append((k, p))
            k += 1
    return spark.createDataFrame(rows, "ord long, PredicateLabel string")


def test_split_sizes_per_predicate(spark):
    sizes = {"a": 9, "b": 10, "c": 25, "d": 50, "e": 75}
    out = S.stratified_split(_frame(spark, sizes))
    got = {(r.PredicateLabel, r.split): r["count"] for r in out.groupBy("PredicateLabel", "split").count().collect()}
    assert got[("a", "training")] == 9 and ("a", "evaluation") not in got
    assert got[("b", "training")] == round(0.74 * 10) == 7
    assert got[("c", "training")] == round(0.74 * 25) == 18
    assert got[("d", "training")] == 37
    assert got[("e", "training")] == round(0.74 * 75) == 56
    assert sum(got.values()) == sum(sizes.values())


def test_null_predicate_dropped_and_counted(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "ord long, PredicateLabel string")
    assert S.stratified_split(df).count() == 1
    assert S.split_dropped(df).first().dropped == 2


def test_two_level_rank_equals_plain_row_number(spark):
    df = _frame(spark, {"hot": 3000, "b": 40, "c": 12})
    out = S.stratified_split(df, bucket_digits=2)
    h = F.md5(F.concat(F.lit("42|"), F.col("ord").cast("string")))
    w = Window.partitionBy("PredicateLabel")
    plain = (df.withColumn("n", F.count("*").over(w))
             .withColumn("r", F.row_number().over(w.orderBy(h, "ord")))
             .withColumn("split", F.when((F.col("n") < 10) | (F.col("r") <= F.bround(F.lit(0.74) * F.col("n"), 0)),
                                         "training").otherwise("evaluation")))
    a = {(r.ord, r.split) for r in out.select("ord", "split").collect()}
    b = {(r.ord, r.split) for r in plain.select("ord", "split").collect()}
    assert a == b


def test_split_independent_of_partitioning(spark):
    df = _frame(spark, {"a": 200, "b": 31})
    one = {tuple(r) for r in S.stratified_split(df.repartition(1)).select("ord", "split").collect()}
    many = {tuple(r) for r in S.stratified_split(df.repartition(7, "ord")).select("ord", "split").collect()}
    assert one == many


def test_question_variants_keep_leading_space(spark):
    df = spark.createDataFrame([(1, "has x")], "ord long, PredicateLabel string")
    got = sorted(r.question for r in S.question_variants(df).collect())
    assert got == [" has x ?", "how has x ?", "what has x ?", "which has x ?"]


def test_first_appearance_order(spark):
    df = spark.createDataFrame([(5, "b"), (1, "a"), (3, "b"), (2, "c"), (4, "a")],
                               "ord long, PredicateLabel string")
    got = [r.ord for r in S.first_appearance_order(df).collect()]
    assert got == [1, 4, 2, 3, 5]


def test_question_words_share_one_split(spark):
    df = _frame(spark, {"a": 40, "b": 12, "c": 3})
    v = S.question_variants(S.stratified_split(df))
    per = v.groupBy("ord").agg(F.count_distinct("split").alias("k"), F.count("*").alias("n"))
    assert per.filter("k != 1 OR n != 4").count() == 0
