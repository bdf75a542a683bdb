"""QA rows, reproducible stratified train/evaluation split and question variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import answer_span_regex, span_start, word_pattern
from .common import computed, publish

# --- fixed values ---------------------------------------------------------------------------
QUESTION_WORDS = ("what", "which", "how", "")
TRAINING, EVALUATION = "training", "evaluation"
SPLIT_RATIO = 0.74
SMALL_PREDICATE_ROWS = 10
# ---------------------------------------------------------------------------------------------


def qa_rows(df: DataFrame, label: str = "ObjectLabel", text: str = "PaperAbstract",
            keep=("ord", "PaperAbstract", "PredicateLabel", "ObjectLabel"),
            literal: bool = True) -> DataFrame:
    """(context, predicate, answer) rows with the answer's code-point span
    ``StartIndex``/``EndIndex`` (NULL when it is not found as a whole word).  ``literal``
    matches the label as text (JVM-side); ``False`` uses it as a raw Python pattern, as the
    original did (Arrow UDF)."""
    if not literal:
        span = answer_span_regex(label, text)
        return df.select(*keep, span["start"].alias("StartIndex"), span["end"].alias("EndIndex"))
    # pattern and match once a row, however often the offsets are used above
    rows = df.select(*keep, F.col(label).alias("_label"), F.col(text).alias("_text"))
    rows = computed(rows, "_pattern", word_pattern("_label"))
    rows = computed(rows, "StartIndex", span_start("_label", "_text", F.col("_pattern")))
    return rows.select(*keep, "StartIndex", (F.col("StartIndex") + F.char_length("_label")).alias("EndIndex"))


def stratified_split(df: DataFrame, by: str = "PredicateLabel", key: str = "ord",
                     ratio: float = SPLIT_RATIO, min_rows: int = SMALL_PREDICATE_ROWS,
                     seed: int = 42, bucket_digits: int = 3) -> DataFrame:
    """Add ``split``.  A predicate with fewer than ``min_rows`` rows goes to
    training whole; otherwise rows are ordered by ``md5(seed|key)`` and the first
    ``bround(ratio * n)`` go to training, the rest to evaluation.  Rows without a predicate
    are left out (see ``split_dropped``).

    Only (predicate, key) is read to find where each predicate is cut (``predicate_cuts``); the
    cuts are published, one row a predicate, and every row is then compared with its
    predicate's cut where it lies.  Rows with one key go to one side together."""
    cuts = publish(predicate_cuts(df, by, key, ratio, min_rows, seed, bucket_digits), "split-cuts")
    here = F.struct(_order_key(key, seed).alias("h"), F.col(key).alias("k"))
    train = F.col("_whole") | F.coalesce(here <= F.col("_cut"), F.lit(False))
    return (df.join(cuts.withColumnsRenamed({"whole": "_whole", "cut": "_cut"}), by)
            .withColumn("split", F.when(train, TRAINING).otherwise(EVALUATION))
            .select(*df.columns, "split"))


def _order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def predicate_cuts(df: DataFrame, by: str = "PredicateLabel", key: str = "ord", ratio: float = SPLIT_RATIO,
                   min_rows: int = SMALL_PREDICATE_ROWS, seed: int = 42, bucket_digits: int = 3) -> DataFrame:
    """(``by``, whole, cut): whether the predicate goes to training as a whole, and the last
    (order key, key) of its training part (null: none).

    Two levels, so that a predicate with a third of all rows is not ranked by one task: rows
    are counted per predicate and bucket, the leading hex digits of the order key; the counts
    tell the bucket of the cut; ``row_number`` runs inside that bucket only."""
    data = (df.filter(F.col(by).isNotNull()).select(by, F.col(key).alias("_k"), _order_key(key, seed).alias("_h"))
            .withColumn("_b", F.substring("_h", 1, bucket_digits)))
    data = publish(data, "split-order")
    counts = data.groupBy(by, "_b").agg(F.count("*").alias("_c"))
    per_pred = Window.partitionBy(by)
    counts = counts.select(by, "_b", "_c", (F.sum("_c").over(per_pred.orderBy("_b")) - F.col("_c")).alias("_before"),
                           F.sum("_c").over(per_pred).alias("_n"))
    counts = counts.withColumn("_rank", F.bround(F.lit(float(ratio)) * F.col("_n"), 0).cast("long") - F.col("_before"))
    whole = counts.groupBy(by).agg((F.max("_n") < min_rows).alias("whole"))
    cut = counts.filter((F.col("_n") >= min_rows) & (F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_c")))
    local = Window.partitionBy(by, "_b").orderBy("_h", "_k")
    last = (data.join(cut.select(by, "_b", "_rank"), [by, "_b"]).withColumn("_r", F.row_number().over(local))
            .filter("_r = _rank").select(by, F.struct(F.col("_h").alias("h"), F.col("_k").alias("k")).alias("cut")))
    return whole.join(last, by, "left")


def split_dropped(df: DataFrame, by: str = "PredicateLabel") -> DataFrame:
    """Rows left out of the split because their predicate is missing."""
    return df.agg(F.count_if(F.col(by).isNull()).alias("dropped"))


def split_sizes(split_df: DataFrame) -> DataFrame:
    """Rows per split."""
    return split_df.groupBy("split").agg(F.count("*").alias("n"))


def question_variants(df: DataFrame, words=QUESTION_WORDS, predicate: str = "PredicateLabel"
                      ) -> DataFrame:
    """One row per question word with ``question = word + ' ' + predicate + ' ?'``
    (the empty word keeps its leading space).  A generator, not a join."""
    return (df.withColumn("question_word", F.explode(F.array(*[F.lit(w) for w in words])))
            .withColumn("question", F.concat(F.col("question_word"), F.lit(" "),
                                             F.col(predicate), F.lit(" ?"))))


def first_appearance_order(df: DataFrame, by: str = "PredicateLabel", key: str = "ord"
                           ) -> DataFrame:
    """the original output order (predicates by first appearance, then row order), as a
    sort applied only on request."""
    first = df.groupBy(by).agg(F.min(key).alias("_first"))
    return df.join(first, by).orderBy("_first", key).drop("_first")
