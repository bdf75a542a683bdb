"""Dataset statistics over a finalized dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_count

# --- fixed values: measurement names ------------------------------------------------------
MEASUREMENTS = (
    "number_of_rows",
    "number_of_unique_categories",
    "number_of_unique_predicate_labels",
    "avg_tokens_of_predicate_labels",
    "avg_tokens_of_object_labels",
    "avg_tokens_of_abstracts",
    "number_of_abstracts_over_510_token(not unique)",
)
LONG_ABSTRACT_TOKENS = 510
# ---------------------------------------------------------------------------------------------


def general_stats(df: DataFrame, category: str = "Category", predicate: str = "PredicateLabel",
                  label: str = "ObjectLabel", abstract: str = "PaperAbstract") -> DataFrame:
    """One aggregate pass, reshaped to (Measurement, Value) rows."""
    one = df.agg(
        F.count("*").cast("double").alias("m0"),
        F.count_distinct(category).cast("double").alias("m1"),
        F.count_distinct(predicate).cast("double").alias("m2"),
        F.avg(token_count(predicate)).alias("m3"),
        F.avg(token_count(label)).alias("m4"),
        F.avg(token_count(abstract)).alias("m5"),
        F.count_if(token_count(abstract) > LONG_ABSTRACT_TOKENS).cast("double").alias("m6"))
    pairs = ", ".join(f"'{m}', m{i}" for i, m in enumerate(MEASUREMENTS))
    return one.selectExpr(f"stack({len(MEASUREMENTS)}, {pairs}) AS (Measurement, Value)")


def category_share(df: DataFrame, category: str = "Category", sort: bool = False,
                   decimals: int | None = None) -> DataFrame:
    """Per category its share of rows in percent, ``count / rows * 100``
    (``decimals=2`` rounds as the original shows it)."""
    counts = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("_c"))
    # The window runs over the per-category counts: one row per category, a bounded set.
    total = F.sum("_c").over(Window.partitionBy())
    share = F.col("_c") / total * 100
    share = share if decimals is None else F.round(share, decimals)
    out = counts.select("category", share.alias("percentage_of_data"))
    return out.orderBy(F.desc("percentage_of_data")) if sort else out
