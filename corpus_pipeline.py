"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but
the last return the columns of ``documents``; ``run`` writes every stage's rows as Parquet
into the shared folder and reads them again for the next one.

* toxicity: rows whose score reaches ``toxicity.THRESHOLD`` go; the model learns from the
  table ``labels`` and the unfiltered ``documents``, outside the kept fold.
* near_duplicates: word 5-grams, Jaccard similarity of 0.8 or more; the smallest doc_id of
  each group stays.
* repeated_passages: words under 13-word windows that start in a smaller doc_id go; a
  document that loses all its words goes.
* source_mix: every row as often as the mix of sources takes it.
* packing: pieces of at most 4096 tokens in sequences.

No stage has an SQL form as a whole, so ``ORACLE_SQL`` is None; ``tests/llm`` runs the stages
against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, mixing, packing, substrings, toxicity
from tessera.llm.common import masked, publish


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the threshold.  A null text is scored as an empty one, equal texts get
    equal scores, repeated rows and rows with a null id are judged like all others; without
    labels of both kinds the score is the share of toxic labels.  An empty table stays empty;
    extra columns, also clashing ones, are kept."""
    lexicon, trees = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                                  spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, name = masked(docs)
    scored = toxicity.score(plain.withColumnRenamed(name["text"], "text"), lexicon, trees)
    return scored.filter("predicted = 0").drop("score", "predicted").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the smallest doc_id of their group.  Null, empty and wordless texts are in no group and
    stay; rows with a null id link others and stay themselves; repeated rows of one id stay
    together.  An empty table stays empty; extra columns, also clashing ones, are kept."""
    return jaccard.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the words under windows that start in a smaller doc_id; a changed text is its kept words
    joined by one space, with its n_chars; a row that loses all its words goes, one without
    words (null, empty) stays as it is, as does a text without repeats.  Repeated rows of one id
    are one document; extra columns, also clashing ones, are kept."""
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it.  A null source is one of its own, ordered last; a
    row without words gets the whole part of its source's copies; repeated rows get the same
    number each.  An empty table stays empty; extra columns, also clashing ones, are kept."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row (repeated rows each, null ids too) with their sequences; a null or
    empty text is one piece with the end id.  Extra columns are left out."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
