"""Token counts through a digest cache.

A count depends on two things only: the normalised content (a null text is the empty text)
and the tokenizer's version (library, library version, vocabulary file).  Both are digested
with SHA-256.  ``count_tokens`` looks the pairs up in a stored table, encodes every distinct
content that is missing exactly once, appends the new counts to the table, and answers from
the table.  One writer at a time per cache; a failed append leaves no partial count behind
(Parquet commits whole jobs), so a rerun only encodes what is still missing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenizers_cached import PieceCounter, WordIds, loaded, version_digest, vocabulary

LIMIT = 4096
VOCABULARY = "piece_bpe_32k.model"
CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent table is an empty one."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _kind(path: str) -> tuple[type, str]:
    return (PieceCounter, "sentencepiece") if path.endswith(".model") else (WordIds, "tokenizers")


def encode_counts(contents: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of each row's ``text`` by the library of the vocabulary file."""
    kind, _ = _kind(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(kind, path)
        for b in batches:
            counts = [coder.count(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())],
                                             names=["digest", "n_tokens"])

    return contents.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def digest(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def fill_cache(docs: DataFrame, cache: str, path: str) -> None:
    """Append the counts of all contents of ``docs`` that the cache lacks.  Copies are folded
    before the shuffle, so a text held by a third of all rows is one row per task."""
    spark = docs.sparkSession
    version = version_digest(path, _kind(path)[1])
    known = read_cache(spark, cache).filter(F.col("version") == version).select("digest")
    distinct = (docs.select(digest(F.col("text")).alias("digest"), F.col("text"))
                .groupBy("digest").agg(F.first("text").alias("text")))
    misses = distinct.join(known, "digest", "left_anti")
    (encode_counts(misses, path).select(F.lit(version).alias("version"), "digest", "n_tokens")
     .write.mode("append").parquet(cache))


def count_tokens(docs: DataFrame, cache: str, vocabulary_file: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every
    whole text, without begin, end or added special tokens.

    Null and empty texts have no bytes and no tokens.  Repeated rows stay; equal texts have
    equal counts; an empty table gives no rows; extra columns are ignored, whatever their
    names."""
    path = vocabulary_file or vocabulary(VOCABULARY)
    version = version_digest(path, _kind(path)[1])
    docs = docs.select("doc_id", "text")
    fill_cache(docs, cache, path)
    counts = (read_cache(docs.sparkSession, cache).filter(F.col("version") == version)
              .select("digest", "n_tokens"))
    keyed = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        digest(F.col("text")).alias("digest"))
    return (keyed.join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
