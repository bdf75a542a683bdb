"""Readers for the parquet tables the engine is fed with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; column pruning and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_in_order(spark: SparkSession, path: str, schema: str | None = None, ord_col: str = "ord") -> DataFrame:
    """A Parquet table plus ``ord``: each row's position in the source, a struct (file, row) that
    compares like the rows of the files read one after the other, in the order of their names.
    It comes from the files' own metadata, so neither the layout of the scan (splits, tasks)
    nor what is filtered changes it, and nothing is sorted or shuffled to get it."""
    r = spark.read if schema is None else spark.read.schema(schema)
    position = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return r.parquet(path).select("*", position.alias(ord_col))
