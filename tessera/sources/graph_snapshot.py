"""Graph snapshots: resources and statements as tables (the service the original paged
through is replaced by a dump of it).

Statements may come nested, as the service returns them (``subject{id}``,
``predicate{id,label}``, ``object{id,label}``), or flat; both read to the flat form the
operators use.  Writing partitions statements by predicate, so a predicate filter prunes
whole folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import read_in_order

# --- fixed values: snapshot schemas --------------------------------------------------------
RESOURCE_SCHEMA = "id string, label string, classes array<string>"
NESTED_STATEMENT_SCHEMA = ("subject struct<id:string>, predicate struct<id:string,label:string>, "
                           "object struct<id:string,label:string>")
FLAT_STATEMENT_COLUMNS = ("subject_id", "predicate_id", "predicate_label", "object_id",
                          "object_label")
# ---------------------------------------------------------------------------------------------


def flatten_statements(df: DataFrame) -> DataFrame:
    """Nested statements -> (subject_id, predicate_id, predicate_label, object_id,
    object_label); a flat frame passes through."""
    if "subject" in df.columns and isinstance(df.schema["subject"].dataType, StructType):
        return df.select(F.col("subject.id").alias("subject_id"),
                         F.col("predicate.id").alias("predicate_id"),
                         F.col("predicate.label").alias("predicate_label"),
                         F.col("object.id").alias("object_id"),
                         F.col("object.label").alias("object_label"))
    return df.select(*FLAT_STATEMENT_COLUMNS)


def read_resources(spark: SparkSession, path: str, fmt: str = "parquet", ordered: bool = False) -> DataFrame:
    """Resources of a snapshot; ``ordered`` (Parquet only) adds ``ord``, the row's position in the
    source, by which the last of several rows of an id wins."""
    if ordered:
        if fmt != "parquet":
            raise ValueError("the order of rows is known for Parquet only")
        return read_in_order(spark, path, RESOURCE_SCHEMA)
    return spark.read.schema(RESOURCE_SCHEMA).format(fmt).load(path)


def read_statements(spark: SparkSession, path: str, fmt: str = "parquet",
                    nested: bool = False) -> DataFrame:
    """Flat statements from a snapshot (``nested=True`` for the service's nested layout)."""
    r = spark.read.format(fmt)
    if nested:
        r = r.schema(NESTED_STATEMENT_SCHEMA)
    return flatten_statements(r.load(path))


def write_statements(statements: DataFrame, path: str) -> None:
    """Flat statements as Parquet partitioned by predicate id."""
    (flatten_statements(statements).write.mode("overwrite").partitionBy("predicate_id")
     .parquet(path))
