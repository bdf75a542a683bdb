"""Stage tables in and out.

Between stages tables are Parquet with explicit schemas.  CSV import/export keeps the old
layout (header, no index, list columns written as Python list literals) for exchange with
tools that expect it; the training sets are JSON lines partitioned by question word and
split, and the single-object legacy training file can still be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import coerce_na, list_literal, parse_id_list
from .records import csv_quotes, json_quotes, read_records

# --- fixed values: stage schemas --------------------------------------------------------------
FIELD_PAPERS_SCHEMA = ("ResearchFieldId string, ResearchFieldLabel string, n_papers bigint, "
                       "PaperIds array<string>")
FLAT_SCHEMA = "ResearchFieldId string, ResearchFieldLabel string, PaperId string, PaperTitle string"
STATEMENT_ROWS_SCHEMA = (FLAT_SCHEMA + ", Contribution string, PredicateLabel string, "
                         "ObjectLabel string, PaperAbstract string")
TRAINING_SCHEMA = ("ord bigint, context string, question string, answer string, "
                   "answer_start int, answer_end int, question_word string, split string")
MANIFEST_SCHEMA = "inputs string, rows bigint"
OPEN_SETS = 64  # training sets that a writing task keeps open; with more of them it sorts its rows
EMPTY_WORD = "_none"  # folder of the question variant without a question word
EVAL_SCHEMA = ("abstract string, question string, answer string, predict_answer string, "
               "exact_match boolean, containment_match boolean")
LEGACY_KEY = r'^[\s,{]*"(\w+)"\s*:\s*\['                        # a set begins
LEGACY_ROW = r'(?s)^[\s,{]*(?:"\w+"\s*:\s*\[)?\s*\[(.*)\z'  # a row, without its last bracket
# ---------------------------------------------------------------------------------------------


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def content_digest(df: DataFrame) -> str:
    """A digest of the rows of ``df`` whatever their order: their number, and the xor and the sum
    of two 64-bit hashes a row.  One pass, one row of result."""
    values = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    row = df.select(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b")).agg(
        F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{names}|{row['n']}|{row['a']}|{row['b']}"


def _manifest(spark: SparkSession, path: str):
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}.manifest").collect()  # one row by construction
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0] if rows else None


def _write_manifest(spark: SparkSession, path: str, inputs: str, rows: int | None) -> None:
    (spark.createDataFrame([(inputs, rows)], MANIFEST_SCHEMA).coalesce(1)
     .write.mode("overwrite").json(f"{path}.manifest"))


def resumable_stage(spark: SparkSession, path: str, inputs: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage table at ``path``: read if an earlier run finished it from the same ``inputs`` (a
    digest), made and written otherwise.

    Beside the table lies its manifest, a record of the inputs and the number of rows.  It is
    voided before the table is written and filled after the writer has committed, so a run that
    dies in between leaves no table that counts as finished; one whose files lost rows since is
    made anew too."""
    done = _manifest(spark, path)
    if done is not None and done["inputs"] == inputs and done["rows"] is not None:
        kept = read_stage(spark, path)
        if kept.count() == done["rows"]:
            return kept
    _write_manifest(spark, path, inputs, None)
    write_stage(make(), path)
    made = read_stage(spark, path)
    _write_manifest(spark, path, inputs, made.count())
    return made


def read_stage(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; array<string> columns become list literals (``['R1', 'R2']``)."""
    cols = [(list_literal(F.col(f.name)) if isinstance(f.dataType, ArrayType) else F.col(f.name))
            .alias(f.name) for f in df.schema.fields]
    (df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"')
     .csv(path))


def import_csv(spark: SparkSession, path: str, schema: str | StructType,
               coerce_missing: bool = False) -> DataFrame:
    """Read a stage CSV with an explicit schema; array<string> columns are parsed from list
    literals.  ``coerce_missing`` turns NA-like spellings of string columns ('NA', 'nan',
    'null', ...) into NULL as the pandas reader did (H15); off by default, so a label that
    is literally "NA" stays text.

    Fields may hold line feeds, and still a file is read by as many tasks as it has byte
    ranges (see ``records``).  A quote inside a quoted field is written twice, as
    ``export_csv`` does; records end with a line feed, which a carriage return may precede.
    Each file begins with a header; empty lines are no rows.  The layout does not tell an empty
    text from a missing one: both are NULL."""
    target = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    text_schema = StructType([
        StructField(f.name, StringType(), True) if isinstance(f.dataType, ArrayType) else f
        for f in target.fields])
    records = (read_records(spark, path, "\n", csv_quotes)
               .filter((F.col("start") > 0) | (F.col("no") > 0))  # the header
               .select(F.regexp_replace("text", r"\r\z", "").alias("text")).filter("text <> ''"))
    raw = records.select(F.from_csv("text", text_schema.simpleString(),
                                    {"multiLine": "true", "escape": '"'}).alias("row")).select("row.*")

    def column(f):
        if isinstance(f.dataType, ArrayType):
            return parse_id_list(f.name)
        if coerce_missing and isinstance(f.dataType, StringType):
            return coerce_na(f.name)
        return F.col(f.name)

    return raw.select(*[column(f).alias(f.name) for f in target.fields])


def write_training(df: DataFrame, path: str) -> None:
    """A5: JSON lines, one folder per question word and split (partition pruning on read).
    An empty folder value would come back as NULL, so the empty word has a code.

    A text stands in as many rows as it has labels and question words, so the files are
    compressed (gzip, its fast level), and a task writes its sets side by side instead of
    sorting its rows, whole texts, by folder."""
    coded = F.when(F.col("question_word") == "", EMPTY_WORD).otherwise(F.col("question_word"))
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(OPEN_SETS))
    try:
        (df.withColumn("question_word", coded).write.mode("overwrite").option("compression", "gzip")
         .option("zlib.compress.level", "BEST_SPEED").partitionBy("question_word", "split").json(path))
    finally:
        conf.set(key, before)


def read_training(spark: SparkSession, path: str, question_word: str | None = None) -> DataFrame:
    """Read the training sets back; a question-word filter prunes folders."""
    df = spark.read.schema(TRAINING_SCHEMA).json(path)
    if question_word is not None:
        df = df.filter(F.col("question_word") == (question_word or EMPTY_WORD))
    word = F.when(F.col("question_word") == EMPTY_WORD, "").otherwise(F.col("question_word"))
    return df.withColumn("question_word", word)


def read_legacy_training(spark: SparkSession, path: str) -> DataFrame:
    """A6 for the single-object file ``{"training_set": [[...5]], "evaluation_set": [...]}``:
    rows (split, context, question, answer, answer_start, answer_end).

    The file is cut behind every closing bracket outside strings, so many tasks read one
    object, on one line or on many.  A row belongs to the set whose key is the last before it."""
    records = read_records(spark, path, "]", json_quotes)
    keyed = records.withColumn("name", F.regexp_extract("text", LEGACY_KEY, 1))
    names = (keyed.filter("name <> ''").groupBy("file")  # one row a file, as many names as the object has keys
             .agg(F.array_sort(F.collect_list(F.struct("start", "no", "name"))).alias("names")))
    place = F.struct("start", "no", F.lit("\U0010ffff").alias("name"))
    before = F.filter("names", lambda x: x <= place)
    body = F.concat(F.lit("["), F.regexp_extract("text", LEGACY_ROW, 1), F.lit("]"))
    rows = (keyed.filter(F.col("text").rlike(LEGACY_ROW)).join(F.broadcast(names), "file")
            .select(F.element_at(before, -1)["name"].alias("name"), F.from_json(body, "array<string>").alias("r")))
    split = F.when(F.col("name") == "training_set", "training").when(F.col("name") == "evaluation_set", "evaluation")
    return rows.withColumn("split", split).filter("split IS NOT NULL").select(
        "split", F.get("r", 0).alias("context"), F.get("r", 1).alias("question"),
        F.get("r", 2).alias("answer"),
        F.get("r", 3).try_cast("double").cast("int").alias("answer_start"),
        F.get("r", 4).try_cast("double").cast("int").alias("answer_end"))


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """The per-row evaluation table as ``write_eval`` wrote it."""
    return import_csv(spark, path, EVAL_SCHEMA)


def write_eval(scored: DataFrame, path: str) -> None:
    """The per-row evaluation table as CSV."""
    (scored.select("abstract", "question", "answer", "predict_answer", "exact_match",
                   "containment_match")
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one-row metrics record as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
