"""Records that may span lines, read from one file by many tasks.

The text source cuts a file into byte ranges and gives every task whole pieces between
separators.  Whether a separator ends a record depends on the quotes before it in the file, so
the quotes of each range are counted first (one aggregate, one row a range); their running sum
tells every range if it begins inside quotes.  Then each range is cut into records by itself, and
what a border of ranges cut apart (at most one record a border) is put together again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import publish

PART_SCHEMA = "file string, start bigint, no bigint, text string, continues boolean, goes_on boolean"
PART_ROWS = 4096


def _cutter(separator: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        place, no, inside, first, held = None, 0, False, False, []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows)
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            names = ("file", "start", "no", "text", "continues", "goes_on")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("file", "start", "open", "quotes", "value")]
            for file, start, opens, n, value in zip(*columns):
                if (file, start) != place:
                    if held:
                        rows.append((*place, no, separator.join(held), first, True))
                    place, no, held = (file, start), 0, []
                    inside = first = opens
                held.append(value)
                inside ^= n % 2 == 1
                if not inside:
                    rows.append((*place, no, separator.join(held), first, False))
                    no, first, held = no + 1, False, []
                    if len(rows) >= PART_ROWS:
                        yield batch()
                        rows.clear()
        if held:
            rows.append((*place, no, separator.join(held), first, True))
        if rows:
            yield batch()

    return cut


def read_records(spark: SparkSession, path: str, separator: str, quotes: Callable[[Column], Column]) -> DataFrame:
    """(file, start, no, text): the records of the files at ``path``, published.  A record ends at
    a ``separator`` that an even number of quotes precedes in its file; ``quotes`` counts those of
    a piece (a text without separators).  (start, no), the byte range and the number in it, orders
    the records of a file.  An empty file has none, and quotes that never close make the rest of
    the file one record.

    The texts are read twice, once for the count, and written once; only records that a border
    of ranges cuts are shuffled.  Broadcast: one row per range.  Should the ranges of the two
    reads differ (the parallelism changed in between), the job fails instead of guessing."""
    pieces = (spark.read.option("lineSep", separator).text(path)
              .select("value", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("start"))
              .withColumn("quotes", quotes(F.col("value")).cast("bigint")))
    in_file = Window.partitionBy("file").orderBy("start")
    ranges = (pieces.groupBy("file", "start").agg(F.sum("quotes").alias("n"))
              .select("file", "start", (((F.sum("n").over(in_file) - F.col("n")) % 2) == 1).alias("open")))
    known = F.when(F.col("open").isNull(), F.raise_error(F.lit("byte ranges changed between two reads"))
                   .cast("boolean")).otherwise(F.col("open"))
    marked = pieces.join(F.broadcast(ranges), ["file", "start"], "left").withColumn("open", known)
    parts = publish(marked.mapInArrow(_cutter(separator), PART_SCHEMA), "records")

    # a cut record has its first part where one goes on that does not continue another
    cut = parts.filter("continues OR goes_on")
    order = Window.partitionBy("file").orderBy("start", "no")
    owner = F.last(F.when(~F.col("continues"), F.struct("start", "no")), ignorenulls=True).over(order)
    owned = cut.select("file", "start", "no", "continues").withColumn("owner", owner).drop("continues")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "no", "text"))), lambda x: x["text"])
    glued = (cut.join(owned, ["file", "start", "no"]).groupBy("file", "owner").agg(texts.alias("texts"))
             .select("file", "owner.start", "owner.no", F.array_join("texts", separator).alias("text")))
    return parts.filter("NOT (continues OR goes_on)").select("file", "start", "no", "text").unionByName(glued)


def csv_quotes(piece: Column) -> Column:
    """Quotes of a piece of CSV whose quoted fields write a quote twice."""
    return F.char_length(piece) - F.char_length(F.replace(piece, F.lit('"'), F.lit("")))


def json_quotes(piece: Column) -> Column:
    """Quotes of a piece of JSON that open or close a string."""
    return csv_quotes(F.regexp_replace(piece, r"(?s)\\.", ""))
