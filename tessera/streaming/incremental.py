"""Incremental application of the row-wise stages with Structured Streaming.

The original runs once over a finished snapshot, and so does the batch form of every
operator.  When statement rows arrive as new Parquet files, the row-wise stages (prune,
containment flag and filter, categorisation, spans, scoring) can be applied to just the new
files: the same DataFrame functions run on a streaming frame, and the checkpoint gives
exactly-once output files.  Stages that need all rows at once (keep-last de-duplication,
the stratified split, aggregates) stay batch jobs over the accumulated table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_stage(spark: SparkSession, source: str, schema: str | StructType,
                 stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Run ``stage`` over the Parquet files arriving in ``source`` and append the result to
    ``sink``; ``checkpoint`` must be on shared storage.  ``available_now`` processes what is
    there and stops (a scheduled incremental batch); otherwise it keeps running."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = (stage(stream).writeStream.format("parquet").outputMode("append")
              .option("path", sink).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def stream_metrics(spark: SparkSession, source: str, schema: str | StructType, out: str,
                   checkpoint: str, strict_reference: bool = True,
                   available_now: bool = True) -> StreamingQuery:
    """Keep the scoring metrics up to date while prediction files arrive in ``source``.

    The token and match counters are a streaming aggregation (kept in the state store under
    ``checkpoint``); after every micro-batch the complete one-row record is rewritten to
    ``out`` as JSON.  Once all files are in, the record equals ``score.metrics`` over them."""
    from ..operators import score

    stream = spark.readStream.schema(schema).parquet(source)
    record = score.metrics(score.score_rows(stream, strict_reference=strict_reference))

    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").json(out)

    writer = (record.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
