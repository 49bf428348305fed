"""Streams of receipts and samples, and running a stream to its present end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.schema import RECEIPT


def read_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_files: int | None = None,
    pattern: str = "*.parquet",
) -> DataFrame:
    """A stream of the parquet files in a folder.  ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need an instant; zone-less times are read in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def append_end_marker(
    spark: SparkSession, path: str, schema: T.StructType, last: dt.datetime, slot_length: str, delay: str, ts: str = "ts"
) -> None:
    """Ends the source in a folder, up to now: one more file with a row that has a time only.

    The time is that at which the watermark passes the slot that holds ``last``, the newest event,
    and no later, so that the next slot's events are still in time.  Streams that know markers
    emit what was open.  Write it once everything up to ``last`` is in the folder: files are read
    in the order of their writing.
    """
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != ts]
    row = spark.range(1).groupBy(F.window(F.lit(last).cast("timestamp"), slot_length).alias("__w")).count()
    row = row.select((F.col("__w.end") + F.expr(f"interval {delay}")).cast(schema[ts].dataType).alias(ts), *blank)
    row.select(*schema.names).coalesce(1).write.mode("append").parquet(path)


def receipts_from_json(messages: DataFrame, column: str = "value") -> DataFrame:
    """Receipts from json message bodies, e.g. the value of a Kafka stream."""
    body = F.from_json(F.col(column).cast("string"), RECEIPT)
    return messages.select(body.alias("r")).select("r.*")


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> None:
    """Processes everything available now and appends it to a parquet folder."""
    (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
        .awaitTermination()
    )
