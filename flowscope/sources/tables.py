"""Reading and appending the telemetry tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.schema import TABLES


def read_table(
    spark: SparkSession,
    name: str,
    path: str,
    columns: list[str] | None = None,
    source: str = "parquet",
    **options: str,
) -> DataFrame:
    """A telemetry table with its fixed schema; only ``columns`` reach the scan."""
    schema = TABLES[name]
    df = spark.read.format(source).schema(schema).options(**options).load(path)
    return df.select(*(columns or schema.fieldNames()))


def jdbc_options(
    name: str, url: str, partitions: int | None = None, bounds: tuple[int, int] | None = None
) -> dict[str, str]:
    """Options to read a telemetry table from a database in parallel.

    Tables with a topology id are split on it, into equal ranges over ``bounds``.
    """
    options = {"url": url, "dbtable": name}
    schema = TABLES[name]
    if partitions and "topology_id" in schema.fieldNames():
        low, high = bounds or (0, partitions)
        options |= {
            "partitionColumn": "topology_id",
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, name: str, url: str, **kwargs) -> DataFrame:
    """A telemetry table from a database, cast to its fixed schema."""
    df = spark.read.format("jdbc").options(**jdbc_options(name, url, **kwargs)).load()
    return df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]])


def write_table(df: DataFrame, name: str, path: str, mode: str = "overwrite") -> None:
    """Writes a telemetry table with its column types."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
    typed.write.mode(mode).parquet(path)


def append_assignments(rows: DataFrame, path: str, time: str = "time", batch: str | None = None) -> None:
    """Appends ``time, topologies, assignment`` rows, partitioned by batch and day.

    A run that names its ``batch`` may be repeated: it overwrites what it wrote before.
    """
    rows.select(
        F.col(time).cast(T.TimestampType()).alias("time"),
        "topologies",
        "assignment",
        F.col(time).cast("date").alias("day"),
    ).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch or uuid.uuid4().hex}")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    parts = [T.StructField("batch", T.StringType()), T.StructField("day", T.DateType())]
    return spark.read.schema(T.StructType([*TABLES["assignment"].fields, *parts])).parquet(path).drop("batch")
