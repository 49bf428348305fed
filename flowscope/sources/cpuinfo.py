"""Processor description files, one text per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.functions.params import mhz_to_hz
from flowscope.functions.text import key_of, value_of

# The line keys read from a description.
PROCESSOR_KEY = "processor"
MODEL_KEY = "model name"
MHZ_KEY = "cpu MHz"


def read_cpuinfo(spark: SparkSession, path: str) -> DataFrame:
    """``host, body`` from ``<path>/<host>/<file>`` or ``<path>/host=<host>/<file>``."""
    host = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:host=)?([^/]+)/[^/]+$", 1)
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return texts.select(host.alias("host"), F.col("value").alias("body"))


def parse_cpuinfo(texts: DataFrame) -> DataFrame:
    """Cores of each host: ``host, processor, model_name, speed_hz``.

    A core starts at its ``processor`` line.  A processor number that appears
    twice is one core, described by its last block.
    """
    blocks = F.split("body", rf"(?m)^(?=\s*{PROCESSOR_KEY}\s*:)")
    core = texts.select("host", F.posexplode(blocks).alias("position", "block")).filter(
        F.trim("block") != ""
    )
    parsed = core.select(
        "host",
        "position",
        _line_value(PROCESSOR_KEY).cast("int").alias("processor"),
        F.coalesce(_line_value(MODEL_KEY), F.lit("")).alias("model_name"),
        F.coalesce(mhz_to_hz(_line_value(MHZ_KEY)), F.lit(0).cast("long")).alias("speed_hz"),
    ).filter(F.col("processor").isNotNull())
    last = F.max_by(F.struct("model_name", "speed_hz"), "position").alias("__core")
    return (
        parsed.groupBy("host", "processor").agg(last).select("host", "processor", "__core.*")
    )


def _line_value(key: str) -> Column:
    """Value of the block's last line with this key, null without one."""
    lines = F.filter(F.split("block", r"\r?\n"), lambda line: key_of(line) == key)
    return value_of(F.try_element_at(lines, F.lit(-1)))


def host_cpu_totals(cores: DataFrame) -> DataFrame:
    return cores.groupBy("host").agg(
        F.count(F.lit(1)).cast("int").alias("cores"), F.sum("speed_hz").alias("total_hz")
    )
