"""Session facts the library needs: a shared scratch folder and sane defaults."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a long-running cluster job should start with.  Broadcasts stay under
# Spark's own measured size limit, hot join keys are split at run time, and
# shuffle partitions are coalesced from a generous initial number.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own; a
    cluster session is refused, because executors cannot share a machine-local
    path.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="flowscope-")


def application_root(spark: SparkSession) -> str:
    """One folder an application below the shared one; removed when the driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _ROOTS:
        root = f"{shared_dir(spark)}/flowscope-{application}-{uuid.uuid4().hex[:8]}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[application] = root
    return _ROOTS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder."""
    return f"{application_root(spark)}/{label}-{uuid.uuid4().hex}"


_STORED: dict[tuple[str, str], str] = {}

# What a task takes of a shuffle while a table is stored.  Joins and sums of many short rows
# hold about twenty times as much, and Spark's 64 MB would let that grow with the input.
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
STORED_PART = "8m"


# Shuffle files of a write go as it ends.  They would else stay until the driver happens to
# collect its garbage, and the disk would hold those of all tables a query starts from.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` written once per application to the shared folder, then read back.

    Cuts the lineage of results many operators start from.  A lost executor
    costs a re-read, not a re-computation, and the file sizes give the
    optimizer real statistics for its join choices.
    """
    key = (spark.sparkContext.applicationId, label)
    if key not in _STORED:
        df = build()
        path = scratch_path(spark, "stored")
        with _settings(spark, {_ADVISORY: STORED_PART, _CLEANUP: "true"}):
            df.write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, however often it is used."""
    path = scratch_path(df.sparkSession, label)
    with _settings(df.sparkSession, {_CLEANUP: "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
