"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Column names differ by case in feeds, and GBK text needs the JVM's own charsets, which also
# report bad bytes as U+FFFD instead of failing the job.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.session.timeZone": "UTC",
}

_CARRIED = (
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.coalescePartitions.enabled",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.execution.arrow.maxRecordsPerBatch",
)


def working_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session on the same Spark context with the library's settings; the caller's is left alone."""
    mine = spark.newSession()
    for key in _CARRIED:
        value = spark.conf.get(key, None)
        if value is not None:
            mine.conf.set(key, value)
    for key, value in {**SETTINGS, **settings}.items():
        mine.conf.set(key, value)
    return mine


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, as in tests, may leave that unset; then a folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rowtally-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


SHUFFLE_BYTES = 128 << 20


def size_shuffles(session: SparkSession, input_bytes: int) -> None:
    """Start shuffles with partitions of about 128 MB of input; AQE merges what turns out small."""
    at_least = int(session.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(at_least, -(-input_bytes // SHUFFLE_BYTES))
    session.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write a frame as a table and go on from there: later uses read it, and lost executors do not matter."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
