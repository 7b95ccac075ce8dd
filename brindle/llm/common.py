"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points outside space and x09-x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local folder only where none is set on a local master (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, _local[app], True)
    return "file://" + _local[app]


def store(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/brindle/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """``df`` with a broadcast hint if it is stored and has at most ``max_rows`` rows (of two
    longs or so, hence some 20 MB); otherwise as it is, so that Spark shuffles for the join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Whole texts go to Python in batches of at most ``rows``; a setting other than Spark's own is left."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
    return spark


def released(run):
    """``run`` over batches, after which the worker, which lives on, gives freed memory back."""

    @functools.wraps(run)
    def through(batches):
        yield from run(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return through


def input_parts(df: DataFrame) -> int:
    """Partitions that the scan of ``df`` has; follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())
