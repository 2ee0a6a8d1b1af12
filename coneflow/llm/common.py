"""What the training-data operators share: the shared folder, stored tables, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import new_folder

#: A word, as every operator here counts it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch where several operators share the workers, and the setting that bounds them.
BATCH_ROWS, ARROW_ROWS = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``."""
    return new_folder(spark)


#: Rows of keys and numbers that a task takes at least, where a table's size is known.
TASK_ROWS = 50_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than ``rows``, about its size, are worth, but in one for each core.

    A shuffle makes as many partitions as the session says, however few its rows are; each would be a task and a file.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_texts_in_batches(spark: SparkSession) -> None:
    """Send workers at most ``BATCH_ROWS`` rows at once, if the session doesn't ask for fewer.

    Both sides hold a batch and what it grew from: with Spark's 10,000 rows, of whole texts, a hundred MB a task.
    """
    rows = int(spark.conf.get(ARROW_ROWS))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


def discard(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a stored table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What this worker process keeps from task to task, by the call that it belongs to: one call's at most.
_kept: dict[str, Any] = {}


def given_back() -> None:
    """Let go of what earlier calls left in this worker process, whether it was kept or is only unused."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def worker_keeps(key: str, make: Callable[[], Any]) -> Any:
    """What the worker keeps for the call ``key``; it takes the place of what another call kept."""
    if key not in _kept:
        given_back()
        _kept[key] = make()
    return _kept[key]


#: Keys with more rows than this may count as hot, and so many hot keys at most are broadcast.
HOT_ROWS, HOT_KEYS = 2048, 10_000


def hot_keys(side: DataFrame, keys: list[str], copies: str, most: int = HOT_KEYS) -> DataFrame | None:
    """Keys of a stored ``side`` with a large part of all rows, ``copies`` being a key's number of rows; None if there are none.

    Each has more than the ``most``-th part of the rows, so they are few whatever the input.
    """
    total, largest = side.agg(F.coalesce(F.sum(copies), F.lit(0)), F.coalesce(F.max(copies), F.lit(0))).first()
    many = max(HOT_ROWS, total // most)
    return side.filter(F.col(copies) > many).select(*keys) if largest > many else None


def joined_apart(rows: DataFrame, side: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with a ``side`` that has one row for each key.

    A key with a large part of all rows would fill one task of a shuffle, so what
    ``side`` knows of the few hot keys is broadcast; all others meet by a shuffle.
    """
    if hot is None:
        return rows.join(side, keys)
    cold = rows.join(F.broadcast(hot), keys, "left_anti").join(side, keys)
    return rows.join(F.broadcast(side.join(F.broadcast(hot), keys, "left_semi")), keys).unionByName(cold)


def joined(rows: DataFrame, side: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """The same with the hot keys that ``copies`` of the stored ``side`` tells."""
    return joined_apart(rows, side, hot_keys(side, keys, copies), keys)


def numbered(rows: DataFrame, order: list[Column], folder: str, name: str, within: str | None = None) -> DataFrame:
    """``rows`` sorted over all partitions and stored, with ``number`` from 0 in that order, anew for each value of ``within``.

    ``within``, if given, must be what ``order`` begins with. No row leaves its
    partition: each partition's rows are counted (by value, of which a sorted
    partition has few), and the counts before it added.
    """
    keys = [F.col(within)] if within else []
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), folder, name).withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("part", *keys).agg(F.count("*").alias("n"), F.min("place").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", *keys, (before - F.col("least")).alias("shift"))
    return placed.join(offsets, ["part", *([within] if within else [])]).withColumn("number", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
