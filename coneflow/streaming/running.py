"""Running histograms and chunked ingest as structured streams.

Sums commute, so late files need no watermark: each batch's partial sums are
folded into the totals in the state store, whose size is the number of bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..cluster import finished, removed
from ..operators.histograms import Axis, histogram


def event_stream(spark: SparkSession, path: str, schema: StructType, files_at_a_time: int = 1, kind: str = "parquet") -> DataFrame:
    """New files of a folder, a few at a time."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_at_a_time).load(path)


def running_histogram(stream: DataFrame, axes: dict[str, tuple[Column, Axis]], weight: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The histogram of all rows so far; write it in complete or update mode."""
    return histogram(stream, axes, weight, keys)


def folded(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run a stream over all files that are there and return its final table.

    Each batch's totals are a folder of their own below ``target``, numbered by
    the batch; readers take the last one that was written to its end, so they
    never meet a half-written table, and a batch that runs again replaces its
    own folder. The totals before the last but one are deleted.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")
        if number > 1:
            removed(spark, f"{target}/batch={number - 2:012d}")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return latest(spark, target, stream.schema)


def latest(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The totals of the last batch that was written to its end; none, if there is no such batch."""
    done = finished(spark, f"{target}/batch=*")
    return spark.read.schema(schema).parquet(done[-1]) if done else spark.createDataFrame([], schema)


def ingest(stream: DataFrame, target: str, checkpoint: str, chunk: str = "chunk") -> None:
    """Write each batch as a chunk of its own; a batch that runs again replaces its chunk."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{chunk}={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
