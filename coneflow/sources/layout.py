"""How tables lie on disk and over tasks: buckets by event, files of a size, partitions of equal cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..cluster import checkpointed, new_folder

EVENT = ("run_number", "event_id")


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: Sequence[str] = EVENT) -> DataFrame:
    """Write ``df`` as table ``name``, in buckets by ``keys`` and sorted by them inside each; one shuffle, at ingest.

    Tables with equal buckets and keys are then joined and grouped by those keys
    without any exchange, however often. Every bucket is one file, dealt by the
    hash that Spark's own exchange would use.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def running_cost(df: DataFrame, order: Sequence[str], cost: Column) -> DataFrame:
    """Add ``cost`` and ``before``: the sum of all costs that stand before a row in a global order.

    Rows are sorted in ranges and stored; each range's total gives the offset of the next.
    """
    ranged = df.withColumn("cost", cost.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = checkpointed(ranged).withColumn("__part", F.shiftright("__id", 33))
    upto = F.sum("cost").over(Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy("__part").agg(F.sum("cost").alias("n"))  # one row for each partition
    earlier = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    return ranged.withColumn("before", F.coalesce(upto, F.lit(0))).join(offsets, "__part").withColumn("before", F.col("before") + F.col("__before")).drop("__id", "__part", "__before")


def cost_slots(costs: DataFrame, order: Sequence[str], slots: int) -> DataFrame:
    """Rows of (keys, cost) with ``slot``: contiguous in ``order``, each slot within one row of an equal share of the cost."""
    placed = checkpointed(running_cost(costs, order, F.col("cost")))
    total = placed.agg(F.sum("cost")).first()[0]
    if not total:
        return placed.withColumn("slot", F.lit(0)).drop("before")
    # whole division: a quotient of decimals is rounded to six digits, which lifts an event just below a cut over it
    return placed.withColumn("slot", F.expr(f"CAST(CAST(before AS DECIMAL(38,0)) * {slots} DIV CAST({total} AS DECIMAL(38,0)) AS INT)")).drop("before")


def nested_by_cost(tracks: DataFrame, slots: int, event: str = "event_id", power: int = 2) -> DataFrame:
    """One row per event with its particles in order, events dealt to ``slots`` partitions of equal cost.

    What follows takes time by the number of tracks squared, so a run of central
    events is spread over many partitions where a split by rows would give it to
    one. Tracks are counted first (sums combine before the shuffle), and then sent
    to their slot once; events are gathered there.
    """
    counts = tracks.groupBy(event).agg(F.count("*").alias("n")).select(event, F.pow("n", F.lit(power)).cast("long").alias("cost"))
    dealt = tracks.join(cost_slots(counts, [event], slots).select(event, "slot"), event)
    rest = [c for c in tracks.columns if c not in (event, "idx")]
    particle = F.struct("idx", *rest)
    gathered = dealt.groupBy(event, "slot").agg(F.array_sort(F.collect_list(particle)).alias("particles"))
    return gathered.repartitionById(slots, "slot").drop("slot")


def file_sizes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, bytes) of all files below some folders, whatever they hold; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def rechunked(spark: SparkSession, paths: Sequence[str], target: str, chunk_bytes: int, schema: StructType) -> DataFrame:
    """Write all readable rows below ``paths`` to files of about ``chunk_bytes``; returns (file, bytes, n_rows), n_rows null for a broken file.

    A row's place in bytes is that of its file plus its share of it; places are
    cut every ``chunk_bytes``. So small files are packed together, large ones
    are split, and each chunk is one task and one file.
    """
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(*paths)
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    n = rows.groupBy("__file").agg(F.count("*").alias("n_rows"))
    name = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")  # noqa: E731  one reader says file:/a, the other file:///a
    files = file_sizes(spark, paths)
    files = checkpointed(files.join(n.withColumnRenamed("__file", "__f"), name(F.col("file")) == name(F.col("__f")), "left").drop("__f"))
    good = checkpointed(running_cost(files.filter("n_rows > 0"), ["file"], F.col("bytes")))
    place = F.col("before") + F.floor(F.col("__row") * (F.col("bytes") / F.col("n_rows")))
    at = good.select(name(F.col("file")).alias("__f"), "before", "bytes", "n_rows")
    cut = rows.join(at, name(F.col("__file")) == F.col("__f")).withColumn("__chunk", F.floor(place / chunk_bytes).cast("int"))
    chunks = -(-(good.agg(F.sum("bytes")).first()[0] or 0) // chunk_bytes)
    cut.repartitionById(max(1, chunks), "__chunk").sortWithinPartitions("__file", "__row").select(*schema.fieldNames()).write.mode("overwrite").parquet(target)
    return files.select("file", "bytes", "n_rows")


def joined_copies(spark: SparkSession, tables: dict[str, DataFrame], buckets: int, keys: Sequence[str] = EVENT) -> dict[str, DataFrame]:
    """The same tables, written in equal buckets under names of their own in the shared folder."""
    folder = new_folder(spark)
    unique = folder.rsplit("/", 1)[1][:12]
    return {n: write_bucketed(df, f"{n}_{unique}", f"{folder}/{n}", buckets, keys) for n, df in tables.items()}
