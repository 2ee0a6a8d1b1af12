"""Make the package importable in Python workers, and rows fixed where lost executors may ask for them again."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_coneflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in root.rglob("*.py"):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._coneflow_shipped = True


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    On a single machine a temporary folder is set for the session where the
    setting is absent; on a cluster its absence is an error, since executors
    would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder that all executors share."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, written once to the shared folder and read from there; cuts the lineage."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of a pattern whose writers ended well, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(f.getPath().getParent().toString() for f in found)
