"""Generator text files: a header line opened by '#', particle lines, and a footer with the file's cross section.

Records are cut at '#', so a file splits between events and no task needs the
lines of another. Particle fields are index, pid, status, E, px, py, pz and,
in the first format, eta and phi.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTICLE = ["particle_id int", "status tinyint", "e float", "px float", "py float", "pz float"]


def _records(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "#").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n", 2).alias("parts"))
    header = F.split(F.regexp_replace(F.get("parts", F.lit(0)), r"^\s+|\s+$", ""), r"\t")
    return rows.select("file", header.alias("header"), F.coalesce(F.get("parts", F.lit(1)), F.lit("")).alias("body")).filter("header[0] <> ''")


def _field(name: str) -> Column:
    """The value after a label in the header."""
    at = F.array_position("header", name)
    return F.when(at > 0, F.get("header", at.cast("int")))


def _particles() -> Column:
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda line: _particle(F.split(F.trim(line), r"\s+")))


def _particle(v: Column) -> Column:
    kinds = [c.split() for c in _PARTICLE]
    return F.struct(*[F.get(v, F.lit(k + 1)).cast(t).alias(n) for k, (n, t) in enumerate(kinds)])


def read_generator(spark: SparkSession, path: str) -> DataFrame:
    """file, event_id, event_weight, event_plane_angle, n_particles, particles, cross_section, cross_section_error.

    Header versions: labelled (Event, weight, EPangle, N_hadrons or N_partons) of
    any length, and the old one (angle, EventNID, N, ...), which has no weight.
    """
    records = _records(spark, path)
    footer = records.filter("header[0] = 'sigmaGen'").select("file", F.get("header", F.lit(1)).cast("float").alias("cross_section"), F.get("header", F.lit(3)).cast("float").alias("cross_section_error"))
    labelled = F.get("header", F.lit(0)) == "Event"
    old_id = F.regexp_extract(F.get("header", F.lit(1)), r"Event(\d+)ID", 1)
    rows = records.filter("header[0] <> 'sigmaGen'").select(
        "file",
        F.when(labelled, _field("Event")).otherwise(old_id).cast("int").alias("event_id"),
        F.when(labelled, _field("weight")).cast("float").alias("event_weight"),
        F.when(labelled, _field("EPangle")).otherwise(F.get("header", F.lit(0))).cast("float").alias("event_plane_angle"),
        F.when(labelled, F.coalesce(_field("N_hadrons"), _field("N_partons"))).otherwise(F.get("header", F.lit(2))).cast("int").alias("n_particles"),
        _particles().alias("particles"),
    )
    return rows.join(footer, "file", "left")


def miscounted(events: DataFrame) -> DataFrame:
    """Events whose particle lines are not as many as the header says."""
    return events.filter(F.size("particles") != F.col("n_particles")).select("file", "event_id", "n_particles", F.size("particles").alias("found"))


def slim(events: DataFrame) -> DataFrame:
    """Only what a later analysis can't compute again: e, px, py, pz of the particles."""
    keep = ("particle_id", "status", "e", "px", "py", "pz")
    return events.withColumn("particles", F.transform("particles", lambda p: F.struct(*[p[k].alias(k) for k in keep])))


def write_events(events: DataFrame, path: str, per_file: int) -> None:
    """Parquet with zstd and at most so many events in a file."""
    events.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)


def bin_of_file(file_name: Column) -> Column:
    """pt-hard bin in a file name such as .../bin_12/... or ..._Bin110_120..."""
    found = F.regexp_extract(file_name, r"(?i)bin_?(\d+)", 1)
    return F.when(found != "", found.cast("int"))
