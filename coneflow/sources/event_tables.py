"""Event tables in Parquet and flat rows, brought to one list of particles per level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.matching import complete_events, numbered

#: Columns of the input layouts by collision system, and how they are named here.
EVENT_COLUMNS = {"pp": ("run_number", "trigger_bit_INT7"), "pythia": ("run_number", "trigger_bit_INT7"), "PbPb": ("run_number", "trigger_bit_INT7", "centrality", "event_plane_V0M", "trigger_bit_central", "trigger_bit_semi_central")}
LEVELS = {"pp": {"data": "particle_data"}, "PbPb": {"data": "particle_data"}, "pythia": {"det_level": "particle_data", "part_level": "particle_gen"}}
JET_EXTRACTOR = {"Jet_Track_Pt": "pt", "Jet_Track_Eta": "eta", "Jet_Track_Phi": "phi", "Jet_Track_Charge": "charged", "Jet_Track_Label": "label"}
EXTRACTOR_EVENTS = {"Event_Weight": "event_weight", "Event_ImpactParameter": "event_impact_parameter", "Jet_Pt": "jet_pt_original"}
JEWEL = {"partpT": "pt", "party": "eta", "partphi": "phi", "partm": "m", "partc": "charge", "parts": "scattering_center"}
JEWEL_EVENTS = {"mcweight": "event_weight"}


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet with only these columns in the scan."""
    return spark.read.parquet(path).select(*columns)


def zipped(columns: dict[str, str]) -> Column:
    """Parallel list columns (name here: column there) as one list of structs."""
    arrays = F.arrays_zip(*columns.values())
    return F.transform(arrays, lambda x: F.struct(*[x[c].alias(n) for n, c in columns.items()]))


def track_skim(df: DataFrame, system: str) -> DataFrame:
    """Flat prefixed lists (particle_data_pt, ...) to a list of particles for each level."""
    out = [c for c in EVENT_COLUMNS[system] if c in df.columns]
    lists = []
    for level, prefix in LEVELS[system].items():
        own = {c.removeprefix(f"{prefix}_"): c for c in df.columns if c.startswith(f"{prefix}_")}
        lists.append(zipped(own).alias(level))
    return df.select(*out, *lists)


def renamed_lists(df: DataFrame, names: dict[str, str], level: str = "part_level", keep: tuple[str, ...] = (), events: dict[str, str] | None = None) -> DataFrame:
    """The same for layouts given as maps of column names, of lists and of the event's own values."""
    own = [F.col(c).alias(n) for c, n in (events or {}).items() if c in df.columns]
    return df.select(*keep, *own, zipped({n: c for c, n in names.items() if c in df.columns}).alias(level))


def grouped_events(tracks: DataFrame, keys: tuple[str, ...], order: str = "idx") -> DataFrame:
    """Flat track rows to one row per event, particles in order."""
    rest = [c for c in tracks.columns if c not in keys and c != order]
    return tracks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("particles"))


def event_tree(events: DataFrame, det: DataFrame, part: DataFrame, keys: tuple[str, ...] = ("run_number", "event_id")) -> DataFrame:
    """Events that occur in all three tables, with the lists of both levels."""
    kept = complete_events(events, det, part, keys=keys)
    d = grouped_events(det, keys).withColumnRenamed("particles", "det_level")
    p = grouped_events(part, keys).withColumnRenamed("particles", "part_level")
    return kept.join(d, list(keys)).join(p, list(keys))


def entries(df: DataFrame, order: list[str], start: int, stop: int, near: int = 10_000) -> DataFrame:
    """Rows [start, stop) in a global order; up to ``near`` each task sends no more than ``stop`` rows, beyond it rows are numbered where they lie."""
    if stop <= near:
        return df.orderBy(*order).limit(stop).offset(start)
    return numbered(df, order).filter(F.col("position").between(start, stop - 1))


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add the number of the chunk of ``size`` rows that each row lies in."""
    return numbered(df, order).withColumn("chunk", F.floor(F.col("position") / size))


def rows_per_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).count()


def entry_ranges(files: DataFrame, size: int, count: str = "n_entries") -> DataFrame:
    """(…, low, high) ranges of at most ``size`` rows; no empty range at the end."""
    starts = files.filter(F.col(count) > 0).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(size).cast("long"))))
    return starts.withColumn("high", F.least(F.col("low") + size, F.col(count)))


def compacted(spark: SparkSession, paths: list[str], target: str, n_files: int, schema: StructType | None = None) -> None:
    """Read what is readable and write it to a number of files; with a schema no file has to be readable to find it."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    (reader.schema(schema) if schema else reader).parquet(*paths).repartition(n_files).write.mode("overwrite").parquet(target)


def jet_records(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Per-level branches (``{branch}_fJetPt`` ...) to standard jet records; nulls become the fill value."""
    out = []
    for name, branch in prefixes.items():
        ident = next((c for c in (f"{branch}_fID", f"{branch}_fGlobalIndex") if c in df.columns), None)
        parts = {n: f"{branch}_{c}" for n, c in (("pt", "fPt"), ("eta", "fEta"), ("phi", "fPhi")) if f"{branch}_{c}" in df.columns} | ({"id": ident} if ident else {})
        out += [F.coalesce(F.col(f"{branch}_fJetPt"), F.lit(-9999.0)).alias(f"{name}_jet_pt"), zipped(parts).alias(f"{name}_constituents")]
    optional = [F.coalesce(F.col(c), F.lit(-9999.0)).alias("pt_hard") for c in ("pt_hard", "ptHard") if c in df.columns][:1]
    return df.select(*out, *optional)


def write_skim(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that the skim holds, so a second run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def uniform_skim(df: DataFrame, renames: dict[str, str], types: dict[str, str], scale_factor: float = 1.0) -> DataFrame:
    """Cross-check output to the skim's names and types, with a constant weight."""
    out = df.withColumnsRenamed(renames)
    return out.select(*[F.col(c).cast(types.get(c, t)).alias(c) for c, t in out.dtypes], F.lit(scale_factor).cast("float").alias("scale_factor"))


def points(spectrum: DataFrame, low: float, high: float) -> DataFrame:
    """A spectrum as points: centre, value, error, low and high systematic error, within a range."""
    return spectrum.filter(F.col("centre").between(low, high)).select("centre", "value", "error", "low", "high")


def predictions(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """Text of (central, lower, upper) rows, numbered in file order, as value with errors on both sides."""
    raw = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    v = F.split(F.trim("value"), f"[{separator}]+")
    rows = raw.filter("trim(value) <> '' and not startswith(trim(value), '#')").select("place", *[F.get(v, F.lit(k)).cast("double").alias(n) for k, n in enumerate(("value", "lower", "upper"))])
    w = Window.orderBy("place")  # one row for each bin of a spectrum
    return rows.select((F.row_number().over(w) - 1).alias("bin"), "value", (F.col("value") - F.col("lower")).alias("low"), (F.col("upper") - F.col("value")).alias("high"))
