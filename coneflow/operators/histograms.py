"""Weighted histograms and profiles as sparse rows: one grouped sum over any number of axes and keys.

A bin number is -1 below the axis and n at or above its end; the upper edge of a
bin is outside. Sums are combined before the shuffle, so the steep spectra that
put most rows into few bins shuffle one row for each task and bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Regular:
    """n bins of equal width on [low, high)."""

    n: int
    low: float
    high: float

    def bin(self, x: Column) -> Column:
        width = (self.high - self.low) / self.n
        inside = F.floor((x - self.low) / width).cast("int")
        return F.when(x < self.low, -1).when(x >= self.high, self.n).otherwise(F.least(inside, F.lit(self.n - 1)))

    def centre(self, i: Column) -> Column:
        return self.low + (i + 0.5) * ((self.high - self.low) / self.n)

    def sql(self, x: str) -> str:
        width = (self.high - self.low) / self.n
        return f"CASE WHEN {x} < {self.low} THEN -1 WHEN {x} >= {self.high} THEN {self.n} ELSE least(CAST(floor(({x} - {self.low}) / CAST({width!r} AS DOUBLE)) AS INT), {self.n - 1}) END"


@dataclass(frozen=True)
class Variable:
    """Bins between given edges."""

    edges: tuple[float, ...]

    @property
    def n(self) -> int:
        return len(self.edges) - 1

    def bin(self, x: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.when(x >= e, 1).otherwise(0) for e in self.edges]) - 1

    def sql(self, x: str) -> str:
        return "(" + " + ".join(f"CASE WHEN {x} >= {e} THEN 1 ELSE 0 END" for e in self.edges) + " - 1)"

    def catalogue(self, spark) -> DataFrame:
        """(bin, low, high, centre, width) for dense output."""
        rows = [(k, float(a), float(b), (a + b) / 2, float(b - a)) for k, (a, b) in enumerate(zip(self.edges, self.edges[1:]))]
        return spark.createDataFrame(rows, "bin int, low double, high double, centre double, width double")


Axis = Regular | Variable


def histogram(df: DataFrame, axes: dict[str, tuple[Column, Axis]], weight: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, a bin column for each axis, sumw, sumw2 and n. Rows with a null on an axis are left out."""
    w = F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)
    rows = df.select(*keys, *[axis.bin(x).alias(name) for name, (x, axis) in axes.items()], w.alias("__w")).dropna(subset=list(axes))
    return rows.groupBy(*keys, *axes).agg(F.sum("__w").alias("sumw"), F.sum(F.col("__w") * F.col("__w")).alias("sumw2"), F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, x: Column, axis: Axis, value: Column, weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean and variance of a value in bins of x."""
    rows = df.select(*keys, axis.bin(x).alias("bin"), value.alias("__v"), weight.alias("__w")).dropna(subset=["bin", "__v"])
    w, v = F.col("__w"), F.col("__v")
    sums = rows.groupBy(*keys, "bin").agg(F.sum(w).alias("sumw"), F.sum(w * w).alias("sumw2"), F.sum(w * v).alias("swv"), F.sum(w * v * v).alias("swvv"), F.count(F.lit(1)).alias("n"))
    mean = F.col("swv") / F.col("sumw")
    return sums.withColumns({"mean": mean, "variance": F.greatest(F.col("swvv") / F.col("sumw") - mean * mean, F.lit(0.0))}).drop("swv", "swvv")


def merged(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Add histograms with the same keys and bins; all keys of all parts stay. Parts of other columns are refused."""
    wanted = sorted(parts[0].columns)
    for p in parts[1:]:
        if sorted(p.columns) != wanted:
            raise TypeError(f"results differ in columns: {wanted} and {sorted(p.columns)}")
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts[0].columns if c not in keys])


def projected(hist: DataFrame, keep: Sequence[str], ranges: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Sum the other axes, some of them over a range of bins (last one included)."""
    for axis, (a, b) in (ranges or {}).items():
        hist = hist.filter(F.col(axis).between(a, b))
    return hist.groupBy(*keep).agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"), F.sum("n").alias("n"))


def rebinned(hist: DataFrame, axis: str, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    coarse = hist.withColumn(axis, F.floor(F.col(axis) / factor).cast("int"))
    return coarse.groupBy(*keys, axis).agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"), F.sum("n").alias("n"))


def normalized(hist: DataFrame, width: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``value``: the share of the total divided by the bin width; null where the total is 0."""
    total = F.sum("sumw").over(Window.partitionBy(*keys)) if keys else None
    if total is None:
        whole = F.broadcast(hist.agg(F.sum("sumw").alias("__total")))  # one row
        hist, total = hist.crossJoin(whole), F.col("__total")
    return hist.withColumn("value", F.when(total != 0, F.col("sumw") / total / width)).drop("__total")


def per_jet(hist: DataFrame, n_jets: DataFrame, keys: Sequence[str], width: float | Column) -> DataFrame:
    """Divide by the weighted number of jets of the same keys and by the bin width."""
    return hist.join(n_jets, list(keys)).withColumn("value", F.col("sumw") / F.col("n_jets") / width)


def ratio(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin-wise a / b with errors added in quadrature of the relative ones; bins empty in b are left out."""
    right = b.select(*keys, F.col("sumw").alias("__b"), F.col("sumw2").alias("__b2"))
    joined = a.join(right, list(keys)).filter("__b <> 0")
    value = F.col("sumw") / F.col("__b")
    error = F.sqrt(F.col("sumw2") / (F.col("__b") * F.col("__b")) + F.col("__b2") * F.col("sumw") * F.col("sumw") / F.pow(F.col("__b"), F.lit(4.0)))
    return joined.select(*keys, value.alias("ratio"), error.alias("ratio_error"))


def only_in_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two sets that the other lacks, with ``only_in``: empty if the sets are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def same_edges(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins that only one of two histograms has: empty if their edges agree."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, list(keys), "left_anti").unionByName(right.join(left, list(keys), "left_anti"))


def column_normalized(response: DataFrame, measured: Sequence[str], generated: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each generator bin sums to one over the measured bins; 0 where it is empty."""
    total = F.sum("sumw").over(Window.partitionBy(*keys, *generated))
    return response.withColumn("value", F.when(total != 0, F.col("sumw") / total).otherwise(0.0))
