"""Systematic errors of spectra as columns and joins on bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asymmetric(first: Column, second: Column | None = None) -> Column:
    """STRUCT<low, high> from one or two differences to the default.

    One difference counts on its own side. Two of the same sign: the larger one
    on that side; of opposite signs: one on each. Zero counts as not positive.
    """
    if second is None:
        return F.struct(F.when(first > 0, 0.0).otherwise(F.abs(first)).alias("low"), F.when(first > 0, first).otherwise(0.0).alias("high"))
    a, b = first > 0, second > 0
    most = F.greatest(F.abs(first), F.abs(second))
    high = F.when(a & b, most).when(a, first).when(b, second).otherwise(0.0)
    low = F.when(~a & ~b, most).when(~a, F.abs(first)).when(~b, F.abs(second)).otherwise(0.0)
    return F.struct(low.alias("low"), high.alias("high"))


def symmetric(difference: Column) -> Column:
    return F.struct(F.abs(difference).alias("low"), F.abs(difference).alias("high"))


def source(default: DataFrame, variations: Sequence[DataFrame], name: str, keys: Sequence[str], even: bool = False) -> DataFrame:
    """(keys, source, low, high) of one or two variations of a spectrum (keys, value)."""
    joined = default.select(*keys, F.col("value").alias("__d"))
    for k, v in enumerate(variations):
        joined = joined.join(v.select(*keys, F.col("value").alias(f"__v{k}")), list(keys))
    differences = [F.col(f"__v{k}") - F.col("__d") for k in range(len(variations))]
    error = symmetric(differences[0]) if even else asymmetric(*differences)
    return joined.select(*keys, F.lit(name).alias("source"), error.alias("e")).select(*keys, "source", "e.low", "e.high")


def relative_source(default: DataFrame, relative: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Non-closure or model dependence: a relative difference (keys, relative) times the default."""
    joined = default.join(relative, list(keys))
    return joined.select(*keys, F.lit(name).alias("source"), asymmetric(F.col("relative") * F.col("value")).alias("e")).select(*keys, "source", "e.low", "e.high")


def total(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sum of all sources in quadrature, low and high apart."""
    whole = reduce(lambda a, b: a.unionByName(b), sources)
    return whole.groupBy(*keys).agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in ("low", "high")])


def equal_sources(sources: Sequence[DataFrame], keys: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Pairs of sources that agree in every bin, which points to a mistake: (a, b)."""
    whole = reduce(lambda x, y: x.unionByName(y), sources)
    a = whole.select(*keys, F.col("source").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"))
    b = whole.select(*keys, F.col("source").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"))
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= atol + rtol * F.abs(F.col(y))
    return a.join(b, list(keys)).filter("a < b").groupBy("a", "b").agg(F.every(close("al", "bl") & close("ah", "bh")).alias("same")).filter("same").select("a", "b")


def relative_table(spectrum: DataFrame, errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 - low / value and 1 + high / value of each source."""
    joined = errors.join(spectrum.select(*keys, "value"), list(keys)).filter("value <> 0")
    return joined.select(*keys, "source", (1 - F.col("low") / F.col("value")).alias("low"), (1 + F.col("high") / F.col("value")).alias("high"))


def ratio_with_errors(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratio of two results (keys, value, error, low, high); relative errors in quadrature times the ratio."""
    other = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("value", "error", "low", "high")])
    joined = a.join(other, list(keys)).filter("value <> 0 and __value <> 0").withColumn("ratio", F.col("value") / F.col("__value"))
    part = lambda c: (F.col("ratio") * F.sqrt(F.pow(F.col(c) / F.col("value"), F.lit(2.0)) + F.pow(F.col(f"__{c}") / F.col("__value"), F.lit(2.0)))).alias(c)
    return joined.select(*keys, F.col("ratio").alias("value"), part("error"), part("low"), part("high"))


def within(spectrum: DataFrame, low: float, high: float, centre: str = "centre") -> DataFrame:
    """Bins whose centre is in a closed range."""
    return spectrum.filter(F.col(centre).between(low, high))


def model_over_data(model: DataFrame, data: DataFrame, keys: Sequence[str], renormalize: bool = False) -> DataFrame:
    """Model / data on the bins both have; data errors are carried as relative ones, the model may be normalised to 1 first."""
    m = model.join(data.select(*keys), list(keys), "left_semi")
    if renormalize:
        whole = m.agg(F.sum("value").alias("__t"))  # one row
        m = m.crossJoin(F.broadcast(whole)).withColumn("value", F.col("value") / F.col("__t")).drop("__t")
    m = m.select(*keys, F.col("value").alias("__m"))
    joined = data.join(m, list(keys)).filter("value <> 0")
    r = F.col("__m") / F.col("value")
    return joined.select(*keys, r.alias("value"), *[(r * F.col(c) / F.col("value")).alias(c) for c in ("low", "high")])
