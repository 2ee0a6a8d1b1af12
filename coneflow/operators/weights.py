"""Scale factors of productions and weighted spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .histograms import Axis


def scale_factors(files: DataFrame) -> DataFrame:
    """Per pt-hard bin over all its files: entry-weighted cross section over the sum of trials, and the sums themselves."""
    sums = files.groupBy("pt_hard_bin").agg(F.sum("n_accepted").alias("n_accepted"), F.sum("n_entries").alias("n_entries"), F.sum("n_trials").alias("n_trials"), (F.sum(F.col("cross_section") * F.col("n_entries")) / F.sum("n_entries")).alias("cross_section"))
    return sums.withColumn("factor", F.col("cross_section") / F.col("n_trials"))


def file_factors(files: DataFrame) -> DataFrame:
    """The file-level alternative: cross section times entries over trials, averaged over a bin's files."""
    return files.filter("n_trials > 0").groupBy("pt_hard_bin").agg(F.avg(F.col("cross_section") * F.col("n_entries") / F.col("n_trials")).alias("factor"))


def scaled_spectra(jets: DataFrame, factors: DataFrame, bin_column: str = "bin") -> DataFrame:
    """Per-bin and total weighted counts; bins without a factor are left out. pt_hard_bin is null in the totals."""
    joined = jets.join(factors.select("pt_hard_bin", "factor"), "pt_hard_bin")
    return joined.groupingSets([["pt_hard_bin", bin_column], [bin_column]], "pt_hard_bin", bin_column).agg(F.sum("factor").alias("sumw"), F.sum(F.col("factor") * F.col("factor")).alias("sumw2"), F.count(F.lit(1)).alias("n"))


def level_spectra(jets: DataFrame, spectra: dict[str, tuple[Column, Column]], axis: Axis, weight: str = "scale_factor") -> DataFrame:
    """(spectrum, pt_hard_bin, bin, sumw, sumw2, n) of several spectra of each jet, by pt-hard bin and in total (a null bin).

    ``spectra``: name -> (pt, selection). One pass: a jet is one row for each
    spectrum that selects it, and the totals are summed from the bins.
    """
    rows = F.explode(F.array(*[F.when(keep & pt.isNotNull(), F.struct(F.lit(name).alias("spectrum"), axis.bin(pt).alias("bin"))) for name, (pt, keep) in spectra.items()])).alias("s")
    long = jets.select("pt_hard_bin", F.col(weight).alias("w"), rows).filter("s is not null")
    by_bin = long.groupBy("s.spectrum", "pt_hard_bin", "s.bin").agg(F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"), F.count(F.lit(1)).alias("n"))
    sums = [F.sum(c).alias(c) for c in ("sumw", "sumw2", "n")]
    return by_bin.groupingSets([["spectrum", "pt_hard_bin", "bin"], ["spectrum", "bin"]], "spectrum", "pt_hard_bin", "bin").agg(*sums)


def uneven_bins(factors: DataFrame, data: DataFrame) -> DataFrame:
    """pt-hard bins that only the factors or only the data have."""
    f, d = factors.select("pt_hard_bin").distinct().withColumn("f", F.lit(1)), data.select("pt_hard_bin").distinct().withColumn("d", F.lit(1))
    return f.join(d, "pt_hard_bin", "full_outer").filter("f is null or d is null").select("pt_hard_bin", F.when(F.col("f").isNull(), "data").otherwise("factors").alias("only_in"))
