"""Event, particle and jet selections as predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinematics import area_from_percent


def select_events(events: DataFrame, z_max: float = 10.0) -> DataFrame:
    """Not rejected, vertex within z_max; a cut whose column is absent is left out."""
    if "is_ev_rej" in events.columns:
        events = events.filter("is_ev_rej = 0")
    if "z_vtx_reco" in events.columns:
        events = events.filter(F.abs("z_vtx_reco") < z_max)
    return events


def above(particles: Column, pt_min: float = 0.150) -> Column:
    """The particles of a list at or above a pt."""
    return F.filter(particles, lambda p: p["pt"] >= pt_min)


def occupied(*lists: Column) -> Column:
    """Every list holds a particle."""
    return reduce(lambda a, b: a & b, [F.size(x) > 0 for x in lists])


def indexed(particles: Column, offset: int = 0) -> Column:
    """Particles with an index from the source's offset on."""
    return F.transform(particles, lambda p, i: F.struct(p.alias("particle"), (i + offset).alias("index")))


def of_species(pid: Column, either_sign: Sequence[int], exact: Sequence[int] = ()) -> Column:
    keep = F.abs(pid).isin(list(either_sign))
    return keep | pid.isin(list(exact)) if exact else keep


def no_hard_constituent(constituents: Column, most: float = 100.0) -> Column:
    return ~F.exists(constituents, lambda c: c["pt"] > most)


def large_area(area: Column, r: float, percent: float = 60.0) -> Column:
    return area > area_from_percent(percent, r)


def several_constituents(constituents: Column, system: str) -> Column:
    """More than one constituent, which heavy-ion and embedded jets need not have."""
    return F.lit(True) if system in ("PbPb", "embedPythia", "embed_thermal_model") else F.size(constituents) > 1


def fiducial(eta: Column, r: float, edge: float = 0.9) -> Column:
    return F.abs(eta) < edge - r


def in_range(x: Column, low: float, high: float) -> Column:
    """The upper edge is outside."""
    return (x >= low) & (x < high)


def joined_range(ranges: Sequence[tuple[float, float]]) -> tuple[float, float]:
    return min(a for a, _ in ranges), max(b for _, b in ranges)


def no_double_counting(det_lead: Column, hybrid_lead: Column, true_pt: Column, strict: bool = False) -> Column:
    """The background brought no harder track than the signal; true pt from 10 (strictly above, for unfolding)."""
    return (det_lead >= hybrid_lead) & ((true_pt > 10) if strict else (true_pt >= 10))


def weight_or_one(scale: Column) -> Column:
    return F.coalesce(scale, F.lit(1.0))


#: Least smeared kt by selection, for the usual and for small jets.
MIN_KT, MIN_KT_SMALL_R = (-1.0, 2.0, 3.0, 5.0), (0.5, 1.0, 1.5, 2.0)


def cut_flow(df: DataFrame, cuts: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, name, n): rows left after each cut and all before it, in one pass."""
    cumulative, sums = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for k, (_, cut) in enumerate(cuts, 1):
        cumulative = cumulative & cut
        sums.append(F.count(F.when(cumulative, 1)).alias(f"c{k}"))
    names = ["all", *(n for n, _ in cuts)]
    return df.agg(*sums).select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.col(f"c{k}").alias("n")) for k, n in enumerate(names)])).alias("x")).select("x.*")


