"""Four-vectors, distances and names as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default particle mass (GeV), the value that marks an absent splitting, and the fill for nulls.
PION_MASS, UNTAGGED, NULL_FILL = 0.139, -0.005, -9999


def delta_phi(a: Column, b: Column) -> Column:
    """a - b brought into [-pi, pi)."""
    d = a - b
    return d - 2 * math.pi * F.floor((d + math.pi) / (2 * math.pi))


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column, wrap: bool = True) -> Column:
    """Distance in (eta, phi); jets wrap phi, constituents near each other need not."""
    de, dp = eta1 - eta2, delta_phi(phi1, phi2) if wrap else phi1 - phi2
    return F.sqrt(de * de + dp * dp)


def cartesian(pt: Column, eta: Column, phi: Column, mass: Column) -> Column:
    """STRUCT<px, py, pz, e>."""
    px, py, pz = pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta)
    return F.struct(px.alias("px"), py.alias("py"), pz.alias("pz"), F.sqrt(px * px + py * py + pz * pz + mass * mass).alias("e"))


def polar(px: Column, py: Column, pz: Column, e: Column) -> Column:
    """STRUCT<pt, eta, phi, m>; a negative squared mass from rounding counts as 0."""
    pt = F.sqrt(px * px + py * py)
    m2 = e * e - px * px - py * py - pz * pz
    return F.struct(pt.alias("pt"), F.asinh(pz / pt).alias("eta"), F.atan2(py, px).alias("phi"), F.sqrt(F.greatest(m2, F.lit(0.0))).alias("m"))


def gaussian(x: Column, mean: float, sigma: float, normalized: bool = False) -> Column:
    g = F.exp(-0.5 * (x - mean) * (x - mean) / (sigma * sigma))
    return g / (sigma * math.sqrt(2 * math.pi)) if normalized else g


def power_law(x: Column, a: float, n: float) -> Column:
    return F.pow(a * x, F.lit(-n))


def area_from_percent(percent: float, r: float) -> float:
    """Smallest jet area as a share of a circle; a percentage of less than 1 is a mistaken fraction."""
    if percent < 1:
        raise ValueError(f"percentage below 1: {percent}")
    return percent / 100 * math.pi * r * r


def range_name(variable: Column, low: Column, high: Column) -> Column:
    """Like jet_pt_40_120."""
    return F.concat_ws("_", variable, low.cast("string"), high.cast("string"))


def binning_name(edges: Column) -> Column:
    """Sorted distinct edges joined by underscores, points as p."""
    return F.replace(F.array_join(F.transform(F.array_sort(F.array_distinct(edges)), lambda e: e.cast("string")), "_"), F.lit("."), F.lit("p"))


def null_filled(x: Column) -> Column:
    return F.coalesce(x, F.lit(NULL_FILL))


def renamed(name: str, rules: tuple[tuple[str, str], ...] = (("matched", "true"), ("data", "hybrid"))) -> str:
    """A column name after the renaming rules, each applied to whole parts of the name."""
    for old, new in rules:
        name = "_".join(new if p == old else p for p in name.split("_"))
    return name
