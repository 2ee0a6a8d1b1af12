"""Random choices by hashes of keys and a seed: the same on every run and for every partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*keys: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that hangs only on the keys and the seed: the first 52 bits of the md5 of their text."""
    text = F.concat_ws(":", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def activity_class(centrality: Column) -> Column:
    """0-10, 10-30, 30-50, 50-90 percent; null beyond."""
    c = centrality
    return F.when((c >= 0) & (c < 10), 0).when((c >= 10) & (c < 30), 1).when((c >= 30) & (c < 50), 2).when((c >= 50) & (c < 90), 3)


def lossy(tracks: DataFrame, chance: Column, seed: int, keys: tuple[str, ...] = ("event_id", "idx")) -> DataFrame:
    """Drop tracks whose number exceeds their efficiency."""
    return tracks.filter(uniform(*keys, seed=seed) <= chance)


def lossy_signal(particles: DataFrame, chance: float, seed: int) -> DataFrame:
    """The same for signal particles only; the background always stays."""
    return particles.filter((F.col("source") == "background") | (uniform("event_id", "idx", seed=seed) <= chance))


def normal(*keys: str | Column, seed: int = 0) -> Column:
    """A standard normal number by the Box-Muller rule."""
    u, v = F.greatest(uniform(*keys, seed=seed), F.lit(1e-12)), uniform(*keys, seed=seed + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def thermal_background(events: DataFrame, mean: float, sigma: float, temperature: float = 0.4, seed: int = 11) -> DataFrame:
    """event_id, idx, pt, eta, phi: rint(Normal(mean, sigma)) massless particles per event.

    pt follows x exp(-x / T), the sum of two exponential numbers; eta is flat on
    +-0.9 and phi flat.
    """
    n = F.greatest(F.rint(mean + sigma * normal("event_id", seed=seed)), F.lit(0.0)).cast("int")
    rows = events.select("event_id", n.alias("n")).filter("n > 0").select("event_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    u = lambda k: uniform("event_id", "idx", seed=seed + k)
    pt = -temperature * (F.log(F.greatest(u(2), F.lit(1e-12))) + F.log(F.greatest(u(3), F.lit(1e-12))))
    return rows.select("event_id", "idx", pt.alias("pt"), (-0.9 + 1.8 * u(4)).alias("eta"), (2 * math.pi * u(5)).alias("phi"))
