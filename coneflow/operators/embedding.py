"""Skim of an embedding: three levels of each jet side by side, groomed and matched prong by prong.

Everything a jet needs lies in one row (splittings, subjets and constituents of
each level), so after the one shuffle that gathers it all methods, both prong
matchings and the fractions in the measured jet are array functions of that row;
nothing is joined again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinematics import UNTAGGED
from .grooming import methods, splitting_number
from .matching import subjet_pt

LEVELS = ("hybrid", "det_level", "true")
#: Measured and generated level of the prong matchings; fractions in the measured jet are those of the first pair.
PAIRS = (("hybrid", "det_level"), ("det_level", "true"))


def gathered_levels(rows: DataFrame, levels: dict[int, str], key: str = "jet_id") -> DataFrame:
    """One row per jet with a struct for each level, null where the jet isn't there, from (key, lvl, level: struct)."""
    return rows.groupBy(key).agg(*[F.first(F.when(F.col("lvl") == lvl, F.col("level")), ignorenulls=True).alias(name) for lvl, name in levels.items()])


def _found(constituents: Column, ids: Column) -> Column:
    """Scalar pt of those constituents whose id is among ``ids``."""
    return F.aggregate(F.filter(constituents, lambda c: F.array_contains(ids, c["id"])), F.lit(0.0), lambda s, c: s + c["pt"])


def _prongs(subjets: Column, splitting: Column) -> Column:
    """The two subjets of a splitting as (constituents, ids, size), each worked out once."""
    own = F.filter(subjets, lambda s: s["parent_splitting_index"] == splitting)
    return F.transform(own, lambda s: F.struct(s["constituents"].alias("constituents"), F.transform(s["constituents"], lambda c: c["id"]).alias("ids"), subjet_pt(s["constituents"]).alias("size")))


def _code(measured: dict[str, Column], generated: Column, own: str, other: str, has_measured: Column, has_generated: Column) -> Column:
    """1: more than half of the generated prong lies in the measured one of its name, 2: of the other name, 3: in neither."""
    hit = lambda name: F.coalesce(_found(generated["constituents"], measured[name]["ids"]) > 0.5 * generated["size"], F.lit(False))
    return F.when(~has_measured, -1).when(~has_generated, 0).when(hit(own), 1).when(hit(other), 2).otherwise(3)


def embedding_skim(jets: DataFrame, names: list[str], key: str = "jet_id", registry: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A row per jet and method: picked splitting of each level, both prong matchings, fractions of detector-level subjets in the hybrid jet.

    ``jets``: the key and a struct for each level of

    - splittings: array of (idx, parent, kt, delta_r, z) in the order of idx,
    - subjets: array of (parent_splitting_index, constituents: array of (id, pt, phi, ...)),
    - constituents: array of (id, pt, ...).

    A level that is null has no splitting.
    """
    registry = registry or methods()
    none = F.struct(F.lit(UNTAGGED).alias("value"), F.lit(-1).alias("idx"), F.lit(0).alias("n_passed"))
    pick = lambda level, name: F.coalesce(F.when(F.col(level).isNotNull(), registry[name](F.col(f"{level}.splittings"))), none)
    picks = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), *[pick(level, n).alias(level) for level in LEVELS]) for n in names])).alias("picked")
    rows = jets.select(key, *LEVELS, picks)
    idx = lambda level: F.col(f"picked.{level}.idx")
    prongs = {f"{level}_prongs": F.when(idx(level) >= 0, _prongs(F.col(f"{level}.subjets"), idx(level))) for level in LEVELS}
    chosen = {f"{level}_splitting": F.when(idx(level) >= 0, F.get(F.col(f"{level}.splittings"), idx(level))) for level in LEVELS}
    everywhere = {"__ids": F.transform(F.col(f"{PAIRS[0][0]}.constituents"), lambda c: c["id"])}
    rows = rows.withColumns(prongs | chosen | everywhere)
    named = {}
    for level in LEVELS:
        a, b = F.get(f"{level}_prongs", F.lit(0)), F.get(f"{level}_prongs", F.lit(1))
        first = a["size"] >= b["size"]
        named |= {f"{level}_leading": F.when(first, a).otherwise(b), f"{level}_subleading": F.when(first, b).otherwise(a)}
    rows = rows.withColumns(named)
    prong = lambda level, name: F.col(f"{level}_{name}")
    out = []
    for level in LEVELS:
        out += [F.coalesce(F.col(f"{level}_splitting.{c}"), F.lit(UNTAGGED)).alias(f"{level}_{c}") for c in ("kt", "delta_r", "z")]
        steps = F.coalesce(splitting_number(F.col(f"{level}.splittings"), idx(level)), F.lit(0))
        out += [F.col(f"picked.{level}.n_passed").alias(f"{level}_n_passed"), steps.alias(f"{level}_n_to_split")]
    for measured, generated in PAIRS:
        m = {name: prong(measured, name) for name in ("leading", "subleading")}
        for own, other in (("leading", "subleading"), ("subleading", "leading")):
            out.append(_code(m, prong(generated, own), own, other, idx(measured) >= 0, idx(generated) >= 0).alias(f"{measured}_{generated}_matching_{own}"))
    measured, generated = PAIRS[0]
    for own in ("leading", "subleading"):
        p = prong(generated, own)
        share = F.when(p["size"] > 0, _found(p["constituents"], F.col("__ids")) / p["size"])
        out.append(F.coalesce(share, F.lit(0.0)).cast("float").alias(f"{generated}_{own}_subjet_momentum_fraction_in_{measured}_jet"))
    return rows.select(key, F.col("picked.method").alias("method"), *out)
