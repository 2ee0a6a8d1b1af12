"""Grooming: pick one splitting of each jet by a registered method.

Splittings lie in an array per jet, in the order of their index, so grooming is
a narrow pass: array functions only, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinematics import UNTAGGED

#: Value of a splitting by which the leading one is found, or None for the first one that passes.
Method = Callable[[Column], Column]


def nested(splittings: DataFrame, keys: tuple[str, ...] = ("jet_id", "lvl"), parent: str = "parent_index") -> DataFrame:
    """One row per jet with its splittings in order."""
    return splittings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", F.col(parent).alias("parent"), "kt", "delta_r", "z"))).alias("splittings"))


def parent_pt(s: Column) -> Column:
    return s["kt"] / F.sin(s["delta_r"]) / s["z"]


def theta(s: Column, r: float) -> Column:
    return s["delta_r"] / r


def hardness(s: Column, r: float, a: float) -> Column:
    """z (1 - z) pt (delta_R / R)^a: a is 0.5 for core, 0.1 for z, 1 for kt, 2 for time."""
    return s["z"] * (1 - s["z"]) * parent_pt(s) * F.pow(theta(s, r), F.lit(a))


def _leading(cut: float | None, value: Method) -> Callable[[Column], Column]:
    def pick(splittings: Column) -> Column:
        passing = F.filter(splittings, lambda s: s["z"] > cut) if cut is not None else splittings
        best = F.array_max(F.transform(passing, lambda s: F.struct(value(s).alias("value"), (-s["idx"]).alias("back"))))
        return F.struct(F.coalesce(best["value"], F.lit(UNTAGGED)).alias("value"), F.coalesce(-best["back"], F.lit(-1)).alias("idx"), F.size(passing).alias("n_passed"))

    return pick


def _first(cut: float) -> Callable[[Column], Column]:
    def pick(splittings: Column) -> Column:
        passing = F.filter(splittings, lambda s: s["z"] > cut)
        first = F.get(passing, F.lit(0))
        return F.struct(F.coalesce(first["z"], F.lit(UNTAGGED)).alias("value"), F.coalesce(first["idx"], F.lit(-1)).alias("idx"), F.size(passing).alias("n_passed"))

    return pick


def methods(r: float = 0.4) -> dict[str, Callable[[Column], Column]]:
    """Name -> array of splittings -> STRUCT<value, idx, n_passed>; the lowest index wins ties. Callers may add their own."""
    found = {f"dynamical_{name}": _leading(None, lambda s, a=a: hardness(s, r, a)) for name, a in (("core", 0.5), ("z", 0.1), ("kt", 1.0), ("time", 2.0))}
    found["leading_kt"] = _leading(None, lambda s: s["kt"])
    for cut, name in ((0.2, "02"), (0.4, "04")):
        found[f"leading_kt_z_cut_{name}"] = _leading(cut, lambda s: s["kt"])
        found[f"soft_drop_z_cut_{name}"] = _first(cut)
    return found


def groomed(jets: DataFrame, method: str, registry: dict[str, Callable[[Column], Column]] | None = None, prefix: str = "") -> DataFrame:
    """Add value, idx, n_passed and the picked splitting's kt, delta_r and z (the sentinel where none passes)."""
    pick = (registry or methods())[method](F.col("splittings"))
    out = jets.withColumn("__p", pick).withColumn("__s", F.get("splittings", F.col("__p.idx")))
    columns = {f"{prefix}{c}": F.when(F.col("__p.idx") >= 0, F.col(f"__s.{c}")).otherwise(UNTAGGED) for c in ("kt", "delta_r", "z")}
    return out.withColumns({f"{prefix}value": F.col("__p.value"), f"{prefix}idx": F.col("__p.idx"), f"{prefix}n_passed": F.col("__p.n_passed"), **columns}).drop("__p", "__s")


def splitting_number(splittings: Column, selected: Column, allowed: Callable[[Column], Column] | None = None) -> Column:
    """How many of the selected splitting and its ancestors are allowed; 0 if none is selected.

    The walk follows parents to -1, at most as many steps as there are splittings.
    """
    keep = allowed or (lambda s: F.lit(True))
    zero = F.struct(selected.cast("int").alias("at"), F.lit(0).alias("n"))

    def up(acc: Column, _: Column) -> Column:
        here = F.get(splittings, acc["at"])
        return F.when(acc["at"] >= 0, F.struct(here["parent"].cast("int").alias("at"), (acc["n"] + F.when((acc["at"] == selected) | keep(here), 1).otherwise(0)).alias("n"))).otherwise(acc)

    return F.aggregate(splittings, zero, up, lambda acc: acc["n"])


def depths(splittings: Column) -> Column:
    """Depth of each splitting in its tree, the root at 1."""
    return F.transform(splittings, lambda s: splitting_number(splittings, s["idx"]))


def iterative(splittings: Column) -> Column:
    """The iterative chain: from the root on, the first child of each."""
    start = F.struct(F.lit(-1).alias("at"), F.filter(splittings, lambda s: F.lit(False)).alias("chain"))
    step = lambda acc, s: F.when(s["parent"] == acc["at"], F.struct(s["idx"].alias("at"), F.array_append(acc["chain"], s).alias("chain"))).otherwise(acc)
    return F.aggregate(splittings, start, step, lambda acc: acc["chain"])


def jet_direction(constituents: Column) -> Column:
    """STRUCT<eta, phi, pt> of the massless sum of constituents."""
    total = lambda f: F.aggregate(constituents, F.lit(0.0), lambda s, c: s + f(c))
    px, py, pz = total(lambda c: c["pt"] * F.cos(c["phi"])), total(lambda c: c["pt"] * F.sin(c["phi"])), total(lambda c: c["pt"] * F.sinh(c["eta"]))
    pt = F.sqrt(px * px + py * py)
    return F.struct(F.asinh(pz / pt).alias("eta"), F.atan2(py, px).alias("phi"), pt.alias("pt"))


def skim(splittings: DataFrame, jets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Long flat skim: a row per jet, level and method, with the jet's columns."""
    return skim_of(nested(splittings), jets, names)


def skim_of(rows: DataFrame, jets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The same from jets whose splittings are nested already."""
    registry = methods()
    picked = F.array(*[F.struct(F.lit(n).alias("method"), registry[n](F.col("splittings")).alias("p")) for n in (names or registry)])
    long = rows.withColumn("g", F.explode(picked)).withColumn("s", F.get("splittings", F.col("g.p.idx")))
    value = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(UNTAGGED)).alias(c)
    long = long.select("jet_id", "lvl", "g.method", F.col("g.p.value").alias("value"), F.col("g.p.idx").alias("idx"), F.col("g.p.n_passed").alias("n_passed"), value("kt"), value("delta_r"), value("z"), splitting_number(F.col("splittings"), F.col("g.p.idx")).alias("n_to_split"))
    return long.join(jets, "jet_id")
