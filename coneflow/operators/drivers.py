"""Whole analyses of a collision system: events to matched, reclustered, groomed jets.

Jets are found in narrow passes over nested events; the joins are by event, or
by event and jet. Levels keep their names through the column prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed
from ..functions.selections import large_area, no_hard_constituent, several_constituents
from . import grooming, jetfinding, matching
from .sampling import thermal_background


def _jets(tracks: DataFrame, r: float, pt_min: float, system: str, ghost_area: float | None = None, most_pt: float = 100.0) -> DataFrame:
    """Jets with their particles after the cuts on constituents, area and acceptance; found once and kept for all uses."""
    jets = jetfinding.find_jets(jetfinding.nested(tracks), r, pt_min=pt_min, eta_max=0.9 - r, ghost_area=ghost_area, with_particles=True)
    jets = jets.filter(no_hard_constituent(F.col("particles"), most_pt) & several_constituents(F.col("particles"), system))
    return checkpointed(jets.filter(large_area(F.col("area"), r)) if ghost_area else jets)


def _groomed(jets: DataFrame, method: str, level: str) -> DataFrame:
    trees = jetfinding.recluster(jets, with_subjets=False)
    out = grooming.groomed(trees, method).withColumn("n_to_split", grooming.splitting_number(F.col("splittings"), F.col("idx")))
    keep = ("kt", "delta_r", "z", "n_passed", "n_to_split")
    return out.join(jets.select("event_id", "jet", "pt"), ["event_id", "jet"]).select("event_id", F.col("jet").alias(level), F.col("pt").alias(f"{level}_jet_pt"), *[F.col(c).alias(f"{level}_{c}") for c in keep])


def analyze_data(tracks: DataFrame, r: float = 0.4, method: str = "soft_drop_z_cut_02", pt_min: float = 5.0, system: str = "pp", ghost_area: float | None = None) -> DataFrame:
    """One row per jet: data_jet_pt and the picked splitting."""
    return _groomed(_jets(tracks.filter("pt >= 0.15"), r, pt_min, system, ghost_area), method, "data")


def analyze_mc(det: DataFrame, part: DataFrame, r: float = 0.4, method: str = "soft_drop_z_cut_02", pt_min: float = 5.0, distance: float = 1.0) -> DataFrame:
    """One row per pair of jets of the measured and the generated level that match."""
    found = {"det_level": _jets(det.filter("pt >= 0.15"), r, pt_min, "pythia"), "true": _jets(part, r, pt_min, "pythia")}
    pairs = matching.geometric_matches(found["det_level"], found["true"], distance)
    pairs = pairs.select("event_id", F.col("base").alias("det_level"), F.col("tag").alias("true"), "distance")
    out = pairs
    for level, jets in found.items():
        out = out.join(_groomed(jets, method, level), ["event_id", level])
    return out


def analyze_embedding(part: DataFrame, det: DataFrame, background: DataFrame, r: float = 0.4, method: str = "soft_drop_z_cut_02", pt_min: float = 5.0, distance: float = 0.3, shared: float = 0.5) -> DataFrame:
    """One row per chain of a hybrid, a measured and a generated jet with enough of its momentum in the hybrid one.

    The density comes from the background's particles alone; hybrid particles
    are subtracted event by event. Signal particles keep their index, so the
    shared momentum is a join on (jet, index).
    """
    mixed = det.select("event_id", "idx", "pt", "eta", "phi").unionByName(background.select("event_id", "idx", "pt", "eta", "phi")).filter("pt >= 0.15")
    rho = jetfinding.density(det, background)
    left = jetfinding.constituent_subtraction(jetfinding.nested(mixed).join(rho, "event_id"), ghost_area=0.05).withColumnRenamed("index", "idx")
    levels = {"hybrid": left, "det_level": det.filter("pt >= 0.15"), "true": part}
    found = {level: _jets(tracks, r, pt_min, "embedPythia") for level, tracks in levels.items()}
    chain = matching.match_chain(matching.geometric_matches(found["hybrid"], found["det_level"], distance), matching.geometric_matches(found["det_level"], found["true"], distance))
    chain = chain.select("event_id", "hybrid", F.col("det").alias("det_level"), "true")
    key = F.struct("event_id", "det_level").alias("jet_id")
    generated = found["det_level"].select("event_id", F.col("jet").alias("det_level"), "pt", F.explode("particles").alias("p"))
    measured = chain.join(found["hybrid"].select("event_id", F.col("jet").alias("hybrid"), F.explode("constituents").alias("id")), ["event_id", "hybrid"]).select(key, "id")
    share = matching.shared_fraction(generated.select(key, F.col("p.index").alias("id"), F.col("p.pt").alias("pt")), measured, found["det_level"].select(F.struct("event_id", F.col("jet").alias("det_level")).alias("jet_id"), "pt"))
    out = chain.join(share.select("jet_id.event_id", "jet_id.det_level", "fraction").filter(F.col("fraction") >= shared), ["event_id", "det_level"])
    for level, jets in found.items():
        out = out.join(_groomed(jets, method, level), ["event_id", level])
    return out


def analyze_thermal_embedding(part: DataFrame, det: DataFrame, mean: float, sigma: float, temperature: float = 0.4, seed: int = 11, **settings: float | str) -> DataFrame:
    """The same with a thermal background under each event of the measured level; its particles' indices follow all of the signal's."""
    events = det.select("event_id").distinct()
    first = 1 + (det.agg(F.max("idx")).first()[0] or 0)
    background = thermal_background(events, mean, sigma, temperature, seed).withColumn("idx", (F.col("idx") + first).cast("int"))
    return analyze_embedding(part, det, background, **settings)
