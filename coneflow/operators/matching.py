"""Joins of events, jets, constituents and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import checkpointed
from ..functions.kinematics import delta_r
from .sampling import uniform


def with_mass(particles: DataFrame, masses: DataFrame, pid: str = "particle_id") -> DataFrame:
    """Mass in GeV by particle id from (particle_id, mass_mev), 0 if the id is unknown.

    The catalogue has one row for each species, a few hundred at most; Spark
    broadcasts it by its size.
    """
    m = masses.select(F.col("particle_id").alias(pid), (F.col("mass_mev") / 1000).alias("mass"))
    return particles.join(m, pid, "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def complete_events(events: DataFrame, *tracks: DataFrame, keys: tuple[str, ...] = ("run_number", "event_id")) -> DataFrame:
    """Events that occur in every table of tracks as well; none of them is a subset of another."""
    for t in tracks:
        events = events.join(t.select(*keys), list(keys), "left_semi")
    return events


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Dense row numbers in a global order, without a window over all rows.

    Rows are sorted in ranges; a count for each range gives its offset. The
    ranges come from samples, so they are fixed by a checkpoint before both uses.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = checkpointed(ranged)  # an id holds the partition above 33 bits and the row's place below
    ranged = ranged.withColumns({"__part": F.shiftright("__id", 33), "__in": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
    counts = ranged.groupBy("__part").count()  # one row for each partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return ranged.join(offsets, "__part").withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__part", "__in", "__before")


def embedding_pairs(signal: DataFrame, background: DataFrame, key: str = "event_id", repeat: bool = True) -> DataFrame:
    """(background, signal): the n-th background event gets the n-th signal event; the signal repeats when it runs out.

    Without ``repeat`` both sources are fixed, and must have equal numbers of events.
    """
    s = numbered(signal.select(key).distinct(), [key])
    b = numbered(background.select(key).distinct(), [key])
    n = s.count()
    if not repeat and n != (m := b.count()):
        raise ValueError(f"sizes of fixed sources differ: {n} signal and {m} background events")
    s, b = s.withColumnRenamed(key, "signal"), b.withColumnRenamed(key, "background")
    return b.withColumn("position", F.col("position") % n).join(s, "position").select("background", "signal")


def file_pairs(background: DataFrame, signal: DataFrame, n_bins: int, seed: int) -> DataFrame:
    """For each background file a bin chosen evenly and a file in it, by hash of the file and a seed."""
    rank = F.row_number().over(Window.partitionBy("pt_hard_bin").orderBy("file_id")) - 1
    s = signal.select("pt_hard_bin", F.col("file_id").alias("signal_file"), rank.alias("place"))
    n = signal.groupBy("pt_hard_bin").agg(F.count("*").alias("n"))
    b = background.select(F.col("file_id").alias("background_file"))
    b = b.withColumn("pt_hard_bin", (F.floor(uniform("background_file", seed=seed) * n_bins) + 1).cast("int")).join(n, "pt_hard_bin")
    b = b.withColumn("place", F.floor(uniform("background_file", seed=seed + 1) * F.col("n")).cast("int"))
    return b.join(s, ["pt_hard_bin", "place"]).select("background_file", "pt_hard_bin", "signal_file")


def hybrid(det: DataFrame, background: DataFrame) -> DataFrame:
    """Signal and background particles together in long form, with their source."""
    return det.withColumn("source", F.lit("signal")).unionByName(background.withColumn("source", F.lit("background")))


def geometric_matches(base: DataFrame, tag: DataFrame, most: float, event: str = "event_id", number: str = "jet") -> DataFrame:
    """(event, base, tag, distance) of jets that are each other's nearest, closer than ``most``; equal distances keep the first.

    The join is on the event, so it never leaves it; the nearest of each side is
    a grouped minimum, which combines before the shuffle.
    """
    b = base.select(event, F.col(number).alias("base"), F.col("eta").alias("be"), F.col("phi").alias("bp"))
    t = tag.select(event, F.col(number).alias("tag"), F.col("eta").alias("te"), F.col("phi").alias("tp"))
    pairs = b.join(t, event).withColumn("distance", delta_r(F.col("be"), F.col("bp"), F.col("te"), F.col("tp"))).select(event, "base", "tag", "distance").filter(F.col("distance") < most)
    there = pairs.groupBy(event, "base").agg(F.min(F.struct("distance", "tag")).alias("x")).select(event, "base", F.col("x.tag").alias("tag"), F.col("x.distance").alias("distance"))
    back = pairs.groupBy(event, "tag").agg(F.min(F.struct("distance", "base")).alias("x")).select(event, "tag", F.col("x.base").alias("base"))
    return there.join(back, [event, "base", "tag"])


def match_chain(hybrid_det: DataFrame, det_true: DataFrame, event: str = "event_id") -> DataFrame:
    """Jets with both links: (event, hybrid, det, true)."""
    a = hybrid_det.select(event, F.col("base").alias("hybrid"), F.col("tag").alias("det"))
    b = det_true.select(event, F.col("base").alias("det"), F.col("tag").alias("true"))
    return a.join(b, [event, "det"]).select(event, "hybrid", "det", "true")


#: Cells are so many distances wide, and a row reaches this much farther than the distance, so that rounding parts no pair.
_CELL_WIDTH, _CELL_SLACK = 4, 1.001


def _cell(x: Column, near: float) -> Column:
    return F.floor(x / (near * _CELL_WIDTH))


def cells_in_reach(rows: DataFrame, near: float) -> DataFrame:
    """Each row once for every cell (__i, __j) that may hold what is ``near``."""
    around = lambda x: F.explode(F.sequence(_cell(F.col(x) - near * _CELL_SLACK, near), _cell(F.col(x) + near * _CELL_SLACK, near)))
    return rows.withColumn("__i", around("eta")).withColumn("__j", around("phi"))


def near_pairs(generated: DataFrame, measured: DataFrame, key: str, near: float) -> DataFrame:
    """Rows of ``generated`` beside those of ``measured`` with the same key, within ``near`` in eta and in phi.

    A measured row is sent to all cells of the eta-phi plane that lie within
    reach, mostly one or two and at most four, so pairs come from an equi-join on
    (key, cell) and a jet of many constituents is not compared with itself. Rows
    without eta or phi match nothing.
    """
    m = cells_in_reach(measured, near).withColumnsRenamed({"eta": "__eta", "phi": "__phi"})
    pairs = generated.withColumns({"__i": _cell(F.col("eta"), near), "__j": _cell(F.col("phi"), near)}).join(m, [key, "__i", "__j"])
    return pairs.filter((F.abs(F.col("eta") - F.col("__eta")) <= near) & (F.abs(F.col("phi") - F.col("__phi")) <= near)).drop("__i", "__j", "__eta", "__phi")


def shared_fraction(generated: DataFrame, measured: DataFrame, jet_pt: DataFrame, key: str = "jet_id", near: float | None = None) -> DataFrame:
    """(jet, fraction): pt of generated constituents whose id is in the measured jet, over the generated jet's pt.

    With ``near`` a constituent is found by distance instead (``near_pairs``).
    """
    if near is None:
        both = generated.join(measured.select(key, "id").distinct(), [key, "id"], "left_semi")
    else:
        both = near_pairs(generated, measured.select(key, "eta", "phi"), key, near).groupBy(key, "id").agg(F.first("pt").alias("pt"))
    found = both.groupBy(key).agg(F.sum("pt").alias("shared"))
    return jet_pt.join(found, key, "left").select(key, (F.coalesce("shared", F.lit(0.0)) / F.col("pt")).alias("fraction"))


def found_in_jet(generated: DataFrame, measured: DataFrame, jets: DataFrame, key: str = "jet_id", near: float | None = None) -> DataFrame:
    """(jet, leading, subleading): the part of a generated subjet's pt that lies anywhere in the measured jet, as floats.

    ``generated`` has the constituents of both subjets (key, prong, id, pt, phi;
    eta too with ``near``), ``measured`` all constituents of the measured jets. The
    whole is the vector sum of the subjet. Jets without a generated splitting have 0.
    """
    if near is None:
        hits = measured.select(key, "id").distinct()
    else:
        hits = near_pairs(generated.select(key, "id", "eta", "phi"), measured.select(key, "eta", "phi"), key, near).select(key, "id").distinct()
    rows = generated.join(hits.withColumn("__in", F.lit(True)), [key, "id"], "left")
    of = lambda p, x: F.sum(F.when(F.col("prong") == p, x).otherwise(0.0))
    x, y, hit = F.col("pt") * F.cos("phi"), F.col("pt") * F.sin("phi"), F.when(F.col("__in"), F.col("pt")).otherwise(0.0)
    sums = rows.groupBy(key).agg(*[c for p in ("leading", "subleading") for c in (of(p, hit).alias(f"{p}_hit"), of(p, x).alias(f"{p}_x"), of(p, y).alias(f"{p}_y"))])
    whole = lambda p: F.sqrt(F.col(f"{p}_x") * F.col(f"{p}_x") + F.col(f"{p}_y") * F.col(f"{p}_y"))
    share = lambda p: F.coalesce(F.when(whole(p) > 0, F.col(f"{p}_hit") / whole(p)), F.lit(0.0)).cast("float").alias(p)
    return jets.select(key).join(sums, key, "left").select(key, share("leading"), share("subleading"))


def shared_fraction_near(generated: Column, measured: Column, jet_pt: Column, most: float = 0.01) -> Column:
    """The same by distance, for nested constituents: within ``most`` in eta and in phi."""
    near = lambda g: F.exists(measured, lambda m: (F.abs(m["eta"] - g["eta"]) <= most) & (F.abs(m["phi"] - g["phi"]) <= most))
    return F.aggregate(F.filter(generated, near), F.lit(0.0), lambda s, c: s + c["pt"]) / jet_pt


def leading_pt_of(indices: DataFrame, particles: DataFrame) -> DataFrame:
    """Largest original pt among a jet's constituents: (event, jet, index) against (event, index, pt)."""
    return indices.join(particles, ["event_id", "index"]).groupBy("event_id", "jet").agg(F.max("pt").alias("leading_track_pt"))


def with_scale_factor(skim: DataFrame, factors: DataFrame, last_bin: int = 20) -> DataFrame:
    """Scale factor by pt-hard bin; bins beyond the last use the last, and a missing one is 1."""
    f = factors.select(F.col("pt_hard_bin").alias("__bin"), "factor")
    return skim.join(f, F.least("pt_hard_bin", F.lit(last_bin)) == F.col("__bin"), "left").drop("__bin").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def gathered(constituents: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.get(constituents, i))


def subjet_pt(constituents: Column) -> Column:
    """Length of the vector sum, in one pass over the constituents."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    step = lambda s, c: F.struct((s["x"] + c["pt"] * F.cos(c["phi"])).alias("x"), (s["y"] + c["pt"] * F.sin(c["phi"])).alias("y"))
    return F.aggregate(constituents, zero, step, lambda s: F.sqrt(s["x"] * s["x"] + s["y"] * s["y"]))


def subjets_of(subjets: Column, splitting: Column) -> Column:
    """The two subjets of a splitting, the harder first: STRUCT<leading, subleading>."""
    own = F.filter(subjets, lambda s: s["parent_splitting_index"] == splitting)
    a, b = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    first = subjet_pt(a["constituents"]) >= subjet_pt(b["constituents"])
    return F.struct(F.when(first, a).otherwise(b).alias("leading"), F.when(first, b).otherwise(a).alias("subleading"))


def contained(generated: DataFrame, measured: DataFrame, key: str = "jet_id", near: float | None = None) -> DataFrame:
    """(jet, prong, other, share) of generated subjets found in measured ones: (jet, prong, id, pt) on both sides.

    One join on (jet, id) and grouped sums. With ``near`` constituents match by
    distance instead (``near_pairs``), each generated one at most once for each
    measured subjet.
    """
    total = generated.groupBy(key, "prong").agg(F.sum("pt").alias("total"))
    if near is None:
        both = generated.join(measured.select(key, F.col("prong").alias("other"), "id"), [key, "id"])
    else:
        pairs = near_pairs(generated, measured.select(key, F.col("prong").alias("other"), "eta", "phi"), key, near)
        both = pairs.groupBy(key, "prong", "other", "id").agg(F.first("pt").alias("pt"))
    both = both.groupBy(key, "prong", "other").agg(F.sum("pt").alias("shared"))
    return both.join(total, [key, "prong"]).select(key, "prong", "other", (F.col("shared") / F.col("total")).alias("share"))


def prong_codes(jets: DataFrame, shares: DataFrame, key: str = "jet_id") -> DataFrame:
    """Match codes of both prongs: 1 proper, 2 swapped, 3 failed; 0 without a generated splitting, -1 without a measured one.

    ``jets``: key, has_measured, has_generated. Contained means more than half.
    """
    has = lambda p, o: F.coalesce(F.max(F.when((F.col("prong") == p) & (F.col("other") == o), F.col("share") > 0.5)), F.lit(False))
    wide = shares.groupBy(key).agg(has("leading", "leading").alias("ll"), has("leading", "subleading").alias("ls"), has("subleading", "leading").alias("sl"), has("subleading", "subleading").alias("ss"))
    code = lambda proper, swapped: F.when(~F.col("has_measured"), -1).when(~F.col("has_generated"), 0).when(F.coalesce(proper, F.lit(False)), 1).when(F.coalesce(swapped, F.lit(False)), 2).otherwise(3)
    return jets.join(wide, key, "left").select(key, code(F.col("ll"), F.col("ls")).alias("leading"), code(F.col("ss"), F.col("sl")).alias("subleading"))


def by_vector_sum(constituents: DataFrame, key: str = "jet_id") -> DataFrame:
    """Name the two subjets of (jet, part, id, pt, phi): ``prong`` is leading for the one of larger vector pt, the first part on a tie."""
    x, y = F.sum(F.col("pt") * F.cos("phi")), F.sum(F.col("pt") * F.sin("phi"))
    sums = constituents.groupBy(key, "part").agg(F.round(F.sqrt(x * x + y * y), 9).alias("size"))
    first = sums.groupBy(key).agg(F.max_by("part", F.struct("size", (-F.col("part")).alias("p"))).alias("first"))
    prong = F.when(F.col("part") == F.col("first"), "leading").otherwise("subleading")
    return constituents.join(first, key).withColumn("prong", prong).drop("first", "part")


def prong_flags(shares: DataFrame, key: str = "jet_id") -> DataFrame:
    """The older rule: proper and mistag of each prong as flags that may both hold; shares are of scalar sums of pt."""
    has = lambda p, o: F.coalesce(F.max(F.when((F.col("prong") == p) & (F.col("other") == o), F.col("share") > 0.5)), F.lit(False))
    pairs = {"leading_proper": ("leading", "leading"), "leading_mistag": ("leading", "subleading"), "subleading_proper": ("subleading", "subleading"), "subleading_mistag": ("subleading", "leading")}
    return shares.groupBy(key).agg(*[has(*p).alias(n) for n, p in pairs.items()])


def prong_flags_in_one(rows: DataFrame, key: str = "jet_id") -> DataFrame:
    """``prong_flags`` of two levels named ``by_vector_sum``, from rows of both together: (jet, measured, part, id, pt, phi).

    ``part`` is 0 or 1, and a level of a jet has an id once. All is windows and
    grouped sums by jet, or by jet and id, so rows that lie by jet don't travel
    again. Jets without a shared id have no row.
    """
    c, w = F.col, Window.partitionBy(key)

    def size(measured: bool, part: int) -> Column:
        own = (c("measured") == measured) & (c("part") == part)
        x, y = (F.sum(F.when(own, c("pt") * f("phi"))).over(w) for f in (F.cos, F.sin))
        return F.round(F.sqrt(x * x + y * y), 9)

    sizes = {f"__{int(m)}{p}": size(m, p) for m in (False, True) for p in (0, 1)}
    first = lambda m: F.when(c(f"__{m}0").isNull() | (c(f"__{m}1") > c(f"__{m}0")), 1).otherwise(0)
    named = rows.withColumns(sizes).withColumn("leading", c("part") == F.when(c("measured"), first(1)).otherwise(first(0)))
    of = lambda m, x: F.max(F.when(c("measured") == m, x))
    ids = named.groupBy(key, "id").agg(of(False, c("leading")).alias("__g"), of(True, c("leading")).alias("__m"), of(False, c("pt")).alias("__pt"))
    total = {p: F.sum(F.when(c("__g") == p, c("__pt"))) for p in (True, False)}
    flag = lambda p, o: F.coalesce(F.sum(F.when((c("__g") == p) & (c("__m") == o), c("__pt"))) / total[p] > 0.5, F.lit(False))
    flags = {"leading_proper": flag(True, True), "leading_mistag": flag(True, False), "subleading_proper": flag(False, False), "subleading_mistag": flag(False, True)}
    both = F.count(F.when(c("__g").isNotNull() & c("__m").isNotNull(), 1)).alias("__n")
    return ids.groupBy(key).agg(both, *[x.alias(n) for n, x in flags.items()]).filter("__n > 0").drop("__n")


def matching_class(leading: Column, subleading: Column, mixes: bool = False) -> Column:
    """Class of a jet by the codes of both prongs; null where a prong has no code.

    A correct prong beside a swapped one is ``other``, or with ``mixes`` one of two classes of its own.
    """
    code = {"correct": 1, "mistag": 2, "untagged": 3}
    name = lambda a, b: "pure" if a == b == "correct" else "swap" if a == b == "mistag" else "both_untagged" if a == b else f"leading_{a}_subleading_{b}"
    out = F.when((leading < 1) | (subleading < 1), F.lit(None).cast("string"))
    for a in code:
        for b in code:
            mixed = {a, b} == {"correct", "mistag"} and not mixes
            out = out.when((leading == code[a]) & (subleading == code[b]), F.lit("other" if mixed else name(a, b)))
    return out


def with_side_table(skim: DataFrame, side: DataFrame, key: str = "jet_id") -> DataFrame:
    """Columns of a side table on a stable jet key; a name that the skim has already is refused."""
    twice = set(skim.columns) & set(side.columns) - {key}
    if twice:
        raise ValueError(f"columns of both tables: {sorted(twice)}")
    return skim.join(side, key, "left")
