"""Response matrices, closure samples and Bayesian unfolding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import checkpointed
from .histograms import Axis, Variable, histogram
from .sampling import uniform


def binning_for(settings: DataFrame, method: str, variation: str = "nominal") -> DataFrame:
    """(variable, edges) for a method: its own binning before the default, the special setting before the nominal."""
    fits = settings.filter(F.col("method").isin(method, "default") & F.col("variation").isin(variation, "nominal"))
    rank = F.struct(F.col("variation") != variation, F.col("method") != method)
    return fits.groupBy("variable").agg(F.min_by("edges", rank).alias("edges"))


def untagged_bin(edges: Sequence[float], low: float, high: float) -> tuple[float, float, float] | None:
    """Range and centre of the bin for jets without a splitting; equal edges switch it off."""
    return None if low == high else (low, high, (low + high) / 2)


def with_untagged(value: Column, untagged: float, low: float, high: float) -> Column:
    """Negative values go to the untagged value; others outside [low, high] are null."""
    return F.when(value < 0, F.lit(untagged)).when(value.between(low, high), value)


def response_rows(skim: DataFrame, meas_pt: str, meas: str, true_pt: str, true: str, smeared_pt: Variable, smeared: Variable, truth_pt: Variable, truth: Variable, weight: str = "scale_factor", keep: Sequence[str] = ()) -> DataFrame:
    """One row per jet with flags and bins: in_truth (truth cuts), in_both (measured cuts as well), and four bins."""
    inside = lambda x, axis: F.col(x).between(axis.edges[0], axis.edges[-1])
    in_truth = inside(true_pt, truth_pt) & inside(true, truth)
    in_both = in_truth & inside(meas_pt, smeared_pt) & inside(meas, smeared)
    bins = {"meas_pt_bin": smeared_pt.bin(F.col(meas_pt)), "meas_bin": smeared.bin(F.col(meas)), "true_pt_bin": truth_pt.bin(F.col(true_pt)), "true_bin": truth.bin(F.col(true))}
    return skim.select("jet_id", *keep, F.col(weight).alias("w"), in_truth.alias("in_truth"), in_both.alias("in_both"), *[b.alias(n) for n, b in bins.items()]).filter("in_truth")


def response(rows: DataFrame) -> DataFrame:
    """Sparse four-dimensional response of jets that pass all cuts."""
    return rows.filter("in_both").groupBy("meas_pt_bin", "meas_bin", "true_pt_bin", "true_bin").agg(F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"), F.count(F.lit(1)).alias("n"))


def truth_spectra(rows: DataFrame) -> DataFrame:
    """Full truth and truth after measured cuts, in one pass: (true_pt_bin, true_bin, full, cut)."""
    return rows.groupBy("true_pt_bin", "true_bin").agg(F.sum("w").alias("full"), F.sum(F.when(F.col("in_both"), F.col("w")).otherwise(0.0)).alias("cut"))


def efficiency(truth: DataFrame, by: str) -> DataFrame:
    """Kinematic efficiency along one axis."""
    return truth.groupBy(by).agg((F.sum("cut") / F.sum("full")).alias("efficiency"))


def pure_match(leading: Column, subleading: Column, value: Column, untagged: float) -> Column:
    return ((leading == 1) & (subleading == 1)) | (F.abs(value - untagged) < 0.001)


def reweighted(rows: DataFrame, factors: DataFrame, x: str, axis: Axis, weight: str = "w") -> DataFrame:
    """Multiply weights by factors (bin, factor) of the truth; values beyond the axis take its first or last bin."""
    at = F.greatest(F.lit(0), F.least(axis.bin(F.col(x)), F.lit(axis.n - 1)))
    return rows.withColumn("__bin", at).join(factors.select(F.col("bin").alias("__bin"), "factor"), "__bin").withColumn(weight, F.col(weight) * F.col("factor")).drop("__bin", "factor")


def closure_split(rows: DataFrame, key: str = "jet_id", share: float = 0.75, seed: int = 5) -> DataFrame:
    """Add ``part``: response for a share of the keys, pseudo-data for the others."""
    return rows.withColumn("part", F.when(uniform(key, seed=seed) < share, "response").otherwise("pseudo_data"))


def folded(truth: DataFrame, resp: DataFrame) -> DataFrame:
    """Measured = sum over truth of P(measured | truth) times truth: (meas_pt_bin, meas_bin, value)."""
    total = F.sum("sumw").over(Window.partitionBy("true_pt_bin", "true_bin"))
    p = resp.withColumn("p", F.when(total != 0, F.col("sumw") / total).otherwise(0.0))
    return p.join(truth, ["true_pt_bin", "true_bin"]).groupBy("meas_pt_bin", "meas_bin").agg(F.sum(F.col("p") * F.col("value")).alias("value"))


CAUSE, EFFECT = ["true_pt_bin", "true_bin"], ["meas_pt_bin", "meas_bin"]
#: Iterations between two written tables: a plan grows by two windows an iteration.
WRITTEN_EVERY = 5


def _cells(resp: DataFrame, truth: DataFrame, measured: DataFrame, setting: str) -> tuple[DataFrame, DataFrame]:
    """The filled cells of every setting's response with P(measured | true), its sum over measured bins (``seen``), the
    measured value (``d``) and its variance (``var``; the value itself if none is given); and the truth."""
    t = truth.groupBy(setting, *CAUSE).agg(F.sum("value").cast("double").alias("t"))
    p = resp.groupBy(setting, *EFFECT, *CAUSE).agg(F.sum("sumw").cast("double").alias("r")).join(t, [setting, *CAUSE])
    p = p.withColumn("p", F.when(F.col("t") > 0, F.col("r") / F.col("t")).otherwise(0.0))
    var = F.sum("variance" if "variance" in measured.columns else "value").cast("double")
    d = measured.groupBy(setting, *EFFECT).agg(F.sum("value").cast("double").alias("d"), var.alias("var"))
    p = p.join(d, [setting, *EFFECT], "left").fillna(0.0, ["d", "var"])
    p = p.withColumn("seen", F.sum("p").over(Window.partitionBy(setting, *CAUSE)))
    return p.select(setting, *EFFECT, *CAUSE, "p", "seen", "d", "var", F.col("t").alias("before")), t


def _iterated(cells: DataFrame, setting: str) -> DataFrame:
    """One iteration on the cells: ``m`` shares a measured bin out over the true ones, ``value`` and ``error`` are the spectrum's."""
    joint = cells.withColumn("joint", F.col("p") * F.col("before"))
    whole = F.sum("joint").over(Window.partitionBy(setting, *EFFECT))
    m = joint.withColumn("m", F.when((whole > 0) & (F.col("seen") > 0), F.col("joint") / (whole * F.col("seen"))).otherwise(0.0))
    over = Window.partitionBy(setting, *CAUSE)
    return m.drop("joint").withColumns({"value": F.sum(F.col("m") * F.col("d")).over(over), "error": F.sqrt(F.sum(F.col("m") * F.col("m") * F.col("var")).over(over))})


def unfolded(resp: DataFrame, truth: DataFrame, measured: DataFrame, iterations: int = 10, setting: str = "setting") -> DataFrame:
    """(setting, iteration, true_pt_bin, true_bin, value, error): iterative unfolding of D'Agostini (1995), all settings at once.

    ``truth`` is the full truth, so lost jets count in the efficiency. With P the
    probability of a measured bin given a true one, an iteration shares each
    measured bin out over the true ones in proportion to P times the spectrum of
    the iteration before. The error is that of the measured spectrum alone. Each
    iteration is two windows over the filled cells of the response, which carry
    the spectra; every few iterations they are written, so that plans stay short.
    """
    cells, t = _cells(resp, truth, measured, setting)
    kept = [setting, *EFFECT, *CAUSE, "p", "seen", "d", "var", "before", "spectra"]
    empty = F.array().cast("array<struct<iteration:int,value:double,error:double>>")
    cells = checkpointed(cells.withColumn("spectra", empty).select(*kept))
    for k in range(1, iterations + 1):
        now = F.struct(F.lit(k).alias("iteration"), F.col("value"), F.col("error"))
        cells = _iterated(cells, setting).withColumn("spectra", F.array_append("spectra", now)).withColumn("before", F.col("value")).select(*kept)
        if k % WRITTEN_EVERY == 0 and k < iterations:
            cells = checkpointed(cells)
    spectra = cells.groupBy(setting, *CAUSE).agg(F.first("spectra").alias("spectra"))
    none = F.transform(F.sequence(F.lit(1), F.lit(iterations)), lambda k: F.struct(k.alias("iteration"), F.lit(0.0).alias("value"), F.lit(0.0).alias("error")))
    every = t.join(spectra, [setting, *CAUSE], "left").select(setting, *CAUSE, F.explode(F.coalesce("spectra", none)).alias("s"))
    return checkpointed(every.select(setting, "s.iteration", *CAUSE, "s.value", "s.error"))


def unfolding_covariance(resp: DataFrame, truth: DataFrame, measured: DataFrame, iterations: int = 8, setting: str = "setting") -> DataFrame:
    """(setting, pt_i, bin_i, pt_j, bin_j, value): covariance of the unfolded spectrum after some iterations.

    The spectrum of an iteration depends on the measured bins through its own
    sharing and through the spectrum before, which the sharing weights by (Adye,
    2011). With M the sharing, n0 and n the spectra before and after, E the
    measured values and e the efficiency, the derivatives D = dn/dE are

        D = M + (n / n0) D0 - M E G,    G(k, j) = sum over l of M(l, k) e(l) / n0(l) D0(l, j),

    where D0 are those of the iteration before: two joins of the filled cells,
    one on the true bin and one on the measured one, and grouped sums. The
    covariance is a self-join of D on the measured bin, weighted by its variance.
    """
    cells, _ = _cells(resp, truth, measured, setting)
    cells = checkpointed(cells)
    meas = lambda x: [F.col(c).alias(f"{x}_{c}") for c in EFFECT]
    other = [f"of_{c}" for c in EFFECT]
    found = None
    for _k in range(iterations):
        step = checkpointed(_iterated(cells, setting))
        direct = step.select(setting, *CAUSE, *meas("of"), F.col("m").alias("x"))
        if found is not None:
            spectrum = step.filter("before > 0").groupBy(setting, *CAUSE).agg(F.first(F.col("value") / F.col("before")).alias("ratio"))
            scaled = found.join(spectrum, [setting, *CAUSE]).select(setting, *CAUSE, *other, (F.col("x") * F.col("ratio")).alias("x"))
            weights = step.filter("before > 0").select(setting, *CAUSE, *EFFECT, (F.col("m") * F.col("seen") / F.col("before")).alias("g"))
            g = weights.join(found, [setting, *CAUSE]).groupBy(setting, *EFFECT, *other).agg(F.sum(F.col("g") * F.col("x")).alias("g"))
            through = step.select(setting, *CAUSE, *EFFECT, (F.col("m") * F.col("d")).alias("me")).join(g, [setting, *EFFECT])
            direct = direct.unionByName(scaled).unionByName(through.select(setting, *CAUSE, *other, (-F.col("me") * F.col("g")).alias("x")))
            direct = direct.groupBy(setting, *CAUSE, *other).agg(F.sum("x").alias("x"))
        found = checkpointed(direct)
        cells = step.select(setting, *EFFECT, *CAUSE, "p", "seen", "d", "var", F.col("value").alias("before"))
    variance = cells.groupBy(setting, *meas("of")).agg(F.first("var").alias("var"))
    weighted = found.join(variance, [setting, *other])
    a = weighted.select(setting, *other, "var", F.col("x").alias("a"), F.col("true_pt_bin").alias("pt_i"), F.col("true_bin").alias("bin_i"))
    b = found.select(setting, *other, F.col("x").alias("b"), F.col("true_pt_bin").alias("pt_j"), F.col("true_bin").alias("bin_j"))
    return a.join(b, [setting, *other]).groupBy(setting, "pt_i", "bin_i", "pt_j", "bin_j").agg(F.sum(F.col("a") * F.col("b") * F.col("var")).alias("value"))


def correlation_blocks(covariance: DataFrame, keys: Sequence[str] = ("setting",)) -> DataFrame:
    """(keys, block, at, i, j, value): Pearson coefficients within each pt bin (block ``pt``, between bins of the variable)
    and within each bin of the variable (block ``variable``, between pt bins); 0 without variance."""
    pair = [F.struct(F.lit(n).alias("block"), F.col(f"{at}_i").alias("at"), F.col(f"{by}_i").alias("i"), F.col(f"{by}_j").alias("j"), (F.col(f"{at}_i") == F.col(f"{at}_j")).alias("inside")) for n, at, by in (("pt", "pt", "bin"), ("variable", "bin", "pt"))]
    rows = covariance.select(*keys, "value", F.explode(F.array(*pair)).alias("b")).filter("b.inside").select(*keys, "b.block", "b.at", "b.i", "b.j", "value")
    return correlations(rows, [*keys, "block", "at"])


def refolded(spectrum: DataFrame, resp: DataFrame, truth: DataFrame, setting: str = "setting", keys: Sequence[str] = ()) -> DataFrame:
    """(setting, meas_pt_bin, meas_bin, value): what a true spectrum looks like when measured, losses included; for each of ``keys``."""
    cause = [setting, *CAUSE]
    full = truth.groupBy(*cause).agg(F.sum("value").alias("t")).filter("t > 0")
    p = resp.join(full, cause).join(spectrum.select(*cause, *keys, "value"), cause)
    return p.groupBy(setting, *keys, *EFFECT).agg(F.sum(F.col("sumw") / F.col("t") * F.col("value")).alias("value"))


def correlations(covariance: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson coefficients from (keys, i, j, value): a self join on the diagonal."""
    diagonal = covariance.filter("i = j")
    a, b = diagonal.select(*keys, "i", F.col("value").alias("vi")), diagonal.select(*keys, "j", F.col("value").alias("vj"))
    pearson = F.when((F.col("vi") > 0) & (F.col("vj") > 0), F.col("value") / F.sqrt(F.col("vi") * F.col("vj"))).otherwise(0.0)
    return covariance.join(a, [*keys, "i"]).join(b, [*keys, "j"]).select(*keys, "i", "j", pearson.alias("value"))


def projected_spectrum(spectra: DataFrame, along: str, keys: Sequence[str]) -> DataFrame:
    """Sum over the other axis: values add, errors in quadrature."""
    return spectra.groupBy(*keys, along).agg(F.sum("value").alias("value"), F.sqrt(F.sum(F.col("error") * F.col("error"))).alias("error"))


def iteration_errors(spectra: DataFrame, keys: Sequence[str], prior: DataFrame | None = None, untagged: Column | None = None) -> DataFrame:
    """(iteration, regularization, statistical, prior, total): what there is to choose an iteration by.

    Regularisation: the larger change to the iteration before and to the second
    one after, where both exist. Prior: the difference to the same iteration of
    the unfolding with another prior, if one is given. Statistical: errors, without
    the bins where ``untagged`` holds, whose errors say little. All are summed
    relative to the value (0 where that is 0) and add in quadrature.
    """
    w = Window.partitionBy(*keys).orderBy("iteration")
    before, after = F.lag("value").over(w), F.lead("value", 2).over(w)
    rows = spectra.withColumns({"before": before, "after": after}).filter("before is not null and after is not null")
    if prior is not None:
        rows = rows.join(prior.select(*keys, "iteration", F.col("value").alias("other")), [*keys, "iteration"], "left")
    part = lambda x: F.sum(F.when(F.col("value") != 0, x / F.col("value")).otherwise(0.0))
    change = F.greatest(F.abs(F.col("before") - F.col("value")), F.abs(F.col("after") - F.col("value")))
    counted = F.col("error") if untagged is None else F.when(untagged, 0.0).otherwise(F.col("error"))
    with_prior = part(F.abs(F.col("value") - F.coalesce("other", F.lit(0.0)))) if prior is not None else F.lit(0.0)
    sums = rows.groupBy("iteration").agg(part(change).alias("regularization"), part(counted).alias("statistical"), with_prior.alias("prior"))
    return sums.withColumn("total", F.sqrt(sum((F.col(c) * F.col(c) for c in ("regularization", "statistical", "prior")), F.lit(0.0))))


def best_iteration(errors: DataFrame) -> DataFrame:
    """One row: the iteration of the least total, the first of equal ones."""
    return errors.agg(F.min_by("iteration", F.struct("total", "iteration")).alias("iteration"))


#: Closure variants: whether the response and the pseudo-data take the reweighting factor.
VARIANTS = {"split": (False, False), "reweight_pseudo_data": (False, True), "reweight_response": (True, False)}


def closure_variants(parts: DataFrame, factor: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(response, truth, measured, pseudo-truth) of all closure variants as settings, from ``closure_split`` rows.

    Each variant takes one part's weights as they are and may multiply the
    other's by ``factor``, a function of true values. Both sums of every cell are
    worked out in one pass over the rows, and the few cells are dealt to variants.
    """
    response = F.col("part") == "response"
    cells = parts.withColumn("f", factor).groupBy("part", "in_both", *EFFECT, *CAUSE).agg(F.sum("w").alias("plain"), F.sum(F.col("w") * F.col("f")).alias("reweighted"))
    takes = lambda v: F.when(response, F.lit(VARIANTS[v][0])).otherwise(F.lit(VARIANTS[v][1]))
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("setting"), F.when(takes(v), F.col("reweighted")).otherwise(F.col("plain")).alias("value")) for v in VARIANTS]))
    rows = checkpointed(cells.select("part", "in_both", *EFFECT, *CAUSE, each.alias("s")).select("s.*", "part", "in_both", *EFFECT, *CAUSE))
    of = lambda what, *keys: rows.filter(what).groupBy("setting", *keys)
    pseudo = F.col("part") == "pseudo_data"
    return (
        of(response & F.col("in_both"), *EFFECT, *CAUSE).agg(F.sum("value").alias("sumw")),
        of(response, *CAUSE).agg(F.sum("value").alias("value")),
        of(pseudo & F.col("in_both"), *EFFECT).agg(F.sum("value").alias("value")),
        of(pseudo, *CAUSE).agg(F.sum("value").alias("value")),
    )


def raw_spectrum(skim: DataFrame, pt: str, value: str, pt_axis: Variable, axis: Variable, untagged: float, low: float, high: float, weight: str | None = None) -> DataFrame:
    """Measured spectrum: closed pt range, absent splittings at the untagged value."""
    rows = skim.filter(F.col(pt).between(pt_axis.edges[0], pt_axis.edges[-1])).withColumn("__v", with_untagged(F.col(value), untagged, low, high)).filter("__v is not null")
    return histogram(rows, {"meas_pt_bin": (F.col(pt), pt_axis), "meas_bin": (F.col("__v"), axis)}, F.col(weight) if weight else None)
