"""Queries: sources, functions, selections, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kinematics as K
from ..functions import selections as P
from ..operators import sampling, weights
from ..operators.histograms import Regular
from ..operators.tracking_efficiency import RUN1, RUN2_ETA, RUN2_PT, efficiency
from ..sources import event_tables, generator_text
from .catalogue import query, r6, rounded
from .views import view


@query("SELECT event_id, idx, pt FROM (SELECT *, row_number() OVER (ORDER BY event_id, idx) - 1 AS p FROM tracks) t WHERE p >= 100 AND p < 350", "tracks")
def s02_entry_range(spark: SparkSession, d: str) -> DataFrame:
    return event_tables.entries(view(spark, d, "tracks"), ["event_id", "idx"], 100, 350).select("event_id", "idx", "pt")


@query("SELECT event_id, idx, pt FROM (SELECT *, row_number() OVER (ORDER BY event_id, idx) - 1 AS p FROM tracks) t WHERE p >= 4000 AND p < 4250", "tracks")
def s02_entry_range_far(spark: SparkSession, d: str) -> DataFrame:
    """A range far from the beginning: by numbers over all partitions."""
    return event_tables.entries(view(spark, d, "tracks"), ["event_id", "idx"], 4000, 4250, near=0).select("event_id", "idx", "pt")


@query("SELECT CAST(floor((row_number() OVER (ORDER BY event_id, idx) - 1) / 1000) AS BIGINT) AS chunk, event_id, idx FROM tracks", "tracks")
def s02_chunks(spark: SparkSession, d: str) -> DataFrame:
    return event_tables.chunked(view(spark, d, "tracks"), ["event_id", "idx"], 1000).select("chunk", "event_id", "idx")


@query("SELECT event_id, CAST(count(*) AS INT) AS n_tracks, round(sum(pt), 6) AS sum_pt, first(pt ORDER BY idx) AS first_pt FROM tracks GROUP BY event_id", "tracks")
def s09_nested_events(spark: SparkSession, d: str) -> DataFrame:
    nested = event_tables.grouped_events(view(spark, d, "tracks"), ("event_id",))
    return nested.select("event_id", F.size("particles").alias("n_tracks"), r6(F.aggregate("particles", F.lit(0.0), lambda s, p: s + p["pt"])).alias("sum_pt"), F.col("particles")[0]["pt"].alias("first_pt"))


@query("SELECT CAST(regexp_extract(file_name, 'bin_([0-9]+)', 1) AS INT) AS pt_hard_bin, count(*) AS n_files FROM files GROUP BY 1", "files")
def s11_bins_in_file_names(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").groupBy(generator_text.bin_of_file(F.col("file_name")).alias("pt_hard_bin")).agg(F.count("*").alias("n_files"))


@query("SELECT file_id, low, least(low + 250, n_entries) AS high FROM (SELECT file_id, n_entries, unnest(generate_series(0, n_entries - 1, 250)) AS low FROM files) t", "files")
def s13_entry_ranges(spark: SparkSession, d: str) -> DataFrame:
    return event_tables.entry_ranges(view(spark, d, "files"), 250).select("file_id", "low", "high")


@query("SELECT event_id, run_number, z_vtx_reco FROM event_info WHERE is_ev_rej = 0 AND abs(z_vtx_reco) < 10", "event_info")
def p01_event_selection(spark: SparkSession, d: str) -> DataFrame:
    return P.select_events(view(spark, d, "event_info")).select("event_id", "run_number", "z_vtx_reco")


@query("SELECT event_id, CAST(count(*) AS INT) AS n_kept FROM tracks WHERE pt >= 0.15 GROUP BY event_id", "tracks")
def p03_p04_track_cut(spark: SparkSession, d: str) -> DataFrame:
    nested = event_tables.grouped_events(view(spark, d, "tracks"), ("event_id",)).withColumn("particles", P.above(F.col("particles")))
    return nested.filter(P.occupied(F.col("particles"))).select("event_id", F.size("particles").alias("n_kept"))


@query("SELECT event_id, sum(idx + 100000) AS index_sum FROM tracks GROUP BY event_id", "tracks")
def p05_background_index(spark: SparkSession, d: str) -> DataFrame:
    nested = event_tables.grouped_events(view(spark, d, "tracks"), ("event_id",)).select("event_id", P.indexed(F.col("particles"), 100000).alias("p"))
    return nested.select("event_id", F.explode("p.index").alias("i")).groupBy("event_id").agg(F.sum("i").alias("index_sum"))


_PID = "CASE h4 % 6 WHEN 0 THEN 211 WHEN 1 THEN -211 WHEN 2 THEN 321 WHEN 3 THEN -321 WHEN 4 THEN 2212 ELSE 22 END"


@query(f"SELECT {_PID} AS particle_id, count(*) AS n FROM tracks WHERE abs({_PID}) IN (211, 321) OR {_PID} IN (2212) GROUP BY 1", "tracks")
def p07_species(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "tracks").withColumn("particle_id", F.expr(_PID))
    return rows.filter(P.of_species(F.col("particle_id"), (211, 321), (2212,))).groupBy("particle_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, max(pt) AS hardest FROM tracks GROUP BY event_id HAVING max(pt) <= 15", "tracks")
def p08_no_hard_constituent(spark: SparkSession, d: str) -> DataFrame:
    nested = event_tables.grouped_events(view(spark, d, "tracks"), ("event_id",)).filter(P.no_hard_constituent(F.col("particles"), 15.0))
    return nested.select("event_id", F.array_max("particles.pt").alias("hardest"))


@query("SELECT event_id, round(0.02 * n, 6) AS area FROM (SELECT event_id, CAST(count(CASE WHEN h4 % 4 = 0 THEN 1 END) AS DOUBLE) AS n FROM tracks GROUP BY event_id) t WHERE 0.02 * n > 0.9 * 3.141592653589793 * 0.16", "tracks")
def p09_large_area(spark: SparkSession, d: str) -> DataFrame:
    """An event's tracks as one jet, every fourth of them a ghost of area 0.02: above 90 percent of a circle."""
    jets = view(spark, d, "tracks").groupBy("event_id").agg((0.02 * F.count(F.when(F.col("h4") % 4 == 0, 1))).alias("area"))
    return jets.filter(P.large_area(F.col("area"), 0.4, 90.0)).select("event_id", r6("area").alias("area"))


@query("SELECT system, count(*) AS n FROM (SELECT event_id, count(*) AS c FROM tracks WHERE pt > 15 GROUP BY event_id) t CROSS JOIN (SELECT 'pp' AS system UNION ALL SELECT 'pythia' UNION ALL SELECT 'PbPb' UNION ALL SELECT 'embedPythia') s WHERE c > 1 OR system IN ('PbPb', 'embedPythia') GROUP BY system", "tracks")
def p10_several_constituents(spark: SparkSession, d: str) -> DataFrame:
    """An event's hard tracks as the constituents of one jet, in each collision system."""
    jets = event_tables.grouped_events(view(spark, d, "tracks").filter("pt > 15"), ("event_id",))
    passed = [F.when(P.several_constituents(F.col("particles"), s), F.lit(s)) for s in ("pp", "pythia", "PbPb", "embedPythia")]
    return jets.select(F.explode(F.array_compact(F.array(*passed))).alias("system")).groupBy("system").agg(F.count("*").alias("n"))


@query("SELECT event_id, idx, eta FROM tracks WHERE abs(eta) < 0.9 - 0.4 AND pt >= 1 AND pt < 5", "tracks")
def p11_p12_fiducial(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "tracks").filter(P.fiducial(F.col("eta"), 0.4) & P.in_range(F.col("pt"), 1, 5)).select("event_id", "idx", "eta")


@query("SELECT jet_id, CASE WHEN true_jet_pt > 10 THEN 'unfolding' ELSE 'histograms' END AS path FROM jets WHERE det_level_leading_track_pt >= hybrid_leading_track_pt AND true_jet_pt >= 10", "jets")
def p14_double_counting(spark: SparkSession, d: str) -> DataFrame:
    j, c = view(spark, d, "jets"), F.col
    args = c("det_level_leading_track_pt"), c("hybrid_leading_track_pt"), c("true_jet_pt")
    return j.filter(P.no_double_counting(*args)).select("jet_id", F.when(P.no_double_counting(*args, strict=True), "unfolding").otherwise("histograms").alias("path"))


@query("SELECT count(*) AS n, round(sum(coalesce(CASE WHEN pt_hard_bin > 5 THEN scale_factor END, 1)), 6) AS sumw FROM jets", "jets")
def p16_missing_weights(spark: SparkSession, d: str) -> DataFrame:
    w = P.weight_or_one(F.when(F.col("pt_hard_bin") > 5, F.col("scale_factor")))
    return view(spark, d, "jets").agg(F.count("*").alias("n"), r6(F.sum(w)).alias("sumw"))


@query("SELECT s.min_kt, count(*) AS n FROM skim JOIN (SELECT CAST(-1 AS DOUBLE) AS min_kt UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 5) s ON hybrid_kt >= s.min_kt WHERE hybrid_n_passed <= 1 AND momentum_fraction >= 0.5 GROUP BY s.min_kt", "skim")
def p17_p18_selections(spark: SparkSession, d: str) -> DataFrame:
    cuts = spark.createDataFrame([(x,) for x in P.MIN_KT], "min_kt double")  # the selections, four rows
    rows = view(spark, d, "skim").filter("hybrid_n_passed <= 1 and momentum_fraction >= 0.5")
    return rows.join(F.broadcast(cuts), F.col("hybrid_kt") >= F.col("min_kt")).groupBy("min_kt").agg(F.count("*").alias("n"))


@query("SELECT jet_id FROM skim WHERE hybrid_n_passed > 0 AND true_n_passed > 0", "skim")
def p19_groomed_at_both_levels(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "skim").filter("hybrid_n_passed > 0 and true_n_passed > 0").select("jet_id")


@query("SELECT event_id, count(*) AS n_background FROM (SELECT event_id, idx FROM det_tracks UNION ALL SELECT event_id, idx FROM background) t WHERE idx >= 100000 GROUP BY event_id", "det_tracks", "background")
def p20_background_only(spark: SparkSession, d: str) -> DataFrame:
    both = view(spark, d, "det_tracks").unionByName(view(spark, d, "background"))
    return both.filter("idx >= 100000").groupBy("event_id").agg(F.count("*").alias("n_background"))


@query(
    """SELECT 0 AS step, 'all' AS name, count(*) AS n FROM skim
UNION ALL SELECT 1, 'pt', count(*) FROM skim WHERE hybrid_jet_pt >= 40 AND hybrid_jet_pt < 120
UNION ALL SELECT 2, 'fraction', count(*) FROM skim WHERE hybrid_jet_pt >= 40 AND hybrid_jet_pt < 120 AND momentum_fraction >= 0.5
UNION ALL SELECT 3, 'groomed', count(*) FROM skim WHERE hybrid_jet_pt >= 40 AND hybrid_jet_pt < 120 AND momentum_fraction >= 0.5 AND hybrid_n_passed > 0""",
    "skim",
)
def p21_cut_flow(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return P.cut_flow(view(spark, d, "skim"), [("pt", P.in_range(c("hybrid_jet_pt"), 40, 120)), ("fraction", c("momentum_fraction") >= 0.5), ("groomed", c("hybrid_n_passed") > 0)])


_NEXT = "SELECT event_id, idx, eta, phi, lead(eta) OVER (PARTITION BY event_id ORDER BY idx) AS eta2, lead(phi) OVER (PARTITION BY event_id ORDER BY idx) AS phi2 FROM tracks"
_TURN = "phi - phi2 - 6.283185307179586 * floor((phi - phi2 + 3.141592653589793) / 6.283185307179586)"


@query(f"SELECT event_id, idx, round(sqrt((eta - eta2) * (eta - eta2) + ({_TURN}) * ({_TURN})), 6) AS wrapped, round(sqrt((eta - eta2) * (eta - eta2) + (phi - phi2) * (phi - phi2)), 6) AS plain FROM ({_NEXT}) t WHERE eta2 IS NOT NULL", "tracks")
def f01_f02_distances(spark: SparkSession, d: str) -> DataFrame:
    """From each track to the next of its event."""
    w = Window.partitionBy("event_id").orderBy("idx")
    t = view(spark, d, "tracks").withColumns({"eta2": F.lead("eta").over(w), "phi2": F.lead("phi").over(w)}).filter("eta2 is not null")
    c = [F.col(x) for x in ("eta", "phi", "eta2", "phi2")]
    return t.select("event_id", "idx", r6(K.delta_r(*c)).alias("wrapped"), r6(K.delta_r(*c, wrap=False)).alias("plain"))


@query("SELECT event_id, idx, round(pt * cos(phi), 6) + 0.0 AS px, round(pt * sin(phi), 6) + 0.0 AS py, round(pt * (exp(eta) - exp(-eta)) / 2, 6) + 0.0 AS pz, round(sqrt(pt * pt + pow(pt * (exp(eta) - exp(-eta)) / 2, 2) + 0.139 * 0.139), 6) AS e, round(pt, 6) AS pt, round(eta, 6) + 0.0 AS eta FROM tracks", "tracks")
def f03_four_vectors(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    v = view(spark, d, "tracks").withColumn("p", K.cartesian(c("pt"), c("eta"), c("phi"), F.lit(K.PION_MASS)))
    back = v.withColumn("b", K.polar(c("p.px"), c("p.py"), c("p.pz"), c("p.e")))
    return back.select("event_id", "idx", *[(r6(f"p.{x}") + 0.0).alias(x) for x in ("px", "py", "e")], (r6("p.pz") + 0.0).alias("pz"), r6("b.pt").alias("pt"), (r6("b.eta") + 0.0).alias("eta"))


@query("SELECT jet_id, round(exp(-0.5 * (true_jet_pt - 50) * (true_jet_pt - 50) / 400), 6) AS gaus, round(1e6 * pow(0.5 * true_jet_pt, -3.5), 6) AS power_law FROM jets", "jets")
def f04_f05_shapes(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("true_jet_pt")
    return view(spark, d, "jets").select("jet_id", r6(K.gaussian(x, 50, 20)).alias("gaus"), r6(1e6 * K.power_law(x, 0.5, 3.5)).alias("power_law"))


@query("SELECT DISTINCT 'jet_pt_' || CAST(pt_hard_bin * 5 AS VARCHAR) || '_' || CAST(pt_hard_bin * 5 + 5 AS VARCHAR) AS name, CASE WHEN pt_hard_bin > 10 THEN -9999 ELSE pt_hard_bin END AS filled FROM jets", "jets")
def f06_f08_names_and_fill(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("pt_hard_bin")
    return view(spark, d, "jets").select(K.range_name(F.lit("jet_pt"), b * 5, b * 5 + 5).alias("name"), K.null_filled(F.when(b <= 10, b)).alias("filled")).distinct()


_X, _Y = "pt", "abs(eta)"
_PP = f"(CASE WHEN pt < 6 THEN ((((((0.000365*{_X} - 0.007681)*{_X} + 0.062964)*{_X} - 0.252024)*{_X} + 0.501831)*{_X} - 0.442232)*{_X} + 1) ELSE 0.898052 END) * ((((-2.7782*{_Y} + 4.311098)*{_Y} - 2.213152)*{_Y} + 0.402825)*{_Y} + 1)"


@query(f"SELECT event_id, idx, round({_PP.replace('0.', '0.')}, 6) AS efficiency FROM tracks", "tracks")
def r01_efficiency_pp(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "tracks").select("event_id", "idx", r6(efficiency(F.col("pt"), F.col("eta"), "LHC11a")).alias("efficiency"))


def _run1_sql(p: tuple[float, ...]) -> str:
    return f"""(CASE WHEN pt < 2.9 THEN {p[0]} * exp(-pow({p[1]} / pt, {p[2]})) + {p[3]} * pt ELSE {p[4]} + {p[5]} * pt + {p[6]} * pt * pt END
 * CASE WHEN eta < 0 THEN {p[7]} * exp(-pow({p[8]} / abs(eta + 0.91), {p[9]})) + {p[10]} * eta WHEN eta <= 0.4 THEN {p[11]} + {p[12]} * eta + {p[13]} * eta * eta
 ELSE {p[14]} * exp(-pow({p[15]} / abs(0.91 - eta), {p[16]})) END)"""


def _run2_sql(p: tuple[float, ...], q: tuple[float, ...]) -> str:
    side = lambda v, x: f"({v[0]} * exp(-pow({v[1]} / abs({x} + 0.91), {v[2]})) + {v[3]} * eta + {v[4]} * exp(-0.5 * pow((eta + 0.04) / {v[5]}, 2))) / {q[12]}"
    low = f"{p[0]} - {p[1]} / pt + {p[2]} * exp(-0.5 * pow((pt - {p[3]}) / {p[4]}, 2))"
    high = " + ".join(f"{c:.10f} * pow(pt, {k})" for k, c in enumerate(p[5:10]))
    return f"(CASE WHEN pt <= 3.5 THEN {low} ELSE {high} END * CASE WHEN eta <= -0.04 THEN {side(q[0:6], 'eta')} ELSE {side(q[6:12], '(-eta)')} END)"


def _by_class(parts: list[str]) -> str:
    return "CASE activity " + " ".join(f"WHEN {k} THEN {part}" for k, part in enumerate(parts)) + " END"


_ACTIVITY = "CASE WHEN centrality < 10 THEN 0 WHEN centrality < 30 THEN 1 WHEN centrality < 50 THEN 2 WHEN centrality < 90 THEN 3 END"


@query(
    f"""SELECT CAST(activity AS INT) AS activity, round(avg({_by_class([_run1_sql(p) for p in RUN1])}), 6) AS "LHC11h", round(avg({_by_class([_run2_sql(*pq) for pq in zip(RUN2_PT, RUN2_ETA)])}), 6) AS "LHC15o", count(*) AS n
FROM (SELECT t.*, {_ACTIVITY} AS activity FROM tracks t JOIN event_info i ON i.event_id = t.event_id) x GROUP BY activity""",
    "tracks",
    "event_info",
)
def r01_efficiency_by_activity(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "tracks").join(view(spark, d, "event_info"), "event_id").withColumn("activity", sampling.activity_class(F.col("centrality")))
    c = F.col
    return rows.groupBy("activity").agg(*[r6(F.avg(efficiency(c("pt"), c("eta"), p, c("activity")))).alias(p) for p in ("LHC11h", "LHC15o")], F.count("*").alias("n"))


_HASH = "CAST(('0x' || substr(md5(concat_ws(':', event_id, idx, '{seed}')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496"


@query(f"SELECT event_id, count(*) AS n FROM tracks WHERE {_HASH.format(seed=3)} <= {_PP} GROUP BY event_id", "tracks")
def r02_lost_tracks(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "tracks")
    return sampling.lossy(t, efficiency(F.col("pt"), F.col("eta"), "LHC11a"), seed=3).groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, source, count(*) AS n FROM (SELECT event_id, idx, 'signal' AS source FROM det_tracks UNION ALL SELECT event_id, idx, 'background' FROM background) t WHERE source = 'background' OR {_HASH.format(seed=9)} <= 0.95 GROUP BY event_id, source", "det_tracks", "background")
def r03_lost_signal(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.matching import hybrid

    both = hybrid(view(spark, d, "det_tracks"), view(spark, d, "background"))
    return sampling.lossy_signal(both, 0.95, seed=9).groupBy("event_id", "source").agg(F.count("*").alias("n"))


@query()
def r04_thermal_background(spark: SparkSession, d: str) -> DataFrame:
    thermal = sampling.thermal_background(view(spark, d, "event_info").select("event_id"), 100, 10)
    return thermal.groupBy("event_id").agg(F.count("*").alias("n"), r6(F.avg("pt")).alias("mean_pt"))


@query("SELECT event_id, CAST(CASE WHEN centrality < 10 THEN 0 WHEN centrality < 30 THEN 1 WHEN centrality < 50 THEN 2 WHEN centrality < 90 THEN 3 END AS INT) AS activity FROM event_info", "event_info")
def r05_activity_class(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "event_info").select("event_id", sampling.activity_class(F.col("centrality")).alias("activity"))


_W01 = "SELECT pt_hard_bin, CAST(sum(n_accepted) AS BIGINT) AS n_accepted, CAST(sum(n_entries) AS BIGINT) AS n_entries, CAST(sum(n_trials) AS BIGINT) AS n_trials, sum(cross_section * n_entries) / sum(n_entries) AS cross_section, sum(cross_section * n_entries) / sum(n_entries) / sum(n_trials) AS factor FROM files GROUP BY pt_hard_bin"


@query(f"SELECT pt_hard_bin, n_accepted, n_entries, n_trials, round(cross_section, 6) AS cross_section, round(factor * 1e6, 6) AS factor FROM ({_W01}) t", "files")
def w01_scale_factors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weights.scale_factors(view(spark, d, "files")).withColumn("factor", F.col("factor") * 1e6), "cross_section", "factor")


@query("SELECT pt_hard_bin, round(avg(cross_section * n_entries / n_trials), 6) AS factor FROM files WHERE n_trials > 0 GROUP BY pt_hard_bin", "files")
def w02_file_factors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weights.file_factors(view(spark, d, "files")), "factor")


@query(f"SELECT pt_hard_bin, bin, round(sum(factor) * 1e6, 6) AS sumw, count(*) AS n FROM (SELECT j.pt_hard_bin, CAST(floor(true_jet_pt / 10) AS INT) AS bin, w.factor FROM jets j JOIN ({_W01}) w ON w.pt_hard_bin = j.pt_hard_bin) t GROUP BY GROUPING SETS ((pt_hard_bin, bin), (bin))", "jets", "files")
def w03_a20_scaled_spectra(spark: SparkSession, d: str) -> DataFrame:
    jets = view(spark, d, "jets").withColumn("bin", F.floor(F.col("true_jet_pt") / 10).cast("int"))
    out = weights.scaled_spectra(jets, weights.scale_factors(view(spark, d, "files")))
    return out.select("pt_hard_bin", "bin", r6(F.col("sumw") * 1e6).alias("sumw"), "n")


_SPECTRUM = Regular(200, 0, 200)
_KINDS = {"true": ("true", "TRUE"), "true_with_cut": ("true", "hybrid_jet_pt >= 40 AND hybrid_jet_pt < 120"), "hybrid": ("hybrid", "TRUE"), "hybrid_with_cut": ("hybrid", "hybrid_jet_pt >= 40 AND hybrid_jet_pt < 120")}
_KINDS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS spectrum, pt_hard_bin, {_SPECTRUM.sql(f'{level}_jet_pt')} AS bin, scale_factor AS w FROM jets WHERE {cut}" for k, (level, cut) in _KINDS.items())


@query(f"SELECT spectrum, pt_hard_bin, bin, round(sum(w), 6) AS sumw, round(sum(w * w), 6) AS sumw2, count(*) AS n FROM ({_KINDS_SQL}) t GROUP BY GROUPING SETS ((spectrum, pt_hard_bin, bin), (spectrum, bin))", "jets")
def a20_level_spectra(spark: SparkSession, d: str) -> DataFrame:
    """True and hybrid spectra with and without the hybrid cut, by pt-hard bin and in total."""
    kinds = {k: (F.col(f"{level}_jet_pt"), F.expr(cut)) for k, (level, cut) in _KINDS.items()}
    return rounded(weights.level_spectra(view(spark, d, "jets"), kinds, _SPECTRUM), "sumw", "sumw2")


@query("SELECT coalesce(f.b, j.b) AS pt_hard_bin, CASE WHEN f.b IS NULL THEN 'data' ELSE 'factors' END AS only_in FROM (SELECT DISTINCT pt_hard_bin + 2 AS b FROM files) f FULL OUTER JOIN (SELECT DISTINCT pt_hard_bin AS b FROM jets) j ON f.b = j.b WHERE f.b IS NULL OR j.b IS NULL", "files", "jets")
def w04_uneven_bins(spark: SparkSession, d: str) -> DataFrame:
    return weights.uneven_bins(view(spark, d, "files").withColumn("pt_hard_bin", F.col("pt_hard_bin") + 2), view(spark, d, "jets"))
