"""Queries: histograms, normalisation, responses, unfolding, systematics, set operations, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import checkpointed, new_folder
from ..operators import histograms as H
from ..operators import response as U
from ..operators import systematics as Y
from ..operators.matching import matching_class
from ..streaming import running
from .catalogue import query, r6, rounded
from .views import table, view

PT, KT, DR = H.Regular(15, 0, 150), H.Regular(25, 0, 12.5), H.Regular(20, 0, 0.4)
RESIDUAL = H.Regular(80, -2, 2)
LUND_X, LUND_Y = H.Regular(100, 0, 5), H.Regular(100, -5, 5)
SMEARED_PT, TRUE_PT = H.Variable((30, 40, 50, 60, 80, 100, 120)), H.Variable((0, 30, 40, 60, 80, 100, 120, 160))
SMEARED_KT, TRUE_KT = H.Variable((1, 2, 3, 4, 5, 7, 10, 15)), H.Variable((-0.05, 0, 2, 3, 4, 5, 7, 10, 15, 100))
LEVELS = ("hybrid", "det_level", "true")
VARIABLES = {"kt": KT, "delta_r": DR, "n_passed": H.Regular(20, 0, 20)}
_SUMS = "round(sum(w), 6) AS sumw, round(sum(w * w), 6) AS sumw2, count(*) AS n"


def _skim(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "skim")


def _long(skim: DataFrame) -> DataFrame:
    """A row per jet, level and variable, so that many histograms are one grouped sum."""
    parts = [F.struct(F.lit(p).alias("prefix"), F.lit(v).alias("variable"), F.col(f"{p}_{v}").cast("double").alias("x"), F.col(f"{p}_jet_pt").alias("pt")) for p in LEVELS for v in VARIABLES]
    return skim.select("jet_id", "scale_factor", F.explode(F.array(*parts)).alias("h")).select("jet_id", "scale_factor", "h.*")


_LONG = " UNION ALL ".join(f"SELECT jet_id, scale_factor AS w, '{p}' AS prefix, '{v}' AS variable, CAST({p}_{v} AS DOUBLE) AS x, {p}_jet_pt AS pt FROM skim" for p in LEVELS for v in VARIABLES)
_BIN = "CASE variable " + " ".join(f"WHEN '{v}' THEN {a.sql('x')}" for v, a in VARIABLES.items()) + " END"


@query(f"SELECT {PT.sql('hybrid_jet_pt')} AS pt_bin, round(sum(scale_factor), 6) AS sumw, round(sum(scale_factor * scale_factor), 6) AS sumw2, count(*) AS n FROM jets GROUP BY 1", "jets")
def a02_a05_regular_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.histogram(view(spark, d, "jets"), {"pt_bin": (F.col("hybrid_jet_pt"), PT)}, F.col("scale_factor")), "sumw", "sumw2")


@query(f"SELECT {SMEARED_PT.sql('hybrid_jet_pt')} AS pt_bin, {SMEARED_KT.sql('hybrid_kt')} AS kt_bin, round(sum(scale_factor), 6) AS sumw, round(sum(scale_factor * scale_factor), 6) AS sumw2, count(*) AS n FROM skim GROUP BY 1, 2", "skim")
def a03_a21_variable_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.histogram(_skim(spark, d), {"pt_bin": (F.col("hybrid_jet_pt"), SMEARED_PT), "kt_bin": (F.col("hybrid_kt"), SMEARED_KT)}, F.col("scale_factor")), "sumw", "sumw2")


@query(f"SELECT prefix, variable, {PT.sql('pt')} AS pt_bin, {_BIN} AS bin, {_SUMS} FROM ({_LONG}) l GROUP BY 1, 2, 3, 4", "skim")
def a04_all_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Jet pt against every variable at every level, in one pass."""
    rows, binned = _long(_skim(spark, d)), None
    for v, axis in VARIABLES.items():
        binned = axis.bin(F.col("x")) if binned is None else F.when(F.col("variable") == v, axis.bin(F.col("x"))).otherwise(binned)
    rows = rows.withColumn("bin", binned)
    hist = rows.select("prefix", "variable", PT.bin(F.col("pt")).alias("pt_bin"), "bin", F.col("scale_factor").alias("w")).groupBy("prefix", "variable", "pt_bin", "bin")
    return rounded(hist.agg(F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"), F.count("*").alias("n")), "sumw", "sumw2")


@query(f"SELECT {LUND_X.sql('ln(1 / delta_r)')} AS x, {LUND_Y.sql('ln(kt)')} AS y, count(*) AS n FROM splittings WHERE lvl = 2 GROUP BY 1, 2", "splittings")
def a06_lund_plane(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "splittings").filter("lvl = 2")
    return H.histogram(rows, {"x": (F.log(1 / F.col("delta_r")), LUND_X), "y": (F.log("kt"), LUND_Y)}).select("x", "y", "n")


@query("SELECT lvl, count(*) AS n_jets, round(sum(scale_factor), 6) AS weighted_jets, CAST(sum(n) AS BIGINT) AS n_splittings, CAST(sum(p) AS BIGINT) AS n_perturbative FROM (SELECT jet_id, lvl, count(*) AS n, count(CASE WHEN kt > 5 THEN 1 END) AS p FROM splittings GROUP BY 1, 2) s JOIN jets ON jets.jet_id = s.jet_id GROUP BY lvl", "splittings", "jets")
def a07_jet_counts(spark: SparkSession, d: str) -> DataFrame:
    per = view(spark, d, "splittings").groupBy("jet_id", "lvl").agg(F.count("*").alias("n"), F.count(F.when(F.col("kt") > 5, 1)).alias("p"))
    return per.join(view(spark, d, "jets"), "jet_id").groupBy("lvl").agg(F.count("*").alias("n_jets"), r6(F.sum("scale_factor")).alias("weighted_jets"), F.sum("n").alias("n_splittings"), F.sum("p").alias("n_perturbative"))


@query(f"SELECT {KT.sql('true_kt')} AS true_bin, {KT.sql('hybrid_kt')} AS hybrid_bin, count(*) AS n FROM skim GROUP BY 1, 2", "skim")
def a08_a16_level_comparison(spark: SparkSession, d: str) -> DataFrame:
    return H.histogram(_skim(spark, d), {"true_bin": (F.col("true_kt"), KT), "hybrid_bin": (F.col("hybrid_kt"), KT)}).select("true_bin", "hybrid_bin", "n")


#: For the oracle: classes of matches of both prongs, written out by hand.
_CLASS = """CASE WHEN leading_match < 1 OR subleading_match < 1 THEN NULL
 WHEN leading_match = 1 AND subleading_match = 1 THEN 'pure' WHEN leading_match = 3 AND subleading_match = 1 THEN 'leading_untagged_subleading_correct'
 WHEN leading_match = 1 AND subleading_match = 3 THEN 'leading_correct_subleading_untagged' WHEN leading_match = 3 AND subleading_match = 2 THEN 'leading_untagged_subleading_mistag'
 WHEN leading_match = 2 AND subleading_match = 3 THEN 'leading_mistag_subleading_untagged' WHEN leading_match = 2 AND subleading_match = 2 THEN 'swap'
 WHEN leading_match = 3 AND subleading_match = 3 THEN 'both_untagged' ELSE 'other' END"""


def _class() -> Column:
    return matching_class(F.col("leading_match"), F.col("subleading_match"))


@query(f"SELECT coalesce(c, 'all') AS matching, count(*) AS n, round(sum(scale_factor), 6) AS sumw FROM (SELECT {_CLASS} AS c, scale_factor FROM skim) t WHERE c IS NOT NULL GROUP BY GROUPING SETS ((c), ())", "skim")
def a14_matching_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _skim(spark, d).withColumn("c", _class()).filter("c is not null")
    return rows.rollup("c").agg(F.count("*").alias("n"), r6(F.sum("scale_factor")).alias("sumw")).select(F.coalesce("c", F.lit("all")).alias("matching"), "n", "sumw")


_TEN = "CASE WHEN leading_match < 1 OR subleading_match < 1 THEN NULL WHEN leading_match = 1 AND subleading_match = 2 THEN 'leading_correct_subleading_mistag' WHEN leading_match = 2 AND subleading_match = 1 THEN 'leading_mistag_subleading_correct' ELSE " + _CLASS + " END"


@query(f"SELECT coalesce(c, 'all') AS matching, count(*) AS n, round(sum(scale_factor), 6) AS sumw FROM (SELECT {_TEN} AS c, scale_factor FROM skim) t WHERE c IS NOT NULL GROUP BY GROUPING SETS ((c), ())", "skim")
def a14_ten_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of the skim's histograms: mixes of a correct and a swapped prong stand for themselves, and all jets with both codes."""
    rows = _skim(spark, d).withColumn("c", matching_class(F.col("leading_match"), F.col("subleading_match"), mixes=True)).filter("c is not null")
    return rows.rollup("c").agg(F.count("*").alias("n"), r6(F.sum("scale_factor")).alias("sumw")).select(F.coalesce("c", F.lit("all")).alias("matching"), "n", "sumw")


_RES = "((hybrid_jet_pt - true_jet_pt) / true_jet_pt)"


@query(f"SELECT {_CLASS} AS matching, {PT.sql('hybrid_jet_pt')} AS hybrid_bin, {PT.sql('true_jet_pt')} AS true_bin, {RESIDUAL.sql(_RES)} AS residual_bin, count(*) AS n, round(sum(scale_factor), 6) AS sumw FROM skim GROUP BY 1, 2, 3, 4", "skim")
def a09_a10_residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = _skim(spark, d).withColumn("matching", _class())
    axes = {"hybrid_bin": (F.col("hybrid_jet_pt"), PT), "true_bin": (F.col("true_jet_pt"), PT), "residual_bin": (F.expr(_RES), RESIDUAL)}
    return H.histogram(rows, axes, F.col("scale_factor"), ["matching"]).select("matching", *axes, "n", r6("sumw").alias("sumw"))


@query(f"SELECT bin, n, round(swv / sw, 6) AS mean, round(sqrt(greatest(swvv / sw - (swv / sw) * (swv / sw), 0)), 6) AS width FROM (SELECT {PT.sql('true_jet_pt')} AS bin, count(*) AS n, sum(scale_factor) AS sw, sum(scale_factor * {_RES}) AS swv, sum(scale_factor * {_RES} * {_RES}) AS swvv FROM skim WHERE hybrid_jet_pt >= 40 AND hybrid_jet_pt < 120 GROUP BY 1) t", "skim")
def a11_n10_residual_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = _skim(spark, d).filter("hybrid_jet_pt >= 40 and hybrid_jet_pt < 120")
    p = H.profile(rows, F.col("true_jet_pt"), PT, F.expr(_RES), F.col("scale_factor"))
    return p.select("bin", "n", r6("mean").alias("mean"), r6(F.sqrt("variance")).alias("width"))


def _response_sql(extra: str = "") -> str:
    return f"SELECT {_CLASS} AS matching, {PT.sql('hybrid_jet_pt')} AS meas_pt_bin, {KT.sql('hybrid_kt')} AS meas_bin, {PT.sql('true_jet_pt')} AS true_pt_bin, {KT.sql('true_kt')} AS true_bin, count(*) AS n, round(sum(scale_factor), 6) AS sumw FROM skim {extra} GROUP BY 1, 2, 3, 4, 5"


def _response4(rows: DataFrame) -> DataFrame:
    axes = {"meas_pt_bin": (F.col("hybrid_jet_pt"), PT), "meas_bin": (F.col("hybrid_kt"), KT), "true_pt_bin": (F.col("true_jet_pt"), PT), "true_bin": (F.col("true_kt"), KT)}
    return H.histogram(rows.withColumn("matching", _class()), axes, F.col("scale_factor"), ["matching"]).select("matching", *axes, "n", r6("sumw").alias("sumw"))


@query(_response_sql(), "skim")
def a12_a19_response(spark: SparkSession, d: str) -> DataFrame:
    return _response4(_skim(spark, d))


@query(_response_sql("WHERE match_distance < 0.05 AND leading_match = 1 AND subleading_match = 3"), "skim")
def a13_close_response(spark: SparkSession, d: str) -> DataFrame:
    return _response4(_skim(spark, d).filter("match_distance < 0.05 and leading_match = 1 and subleading_match = 3"))


@query(f"SELECT {_CLASS} AS matching, {SMEARED_KT.sql('hybrid_kt')} AS kt_bin, {H.Regular(50, 0, 1).sql('momentum_fraction')} AS fraction_bin, {H.Regular(40, 0, 0.4).sql('match_distance')} AS distance_bin, count(*) AS n FROM skim GROUP BY 1, 2, 3, 4", "skim")
def a15_a17_a18_matching_yields(spark: SparkSession, d: str) -> DataFrame:
    axes = {"kt_bin": (F.col("hybrid_kt"), SMEARED_KT), "fraction_bin": (F.col("momentum_fraction"), H.Regular(50, 0, 1)), "distance_bin": (F.col("match_distance"), H.Regular(40, 0, 0.4))}
    return H.histogram(_skim(spark, d).withColumn("matching", _class()), axes, None, ["matching"]).select("matching", *axes, "n")


@query(f"SELECT {PT.sql('true_jet_pt')} AS pt_bin, round(sum(scale_factor), 6) AS sumw, count(*) AS n FROM jets GROUP BY 1", "jets")
def a22_a23_merged_results(spark: SparkSession, d: str) -> DataFrame:
    jets = view(spark, d, "jets")
    parts = [H.histogram(jets.filter(F.col("jet_id") % 3 == k), {"pt_bin": (F.col("true_jet_pt"), PT)}, F.col("scale_factor")) for k in range(3)]
    return H.merged(parts, ["pt_bin"]).select("pt_bin", r6("sumw").alias("sumw"), "n")


@query("SELECT DISTINCT pt_hard_bin FROM jets", "jets")
def a24_distinct_bins(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "jets").select("pt_hard_bin").distinct()


@query("SELECT s.low, s.high, s.leading, count(*) AS n FROM skim JOIN (SELECT * FROM (SELECT 40 AS low, 60 AS high UNION ALL SELECT 60, 80 UNION ALL SELECT 80, 120) r CROSS JOIN (SELECT 1 AS leading UNION ALL SELECT 2 UNION ALL SELECT 3) m) s ON hybrid_jet_pt >= s.low AND hybrid_jet_pt < s.high AND leading_match = s.leading GROUP BY 1, 2, 3", "skim")
def a25_settings_product(spark: SparkSession, d: str) -> DataFrame:
    settings = spark.createDataFrame([(a, b, m) for a, b in ((40, 60), (60, 80), (80, 120)) for m in (1, 2, 3)], "low int, high int, leading int")
    pt = F.col("hybrid_jet_pt")
    return _skim(spark, d).join(F.broadcast(settings), (pt >= F.col("low")) & (pt < F.col("high")) & (F.col("leading_match") == F.col("leading"))).groupBy("low", "high", "leading").agg(F.count("*").alias("n"))


_H2 = f"SELECT {PT.sql('hybrid_jet_pt')} AS pt_bin, {KT.sql('hybrid_kt')} AS bin, sum(scale_factor) AS sumw, sum(scale_factor * scale_factor) AS sumw2, count(*) AS n FROM skim GROUP BY 1, 2"


def _h2(spark: SparkSession, d: str, level: str = "hybrid") -> DataFrame:
    return H.histogram(_skim(spark, d), {"pt_bin": (F.col(f"{level}_jet_pt"), PT), "bin": (F.col(f"{level}_kt"), KT)}, F.col("scale_factor"))


@query(f"SELECT pt_bin, bin, round(sumw / sum(sumw) OVER (PARTITION BY pt_bin) / 0.5, 6) AS value FROM ({_H2}) h", "skim")
def n01_unit_normalized(spark: SparkSession, d: str) -> DataFrame:
    return H.normalized(_h2(spark, d), 0.5, ["pt_bin"]).select("pt_bin", "bin", r6("value").alias("value"))


@query(f"SELECT h.pt_bin, h.bin, round(h.sumw / j.n_jets / 1.0, 6) AS value FROM (SELECT pt_bin, CAST(floor(bin / 2) AS INT) AS bin, sum(sumw) AS sumw FROM ({_H2}) a GROUP BY 1, 2) h JOIN (SELECT {PT.sql('hybrid_jet_pt')} AS pt_bin, sum(scale_factor) AS n_jets FROM skim GROUP BY 1) j ON j.pt_bin = h.pt_bin", "skim")
def n02_n05_per_jet(spark: SparkSession, d: str) -> DataFrame:
    n = _skim(spark, d).groupBy(PT.bin(F.col("hybrid_jet_pt")).alias("pt_bin")).agg(F.sum("scale_factor").alias("n_jets"))
    return H.per_jet(H.rebinned(_h2(spark, d), "bin", 2, ["pt_bin"]), n, ["pt_bin"], 1.0).select("pt_bin", "bin", r6("value").alias("value"))


_H2T = _H2.replace("hybrid_jet_pt", "true_jet_pt").replace("hybrid_kt", "true_kt")


@query(f"SELECT a.pt_bin, a.bin, round(a.sumw / b.sumw, 6) AS ratio, round(sqrt(a.sumw2 / (b.sumw * b.sumw) + b.sumw2 * a.sumw * a.sumw / pow(b.sumw, 4)), 6) AS ratio_error FROM ({_H2}) a JOIN ({_H2T}) b ON a.pt_bin = b.pt_bin AND a.bin = b.bin WHERE b.sumw <> 0", "skim")
def n03_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.ratio(_h2(spark, d), _h2(spark, d, "true"), ["pt_bin", "bin"]), "ratio", "ratio_error")


@query(f"SELECT bin, round(sum(sumw), 6) AS sumw, round(sum(sumw2), 6) AS sumw2, CAST(sum(n) AS BIGINT) AS n FROM ({_H2}) h WHERE pt_bin BETWEEN 4 AND 11 GROUP BY bin", "skim")
def n04_n15_n16_projection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.projected(_h2(spark, d), ["bin"], {"pt_bin": (4, 11)}), "sumw", "sumw2")


_R2 = f"SELECT {PT.sql('hybrid_jet_pt')} AS meas, {PT.sql('true_jet_pt')} AS gen, sum(scale_factor) AS sumw FROM skim GROUP BY 1, 2"


@query(f"SELECT meas, gen, round(sumw / sum(sumw) OVER (PARTITION BY gen), 6) AS value FROM ({_R2}) r", "skim")
def n06_n18_column_normalized(spark: SparkSession, d: str) -> DataFrame:
    r = H.histogram(_skim(spark, d), {"meas": (F.col("hybrid_jet_pt"), PT), "gen": (F.col("true_jet_pt"), PT)}, F.col("scale_factor"))
    return H.column_normalized(r, ["meas"], ["gen"]).select("meas", "gen", r6("value").alias("value"))


@query("SELECT x, y, round(n / sum(n) OVER () / (0.05 * 0.1), 6) AS value FROM (SELECT " + LUND_X.sql("ln(1 / delta_r)") + " AS x, " + LUND_Y.sql("ln(kt)") + " AS y, CAST(count(*) AS DOUBLE) AS n FROM splittings WHERE lvl = 2 GROUP BY 1, 2) t", "splittings")
def n07_lund_density(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "splittings").filter("lvl = 2")
    return H.normalized(H.histogram(rows, {"x": (F.log(1 / F.col("delta_r")), LUND_X), "y": (F.log("kt"), LUND_Y)}), 0.05 * 0.1).select("x", "y", r6("value").alias("value"))


_N08 = f"SELECT {PT.sql('hybrid_jet_pt')} AS pt_bin, {_CLASS} AS matching, sum(scale_factor) AS w FROM skim WHERE hybrid_n_passed > 0 GROUP BY 1, 2"


@query(f"SELECT pt_bin, matching, round(w / sum(w) OVER (PARTITION BY pt_bin), 6) AS fraction FROM ({_N08}) t", "skim")
def n08_tagging_fraction(spark: SparkSession, d: str) -> DataFrame:
    rows = _skim(spark, d).filter("hybrid_n_passed > 0").groupBy(PT.bin(F.col("hybrid_jet_pt")).alias("pt_bin"), _class().alias("matching")).agg(F.sum("scale_factor").alias("w"))
    return rows.select("pt_bin", "matching", r6(F.col("w") / F.sum("w").over(Window.partitionBy("pt_bin"))).alias("fraction"))


@query(f"SELECT {PT.sql('hybrid_jet_pt')} AS pt_bin, round(sum(CASE WHEN leading_match = 1 THEN scale_factor ELSE 0 END) / sum(scale_factor), 6) AS leading, round(sum(CASE WHEN subleading_match = 1 THEN scale_factor ELSE 0 END) / sum(scale_factor), 6) AS subleading FROM skim WHERE hybrid_n_passed > 0 GROUP BY 1", "skim")
def n09_purity(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: r6(F.sum(F.when(F.col(c) == 1, F.col("scale_factor")).otherwise(0.0)) / F.sum("scale_factor"))
    return _skim(spark, d).filter("hybrid_n_passed > 0").groupBy(PT.bin(F.col("hybrid_jet_pt")).alias("pt_bin")).agg(share("leading_match").alias("leading"), share("subleading_match").alias("subleading"))


_SHAPES = " UNION ALL ".join(f"SELECT '{p}' AS level, {KT.sql(f'{p}_kt')} AS bin, scale_factor AS w FROM skim WHERE {p}_jet_pt >= 60 AND {p}_jet_pt < 80" for p in LEVELS)


@query(f"SELECT level, bin, round(w / sum(w) OVER (PARTITION BY level) / 0.5, 6) AS value FROM (SELECT level, bin, sum(w) AS w FROM ({_SHAPES}) u GROUP BY 1, 2) t", "skim")
def n11_n12_n17_shapes_by_level(spark: SparkSession, d: str) -> DataFrame:
    rows = _long(_skim(spark, d)).filter("variable = 'kt' and pt >= 60 and pt < 80").withColumnRenamed("prefix", "level")
    return H.normalized(H.histogram(rows, {"bin": (F.col("x"), KT)}, F.col("scale_factor"), ["level"]), 0.5, ["level"]).select("level", "bin", r6("value").alias("value"))


@query(f"SELECT CAST(floor(bin / 5) AS INT) AS kt_bin, CAST(sum(CASE WHEN pt_bin BETWEEN 4 AND 5 THEN n ELSE 0 END) AS BIGINT) AS pt_40_60, CAST(sum(CASE WHEN pt_bin BETWEEN 6 AND 7 THEN n ELSE 0 END) AS BIGINT) AS pt_60_80, CAST(sum(CASE WHEN pt_bin BETWEEN 8 AND 11 THEN n ELSE 0 END) AS BIGINT) AS pt_80_120 FROM ({_H2}) h WHERE bin >= 0 GROUP BY 1", "skim")
def n13_statistics_table(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda a, b: F.sum(F.when(F.col("pt_bin").between(a, b), F.col("n")).otherwise(0))
    return _h2(spark, d).filter("bin >= 0").groupBy(F.floor(F.col("bin") / 5).cast("int").alias("kt_bin")).agg(cell(4, 5).alias("pt_40_60"), cell(6, 7).alias("pt_60_80"), cell(8, 11).alias("pt_80_120"))


@query(f"SELECT pt_bin, centre, n FROM (SELECT {PT.sql('true_jet_pt')} AS pt_bin, CAST(0.0 + ({PT.sql('true_jet_pt')} + 0.5) * 10.0 AS DOUBLE) AS centre, count(*) AS n FROM jets GROUP BY 1, 2) t WHERE centre BETWEEN 45 AND 115", "jets")
def n14_s18_bins_in_range(spark: SparkSession, d: str) -> DataFrame:
    h = H.histogram(view(spark, d, "jets"), {"pt_bin": (F.col("true_jet_pt"), PT)}).withColumn("centre", PT.centre(F.col("pt_bin")))
    return Y.within(h, 45, 115).select("pt_bin", "centre", "n")


# --- responses and unfolding ---------------------------------------------------------------------------------------

_UNTAGGED_KT = 1.5
_SKIM_U = f"(SELECT *, CASE WHEN hybrid_kt < 0 THEN {_UNTAGGED_KT} WHEN hybrid_kt BETWEEN 1 AND 15 THEN hybrid_kt END AS v FROM skim WHERE hybrid_jet_pt BETWEEN 30 AND 120)"


@query(f"SELECT {SMEARED_PT.sql('hybrid_jet_pt')} AS meas_pt_bin, {SMEARED_KT.sql('v')} AS meas_bin, count(*) AS n FROM {_SKIM_U} t WHERE v IS NOT NULL GROUP BY 1, 2", "skim")
def u01_u02_u03_raw_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Binning of a method from its settings, and the bin of untagged jets from its edges."""
    other = [0.0, 5.0, 20.0]
    settings = spark.createDataFrame([
        ("default", "nominal", "smeared_jet_pt", [float(e) for e in SMEARED_PT.edges]), ("default", "nominal", "smeared_kt", other), ("leading_kt", "nominal", "smeared_kt", other),
        ("leading_kt_z_cut_02", "nominal", "smeared_kt", other), ("default", "truncation", "smeared_kt", [float(e) for e in SMEARED_KT.edges]), ("soft_drop_z_cut_02", "truncation", "smeared_kt", other),
    ], "method string, variation string, variable string, edges array<double>")
    edges = {r.variable: tuple(r.edges) for r in U.binning_for(settings, "leading_kt_z_cut_02", "truncation").collect()}  # a few settings
    _, _, centre = U.untagged_bin(edges["smeared_kt"], 1, 2)
    axis = H.Variable(edges["smeared_kt"])
    return U.raw_spectrum(_skim(spark, d), "hybrid_jet_pt", "hybrid_kt", H.Variable(edges["smeared_jet_pt"]), axis, centre, axis.edges[0], axis.edges[-1]).select("meas_pt_bin", "meas_bin", "n")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return U.response_rows(_skim(spark, d), "hybrid_jet_pt", "hybrid_kt", "true_jet_pt", "true_kt", SMEARED_PT, SMEARED_KT, TRUE_PT, TRUE_KT)


_ROWS = f"""SELECT jet_id, scale_factor AS w, (hybrid_jet_pt BETWEEN 30 AND 120 AND hybrid_kt BETWEEN 1 AND 15) AS in_both, {SMEARED_PT.sql('hybrid_jet_pt')} AS meas_pt_bin, {SMEARED_KT.sql('hybrid_kt')} AS meas_bin,
 {TRUE_PT.sql('true_jet_pt')} AS true_pt_bin, {TRUE_KT.sql('true_kt')} AS true_bin FROM skim WHERE true_jet_pt BETWEEN 0 AND 160 AND true_kt BETWEEN -0.05 AND 100"""


@query(f"SELECT true_pt_bin, true_bin, round(sum(w), 6) AS full_truth, round(sum(CASE WHEN in_both THEN w ELSE 0 END), 6) AS cut FROM ({_ROWS}) r GROUP BY 1, 2", "skim")
def u04_truth_spectra(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.truth_spectra(_rows(spark, d)).withColumnRenamed("full", "full_truth"), "full_truth", "cut")


_RESP = f"SELECT meas_pt_bin, meas_bin, true_pt_bin, true_bin, sum(w) AS sumw, count(*) AS n FROM ({_ROWS}) r WHERE in_both GROUP BY 1, 2, 3, 4"


@query(f"SELECT meas_pt_bin, meas_bin, true_pt_bin, true_bin, round(sumw, 6) AS sumw, n FROM ({_RESP}) r", "skim")
def u05_response(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.response(_rows(spark, d)).drop("sumw2"), "sumw")


@query(f"SELECT {SMEARED_KT.sql('hybrid_kt')} AS meas_bin, {TRUE_KT.sql('true_kt')} AS true_bin, count(*) AS n FROM skim WHERE (leading_match = 1 AND subleading_match = 1) OR (hybrid_kt BETWEEN -0.006 AND -0.004) GROUP BY 1, 2", "skim")
def u05_pure_matches(spark: SparkSession, d: str) -> DataFrame:
    """Jets whose prongs both match, and jets without a splitting."""
    pure = U.pure_match(F.col("leading_match"), F.col("subleading_match"), F.col("hybrid_kt"), -0.005)
    return H.histogram(_skim(spark, d).filter(pure), {"meas_bin": (F.col("hybrid_kt"), SMEARED_KT), "true_bin": (F.col("true_kt"), TRUE_KT)}).select("meas_bin", "true_bin", "n")


@query(f"SELECT true_bin, round(sum(w * (1 + 0.1 * greatest(0, least({TRUE_KT.n - 1}, true_bin)))), 6) AS sumw FROM ({_ROWS}) r GROUP BY 1", "skim")
def u06_reweighted_truth(spark: SparkSession, d: str) -> DataFrame:
    factors = spark.createDataFrame([(k, 1 + 0.1 * k) for k in range(TRUE_KT.n)], "bin int, factor double")
    rows = U.reweighted(_skim(spark, d).filter("true_jet_pt between 0 and 160 and true_kt between -0.05 and 100"), factors, "true_kt", TRUE_KT, "scale_factor")
    return rows.groupBy(TRUE_KT.bin(F.col("true_kt")).alias("true_bin")).agg(r6(F.sum("scale_factor")).alias("sumw"))


_HASH = "CAST(('0x' || substr(md5(concat_ws(':', {keys}, '{seed}')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496"


@query(f"SELECT CASE WHEN {_HASH.format(keys='jet_id', seed=5)} < 0.75 THEN 'response' ELSE 'pseudo_data' END AS part, true_pt_bin, round(sum(w), 6) AS sumw, count(*) AS n FROM ({_ROWS}) r GROUP BY 1, 2", "skim")
def u07_closure_split(spark: SparkSession, d: str) -> DataFrame:
    return U.closure_split(_rows(spark, d)).groupBy("part", "true_pt_bin").agg(r6(F.sum("w")).alias("sumw"), F.count("*").alias("n"))


#: Factor by which the reweighted variants multiply weights: rises with the true bins.
_FACTOR = "1 + 0.1 * true_bin + 0.02 * true_pt_bin"


def _variants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return U.closure_variants(U.closure_split(_rows(spark, d)), F.expr(_FACTOR))


def _settings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Response, truth and measured spectrum of two settings: nominal and matched jets only."""
    rows = U.response_rows(_skim(spark, d), "hybrid_jet_pt", "hybrid_kt", "true_jet_pt", "true_kt", SMEARED_PT, SMEARED_KT, TRUE_PT, TRUE_KT, keep=["momentum_fraction"])
    rows = checkpointed(rows.withColumn("setting", F.explode(F.when(F.col("momentum_fraction") >= 0.5, F.array(F.lit("nominal"), F.lit("matched"))).otherwise(F.array(F.lit("nominal"))))))
    both = rows.filter("in_both")
    response = both.groupBy("setting", "meas_pt_bin", "meas_bin", "true_pt_bin", "true_bin").agg(F.sum("w").alias("sumw"))
    truth = rows.groupBy("setting", "true_pt_bin", "true_bin").agg(F.sum("w").alias("value"))
    measured = both.groupBy("setting", "meas_pt_bin", "meas_bin").agg(F.sum("w").alias("value"))
    return response, truth, measured


ITERATIONS = 8
_C, _E = "setting, true_pt_bin, true_bin", "setting, meas_pt_bin, meas_bin"
_UNFOLD_HEAD = f"""WITH rows_u AS MATERIALIZED (SELECT r.*, s.setting FROM ({_ROWS}) r JOIN skim k ON k.jet_id = r.jet_id JOIN (SELECT 'nominal' AS setting UNION ALL SELECT 'matched') s ON s.setting = 'nominal' OR k.momentum_fraction >= 0.5),
resp_u AS MATERIALIZED (SELECT {_E}, true_pt_bin, true_bin, sum(w) AS r FROM rows_u WHERE in_both GROUP BY ALL), truth_u AS MATERIALIZED (SELECT {_C}, sum(w) AS t FROM rows_u GROUP BY ALL),
p_u AS MATERIALIZED (SELECT r.*, r.r / t.t AS p, sum(r.r / t.t) OVER (PARTITION BY r.setting, r.true_pt_bin, r.true_bin) AS seen FROM resp_u r JOIN truth_u t USING ({_C})),
d0 AS MATERIALIZED (SELECT {_E}, sum(w) AS d FROM rows_u WHERE in_both GROUP BY ALL)"""


def _unfold_sql(data: str, name: str, n: int = ITERATIONS) -> str:
    """CTEs of the spectra name_1 .. name_n; ``data`` names the measured spectrum (d)."""
    parts, before = [], "(SELECT *, t AS value FROM truth_u)"
    for k in range(1, n + 1):
        share = f"SELECT p.*, coalesce(m.d, 0) AS d, p.p * b.value AS joint, sum(p.p * b.value) OVER (PARTITION BY p.setting, p.meas_pt_bin, p.meas_bin) AS whole FROM p_u p JOIN {before} b USING ({_C}) LEFT JOIN {data} m USING ({_E})"
        sums = f"SELECT {_C}, sum(joint / (whole * seen) * d) AS value, sqrt(sum(pow(joint / (whole * seen), 2) * d)) AS error FROM ({share}) x WHERE whole > 0 AND seen > 0 GROUP BY ALL"
        parts.append(f"{name}_{k} AS MATERIALIZED (SELECT t.setting, t.true_pt_bin, t.true_bin, coalesce(s.value, 0) AS value, coalesce(s.error, 0) AS error FROM truth_u t LEFT JOIN ({sums}) s USING ({_C}))")
        before = f"{name}_{k}"
    return ", ".join(parts)


def _all_sql(name: str, n: int = ITERATIONS) -> str:
    return " UNION ALL ".join(f"SELECT setting, {k} AS iteration, true_pt_bin, true_bin, round(value, 6) AS value, round(error, 6) AS error FROM {name}_{k}" for k in range(1, n + 1))


#: The same tables for closure variants: the response of one part of the jets, measured spectrum and truth of the other.
_VARIANT_HEAD = f"""WITH rows_c AS MATERIALIZED (SELECT r.*, {_HASH.format(keys='jet_id', seed=5)} < 0.75 AS resp, {_FACTOR} AS f FROM ({_ROWS}) r),
v_c AS (SELECT 'split' AS setting, FALSE AS fr, FALSE AS fp UNION ALL SELECT 'reweight_pseudo_data', FALSE, TRUE UNION ALL SELECT 'reweight_response', TRUE, FALSE),
resp_u AS MATERIALIZED (SELECT {_E}, true_pt_bin, true_bin, sum(CASE WHEN fr THEN w * f ELSE w END) AS r FROM rows_c, v_c WHERE resp AND in_both GROUP BY ALL),
truth_u AS MATERIALIZED (SELECT {_C}, sum(CASE WHEN fr THEN w * f ELSE w END) AS t FROM rows_c, v_c WHERE resp GROUP BY ALL),
p_u AS MATERIALIZED (SELECT r.*, r.r / t.t AS p, sum(r.r / t.t) OVER (PARTITION BY r.setting, r.true_pt_bin, r.true_bin) AS seen FROM resp_u r JOIN truth_u t USING ({_C})),
d0 AS MATERIALIZED (SELECT {_E}, sum(CASE WHEN fp THEN w * f ELSE w END) AS d FROM rows_c, v_c WHERE NOT resp AND in_both GROUP BY ALL),
pseudo_u AS MATERIALIZED (SELECT {_C}, sum(CASE WHEN fp THEN w * f ELSE w END) AS truth FROM rows_c, v_c WHERE NOT resp GROUP BY ALL)"""


@query(f"{_VARIANT_HEAD}, {_unfold_sql('d0', 'a', 4)} SELECT setting, true_pt_bin, true_bin, round(a.value, 6) AS value, round(a.error, 6) AS error, round(coalesce(p.truth, 0), 6) AS truth FROM a_4 a LEFT JOIN pseudo_u p USING ({_C})", "skim")
def u07_closure_variants(spark: SparkSession, d: str) -> DataFrame:
    """Split, reweighted pseudo-data and reweighted response: the pseudo-data unfolded four times, beside its truth."""
    response, truth, measured, pseudo = _variants(spark, d)
    keys = ["setting", "true_pt_bin", "true_bin"]
    last = U.unfolded(response, truth, measured, iterations=4).filter("iteration = 4")
    out = last.join(pseudo.select(*keys, F.col("value").alias("truth")), keys, "left").select(*keys, "value", "error", F.coalesce("truth", F.lit(0.0)).alias("truth"))
    return rounded(out, "value", "error", "truth")


@query(f"{_UNFOLD_HEAD}, {_unfold_sql('d0', 'a')} {_all_sql('a')}", "skim")
def u08_u11_trivial_closure(spark: SparkSession, d: str) -> DataFrame:
    """Unfolding the response's own measured spectrum gives its truth back."""
    return rounded(U.unfolded(*_settings(spark, d), iterations=ITERATIONS), "value", "error")


@query(f"{_UNFOLD_HEAD}, {_unfold_sql('d0', 'a', 5)}, d1 AS MATERIALIZED (SELECT {_E}, sum(p * a.value) AS d FROM p_u JOIN a_5 a USING ({_C}) GROUP BY ALL), {_unfold_sql('d1', 'b', 3)} {_all_sql('b', 3)}", "skim")
def u11_refolded_closure(spark: SparkSession, d: str) -> DataFrame:
    """The refold of iteration 5 as input."""
    response, truth, measured = _settings(spark, d)
    fifth = U.unfolded(response, truth, measured, iterations=5).filter("iteration = 5")
    return rounded(U.unfolded(response, truth, U.refolded(fifth, response, truth), iterations=3), "value", "error")


@query(f"SELECT r.meas_pt_bin, r.meas_bin, round(sum(r.sumw), 6) AS value FROM ({_RESP}) r GROUP BY 1, 2", "skim")
def u09_refolded(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    truth = U.truth_spectra(rows).select("true_pt_bin", "true_bin", F.col("cut").alias("value"))
    return rounded(U.folded(truth, U.response(rows)), "value")


def _covariance_sql(n: int) -> str:
    """CTEs up to cov: derivatives of the spectrum of iteration n after the measured bins, and its covariance (setting split)."""
    parts, of = [], "true_pt_bin, true_bin, meas_pt_bin AS opt, meas_bin AS obin"
    for k in range(1, n + 1):
        before = "(SELECT *, t AS value FROM truth_u)" if k == 1 else f"a_{k - 1}"
        joint = f"SELECT p.*, coalesce(m.d, 0) AS d, b.value AS before, p.p * b.value AS joint, sum(p.p * b.value) OVER (PARTITION BY p.meas_pt_bin, p.meas_bin) AS whole FROM p_u p JOIN {before} b USING ({_C}) LEFT JOIN d0 m USING ({_E}) WHERE p.setting = 'split'"
        parts.append(f"m_{k} AS MATERIALIZED (SELECT *, CASE WHEN whole > 0 AND seen > 0 THEN joint / (whole * seen) ELSE 0 END AS m FROM ({joint}) x)")
        if k == 1:
            parts.append(f"der_1 AS MATERIALIZED (SELECT {of}, m AS x FROM m_1)")
            continue
        parts.append(f"g_{k} AS MATERIALIZED (SELECT w.meas_pt_bin, w.meas_bin, q.opt, q.obin, sum(w.m * w.seen / w.before * q.x) AS g FROM m_{k} w JOIN der_{k - 1} q USING (true_pt_bin, true_bin) WHERE w.before > 0 GROUP BY ALL)")
        ratio = f"(SELECT true_pt_bin, true_bin, a.value / b.value AS ratio FROM a_{k} a JOIN a_{k - 1} b USING ({_C}) WHERE a.setting = 'split' AND b.value > 0)"
        parts.append(f"der_{k} AS MATERIALIZED (SELECT true_pt_bin, true_bin, opt, obin, sum(x) AS x FROM (SELECT {of}, m AS x FROM m_{k} UNION ALL SELECT q.true_pt_bin, q.true_bin, q.opt, q.obin, q.x * r.ratio FROM der_{k - 1} q JOIN {ratio} r USING (true_pt_bin, true_bin)"
                     f" UNION ALL SELECT w.true_pt_bin, w.true_bin, g.opt, g.obin, -w.m * w.d * g.g FROM m_{k} w JOIN g_{k} g USING (meas_pt_bin, meas_bin)) u GROUP BY ALL)")  # fmt: skip
    spread = "(SELECT meas_pt_bin AS opt, meas_bin AS obin, d FROM d0 WHERE setting = 'split')"
    parts.append(f"cov AS MATERIALIZED (SELECT a.true_pt_bin AS pt_i, a.true_bin AS bin_i, b.true_pt_bin AS pt_j, b.true_bin AS bin_j, sum(a.x * b.x * v.d) AS value FROM der_{n} a JOIN der_{n} b USING (opt, obin) JOIN {spread} v USING (opt, obin) GROUP BY ALL)")
    return ", ".join(parts)


_BLOCKS = "SELECT 'pt' AS block, pt_i AS at_bin, bin_i AS i, bin_j AS j, value FROM cov WHERE pt_i = pt_j UNION ALL SELECT 'variable', bin_i, pt_i, pt_j, value FROM cov WHERE bin_i = bin_j"


@query(f"{_VARIANT_HEAD}, {_unfold_sql('d0', 'a')}, {_covariance_sql(ITERATIONS)}, blocks AS MATERIALIZED ({_BLOCKS}) SELECT c.block, c.at_bin AS at, c.i, c.j, round(CASE WHEN a.value > 0 AND b.value > 0 THEN c.value / sqrt(a.value * b.value) ELSE 0 END, 6) + 0.0 AS value FROM blocks c JOIN blocks a ON a.block = c.block AND a.at_bin = c.at_bin AND a.i = a.j AND a.i = c.i JOIN blocks b ON b.block = c.block AND b.at_bin = c.at_bin AND b.i = b.j AND b.j = c.j", "skim")
def u10_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pearson blocks of the covariance that eight iterations carry from the measured spectrum to the unfolded one."""
    response, truth, measured, _ = (x.filter("setting = 'split'") for x in _variants(spark, d))
    out = U.correlation_blocks(U.unfolding_covariance(response, truth, measured, iterations=ITERATIONS))
    return out.select("block", "at", "i", "j", (r6("value") + 0.0).alias("value"))


@query(f"SELECT true_bin, round(sum(CASE WHEN in_both THEN w ELSE 0 END) / sum(w), 6) AS efficiency FROM ({_ROWS}) r WHERE true_pt_bin BETWEEN 3 AND 5 GROUP BY 1", "skim")
def u12_kinematic_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.efficiency(U.truth_spectra(_rows(spark, d)).filter("true_pt_bin between 3 and 5"), "true_bin"), "efficiency")


_EFF = f"SELECT true_bin, sum(CASE WHEN in_both THEN w ELSE 0 END) / sum(w) AS efficiency, sum(CASE WHEN in_both THEN w ELSE 0 END) AS cut FROM ({_ROWS}) r WHERE true_pt_bin BETWEEN 3 AND 5 GROUP BY 1"
_WIDTHS = "CASE true_bin " + " ".join(f"WHEN {k} THEN {b - a}" for k, (a, b) in enumerate(zip(TRUE_KT.edges, TRUE_KT.edges[1:]))) + " END"


@query(f"SELECT true_bin, round(cut / efficiency / sum(cut / efficiency) OVER () / ({_WIDTHS}), 6) AS value FROM ({_EFF}) e WHERE efficiency > 0", "skim")
def u13_final_spectrum(spark: SparkSession, d: str) -> DataFrame:
    truth = U.truth_spectra(_rows(spark, d)).filter("true_pt_bin between 3 and 5")
    spectrum = truth.groupBy("true_bin").agg(F.sum("cut").alias("cut")).join(U.efficiency(truth, "true_bin"), "true_bin").filter("efficiency > 0")
    spectrum = spectrum.join(TRUE_KT.catalogue(spark), F.col("true_bin") == F.col("bin")).select("true_bin", "width", (F.col("cut") / F.col("efficiency")).alias("sumw"))
    return H.normalized(spectrum, F.col("width")).select("true_bin", r6("value").alias("value"))


#: Spectra of the true variable at true pt from 60 to 120, by iteration, of the nominal unfolding and of that with another prior.
_STEPS = 10
_SPECTRA = " UNION ALL ".join(f"SELECT setting, {k} AS iteration, true_bin AS bin, sum(value) AS value, sqrt(sum(error * error)) AS error FROM a_{k} WHERE setting <> 'reweight_pseudo_data' AND true_pt_bin BETWEEN 3 AND 5 GROUP BY ALL" for k in range(1, _STEPS + 1))
_STEP_HEAD = f"{_VARIANT_HEAD}, {_unfold_sql('d0', 'a', _STEPS)}, spectra_u AS MATERIALIZED ({_SPECTRA})"
_ERRORS = """errors_u AS MATERIALIZED (SELECT *, sqrt(regularization * regularization + statistical * statistical + prior * prior) AS total FROM (
SELECT c.iteration, sum(CASE WHEN c.value <> 0 THEN greatest(abs(b.value - c.value), abs(n.value - c.value)) / c.value ELSE 0 END) AS regularization,
  sum(CASE WHEN c.value <> 0 AND c.bin > 0 THEN c.error / c.value ELSE 0 END) AS statistical, sum(CASE WHEN c.value <> 0 THEN abs(c.value - p.value) / c.value ELSE 0 END) AS prior
FROM spectra_u c JOIN spectra_u b ON b.setting = c.setting AND b.bin = c.bin AND b.iteration = c.iteration - 1 JOIN spectra_u n ON n.setting = c.setting AND n.bin = c.bin AND n.iteration = c.iteration + 2
JOIN spectra_u p ON p.setting = 'reweight_response' AND p.bin = c.bin AND p.iteration = c.iteration WHERE c.setting = 'split' GROUP BY c.iteration) x)"""


def _steps(spark: SparkSession, d: str) -> tuple[tuple[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]:
    """The variants' tables and the spectra of all iterations, unfolded side by side."""
    tables = tuple(x.filter("setting <> 'reweight_pseudo_data'") for x in _variants(spark, d))
    return tables, U.unfolded(*tables[:3], iterations=_STEPS)


def _along(spectra: DataFrame) -> DataFrame:
    return U.projected_spectrum(spectra.filter("true_pt_bin between 3 and 5"), "true_bin", ["setting", "iteration"]).withColumnRenamed("true_bin", "bin")


def _errors(spectra: DataFrame) -> DataFrame:
    both = _along(spectra)
    return U.iteration_errors(both.filter("setting = 'split'").drop("setting"), ["bin"], both.filter("setting = 'reweight_response'"), F.col("bin") == 0)


@query(f"{_STEP_HEAD}, {_ERRORS} SELECT iteration, round(regularization, 6) AS regularization, round(statistical, 6) AS statistical, round(prior, 6) AS prior, round(total, 6) AS total, iteration = (SELECT iteration FROM errors_u ORDER BY total, iteration LIMIT 1) AS chosen FROM errors_u", "skim")
def u14_iteration_choice(spark: SparkSession, d: str) -> DataFrame:
    """Errors by iteration of the unfolded pseudo-data, with the prior of a reweighted response, and the least in total."""
    errors = checkpointed(_errors(_steps(spark, d)[1]))
    best = U.best_iteration(errors).withColumn("chosen", F.lit(True))
    return rounded(errors.join(best, "iteration", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))), "regularization", "statistical", "prior", "total")


_RATIOS = f"""SELECT s.iteration, 'chosen' AS over, s.bin, s.value / c.value AS ratio FROM spectra_u s JOIN spectra_u c ON c.setting = s.setting AND c.bin = s.bin AND c.iteration = (SELECT iteration FROM errors_u ORDER BY total, iteration LIMIT 1) WHERE s.setting = 'split' AND c.value <> 0
UNION ALL SELECT s.iteration, 'truth', s.bin, s.value / t.value FROM spectra_u s JOIN (SELECT true_bin AS bin, sum(truth) AS value FROM pseudo_u WHERE setting = 'split' AND true_pt_bin BETWEEN 3 AND 5 GROUP BY 1) t ON t.bin = s.bin WHERE s.setting = 'split' AND t.value <> 0
UNION ALL SELECT f.iteration, 'raw', f.bin, f.value / r.value FROM (SELECT x.iteration, p.meas_bin AS bin, sum(p.p * x.value) AS value FROM p_u p JOIN ({' UNION ALL '.join(f'SELECT {k} AS iteration, * FROM a_{k}' for k in range(1, _STEPS + 1))}) x USING ({_C}) WHERE p.setting = 'split' AND p.meas_pt_bin BETWEEN 2 AND 4 GROUP BY 1, 2) f
JOIN (SELECT meas_bin AS bin, sum(d) AS value FROM d0 WHERE setting = 'split' AND meas_pt_bin BETWEEN 2 AND 4 GROUP BY 1) r ON r.bin = f.bin WHERE r.value <> 0"""


@query(f"{_STEP_HEAD}, {_ERRORS} SELECT iteration, over, bin, round(ratio, 6) AS ratio FROM ({_RATIOS}) x", "skim")
def u15_iteration_ratios(spark: SparkSession, d: str) -> DataFrame:
    """By iteration: unfolded over the chosen iteration and over the truth, and refolded over what was measured."""
    (response, truth, measured, pseudo), spectra = _steps(spark, d)
    own = [x.filter("setting = 'split'") for x in (response, truth, measured, pseudo, spectra)]
    along = checkpointed(_along(own[4]))
    chosen = along.join(F.broadcast(U.best_iteration(_errors(spectra))), "iteration").select("bin", F.col("value").alias("by"))  # one row
    generated = own[3].filter("true_pt_bin between 3 and 5").groupBy(F.col("true_bin").alias("bin")).agg(F.sum("value").alias("by"))
    raw = own[2].filter("meas_pt_bin between 2 and 4").groupBy(F.col("meas_bin").alias("bin")).agg(F.sum("value").alias("by"))
    folded = U.refolded(own[4], own[0], own[1], keys=["iteration"]).filter("meas_pt_bin between 2 and 4")
    folded = folded.groupBy("iteration", F.col("meas_bin").alias("bin")).agg(F.sum("value").alias("value"))
    out = None
    for over, above, below in (("chosen", along, chosen), ("truth", along, generated), ("raw", folded, raw)):
        part = above.join(below.filter("by <> 0"), "bin").select("iteration", F.lit(over).alias("over"), "bin", r6(F.col("value") / F.col("by")).alias("ratio"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_STEP_HEAD} SELECT a.iteration, a.bin, round(a.value / b.value, 6) AS ratio FROM spectra_u a JOIN spectra_u b ON b.setting = a.setting AND b.bin = a.bin AND b.iteration = 5 WHERE a.setting = 'split' AND b.value <> 0", "skim")
def u15_ratio_to_iteration(spark: SparkSession, d: str) -> DataFrame:
    """Every iteration's spectrum over that of the fifth."""
    along = checkpointed(_along(_steps(spark, d)[1].filter("setting = 'split'")))
    chosen = along.filter("iteration = 5 and value <> 0").select("bin", F.col("value").alias("by"))
    return along.join(chosen, "bin").select("iteration", "bin", r6(F.col("value") / F.col("by")).alias("ratio"))


@query(f"{_VARIANT_HEAD}, {_unfold_sql('d0', 'a', 4)} SELECT true_bin, round(value / sum(value) OVER () / ({_WIDTHS}), 6) AS value FROM (SELECT true_bin, sum(value) AS value FROM a_4 WHERE setting = 'split' AND true_pt_bin BETWEEN 3 AND 5 AND true_bin BETWEEN 0 AND {TRUE_KT.n - 1} GROUP BY 1) t", "skim")
def u13_unfolded_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """The final spectrum from an unfolding: its efficiency is in the sharing, so only projection, widths and normalisation are left."""
    tables = [x.filter("setting = 'split'") for x in _variants(spark, d)[:3]]
    last = U.unfolded(*tables, iterations=4).filter(f"iteration = 4 and true_pt_bin between 3 and 5 and true_bin between 0 and {TRUE_KT.n - 1}")
    sums = U.projected_spectrum(last, "true_bin", []).join(TRUE_KT.catalogue(spark), F.col("true_bin") == F.col("bin")).select("true_bin", "width", F.col("value").alias("sumw"))
    return H.normalized(sums, F.col("width")).select("true_bin", r6("value").alias("value"))


# --- systematics ---------------------------------------------------------------------------------------------------

_DEF, _VAR = (f"SELECT {PT.sql(f'{p}_jet_pt')} AS bin, sum(scale_factor) AS value, sqrt(sum(scale_factor * scale_factor)) AS error FROM jets GROUP BY 1" for p in ("true", "hybrid"))
_VAR2 = _DEF.replace("true_jet_pt", "det_level_jet_pt")


def _spectrum(spark: SparkSession, d: str, level: str) -> DataFrame:
    return view(spark, d, "jets").groupBy(PT.bin(F.col(f"{level}_jet_pt")).alias("bin")).agg(F.sum("scale_factor").alias("value"), F.sqrt(F.sum(F.col("scale_factor") * F.col("scale_factor"))).alias("error"))


def _sources(spark: SparkSession, d: str) -> list[DataFrame]:
    default, one, two = (_spectrum(spark, d, x) for x in ("true", "hybrid", "det_level"))
    non_closure = default.select("bin", F.lit(0.05).alias("relative"))
    return [
        Y.source(default, [one], "tracking_efficiency", ["bin"], even=True),
        Y.source(default, [one, two], "truncation", ["bin"]),
        Y.source(default, [two], "background_subtraction", ["bin"]),
        Y.relative_source(default, non_closure, "non_closure", ["bin"]),
    ]


_A, _B = "(v1 - v)", "(v2 - v)"
_SRC = f"""WITH b AS (SELECT d.bin, d.value AS v, x.value AS v1, y.value AS v2 FROM ({_DEF}) d JOIN ({_VAR}) x ON x.bin = d.bin JOIN ({_VAR2}) y ON y.bin = d.bin),
s AS (SELECT bin, v, 'tracking_efficiency' AS source, abs{_A} AS low, abs{_A} AS high FROM b
UNION ALL SELECT bin, v, 'truncation', CASE WHEN {_A} <= 0 AND {_B} <= 0 THEN greatest(abs{_A}, abs{_B}) WHEN {_A} <= 0 THEN abs{_A} WHEN {_B} <= 0 THEN abs{_B} ELSE 0 END,
 CASE WHEN {_A} > 0 AND {_B} > 0 THEN greatest({_A}, {_B}) WHEN {_A} > 0 THEN {_A} WHEN {_B} > 0 THEN {_B} ELSE 0 END FROM b
UNION ALL SELECT d.bin, d.value, 'background_subtraction', CASE WHEN y.value - d.value > 0 THEN 0 ELSE abs(y.value - d.value) END, CASE WHEN y.value - d.value > 0 THEN y.value - d.value ELSE 0 END FROM ({_DEF}) d JOIN ({_VAR2}) y ON y.bin = d.bin
UNION ALL SELECT bin, value, 'non_closure', CASE WHEN 0.05 * value > 0 THEN 0 ELSE abs(0.05 * value) END, CASE WHEN 0.05 * value > 0 THEN 0.05 * value ELSE 0 END FROM ({_DEF}) d)"""


@query(f"{_SRC} SELECT bin, source, round(low, 6) AS low, round(high, 6) AS high FROM s", "jets")
def y01_y04_systematic_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = _sources(spark, d)
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "low", "high")


@query(f"{_SRC} SELECT bin, round(sqrt(sum(low * low)), 6) AS low, round(sqrt(sum(high * high)), 6) AS high FROM s WHERE bin IN (SELECT bin FROM b) GROUP BY bin", "jets")
def y05_total_error(spark: SparkSession, d: str) -> DataFrame:
    parts = _sources(spark, d)
    return rounded(Y.total(parts, ["bin"]).join(parts[1].select("bin"), "bin", "left_semi"), "low", "high")


@query(f"""{_SRC}, x AS (SELECT bin, 'a' AS source, low, high FROM s WHERE source = 'tracking_efficiency' UNION ALL SELECT bin, 'copy', low, high FROM s WHERE source = 'tracking_efficiency' UNION ALL SELECT bin, source, low, high FROM s WHERE source = 'truncation')
SELECT p.source AS a, q.source AS b FROM x p JOIN x q ON q.bin = p.bin AND p.source < q.source GROUP BY 1, 2 HAVING max(abs(p.low - q.low) + abs(p.high - q.high)) < 1e-9""", "jets")
def y06_equal_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source that was entered twice under two names."""
    first, second = _sources(spark, d)[:2]
    return Y.equal_sources([first.withColumn("source", F.lit("a")), first.withColumn("source", F.lit("copy")), second], ["bin"])


@query(f"{_SRC} SELECT bin, source, round(1 - low / v, 6) AS low, round(1 + high / v, 6) AS high FROM s WHERE v <> 0", "jets")
def y07_relative_errors(spark: SparkSession, d: str) -> DataFrame:
    parts = _sources(spark, d)
    return rounded(Y.relative_table(_spectrum(spark, d, "true"), parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), ["bin"]), "low", "high")


@query(f"SELECT a.bin, round(a.value / b.value, 6) AS value, round(a.value / b.value * sqrt(pow(a.error / a.value, 2) + pow(b.error / b.value, 2)), 6) AS error, round(a.value / b.value * sqrt(0.01 + 0.01), 6) AS low, round(a.value / b.value * sqrt(0.04 + 0.04), 6) AS high FROM ({_DEF}) a JOIN ({_VAR}) b ON a.bin = b.bin WHERE a.value <> 0 AND b.value <> 0", "jets")
def y08_y09_result_ratio(spark: SparkSession, d: str) -> DataFrame:
    a, b = (_spectrum(spark, d, x).withColumns({"low": F.col("value") * 0.1, "high": F.col("value") * 0.2}) for x in ("true", "hybrid"))
    return rounded(Y.ratio_with_errors(a, b, ["bin"]), "value", "error", "low", "high")


@query(f"SELECT d.bin, round(m.value / t.v / d.value, 6) AS value, round(m.value / t.v / d.value * 0.1, 6) AS low FROM ({_DEF}) d JOIN ({_VAR}) m ON m.bin = d.bin CROSS JOIN (SELECT sum(m.value) AS v FROM ({_VAR}) m WHERE bin IN (SELECT bin FROM ({_DEF}) d)) t WHERE d.value <> 0", "jets")
def y10_model_over_data(spark: SparkSession, d: str) -> DataFrame:
    data = _spectrum(spark, d, "true").withColumns({"low": F.col("value") * 0.1, "high": F.col("value") * 0.1})
    return rounded(Y.model_over_data(_spectrum(spark, d, "hybrid"), data, ["bin"], renormalize=True).select("bin", "value", "low"), "value", "low")


# --- sorts, sets, streams ------------------------------------------------------------------------------------------


@query("SELECT jet_id, hybrid_jet_pt, det_level_kt FROM skim WHERE leading_match = 1 AND subleading_match = 3 AND hybrid_jet_pt > 80 AND det_level_kt > 10 ORDER BY jet_id LIMIT 5", "skim")
def t02_jets_of_interest(spark: SparkSession, d: str) -> DataFrame:
    rows = _skim(spark, d).filter("leading_match = 1 and subleading_match = 3 and hybrid_jet_pt > 80 and det_level_kt > 10")
    return rows.orderBy("jet_id").limit(5).select("jet_id", "hybrid_jet_pt", "det_level_kt")


@query("SELECT event_id, list(idx ORDER BY pt DESC, idx)[1:3] AS hardest FROM tracks GROUP BY event_id", "tracks")
def t01_t03_hardest_tracks(spark: SparkSession, d: str) -> DataFrame:
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("pt")).alias("p"), "idx"))), 1, 3)
    return view(spark, d, "tracks").groupBy("event_id").agg(best.alias("b")).select("event_id", F.col("b.idx").alias("hardest"))


@query("SELECT name, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM (SELECT 'pt_' || CAST(pt_hard_bin AS VARCHAR) AS name, 1 AS a, NULL AS b FROM jets WHERE pt_hard_bin <= 12 UNION ALL SELECT 'pt_' || CAST(pt_hard_bin AS VARCHAR), NULL, 1 FROM jets WHERE pt_hard_bin >= 8) t GROUP BY name", "jets")
def o02_union_of_results(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("pt_"), F.col("pt_hard_bin").cast("string")).alias("name")
    j = view(spark, d, "jets")
    a, b = j.filter("pt_hard_bin <= 12").groupBy(name).agg(F.count("*").alias("a")), j.filter("pt_hard_bin >= 8").groupBy(name).agg(F.count("*").alias("b"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


@query("SELECT DISTINCT pt_hard_bin FROM jets WHERE jet_id % 2 = 0 AND pt_hard_bin IN (SELECT pt_hard_bin FROM jets WHERE jet_id % 3 = 0)", "jets")
def o03_overlap(spark: SparkSession, d: str) -> DataFrame:
    j = view(spark, d, "jets")
    return j.filter("jet_id % 2 = 0").select("pt_hard_bin").intersect(j.filter("jet_id % 3 = 0").select("pt_hard_bin"))


@query("SELECT a.b AS pt_hard_bin, 'first' AS only_in FROM (SELECT DISTINCT pt_hard_bin AS b FROM jets WHERE pt_hard_bin <= 12) a WHERE a.b NOT IN (SELECT pt_hard_bin FROM jets WHERE pt_hard_bin >= 8) UNION ALL SELECT b, 'second' FROM (SELECT DISTINCT pt_hard_bin AS b FROM jets WHERE pt_hard_bin >= 8) c WHERE b > 12", "jets")
def o03_unequal_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two sets are equal if this is empty."""
    bins = view(spark, d, "jets").select("pt_hard_bin").distinct()
    return H.only_in_one(bins.filter("pt_hard_bin <= 12"), bins.filter("pt_hard_bin >= 8"))


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return running.event_stream(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)  # as a pattern the path may be a file or a folder


@query("SELECT CAST(floor(o_totalprice / 50000) AS INT) AS bin, count(*) AS n, round(sum(1.0 / (o_orderkey % 20 + 1)), 6) AS sumw FROM orders WHERE o_totalprice < 500000 GROUP BY 1")
def st01_st02_running_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Files arrive one at a time and are folded into the totals."""
    folder = new_folder(spark)
    stream = _streamed(spark, d, "orders").filter("o_totalprice < 500000")
    hist = running.running_histogram(stream, {"bin": (F.col("o_totalprice"), H.Regular(10, 0, 500_000))}, F.lit(1.0) / (F.col("o_orderkey") % 20 + 1))
    return running.folded(hist, f"{folder}/totals", f"{folder}/checkpoint").select("bin", "n", r6("sumw").alias("sumw"))


@query("SELECT CAST(0 AS INT) AS chunk, o_orderpriority, count(*) AS n FROM orders GROUP BY 2")
def st02_ingested_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Files arrive one at a time and each becomes a chunk."""
    folder = new_folder(spark)
    running.ingest(_streamed(spark, d, "orders"), f"{folder}/chunks", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/chunks").groupBy(F.col("chunk").cast("int").alias("chunk"), "o_orderpriority").agg(F.count("*").alias("n"))


def _several_files(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Orders dealt to five files, as a folder that a stream reads one file at a time."""
    folder, orders = new_folder(spark), table(spark, d, "orders")
    orders.repartition(5, "o_orderkey").write.parquet(f"{folder}/orders")
    return folder, running.event_stream(spark, f"{folder}/orders", orders.schema)


@query("SELECT CAST(floor(o_totalprice / 50000) AS INT) AS bin, count(*) AS n, round(sum(1.0 / (o_orderkey % 20 + 1)), 6) AS sumw FROM orders WHERE o_totalprice < 500000 GROUP BY 1")
def st01_several_files(spark: SparkSession, d: str) -> DataFrame:
    """Totals after five batches, each of which replaced those before."""
    folder, stream = _several_files(spark, d)
    hist = running.running_histogram(stream.filter("o_totalprice < 500000"), {"bin": (F.col("o_totalprice"), H.Regular(10, 0, 500_000))}, F.lit(1.0) / (F.col("o_orderkey") % 20 + 1))
    return running.folded(hist, f"{folder}/totals", f"{folder}/checkpoint").select("bin", "n", r6("sumw").alias("sumw"))


@query("SELECT o_orderpriority, count(*) AS n, CAST(5 AS BIGINT) AS n_chunks FROM orders GROUP BY 1")
def st02_several_files(spark: SparkSession, d: str) -> DataFrame:
    """Five files become five chunks, whose rows are all there once."""
    folder, stream = _several_files(spark, d)
    running.ingest(stream, f"{folder}/chunks", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/chunks").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("chunk").alias("n_chunks"))
