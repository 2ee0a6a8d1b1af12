"""Queries: readers and writers, run over files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import new_folder
from ..functions import selections as P
from ..operators.histograms import Regular, histogram, normalized, ratio
from ..sources import event_tables, generator_text, layout, skim_records
from .catalogue import query, r6, rounded
from .views import view


@query("SELECT CAST(event_id AS INT) AS event_id, CAST(count(*) AS INT) AS n_particles, CAST(count(*) AS INT) AS found, CAST(sum(idx) AS DOUBLE) AS sum_px, CAST(182.4 AS DOUBLE) AS cross_section FROM tracks GROUP BY event_id", "tracks")
def s03_s04_s05_generator_text(spark: SparkSession, d: str) -> DataFrame:
    """Events written as generator text, a footer in every file, and read back."""
    path, c = new_folder(spark), F.col
    line = F.concat_ws(" ", c("idx").cast("string"), F.lit("211 27"), c("pt").cast("string"), c("idx").cast("string"), F.lit("0.2"), F.lit("0.3"))
    events = view(spark, d, "tracks").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"), F.count("*").alias("n"))
    head = F.concat(F.lit("#\tEvent\t"), c("event_id").cast("string"), F.lit("\tweight\t0.5\tEPangle\t0.1\tN_hadrons\t"), c("n").cast("string"), F.lit("\n"))
    text = events.repartition(3, "event_id").select(F.concat(head, c("lines")).alias("value"), F.lit(0).alias("last"), F.spark_partition_id().alias("part"))
    foot = text.select("part").distinct().select(F.lit("#\tsigmaGen\t182.4\tsigmaErr\t1.0").alias("value"), F.lit(1).alias("last"), "part")
    whole = text.unionByName(foot).repartitionByRange("part").sortWithinPartitions("part", "last")
    whole.select("value", "part").write.partitionBy("part").text(path)
    back = generator_text.read_generator(spark, path)
    px = F.aggregate("particles", F.lit(0.0), lambda s, p: s + p["px"].cast("double"))
    return back.select("event_id", "n_particles", F.size("particles").alias("found"), px.alias("sum_px"), F.round(c("cross_section").cast("double"), 3).alias("cross_section"))


@query("SELECT event_id, n_particles, found FROM (SELECT event_id, CAST(count(*) AS INT) AS n_particles, CAST(sum(CASE WHEN pt > 0.11 THEN 1 ELSE 0 END) AS INT) AS found FROM tracks GROUP BY event_id) t WHERE n_particles <> found", "tracks")
def s06_miscounted_events(spark: SparkSession, d: str) -> DataFrame:
    events = event_tables.grouped_events(view(spark, d, "tracks"), ("event_id",)).withColumn("n_particles", F.size("particles")).withColumn("particles", P.above(F.col("particles"), 0.1100000001))
    return generator_text.miscounted(events.withColumn("file", F.lit("-"))).drop("file")


@query("SELECT count(*) AS n_events, CAST(sum(n) AS BIGINT) AS n_tracks, TRUE AS bounded FROM (SELECT event_id, count(*) AS n FROM tracks GROUP BY event_id) t", "tracks")
def s01_s07_s12_bounded_files(spark: SparkSession, d: str) -> DataFrame:
    """Events written with at most 25 in a file, then only two columns read."""
    path = new_folder(spark)
    events = event_tables.grouped_events(view(spark, d, "tracks"), ("event_id",)).withColumn("n", F.size("particles").cast("long"))
    generator_text.write_events(events, path, 25)
    bounded = event_tables.rows_per_file(spark, path).agg((F.max("count") <= 25).alias("bounded"))
    return event_tables.read_columns(spark, path, ["event_id", "n"]).agg(F.count("*").alias("n_events"), F.sum("n").alias("n_tracks")).crossJoin(bounded)  # one row each


@query("SELECT run_number, CAST(sum(n) AS BIGINT) AS n, round(sum(s), 6) AS sum_pt FROM (SELECT CAST(event_id % 50 AS INT) AS run_number, count(*) AS n, sum(pt) AS s FROM tracks GROUP BY event_id) t GROUP BY run_number", "tracks")
def s08_s10_prefixed_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parallel lists with prefixed names to one list of particles."""
    whole = event_tables.grouped_events(view(spark, d, "tracks"), ("event_id",))
    lists = whole.select("event_id", *[F.col(f"particles.{c}").alias(f"particle_data_{c}") for c in ("pt", "eta", "phi")])
    skim = event_tables.track_skim(lists.withColumn("run_number", (F.col("event_id") % 50).cast("int")), "pp")
    return skim.groupBy("run_number").agg(F.sum(F.size("data")).alias("n"), r6(F.sum(F.aggregate("data", F.lit(0.0), lambda s, p: s + p["pt"]))).alias("sum_pt"))


@query("SELECT event_id, CAST(0.5 + event_id % 3 AS DOUBLE) AS event_weight, CAST(event_id % 12 AS DOUBLE) AS event_impact_parameter, CAST(count(*) AS INT) AS n, round(sum(pt), 6) AS sum_pt, CAST(sum(h4 % 3 - 1) AS BIGINT) AS charge FROM tracks GROUP BY event_id", "tracks")
def s10_jet_extractor(spark: SparkSession, d: str) -> DataFrame:
    """Lists under the names of a jet extractor, with the event's weight and impact parameter."""
    t, c = view(spark, d, "tracks"), F.col
    fields = {"Jet_Track_Pt": c("pt"), "Jet_Track_Eta": c("eta"), "Jet_Track_Phi": c("phi"), "Jet_Track_Charge": (c("h4") % 3 - 1).cast("int"), "Jet_Track_Label": c("idx")}
    rows = F.array_sort(F.collect_list(F.struct(c("idx").alias("order"), *[v.alias(n) for n, v in fields.items()])))
    raw = t.groupBy("event_id").agg(rows.alias("r")).select("event_id", *[c(f"r.{n}").alias(n) for n in fields], (0.5 + c("event_id") % 3).alias("Event_Weight"), (c("event_id") % 12).cast("double").alias("Event_ImpactParameter"))
    out = event_tables.renamed_lists(raw, event_tables.JET_EXTRACTOR, keep=("event_id",), events=event_tables.EXTRACTOR_EVENTS)
    total = lambda f, start: F.aggregate("part_level", F.lit(start), lambda s, p: s + p[f])
    return out.select("event_id", c("event_weight").cast("double").alias("event_weight"), "event_impact_parameter", F.size("part_level").alias("n"), r6(total("pt", 0.0)).alias("sum_pt"), total("charged", 0).cast("long").alias("charge"))


@query("SELECT event_id, CAST(0.5 + event_id % 3 AS DOUBLE) AS event_weight, CAST(count(*) AS INT) AS n, round(sum(pt * eta), 6) AS sum_pt_eta, round(sum(CAST(0.1 AS DOUBLE) * (h4 % 3)), 6) AS sum_m FROM tracks GROUP BY event_id", "tracks")
def s10_jewel(spark: SparkSession, d: str) -> DataFrame:
    """The same for a generator's short names, with masses."""
    t, c = view(spark, d, "tracks"), F.col
    fields = {"partpT": c("pt"), "party": c("eta"), "partphi": c("phi"), "partm": 0.1 * (c("h4") % 3), "partc": (c("h4") % 3 - 1).cast("int")}
    rows = F.array_sort(F.collect_list(F.struct(c("idx").alias("order"), *[v.cast("double").alias(n) for n, v in fields.items()])))
    raw = t.groupBy("event_id").agg(rows.alias("r")).select("event_id", (0.5 + c("event_id") % 3).cast("double").alias("mcweight"), *[c(f"r.{n}").alias(n) for n in fields])
    out = event_tables.renamed_lists(raw, event_tables.JEWEL, keep=("event_id",), events=event_tables.JEWEL_EVENTS)
    total = lambda f: r6(F.aggregate("part_level", F.lit(0.0), lambda s, p: s + f(p)))
    return out.select("event_id", "event_weight", F.size("part_level").alias("n"), total(lambda p: p["pt"] * p["eta"]).alias("sum_pt_eta"), total(lambda p: p["m"]).alias("sum_m"))


@query("SELECT pt_hard_bin, count(*) AS n, round(sum(hybrid_jet_pt), 6) AS sum_pt FROM (SELECT DISTINCT jet_id, pt_hard_bin, hybrid_jet_pt FROM jets) t GROUP BY pt_hard_bin", "jets")
def s14_s16_skim_files(spark: SparkSession, d: str) -> DataFrame:
    """A skim written twice by partition, compacted to two files beside one that can't be read, and read back."""
    path, whole = new_folder(spark), new_folder(spark)
    jets = view(spark, d, "jets").select("jet_id", "pt_hard_bin", "hybrid_jet_pt")
    for _ in range(2):
        event_tables.write_skim(jets, path, ["pt_hard_bin"])
    jets.select(F.col("jet_id").cast("string")).write.text(f"{path}/pt_hard_bin=99")  # not Parquet
    event_tables.compacted(spark, [path], whole, 2, jets.schema)
    return spark.read.parquet(whole).groupBy("pt_hard_bin").agg(F.count("*").alias("n"), r6(F.sum("hybrid_jet_pt")).alias("sum_pt"))


@query("SELECT pt_hard_bin, count(*) AS n, round(sum(hybrid_jet_pt), 6) AS sum_pt, CAST(1 AS BIGINT) AS n_broken, TRUE AS sized FROM jets GROUP BY pt_hard_bin", "jets")
def s14_files_of_a_size(spark: SparkSession, d: str) -> DataFrame:
    """Many small files, a large one and a broken one, written again as files of about a fifth of all bytes."""
    small, large, broken, whole = (new_folder(spark) for _ in range(4))
    jets = view(spark, d, "jets").select("jet_id", "pt_hard_bin", "hybrid_jet_pt")
    jets.filter("pt_hard_bin < 8").repartition(12, "jet_id").write.parquet(small)
    jets.filter("pt_hard_bin >= 8").coalesce(1).write.parquet(large)
    jets.limit(3).select(F.col("jet_id").cast("string")).coalesce(1).write.text(broken)  # not Parquet
    total = layout.file_sizes(spark, [small, large]).agg(F.sum("bytes")).first()[0]
    found = layout.rechunked(spark, [small, large, broken], whole, -(-total // 5), jets.schema)
    n_broken = found.filter("n_rows is null").agg(F.count("*").alias("n_broken"))
    sizes = layout.file_sizes(spark, [whole]).agg(((F.max("bytes") <= total / 2) & F.count("*").between(4, 6)).alias("sized"))
    out = spark.read.parquet(whole).groupBy("pt_hard_bin").agg(F.count("*").alias("n"), r6(F.sum("hybrid_jet_pt")).alias("sum_pt"))
    return out.crossJoin(n_broken).crossJoin(sizes)  # one row each


@query("SELECT e.run_number, e.event_id, d.n AS n_det, p.n AS n_part, round(d.s, 6) AS det_pt, round(p.s, 6) AS part_pt FROM event_info e JOIN (SELECT event_id, CAST(count(*) AS INT) AS n, sum(pt) AS s FROM det_tracks WHERE pt > 1 GROUP BY 1) d ON d.event_id = e.event_id JOIN (SELECT event_id, CAST(count(*) AS INT) AS n, sum(pt) AS s FROM tracks WHERE pt > 2 GROUP BY 1) p ON p.event_id = e.event_id", "event_info", "det_tracks")
def j02_a01_bucketed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the lists of both levels, from tables in equal buckets by run and event: joins and nesting need no exchange."""
    run = (F.col("event_id") % 50).cast("int").alias("run_number")
    tracks = {"det": view(spark, d, "det_tracks").filter("pt > 1"), "part": view(spark, d, "tracks").filter("pt > 2")}
    tables = {n: t.select(run, "event_id", "idx", "pt", "eta", "phi") for n, t in tracks.items()} | {"events": view(spark, d, "event_info").select("run_number", "event_id")}
    t = layout.joined_copies(spark, tables, 8)
    tree = event_tables.event_tree(t["events"], t["det"], t["part"])
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda s, p: s + p["pt"]))
    return tree.select("run_number", "event_id", F.size("det_level").alias("n_det"), F.size("part_level").alias("n_part"), total("det_level").alias("det_pt"), total("part_level").alias("part_pt"))


@query("SELECT slot, count(*) AS n_events, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT event_id, cost, CAST(floor((sum(cost) OVER (ORDER BY event_id) - cost) * 16 / sum(cost) OVER ()) AS INT) AS slot FROM (SELECT event_id, CAST(count(*) * count(*) AS HUGEINT) AS cost FROM tracks GROUP BY 1) c) t GROUP BY slot", "tracks")
def a01_events_by_cost(spark: SparkSession, d: str) -> DataFrame:
    """Events dealt to sixteen slots by the square of their tracks."""
    counts = view(spark, d, "tracks").groupBy("event_id").agg((F.count("*") * F.count("*")).alias("cost"))
    return layout.cost_slots(counts, ["event_id"], 16).groupBy("slot").agg(F.count("*").alias("n_events"), F.sum("cost").alias("cost"))


_K13_SPLITS = "SELECT jet_id, lvl, CAST(count(*) AS INT) AS n, sum(kt) AS kt, CAST(sum(idx) AS BIGINT) AS ids FROM splittings WHERE lvl IN (0, 2) GROUP BY 1, 2"


@query(
    f"""SELECT j.jet_id, round(CAST(CAST(j.hybrid_jet_pt AS FLOAT) AS DOUBLE), 4) AS hybrid_jet_pt, round(CASE WHEN t.n IS NULL THEN -9999 ELSE j.true_jet_pt END, 6) AS true_jet_pt, coalesce(h.n, 0) AS n_hybrid, coalesce(t.n, 0) AS n_true, round(coalesce(h.kt, 0), 6) AS hybrid_kt,
CASE WHEN j.jet_id % 3 = 0 THEN -9999 ELSE j.hybrid_leading_track_pt END AS hybrid_leading_track_pt, coalesce(h.ids, 0) AS hybrid_ids, TRUE AS back FROM jets j
LEFT JOIN ({_K13_SPLITS}) h ON h.jet_id = j.jet_id AND h.lvl = 2 LEFT JOIN (SELECT * FROM ({_K13_SPLITS}) s WHERE jet_id % 5 <> 0) t ON t.jet_id = j.jet_id AND t.lvl = 0""",
    "jets",
    "splittings",
)
def k13_skim_records(spark: SparkSession, d: str) -> DataFrame:
    """Analysed jets of two levels to skim records, flat and back; every fifth jet has no true level."""
    s = view(spark, d, "splittings")
    lists = s.filter("lvl in (0, 2)").groupBy("jet_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("lvl") == k, F.struct("idx", "kt", "delta_r", "z", "parent_index")))).alias(f"s{k}") for k in (0, 2)])
    rows = view(spark, d, "jets").join(lists, "jet_id", "left")

    def level(k: int, pt: str, *more: Column) -> Column:
        splits = F.coalesce(F.col(f"s{k}"), F.array().cast(rows.schema[f"s{k}"].dataType))
        constituents = F.transform(splits, lambda x: F.struct(x["kt"].alias("pt"), x["z"].alias("eta"), x["delta_r"].alias("phi"), x["idx"].alias("index")))
        subjets = F.transform(splits, lambda x: F.struct((x["parent_index"] < 0).alias("part_of_iterative_splitting"), x["idx"].alias("splitting_node_index"), F.array(x["idx"]).alias("constituent_indices")))
        return F.struct(F.col(pt).alias("pt"), constituents.alias("constituents"), F.struct(splits.alias("jet_splittings"), subjets.alias("subjets")).alias("reclustering"), *more)

    lead = F.when(F.col("jet_id") % 3 != 0, F.col("hybrid_leading_track_pt")).alias("unsubtracted_leading_track_pt")
    true = F.when((F.size("s0") > 0) & (F.col("jet_id") % 5 != 0), level(0, "true_jet_pt"))
    records = skim_records.to_skim_records(rows.select("jet_id", level(2, "hybrid_jet_pt", lead).alias("reco"), true.alias("gen")), {"reco": "hybrid", "gen": "true"})
    flat = skim_records.flattened(records)
    again = skim_records.flattened(skim_records.nested_again(flat, records.schema))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    both = skim_records.flattened(records, {"jet_pt": "float"}).select("jet_id", F.col("hybrid_jet_pt").alias("narrow"))
    flat = flat.withColumn("all", F.hash(*flat.columns)).join(again.select("jet_id", F.hash(*again.columns).alias("again")), "jet_id").join(both, "jet_id")
    total = lambda c, zero: F.aggregate(F.coalesce(c, F.array().cast(flat.schema[c].dataType)), zero, lambda a, x: a + x)
    return flat.select(
        "jet_id", F.round(F.col("narrow").cast("double"), 4).alias("hybrid_jet_pt"), r6("true_jet_pt").alias("true_jet_pt"), size("hybrid_jet_splittings_kt").alias("n_hybrid"), size("true_jet_constituents_id").alias("n_true"),
        r6(total("hybrid_jet_constituents_pt", F.lit(0.0))).alias("hybrid_kt"), "hybrid_leading_track_pt", total("hybrid_subjets_parent_splitting_index", F.lit(0)).cast("long").alias("hybrid_ids"), (F.col("all") == F.col("again")).alias("back"),
    )


@query("SELECT jet_id, CASE WHEN jet_id % 5 = 0 THEN -9999 ELSE true_jet_pt END AS true_jet_pt, 2 AS n_constituents, CAST(pt_hard_bin AS DOUBLE) AS pt_hard FROM jets", "jets")
def s15_jet_records(spark: SparkSession, d: str) -> DataFrame:
    pt = F.when(F.col("jet_id") % 5 != 0, F.col("true_jet_pt"))
    pair = lambda a, b: F.array(a, b)
    raw = view(spark, d, "jets").select("jet_id", pt.alias("matched_fJetPt"), pair(F.col("jet_id"), F.col("jet_id") + 1).alias("matched_fGlobalIndex"), pair(pt, pt).alias("matched_fPt"), F.col("pt_hard_bin").cast("double").alias("ptHard"))
    rows = event_tables.jet_records(raw, {"true": "matched"})
    return rows.select(F.col("true_constituents")[0]["id"].alias("jet_id"), "true_jet_pt", F.size("true_constituents").alias("n_constituents"), "pt_hard")


@query("SELECT jet_id AS id, CAST(CAST(hybrid_jet_pt AS FLOAT) AS DOUBLE) AS hybrid_jet_pt, CAST(1 AS DOUBLE) AS scale_factor FROM jets", "jets")
def s17_f07_f10_uniform_skim(spark: SparkSession, d: str) -> DataFrame:
    raw = view(spark, d, "jets").select(F.col("jet_id").alias("id"), F.col("hybrid_jet_pt").alias("data_jet_pt"))
    out = event_tables.uniform_skim(raw, {"data_jet_pt": "hybrid_jet_pt"}, {"hybrid_jet_pt": "float"})
    return out.select("id", F.col("hybrid_jet_pt").cast("double").alias("hybrid_jet_pt"), F.col("scale_factor").cast("double").alias("scale_factor"))


@query("SELECT a.pt_hard_bin AS bin, round((a.s / sum(a.s) OVER ()) / (b.s / sum(b.s) OVER ()), 6) AS ratio FROM (SELECT pt_hard_bin, sum(hybrid_jet_pt) AS s FROM jets GROUP BY 1) a JOIN (SELECT pt_hard_bin, sum(true_jet_pt) AS s FROM jets GROUP BY 1) b ON a.pt_hard_bin = b.pt_hard_bin", "jets")
def s19_prediction_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of predictions by bin, each normalised, and their ratio."""
    jets = view(spark, d, "jets")
    sums = (jets.groupBy(F.col("pt_hard_bin").alias("bin")).agg(F.sum(f"{p}_jet_pt").alias("sumw"), F.lit(0.0).alias("sumw2")) for p in ("hybrid", "true"))
    one, two = (normalized(s, 1.0).drop("sumw").withColumnRenamed("value", "sumw") for s in sums)
    return rounded(ratio(one, two, ["bin"]).select("bin", "ratio"), "ratio")


@query("SELECT CAST(pt_hard_bin - 1 AS INT) AS bin, round(s, 4) AS value, round(0.25 * pt_hard_bin, 4) AS low, round(0.5 * pt_hard_bin, 4) AS high FROM (SELECT pt_hard_bin, round(sum(true_jet_pt), 4) AS s FROM jets GROUP BY 1) t", "jets")
def s19_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as text of central, lower and upper values, and read with errors on both sides."""
    path = new_folder(spark)
    s = view(spark, d, "jets").groupBy("pt_hard_bin").agg(F.round(F.sum("true_jet_pt"), 4).alias("s"))
    line = F.format_string("%.4f %.4f %.4f", "s", F.col("s") - 0.25 * F.col("pt_hard_bin"), F.col("s") + 0.5 * F.col("pt_hard_bin"))
    lines = s.select("pt_hard_bin", line.alias("value")).unionByName(spark.createDataFrame([(0, "# central lower upper")], "pt_hard_bin int, value string"))
    lines.repartitionByRange(1, "pt_hard_bin").sortWithinPartitions("pt_hard_bin").select("value").write.text(path)  # one line a bin
    out = event_tables.predictions(spark, path)
    return out.select(F.col("bin").cast("int").alias("bin"), *[F.round(c, 4).alias(c) for c in ("value", "low", "high")])


@query("SELECT centre, round(value, 6) AS value, round(error, 6) AS error, round(0.1 * value, 6) AS low, round(0.2 * value, 6) AS high FROM (SELECT CAST(10 * floor(true_jet_pt / 10) + 5 AS DOUBLE) AS centre, sum(scale_factor) AS value, sqrt(sum(scale_factor * scale_factor)) AS error FROM jets GROUP BY 1) t WHERE centre BETWEEN 25 AND 95", "jets")
def s18_points(spark: SparkSession, d: str) -> DataFrame:
    """A spectrum with its errors as points within a range, written and read back."""
    axis, path = Regular(20, 0, 200), new_folder(spark)
    h = histogram(view(spark, d, "jets"), {"bin": (F.col("true_jet_pt"), axis)}, F.col("scale_factor"))
    h = h.select(axis.centre(F.col("bin")).alias("centre"), F.col("sumw").alias("value"), F.sqrt("sumw2").alias("error")).withColumns({"low": 0.1 * F.col("value"), "high": 0.2 * F.col("value")})
    event_tables.points(h, 25, 95).write.parquet(path)
    return rounded(spark.read.parquet(path), "value", "error", "low", "high")


@query("SELECT i.event_id FROM event_info i JOIN event_info b ON b.event_id = i.event_id + 10 WHERE i.is_ev_rej = 0 AND abs(i.z_vtx_reco) < 10 AND b.is_ev_rej = 0 AND abs(b.z_vtx_reco) < 10", "event_info")
def p02_background_events(spark: SparkSession, d: str) -> DataFrame:
    events = view(spark, d, "event_info")
    background = P.select_events(events).select((F.col("event_id") - 10).alias("event_id"))
    return P.select_events(events).join(background, "event_id", "left_semi").select("event_id")


@query("SELECT jet_id FROM skim WHERE true_jet_pt > 0 AND pt_hard_bin >= 5 AND hybrid_jet_pt >= 40 AND hybrid_jet_pt < 120 AND true_n_passed > 1 AND det_level_n_passed > 1 AND hybrid_n_passed > 1 AND momentum_fraction > 0.6 * 3.141592653589793 * 0.16 AND true_leading_track_pt >= hybrid_leading_track_pt", "skim")
def p09_p10_p13_p15_jet_quality(spark: SparkSession, d: str) -> DataFrame:
    """Masks of the skim; the momentum fraction stands in for an area."""
    c = F.col
    rows = view(spark, d, "skim").filter((c("true_jet_pt") > 0) & (c("pt_hard_bin") >= 5) & P.in_range(c("hybrid_jet_pt"), 40, 120))
    return rows.filter("true_n_passed > 1 and det_level_n_passed > 1 and hybrid_n_passed > 1").filter(P.large_area(c("momentum_fraction"), 0.4) & (c("true_leading_track_pt") >= c("hybrid_leading_track_pt"))).select("jet_id")
