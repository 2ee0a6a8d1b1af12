"""Hand-made cases and properties of the operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coneflow.functions import kinematics as K
from coneflow.functions import selections as P
from coneflow.operators import drivers, grooming, jetfinding, matching, response, sampling, systematics
from coneflow.operators import histograms as H
from coneflow.operators.tracking_efficiency import efficiency
from coneflow.sources import event_tables, generator_text
from coneflow.streaming import running


def vector(pt, eta, phi, m=0.0):
    px, py, pz = pt * math.cos(phi), pt * math.sin(phi), pt * math.sinh(eta)
    return [px, py, pz, math.sqrt(px * px + py * py + pz * pz + m * m)]


def test_matching_wraps_ties_and_mutual(spark):
    base = spark.createDataFrame([(1, 0, 0.0, 3.13), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0), (4, 0, 0.0, 0.0)], "event_id long, jet int, eta double, phi double")
    tag = spark.createDataFrame([(1, 0, 0.0, -3.13), (2, 0, 0.0, 0.1), (2, 1, 0.0, -0.1), (3, 0, 0.0, 0.2), (4, 0, 0.0, 0.3)], base.schema)
    more = base.unionByName(spark.createDataFrame([(3, 1, 0.0, 0.25)], base.schema))
    got = {(r.event_id, r.base, r.tag) for r in matching.geometric_matches(more, tag, 0.3).collect()}
    # event 3: both want tag 0, which is nearer to jet 1; event 4: exactly the limit is no match
    assert got == {(1, 0, 0), (2, 0, 0), (3, 1, 0)}


def test_shared_fraction(spark):
    generated = spark.createDataFrame([(1, 1, 4.0), (1, 2, 6.0)], "jet_id long, id long, pt double")
    measured = spark.createDataFrame([(1, 2), (1, 9)], "jet_id long, id long")
    pt = spark.createDataFrame([(1, 10.0)], "jet_id long, pt double")
    assert matching.shared_fraction(generated, measured, pt).first().fraction == pytest.approx(0.6)


def test_grooming_cases(spark):
    rows = spark.createDataFrame([(1, 0, i, i - 1, kt, 0.1, z) for i, (kt, z) in enumerate(zip((9.0, 4.0, 2.0), (0.1, 0.3, 0.45)))], "jet_id long, lvl int, idx int, parent_index int, kt double, delta_r double, z double")
    jets = grooming.nested(rows)
    pick = lambda m: grooming.groomed(jets, m).first()
    assert pick("leading_kt").idx == 0
    assert pick("leading_kt_z_cut_02").idx == 1
    soft = pick("soft_drop_z_cut_02")
    assert (soft.value, soft.n_passed) == (0.3, 2)
    none = grooming.groomed(jets, "hard", {"hard": grooming._first(0.5)}).first()
    assert (none.value, none.idx, none.n_passed, none.kt) == (-0.005, -1, 0, -0.005)


def test_splitting_number(spark):
    rows = spark.createDataFrame([(1, 0, i, p, 1.0, 0.1, z) for i, (p, z) in enumerate(zip((-1, 0, 1, 1), (0.1, 0.3, 0.3, 0.1)))], "jet_id long, lvl int, idx int, parent_index int, kt double, delta_r double, z double")
    s = F.col("splittings")
    got = grooming.nested(rows).select(grooming.splitting_number(s, F.lit(3)).alias("a"), grooming.splitting_number(s, F.lit(3), lambda x: x["idx"].isin(1, 3)).alias("b"), grooming.splitting_number(s, F.lit(-1)).alias("c")).first()
    assert tuple(got) == (3, 2, 0)


def test_prong_codes(spark):
    jets = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True), (4, True, True)], "jet_id long, has_measured boolean, has_generated boolean")
    share = spark.createDataFrame([(1, "leading", "subleading", 0.8), (1, "subleading", "leading", 0.9), (4, "leading", "leading", 0.5)], "jet_id long, prong string, other string, share double")
    got = {r.jet_id: (r.leading, r.subleading) for r in matching.prong_codes(jets, share).collect()}
    assert got == {1: (2, 2), 2: (0, 0), 3: (-1, -1), 4: (3, 3)}


def test_asymmetric_errors(spark):
    df = spark.createDataFrame([(2.0, 1.0), (-2.0, -1.0), (2.0, -1.0), (0.0, 0.0)], "a double, b double")
    got = [tuple(r.e) for r in df.select(systematics.asymmetric(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got == [(0.0, 2.0), (2.0, 0.0), (1.0, 2.0), (0.0, 0.0)]


def test_entry_ranges(spark):
    got = event_tables.entry_ranges(spark.createDataFrame([("f", 10)], "file string, n_entries long"), 5).orderBy("low").collect()
    assert [(r.low, r.high) for r in got] == [(0, 5), (5, 10)]


def test_two_jets_from_three_particles():
    p = np.array([vector(10, 0, 0), vector(5, 0, 0.1), vector(8, 0, 2)])
    jets, parents, vectors = jetfinding.cluster(p, 0.4)
    assert sorted(jetfinding.members(k, parents, 3) for k in jets) == [[0, 1], [2]]


@pytest.mark.parametrize("algorithm", sorted(jetfinding.ALGORITHMS))
def test_clustering_against_plain_search(algorithm):
    rng = np.random.default_rng(3)
    p = np.array([vector(*x, 0.139) for x in zip(rng.exponential(2, 25) + 0.1, rng.uniform(-0.9, 0.9, 25), rng.uniform(-3.1, 3.1, 25))])
    jets, parents, vectors = jetfinding.cluster(p, 0.4, algorithm)
    parts = [jetfinding.members(k, parents, len(p)) for k in jets]
    assert sorted(i for x in parts for i in x) == list(range(len(p)))
    assert np.allclose(vectors[jets].sum(axis=0), p.sum(axis=0))

    def plain():
        left = [([i], v) for i, v in enumerate(p)]
        done = []
        while left:
            pt, y, phi = jetfinding._coordinates(np.array([v for _, v in left]))
            k = pt ** (2 * jetfinding.ALGORITHMS[algorithm])
            options = [(k[i], i, -1) for i in range(len(left))]
            for i in range(len(left)):
                for j in range(i):
                    d = abs(phi[i] - phi[j])
                    options.append((min(k[i], k[j]) * ((y[i] - y[j]) ** 2 + min(d, 2 * math.pi - d) ** 2) / 0.16, i, j))
            _, i, j = min(options)
            if j < 0:
                done.append(sorted(left.pop(i)[0]))
            else:
                a, b = left[i], left[j]
                left = [x for n, x in enumerate(left) if n not in (i, j)] + [(a[0] + b[0], a[1] + b[1])]
        return sorted(done)

    assert sorted(parts) == plain()


def test_schemes_and_empty_event(spark):
    p = np.array([vector(10, 0.2, 0), vector(5, 0, 0.1)])
    for scheme in jetfinding.SCHEMES:
        _, _, v = jetfinding.cluster(p, 1.0, scheme=scheme)
        assert math.hypot(v[2, 0], v[2, 1]) == pytest.approx(15, rel=0.01)
    events = spark.createDataFrame([(1, [])], "event_id long, particles array<struct<index:int,pt:double,eta:double,phi:double,m:double>>")
    with pytest.raises(Exception, match="no particles"):
        jetfinding.find_jets(events).collect()


def test_area_of_a_lone_jet(spark):
    tracks = spark.createDataFrame([(1, 0, 50.0, 0.0, 0.0)], "event_id long, idx int, pt double, eta double, phi double")
    jets = jetfinding.find_jets(jetfinding.nested(tracks), 0.4, ghost_area=0.005).filter(F.size("constituents") > 0).collect()
    assert jets[0].area == pytest.approx(math.pi * 0.16, rel=0.05)


def test_jets_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(e, i, float(rng.exponential(3)), float(rng.uniform(-0.9, 0.9)), float(rng.uniform(-3, 3))) for e in range(8) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, idx int, pt double, eta double, phi double")
    got = [sorted(map(tuple, jetfinding.find_jets(jetfinding.nested(df.repartition(n))).select("event_id", "jet", "pt", "constituents").collect())) for n in (1, 7, 32)]
    assert got[0] == got[1] == got[2]


def test_events_side_by_side():
    """Events of very different sizes, clustered together, give what each gives alone, and a particle without pt is a jet of its own."""
    rng = np.random.default_rng(3)
    sizes = [1, 90, 0, 2, 35, 400, 35, 7]
    events = [np.array([vector(0.1 + 20 * u**6, y, f) for u, y, f in rng.uniform((0, -0.9, -3.1), (1, 0.9, 3.1), (n, 3))]).reshape(n, 4) for n in sizes]
    for algorithm, scheme in (("anti-kt", "E"), ("kt", "pt2"), ("cambridge-aachen", "WTA_pt")):
        together = jetfinding.cluster_many(events, 0.4, algorithm, scheme)
        for p, (jets, parents, vectors) in zip(events, together):
            alone = jetfinding.cluster(p, 0.4, algorithm, scheme)
            assert (jets, parents) == alone[:2] and np.array_equal(vectors, alone[2])
            assert sorted(i for k in jets for i in jetfinding.members(k, parents, len(p))) == list(range(len(p)))
    still = np.array([vector(1, 0, 2), [0, 0, 0, 0.14]])
    assert jetfinding.cluster(still, 0.4)[0] == [0, 1]


@pytest.mark.parametrize("r, algorithm, pt_min, spacing", [(0.4, "anti-kt", 1.0, 0.05), (0.7, "anti-kt", 1.0, 0.02), (0.2, "kt", 0.0, 0.05)])
def test_ghosts_are_dealt_not_clustered(monkeypatch, r, algorithm, pt_min, spacing):
    """Areas are those of clustering with all ghosts, though only particles take steps."""
    rng = np.random.default_rng(8)
    make = lambda n: np.array([vector(float(pt), float(y), float(phi)) for pt, y, phi in zip(0.15 + rng.exponential(2, n), rng.uniform(-0.95, 0.95, n), rng.uniform(-math.pi, math.pi, n))])
    events, grid, seen = [make(n) for n in (1, 3, 60, 90, 120)], jetfinding.ghosts(1.0, spacing), []
    plain, clustered = [], jetfinding._clustered
    for x, p in zip(clustered([np.concatenate([p, grid]) for p in events], r, algorithm, "E"), events):
        jets, parents = x.jets.tolist(), list(map(tuple, x.parents.tolist()))
        parts = [jetfinding.members(k, parents, len(p) + len(grid)) for k in jets]
        plain.append(sorted(([i for i in m if i < len(p)], sum(i >= len(p) for i in m)) for m, v in zip(parts, x.vectors[x.jets]) if math.hypot(v[0], v[1]) >= pt_min))
    monkeypatch.setattr(jetfinding, "_clustered", lambda e, *a: (seen.append(sum(map(len, e))), clustered(e, *a))[1])
    at, vectors, n_ghosts, own = jetfinding._jets_with_area(events, grid, r, algorithm, "E", pt_min)
    assert seen == [sum(map(len, events))]
    first = 0
    for e, p in enumerate(events):
        mine = [k for k in np.flatnonzero(at == e).tolist() if math.hypot(*vectors[k, :2]) >= pt_min]
        assert sorted(((np.flatnonzero(own[first : first + len(p)] == k)).tolist(), int(n_ghosts[k])) for k in mine) == plain[e]
        first += len(p)


def test_density_where_jets_are_found(spark):
    """The median of a narrow pass is that over the rows of all kt jets."""
    rng = np.random.default_rng(9)
    rows = [(e, i, float(0.2 + rng.exponential(3)), float(rng.uniform(-0.8, 0.8)), float(rng.uniform(-3.1, 3.1))) for e in range(20) for i in range(1 + 20 * e)]
    rows += [(99, 0, 200.0, 0.0, 0.0), (99, 1, 3.0, 0.1, 2.0)]
    events = jetfinding.nested(spark.createDataFrame(rows, "event_id long, idx int, pt double, eta double, phi double"))
    jets = jetfinding.find_jets(events, 0.2, "kt", ghost_area=0.05)
    plain = {e: rho for e, rho in jetfinding.median_density(jets).collect()}
    got = jetfinding.event_density(events)
    assert "Exchange" in got._jdf.queryExecution().executedPlan().toString() and "Window" not in got._jdf.queryExecution().executedPlan().toString()
    got = {e: rho for e, rho in got.collect()}
    assert got.keys() == plain.keys() and max(plain.values()) > 0.1 and all(got[e] == pytest.approx(plain[e], rel=1e-12) for e in plain)


def test_splittings_without_subjets(spark):
    """The same splittings whether or not subjets are asked for."""
    rng = np.random.default_rng(10)
    rows = [(e, e % 3, [(i, float(1 + rng.exponential(2)), float(rng.uniform(-0.3, 0.3)), float(rng.uniform(-0.3, 0.3)), 0.14) for i in range(1 + e % 9)]) for e in range(60)]
    jets = spark.createDataFrame(rows, "event_id long, jet int, particles array<struct<index:int,pt:double,eta:double,phi:double,m:double>>")
    both = [{(x["event_id"], x["jet"]): x["splittings"] for x in jetfinding.recluster(jets, with_subjets=w).collect()} for w in (True, False)]
    assert both[0].keys() == both[1].keys() and len(both[0]) == 60
    for k, own in both[0].items():
        assert [(s["idx"], s["parent"]) for s in own] == [(s["idx"], s["parent"]) for s in both[1][k]]
        assert [v for s in own for v in (s["kt"], s["delta_r"], s["z"])] == pytest.approx([v for s in both[1][k] for v in (s["kt"], s["delta_r"], s["z"])], rel=1e-9)


def test_splitting_tree_depth_first():
    splittings, subjets = jetfinding.splitting_tree(np.array([vector(10, 0, 0), vector(4, 0, 0.1), vector(2, 0.3, 0)]))
    assert [s["parent"] for s in splittings] == [-1, 0]
    assert splittings[0]["z"] == pytest.approx(2 / 16, rel=0.05)
    assert [s["part_of_iterative_splitting"] for s in subjets] == [True, False, True, False]


def test_constituent_subtraction_takes_the_density(spark):
    rng = np.random.default_rng(1)
    rows = [(1, i, 0.5, float(rng.uniform(-0.9, 0.9)), float(rng.uniform(-3.1, 3.1))) for i in range(100)]
    events = jetfinding.nested(spark.createDataFrame(rows, "event_id long, idx int, pt double, eta double, phi double")).withColumn("rho", F.lit(2.0))
    left = jetfinding.constituent_subtraction(events, r_max=10.0, ghost_area=0.05).agg(F.sum("pt")).first()[0]
    assert left == pytest.approx(50 - 2 * 4 * math.pi * 0.9, rel=0.01)


def test_unfolding_trivial_closure(spark):
    rng = np.random.default_rng(2)
    r = rng.uniform(0, 1, (5, 4)) + 3 * np.eye(5, 4)
    truth, measured = r.sum(axis=0) * 1.25, r.sum(axis=1) * rng.uniform(0.5, 1.5, 5)
    frame = lambda rows, names: spark.createDataFrame([("s", *x) for x in rows], f"setting string, {names}")
    response_rows = frame([(0, i, 0, j, float(r[i, j])) for i in range(5) for j in range(4)], "meas_pt_bin int, meas_bin int, true_pt_bin int, true_bin int, sumw double")
    truth_rows = frame([(0, j, float(truth[j])) for j in range(4)], "true_pt_bin int, true_bin int, value double")
    data = lambda d: frame([(0, i, float(d[i])) for i in range(5)], "meas_pt_bin int, meas_bin int, value double")
    last = response.unfolded(response_rows, truth_rows, data(r.sum(axis=1)), 3).filter("iteration = 3").orderBy("true_bin").collect()
    assert np.allclose([x.value for x in last], truth)
    # any other spectrum: against the plain rule
    p, prior = r / truth, truth
    for _ in range(3):
        m = p * prior / (p * prior).sum(axis=1, keepdims=True) / p.sum(axis=0)
        prior, error = m.T @ measured, np.sqrt((m * m).T @ measured)
    last = response.unfolded(response_rows, truth_rows, data(measured), 3).filter("iteration = 3").orderBy("true_bin").collect()
    assert np.allclose([x.value for x in last], prior) and np.allclose([x.error for x in last], error)
    back = response.refolded(spark.createDataFrame([("s", 0, j, float(prior[j])) for j in range(4)], "setting string, true_pt_bin int, true_bin int, value double"), response_rows, truth_rows)
    assert np.allclose([x.value for x in back.orderBy("meas_bin").collect()], p @ prior)


def test_merge_order_and_types(spark):
    a = spark.createDataFrame([(1, 2.0, 3)], "bin int, sumw double, n long")
    b = spark.createDataFrame([(1, 1.0, 1), (2, 5.0, 2)], "bin int, sumw double, n long")
    one, two = (sorted(map(tuple, H.merged(x, ["bin"]).collect())) for x in ([a, b], [b, a]))
    assert one == two == [(1, 3.0, 4), (2, 5.0, 2)]
    with pytest.raises(TypeError):
        H.merged([a, b.drop("n")], ["bin"])


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.999, 1.0, 9.99, 10.0)], "x double")
    got = {r.b: r.n for r in H.histogram(df, {"b": (F.col("x"), H.Regular(10, 0, 10))}).collect()}
    assert got == {-1: 1, 0: 2, 1: 1, 9: 1, 10: 1}


def test_efficiencies(spark):
    df = spark.createDataFrame([(1.0, 0.2, 0), (5.0, -0.5, 3), (10.0, 0.6, 1)], "pt double, eta double, a int")
    c = F.col
    got = df.select(efficiency(c("pt"), c("eta"), "LHC11a").alias("x"), efficiency(c("pt"), c("eta"), "LHC11h", c("a")).alias("y"), efficiency(c("pt"), c("eta"), "LHC15o", c("a")).alias("z")).collect()
    assert all(0.4 < v < 1.0 for r in got for v in r)
    with pytest.raises(ValueError):
        efficiency(c("pt"), c("eta"), "LHC18qr", c("a"))


def test_hash_choices_repeat(spark):
    df = spark.range(10_000).withColumn("u", sampling.uniform("id", seed=4))
    again = spark.range(10_000).repartition(13).withColumn("u", sampling.uniform("id", seed=4))
    assert df.exceptAll(again).count() == 0
    assert 0.48 < df.agg(F.avg("u")).first()[0] < 0.52


def test_names_and_area():
    assert K.renamed("data_jet_pt") == "hybrid_jet_pt"
    assert K.renamed("matched_leading_track_pt") == "true_leading_track_pt"
    with pytest.raises(ValueError):
        K.area_from_percent(0.6, 0.4)
    assert P.joined_range([(1, 5), (3, 9)]) == (1, 9)


def test_binning_name(spark):
    assert spark.range(1).select(K.binning_name(F.array(F.lit(2.5), F.lit(1.0), F.lit(2.5)))).first()[0] == "1p0_2p5"


GENERATOR = "#\tEvent\t1\tweight\t0.129547\tEPangle\t0.0116446\tN_hadrons\t2\n0 211 27 1.0 0.1 0.2 0.3\n1 -211 27 2.0 0.4 0.5 0.6\n#\tEvent\t2\tweight\t0.2\tEPangle\t0.5\tN_hadrons\t2\n0 2212 27 1.5 0.1 0.2 0.3\n#\tsigmaGen\t182.423\tsigmaErr\t11.234\n"
OLD = "#\t0.0116446\tEvent1ID\t1\tpstat-EPx\tPy\tPz\tEta\tPhi\n0 211 27 1.0 0.1 0.2 0.3 0.9 0.8\n"


def test_generator_text(spark, tmp_path):
    (tmp_path / "new.dat").write_text(GENERATOR)
    (tmp_path / "old.dat").write_text(OLD)
    got = generator_text.read_generator(spark, str(tmp_path / "new.dat")).orderBy("event_id").collect()
    assert [(r.event_id, r.n_particles, len(r.particles)) for r in got] == [(1, 2, 2), (2, 2, 1)]
    assert got[0].cross_section == pytest.approx(182.423) and got[0].particles[1].particle_id == -211
    assert generator_text.miscounted(generator_text.read_generator(spark, str(tmp_path / "new.dat"))).first().event_id == 2
    old = generator_text.read_generator(spark, str(tmp_path / "old.dat")).first()
    assert (old.event_id, old.event_weight, old.n_particles, old.cross_section) == (1, None, 1, None)
    generator_text.write_events(generator_text.slim(generator_text.read_generator(spark, str(tmp_path / "new.dat"))), str(tmp_path / "out"), 1)
    assert event_tables.rows_per_file(spark, str(tmp_path / "out")).agg(F.sum("count"), F.max("count")).first()[:] == (2, 1)


def test_track_skim_layouts(spark, tmp_path):
    df = spark.createDataFrame([(7, True, [1.0, 2.0], [0.1, 0.2], [1.0, 2.0])], "run_number int, trigger_bit_INT7 boolean, particle_data_pt array<double>, particle_data_eta array<double>, particle_data_phi array<double>")
    row = event_tables.track_skim(df, "pp").first()
    assert row.run_number == 7 and row.data[1].pt == 2.0 and row.data[0].eta == 0.1
    jewel = spark.createDataFrame([([1.0], [0.5], [0.1])], "partpT array<double>, party array<double>, partphi array<double>")
    assert event_tables.renamed_lists(jewel, event_tables.JEWEL).first().part_level[0].eta == 0.5
    (tmp_path / "p.txt").write_text("# c\n1.0 0.5 2.0\n3.0 2.0 3.5\n")
    assert [tuple(r) for r in event_tables.predictions(spark, str(tmp_path / "p.txt")).collect()] == [(0, 1.0, 0.5, 1.0), (1, 3.0, 1.0, 0.5)]


def test_skim_writing_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "pt_hard_bin int, kt double")
    for _ in range(2):
        event_tables.write_skim(df, str(tmp_path / "skim"), ["pt_hard_bin"])
    event_tables.compacted(spark, [str(tmp_path / "skim")], str(tmp_path / "one"), 1)
    assert spark.read.parquet(str(tmp_path / "one")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.parquet(str(tmp_path / "in" / f"part={k}"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = running.event_stream(spark, str(tmp_path / "in"), schema)
    hist = running.folded(running.running_histogram(stream, {"b": (F.col("id"), H.Regular(3, 0, 30))}), str(tmp_path / "totals"), str(tmp_path / "check"))
    assert sorted((r.b, r.n) for r in hist.collect()) == [(0, 10), (1, 10), (2, 10)]
    running.ingest(running.event_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def _unfolding_problem(spark):
    rng = np.random.default_rng(7)
    r = rng.uniform(0, 1, (6, 4)) + 4 * np.eye(6, 4)
    r[r < 0.2] = 0
    truth, measured = r.sum(axis=0) * 1.3, r.sum(axis=1) * rng.uniform(0.6, 1.4, 6)
    frame = lambda rows, names: spark.createDataFrame([("s", *x) for x in rows], f"setting string, {names}")
    cells = frame([(i % 3, i // 3, j % 2, j // 2, float(r[i, j])) for i in range(6) for j in range(4) if r[i, j]], "meas_pt_bin int, meas_bin int, true_pt_bin int, true_bin int, sumw double")
    generated = frame([(j % 2, j // 2, float(truth[j])) for j in range(4)], "true_pt_bin int, true_bin int, value double")
    data = frame([(i % 3, i // 3, float(measured[i]), float(2 * measured[i])) for i in range(6)], "meas_pt_bin int, meas_bin int, value double, variance double")
    return r / truth, truth, measured, (cells, generated, data)


def test_covariance_of_the_unfolding_is_that_of_its_derivatives(spark):
    p, truth, measured, tables = _unfolding_problem(spark)

    def spectrum(d, n=5):
        prior = truth
        for _ in range(n):
            prior = (p * prior / (p * prior).sum(axis=1, keepdims=True) / p.sum(axis=0)).T @ d
        return prior

    step = 1e-5
    derivative = np.array([(spectrum(measured + step * e) - spectrum(measured - step * e)) / (2 * step) for e in np.eye(6)]).T
    want = derivative * (2 * measured) @ derivative.T
    got = np.zeros((4, 4))
    covariance = response.unfolding_covariance(*tables, iterations=5)
    for x in covariance.collect():
        got[x.pt_i + 2 * x.bin_i, x.pt_j + 2 * x.bin_j] = x.value
    assert np.allclose(got, want, rtol=1e-6)
    blocks = {(x.block, x["at"], x.i, x.j): x.value for x in response.correlation_blocks(covariance).collect()}
    assert len(blocks) == 16 and blocks["pt", 1, 0, 1] == pytest.approx(want[1, 3] / np.sqrt(want[1, 1] * want[3, 3])) and blocks["variable", 1, 0, 1] == pytest.approx(want[2, 3] / np.sqrt(want[2, 2] * want[3, 3]))


def test_unfolding_survives_many_iterations_and_empty_bins(spark):
    _, _, _, (cells, generated, data) = _unfolding_problem(spark)
    more = generated.unionByName(spark.createDataFrame([("s", 9, 9, 5.0)], generated.schema))  # a true bin that nothing measures
    out = response.unfolded(cells, more, data, iterations=12)
    assert out.count() == 12 * 5 and [tuple(x) for x in out.filter("true_bin = 9").select("value", "error").distinct().collect()] == [(0.0, 0.0)]
    assert response.unfolded(cells.limit(0), generated, data, iterations=2).filter("value <> 0").count() == 0


def test_iteration_errors_by_loops(spark):
    rng = np.random.default_rng(4)
    v, e, o = (rng.uniform(1, 2, (7, 3)) for _ in range(3))
    v[3, 1] = 0
    frame = lambda x: spark.createDataFrame([(k + 1, b, float(x[k, b]), float(e[k, b])) for k in range(7) for b in range(3)], "iteration int, bin int, value double, error double")
    got = {r.iteration: r for r in response.iteration_errors(frame(v), ["bin"], frame(o), F.col("bin") == 0).collect()}
    assert sorted(got) == [2, 3, 4, 5]
    for k, r in got.items():
        cur, over = v[k - 1], np.where(v[k - 1] != 0, 1 / np.where(v[k - 1] != 0, v[k - 1], 1), 0)
        reg, stat, prior = (np.maximum(abs(v[k - 2] - cur), abs(v[k + 1] - cur)) * over).sum(), (e[k - 1] * over)[1:].sum(), (abs(cur - o[k - 1]) * over).sum()
        assert (r.regularization, r.statistical, r.prior, r.total) == pytest.approx((reg, stat, prior, np.sqrt(reg**2 + stat**2 + prior**2)))
    assert response.best_iteration(response.iteration_errors(frame(v), ["bin"])).first().iteration in got


def test_fixed_sources_must_agree(spark):
    a, b = spark.range(12).withColumnRenamed("id", "event_id"), spark.range(5).withColumnRenamed("id", "event_id")
    assert matching.embedding_pairs(a, a, repeat=False).filter("background <> signal").count() == 0
    assert matching.embedding_pairs(b, a).count() == 12
    with pytest.raises(ValueError, match="12 background"):
        matching.embedding_pairs(b, a, repeat=False)


def test_thermal_embedding_finds_the_signal(spark):
    rng = np.random.default_rng(6)
    rows = [(e, i, float(pt), float(0.1 * rng.normal()), float(1 + 0.1 * rng.normal())) for e in range(3) for i, pt in enumerate((25.0, 12.0, 8.0, 5.0))]
    tracks = spark.createDataFrame(rows, "event_id long, idx int, pt double, eta double, phi double")
    out = drivers.analyze_thermal_embedding(tracks, tracks, 150, 5, pt_min=20.0).collect()
    assert sorted(r.event_id for r in out) == [0, 1, 2] and all(abs(r.hybrid_jet_pt - r.true_jet_pt) < 15 and r.det_level_jet_pt == pytest.approx(r.true_jet_pt) for r in out)
