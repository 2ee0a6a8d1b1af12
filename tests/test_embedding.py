"""Matching by cells and the embedding skim, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from coneflow.operators import embedding, matching


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    g = [(j, i, float(rng.uniform(1, 5)), float(x), float(y)) for j in range(3) for i, (x, y) in enumerate(np.round(rng.uniform(-0.06, 0.06, (80, 2)), 2))]
    m = [(j, float(x), float(y)) for j in range(3) for x, y in np.round(rng.uniform(-0.06, 0.06, (60, 2)), 2)]
    return g, m


def test_near_pairs_are_all_pairs(spark, cloud):
    """Coordinates on multiples of the distance lie on edges of cells."""
    g, m = cloud
    gen = spark.createDataFrame([*g, (0, 999, 1.0, None, 0.0)], "jet_id int, id int, pt double, eta double, phi double")
    mea = spark.createDataFrame([*m, (0, float("nan"), 0.0)], "jet_id int, eta double, phi double").withColumn("number", F.monotonically_increasing_id())
    got = matching.near_pairs(gen, mea, "jet_id", 0.01)
    want = sorted((a[0], a[1], b[1], b[2]) for a in g for b in m if a[0] == b[0] and abs(a[3] - b[1]) <= 0.01 and abs(a[4] - b[2]) <= 0.01)
    by_number = {r.number: (r.eta, r.phi) for r in mea.collect()}
    assert sorted((r.jet_id, r.id, *by_number[r.number]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__i" in plan.split("Join", 1)[1].split("\n", 1)[0], "joined on cells"


def test_found_in_jet(spark, cloud):
    g, m = cloud
    gen = spark.createDataFrame([(j, "leading" if i % 2 else "subleading", i, pt, eta, phi) for j, i, pt, eta, phi in g if j], "jet_id int, prong string, id int, pt double, eta double, phi double")
    mea = spark.createDataFrame([(j, k % 50, eta, phi) for k, (j, eta, phi) in enumerate(m)], "jet_id int, id int, eta double, phi double")
    jets = spark.range(4).select(F.col("id").cast("int").alias("jet_id"))
    for near in (None, 0.01):
        out = {r.jet_id: r for r in matching.found_in_jet(gen, mea, jets, near=near).collect()}
        assert set(out) == {0, 1, 2, 3} and out[0].leading == out[3].subleading == 0.0
        for j in (1, 2):
            for prong, odd in (("leading", 1), ("subleading", 0)):
                own = [x for x in g if x[0] == j and x[1] % 2 == odd]
                if near is None:
                    ids = {k % 50 for k, x in enumerate(m) if x[0] == j}
                    hit = [x[2] for x in own if x[1] in ids]
                else:
                    hit = [x[2] for x in own if any(y[0] == j and abs(x[3] - y[1]) <= near and abs(x[4] - y[2]) <= near for y in m)]
                whole = abs(sum(x[2] * np.exp(1j * x[4]) for x in own))
                assert out[j][prong] == pytest.approx(sum(hit) / whole, rel=1e-6)


def test_ten_classes(spark):
    codes = spark.createDataFrame([(a, b) for a in (-1, 0, 1, 2, 3) for b in (-1, 0, 1, 2, 3)], "a int, b int")
    eight, ten = (codes.select(matching.matching_class(F.col("a"), F.col("b"), mixes=m).alias("c")).filter("c is not null") for m in (False, True))
    assert eight.distinct().count() == 8 and ten.distinct().count() == 9 and eight.count() == ten.count() == 9
    assert ten.filter("c = 'other'").count() == 0


def test_skim_of_jets_without_levels_or_splittings(spark):
    level = "struct<splittings: array<struct<idx: int, parent: int, kt: double, delta_r: double, z: double>>, subjets: array<struct<parent_splitting_index: int, constituents: array<struct<id: int, pt: double, phi: double>>>>, constituents: array<struct<id: int, pt: double, phi: double>>>"
    c = [(k, float(5 - k), 0.1 * k) for k in range(4)]
    full = ([(0, -1, 3.0, 0.3, 0.4), (1, 0, 1.0, 0.1, 0.1)], [(0, c[:1]), (0, c[1:]), (1, c[1:2]), (1, c[2:])], c)
    swapped = ([(0, -1, 3.0, 0.3, 0.4)], [(0, [(0, 1.0, 0.0)]), (0, [(1, 9.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 0.0)])], c[:3])
    rows = [(1, full, full, full), (2, full, None, full), (3, None, full, None), (4, ([], [], []), full, full), (5, swapped, full, full)]
    jets = spark.createDataFrame(rows, f"jet_id int, hybrid {level}, det_level {level}, true {level}")
    out = {r.jet_id: r for r in embedding.embedding_skim(jets, ["leading_kt"]).collect()}
    codes = {k: (r.hybrid_det_level_matching_leading, r.hybrid_det_level_matching_subleading, r.det_level_true_matching_leading, r.det_level_true_matching_subleading) for k, r in out.items()}
    assert codes == {1: (1, 1, 1, 1), 2: (0, 0, -1, -1), 3: (-1, -1, 0, 0), 4: (-1, -1, 1, 1), 5: (1, 1, 1, 1)}
    shares = {k: (r.det_level_leading_subjet_momentum_fraction_in_hybrid_jet, r.det_level_subleading_subjet_momentum_fraction_in_hybrid_jet) for k, r in out.items()}
    lead = abs(sum(p * np.exp(1j * f) for _, p, f in c[1:]))
    assert shares[1] == pytest.approx((sum(p for _, p, _ in c[1:]) / lead, 1.0)) and shares[2] == shares[3] == shares[4] == (0.0, 0.0)
    assert shares[5] == pytest.approx(((c[1][1] + c[2][1]) / lead, 1.0))
    assert (out[1].hybrid_kt, out[1].hybrid_n_to_split, out[4].hybrid_kt, out[4].hybrid_n_to_split, out[2].det_level_n_passed) == (3.0, 1, -0.005, 0, 0)
    plan = embedding.embedding_skim(jets, ["leading_kt"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
