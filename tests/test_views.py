"""Views that Spark makes by other means than their text, and how often their rows travel."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coneflow.operators import grooming, matching
from coneflow.plans import QUERIES, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tracks", "splittings"])
def test_rows_of_the_text(spark, name):
    made = views.view(spark, SF, name)
    views.table(spark, SF, "lineitem").createOrReplaceTempView("lineitem")
    text = spark.sql(views.with_views(f"SELECT * FROM {name}", name))
    assert made.columns == text.columns and made.count() == text.count()
    assert made.exceptAll(text).count() == 0


def test_splittings_travel_once(spark):
    """Levels are made after the one shuffle by jet, and nesting by jet and level needs no other."""
    rows = grooming.nested(views.view(spark, SF, "splittings"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    events = views.view(spark, SF, "tracks").groupBy("event_id").agg(F.collect_list("idx"))
    assert events._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("parent", "levels"), [("parent_index", (0, 1, 2)), ("parent_index_tree", (0, 1, 2)), ("parent_index", (0,))])
def test_splittings_nested_where_they_are_sorted(spark, parent, levels):
    got = views.nested_splittings(spark, SF, parent, levels)
    plain = grooming.nested(views.view(spark, SF, "splittings").filter(F.col("lvl").isin(*levels)), parent=parent)
    assert got.dtypes == plain.dtypes and got.count() == plain.count()
    assert got.exceptAll(plain).count() == 0


@pytest.mark.parametrize("name", ["j13_gathered", "g02_dynamical_kt", "g03_leading_kt", "g04_soft_drop_02", "g05_iterative_chain"])
def test_rows_of_levels_are_not_sorted(spark, name):
    """Only lineitem's own keys are shuffled and sorted; the rows of three levels with their values are not."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert "HashAggregate" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["g02_dynamical_core", "g02_dynamical_time", "g02_dynamical_z", "g03_leading_kt_z_cut_02", "g03_leading_kt_z_cut_04", "g04_g06_g08_soft_drop_04"])
def test_other_groomings_sort_keys_only(spark, name):
    """The same of the other queries of the step: one exchange and one sort, of three numbers a row."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan


def test_prong_flags_travel_once(spark):
    """Flags from rows of both levels together are those of joined subjets, ties and lone parts included, and shuffle lineitem once."""
    rows = [(j, m, (i * j + m) % 2 if j % 5 else j % 2, i, 1.0 + (i * 7 + j) % 5, 0.0 if j % 7 == 0 else 0.1 * i * (m + 1)) for j in range(200) for m in (0, 1) for i in range(m * (j % 3), 1 + (j + 3 * m) % 9)]
    both = spark.createDataFrame(rows, "jet_id long, m int, part int, id int, pt double, phi double")
    sides = [both.filter(F.col("m") == m).drop("m") for m in (0, 1)]
    joined = matching.prong_flags(matching.contained(*map(matching.by_vector_sum, sides)))
    got = matching.prong_flags_in_one(both.select("jet_id", (F.col("m") == 1).alias("measured"), "part", "id", "pt", "phi"))
    assert got.columns == joined.columns and 50 < got.count() == joined.count() and got.exceptAll(joined).count() == 0
    plan = QUERIES["j17_prong_flags"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["tracks", "splittings"])
def test_only_needed_columns_travel(spark, name):
    """The order of a view's rows needs no column that its values don't."""
    plan = views.view(spark, SF, name)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any(c in plan for c in ("l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag"))


def test_near_pairs_on_edges_of_cells(spark):
    """All pairs at any place of a cell, and a row is sent to four cells at most, to far fewer than two on average of many."""
    spots = [k * 0.0025 - 0.1 for k in range(81)]
    g = spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate(spots)], "jet_id long, id int, eta double, phi double")
    m = spark.createDataFrame([(1, float(x), float(y)) for x in spots for y in (-0.011, -0.01, -0.0, 0.01, 0.0100001)], "jet_id long, eta double, phi double")
    got = matching.near_pairs(g, m, "jet_id", 0.01)
    near = lambda a, b: abs(a - b) <= 0.01
    assert got.count() == sum(near(x, a) and near(0.0, b) for x in spots for a in spots for b in (-0.011, -0.01, -0.0, 0.01, 0.0100001))
    cells = matching.cells_in_reach(spark.range(10_000).select(F.rand(1).alias("eta"), F.rand(2).alias("phi")), 0.01)
    assert cells.count() < 2.5 * 10_000
