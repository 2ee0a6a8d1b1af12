"""Buckets, costs, chunks of a size, skim records and totals of streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from coneflow.cluster import new_folder
from coneflow.sources import event_tables, layout, skim_records
from coneflow.streaming import running


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_tables_join_and_nest_without_exchange(spark, no_broadcast):
    tracks = spark.range(600).select((F.col("id") % 7).cast("int").alias("run_number"), (F.col("id") % 50).alias("event_id"), F.col("id").alias("idx"), (F.col("id") / 3).alias("pt"))
    tables = {"det": tracks.filter("idx % 4 <> 0"), "part": tracks, "events": tracks.select("run_number", "event_id").distinct()}
    t = layout.joined_copies(spark, tables, 5)
    tree = event_tables.event_tree(t["events"], t["det"], t["part"])
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 4, plan
    plain = event_tables.event_tree(tables["events"], tables["det"], tables["part"])
    assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, tree.collect())) == sorted(map(str, plain.collect()))


def test_events_by_cost(spark):
    """One run of central events holds most of the cost; no partition gets more than its share and one event."""
    sizes = [40] * 30 + [2] * 400
    rows = [(e, i, float(i)) for e, n in enumerate(sizes) for i in range(n)]
    tracks = spark.createDataFrame(rows, "event_id long, idx int, pt double").repartition(6)
    out = layout.nested_by_cost(tracks, 8)
    held = out.withColumn("p", F.spark_partition_id()).select("p", "event_id", F.size("particles").alias("n"), F.col("particles.idx").alias("idx")).collect()
    assert sorted(r.event_id for r in held) == list(range(430)) and all(r.idx == list(range(sizes[r.event_id])) for r in held)
    cost = np.zeros(8)
    for r in held:
        cost[r.p] += r.n**2
    assert out.rdd.getNumPartitions() == 8 and cost.max() <= sum(n * n for n in sizes) / 8 + 40**2 and cost.min() > 0
    assert layout.nested_by_cost(tracks.limit(0), 4).count() == 0


def test_event_just_below_a_cut(spark):
    costs = spark.createDataFrame([(0, 9_999_999), (1, 1), (2, 10_000_000)], "event_id long, cost long")
    assert {r.event_id: r.slot for r in layout.cost_slots(costs, ["event_id"], 2).collect()} == {0: 0, 1: 0, 2: 1}


def test_running_cost_is_exact(spark):
    rows = spark.range(3000, numPartitions=5).select(F.col("id"), (F.col("id") * 37 % 101).alias("c"))
    got = {r.id: (r.before, r.cost) for r in layout.running_cost(rows, ["id"], F.col("c")).collect()}
    total = 0
    for k in range(3000):
        assert got[k] == (total, k * 37 % 101)
        total += k * 37 % 101


def test_rechunked(spark):
    small, large, broken, empty, whole = (new_folder(spark) for _ in range(5))
    rows = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    rows.filter("id < 4000").repartition(9).write.parquet(small)
    rows.filter("id >= 4000").coalesce(1).write.parquet(large)
    rows.limit(0).coalesce(1).write.parquet(empty)
    rows.limit(2).select("text").coalesce(1).write.text(broken)
    found = layout.rechunked(spark, [small, large, broken, empty], whole, 100_000, rows.schema)
    by = {(r.bytes, r.n_rows) for r in found.collect()}
    total = sum(b for b, n in by if n)
    files = [r.bytes for r in layout.file_sizes(spark, [whole]).collect()]
    assert sum(n or 0 for _, n in by) == 20_000 and any(n is None for _, n in by)
    assert len(files) == -(-total // 100_000) and max(files) <= 150_000
    assert sorted(map(tuple, spark.read.parquet(whole).collect())) == sorted(map(tuple, rows.collect()))


def test_skim_records_round_trip(spark):
    schema = "jet_id int, hybrid struct<jet_pt: double, jet_splittings: array<struct<kt: double, parent: int>>, subjets: array<struct<iterative: boolean, constituent_indices: array<int>>>, more: struct<a: float, b: string>>"
    rows = [(1, (2.5, [(1.0, -1), (2.0, 0)], [(True, [1, 2]), (False, [])], (0.5, "x"))), (2, None), (3, (None, [], [], (None, "y"))), (4, (1.0, None, None, None))]
    df = spark.createDataFrame(rows, schema)
    flat = skim_records.flattened(df)
    assert flat.columns == ["jet_id", "hybrid_jet_pt", "hybrid_jet_splittings_kt", "hybrid_jet_splittings_parent", "hybrid_subjets_iterative", "hybrid_subjets_constituent_indices", "hybrid_more_a", "hybrid_more_b"]
    got = {r.jet_id: r for r in flat.collect()}
    assert got[2].hybrid_jet_pt == got[3].hybrid_jet_pt == got[4].hybrid_more_a == -9999.0 and got[1].hybrid_jet_splittings_kt == [1.0, 2.0]
    assert sorted(skim_records.nested_again(flat, df.schema).collect(), key=lambda r: r.jet_id) == sorted(df.collect(), key=lambda r: r.jet_id)
    assert dict(skim_records.flattened(df, {"kt": "float", "jet_pt": "float"}).dtypes)["hybrid_jet_splittings_kt"] == "array<float>"
    with pytest.raises(ValueError):
        skim_records.flattened(spark.createDataFrame([((1,), 2)], "a struct<b: int>, a_b int"))


def test_totals_of_a_stream_are_never_half_written(spark):
    folder = new_folder(spark)
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = running.event_stream(spark, f"{folder}/in", spark.range(1).schema).groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("n"))
    out = running.folded(stream, f"{folder}/totals", f"{folder}/checkpoint")
    assert {r.k: r.n for r in out.collect()} == {0: 14, 1: 13, 2: 13}
    spark.range(5).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("n")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/totals/batch={9:012d}")  # a writer that broke off
    assert {r.k: r.n for r in running.latest(spark, f"{folder}/totals", out.schema).collect()} == {0: 14, 1: 13, 2: 13}
    assert running.latest(spark, f"{folder}/nothing", out.schema).count() == 0
