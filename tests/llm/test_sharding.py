"""Operator 13 against dynamic programming over all groups, with hot groups and few ones, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from coneflow.llm import sharding
from coneflow.llm.common import shared_folder


def group_key(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)


def plain_cuts(sizes, shards):
    """Least capacity by dynamic programming over all edges, then each cut nearest to an even share, within what the capacity allows."""
    edges = [0]
    for s in sizes:
        edges.append(edges[-1] + s)
    best = edges[:]
    for _ in range(shards - 1):
        best = [min(max(best[i], e - edges[i]) for i in range(j + 1)) for j, e in enumerate(edges)]
    cap, total = best[-1], edges[-1]
    latest = [total]
    for _ in range(shards - 1):
        latest.append(next(e for e in edges if e >= latest[-1] - cap))
    cuts, at = [], 0
    for k in range(shards - 1):
        left = shards - k
        near = min(edges, key=lambda e: (abs(e * left - (at * left + total - at)), e))  # noqa: B023
        at = max(min(near, max(e for e in edges if e <= at + cap)), latest[shards - 1 - k], at)  # noqa: B023
        cuts.append(at)
    return cap, cuts


def plain(rows, shards):
    groups = collections.Counter()
    for _, text in rows:
        groups[group_key(text)] += len((text or "").encode()) + 1
    keys = sorted(groups)
    cap, cuts = plain_cuts([groups[k] for k in keys], shards)
    upto, of = 0, {}
    for k in keys:
        of[k] = sum(upto >= c for c in cuts)
        upto += groups[k]
    out, slots = [], collections.Counter()
    for d, text in sorted(rows, key=lambda r: (group_key(r[1]), r[0] is not None, r[0] or 0)):
        b, s = (text or "").encode(), of[group_key(text)]
        out.append((d, len(b) + 1, zlib.crc32(b), "bytes", s, slots[s], None))
        slots[s] += 1
    return cap, sorted(out, key=str)


def texts(kind, rng):
    if kind == "plain":
        return ["w" * rng.randint(0, 900) for _ in range(700)]
    if kind == "hot":  # one group holds over a third of all bytes
        return ["hot " * 60] * 400 + [f"{k} " * rng.randint(1, 60) for k in range(500)]
    return ["a", "b" * 30, "b" * 30, "c" * 5000]  # fewer groups than shards


@pytest.mark.parametrize("kind,shards", [("plain", 8), ("hot", 8), ("few", 8), ("plain", 1), ("hot", 3)])
def test_against_dynamic_programming(spark, kind, shards):
    rows = list(enumerate(texts(kind, random.Random(5))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.shard(docs, shards)
    cap, want = plain(rows, shards)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == want
    held = collections.Counter()
    for r in got:
        held[r[4]] += r[1]
    assert max(held.values()) <= cap
    assert "Python" not in (plan := out._jdf.queryExecution().toString()) and "Arrow" not in plan


def test_the_search_refines_few_buckets(spark):
    rows = spark.range(300_000).select(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("long").alias("key"), (F.col("id") % 4000 + 1).alias("size"))
    order = sharding.Order(rows)
    seen = len(order.buckets)
    cuts = sharding.cut_keys(rows, 8)
    sizes = [r.n for r in rows.groupBy(sum(((F.col("key") >= c).cast("int") for c in cuts), F.lit(0)).alias("s")).agg(F.sum("size").alias("n")).collect()]
    assert seen <= 4096 and max(sizes) - min(sizes) <= 2 * 4000


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "no id"), (None, "no id"), (5, "x" * 70_000), (6, "word " * 30_000), (7, "ünïcode \x1c\x85 ½ 日本")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("size", "key", "shard", "slot", "law", "kept", "place", "number", "low", "n", "part")})
    assert sorted(map(tuple, sharding.shard(docs).collect()), key=str) == plain(rows, 8)[1]
    assert sharding.shard(docs.limit(0)).count() == 0
    carried = sharding.shard(docs, carry=docs.columns)
    assert carried.columns == ["doc_id", "text", "key", "kept", "place", "number", "low", "n", "part", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and carried.count() == 9


def test_written_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = sharding.write(docs, f"{shared_folder(spark)}/out")
    assert sorted(map(tuple, back.select("doc_id", "text").collect()), key=str) == sorted(map(tuple, docs.select("doc_id", "text").collect()), key=str)
    assert back.select("shard").distinct().count() == 8
