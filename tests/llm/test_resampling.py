"""Operator 12 against plain loops, with several run lengths, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from coneflow.llm import queries, resampling
from coneflow.llm.common import numbered, shared_folder

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain(docs, target, least=1, most=1, buckets=10_000, seed=2024, least_words=20, percent=10):
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def found(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(least, most + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(b for _, x in docs for b in found(x)), collections.Counter(b for x in target for b in found(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)}
    rows = []
    for d, text in docs:
        f = found(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[3], -r[2]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("kind", [{}, {"least": 1, "most": 3, "buckets": 700, "percent": 37}, {"least": 2, "most": 2, "percent": 100, "least_words": 0}])
def test_against_loops(spark, kind):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet").repartition(5), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted(map(tuple, resampling.resample(docs, target, **kind).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], **kind)


def test_odd_rows(spark):
    rows = [(1, "One two-three ÄÖ1 ½ \x7f", 1), (1, "One two-three ÄÖ1 ½ \x7f", 1), (1, "other words", 1), (2, None, 1), (3, "", 1), (4, " \t-- ", 1), (None, "no id", 1), (5, "Q" * 150_000, 1), (6, "two words. " * 30_000, 1), (7, "\U0001f600 日本\x85ñ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit("extra") for c in ("n_words", "buckets", "score", "weight", "rank", "n", "bucket", "place", "number")})
    target = spark.createDataFrame([("TWO words",), (None,)], "text string")
    for few, texts in ((target, ["TWO words", None]), (target.limit(0), [])):
        got = resampling.resample(docs, few, least_words=1, percent=70).collect()
        assert sorted(map(tuple, got), key=str) == plain([r[:2] for r in rows], texts, least_words=1, percent=70)
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_offsets_are_those_of_the_text(spark):
    text = "Ünï CODE, a1  b\x80c " * 9000  # longer than one piece
    row = resampling.featurized(spark.createDataFrame([(text,)], "text string"), [], 1, 2, 10_000, with_offsets=True).first()
    assert row.n_words == 36_000 and len(row.buckets) == 71_999
    for k in (0, 17_000, 35_999, 36_000, 71_998):
        run = re.sub("[^0-9A-Za-z\x80-\U0010ffff]+", " ", text[row.starts[k] : row.ends[k]])
        run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
        assert zlib.crc32(run.encode()) % 10_000 == row.buckets[k]


def test_numbers_go_on_over_partitions(spark):
    rows = spark.range(5000, numPartitions=7).withColumn("of", F.pmod(F.col("id"), F.lit(3)))
    got = numbered(rows, [F.col("of"), F.desc("id")], shared_folder(spark), "rows", within="of").collect()
    for of in range(3):
        ids = [r.id for r in sorted((r for r in got if r.of == of), key=lambda r: r.number)]
        assert ids == sorted(ids, reverse=True) and sorted(r.number for r in got if r.of == of) == list(range(len(ids)))
    whole = numbered(rows, [F.col("id")], shared_folder(spark), "rows").collect()
    assert all(r.id == r.number for r in whole)


def test_query_has_the_contract_columns(spark):
    out = queries.op12_resampling(spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
