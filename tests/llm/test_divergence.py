"""Operator 11 against plain loops, with spills and blocks forced, and on odd rows."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coneflow.llm import divergence

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, least, most):
    docs = [(r.lang or "", r.source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))) for r in rows]
    df, n, out = collections.Counter(), collections.Counter(), []
    for lang, source, terms in docs:
        df.update({(lang, t) for t in terms})
        n.update((lang, source, t) for t in terms)
    for lang in {d[0] for d in docs}:
        kept = [t for (of, t), c in df.items() if of == lang and c >= least]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        count = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < most]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"cells": 40, "at_once": 16, "numbers": 12}])
def test_against_loops(spark, bounds):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    got = sorted(map(tuple, divergence.divergences(docs, least=8, most=7, **bounds).collect()))
    assert got == plain(docs.collect(), 8, 7) and any(r[2] == "term" for r in got)


def test_odd_rows(spark):
    rows = [
        (1, "Same same OTHER é1É ½", "en", "a", 1), (1, "Same same OTHER é1É ½", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "same 12 \x7f-_", "en", None, 1),
        (None, "tie tie same", "en", "c", 1), (5, "x" * 300_000, "en", "b", 1), (6, "same other " * 40_000, "en", "b", 1), (7, "日本 日本\x85日本 \U0001f600", "ja", "\U0001f600", 1), (8, "日本", "ja", "～", 1), (9, "日本", "ja", "z", 1), (10, "alone", "", "", 1),
    ]
    docs = spark.createDataFrame(rows, DOC)
    clash = docs.withColumns({c: F.lit("extra") for c in ("term", "df", "sources", "counts", "part", "item", "value", "rank", "kept", "shard", "place")})
    for least in (1, 2, 100):
        assert sorted(map(tuple, divergence.divergences(clash, least=least).collect())) == plain(docs.collect(), least, 50)
    assert divergence.divergences(docs.limit(0)).count() == 0



def test_shares_are_exact():
    counts, total = np.array([0, 1, 8 * 10**14, 9 * 10**14 - 5]), np.array([9 * 10**14] * 4)
    assert divergence.shares(counts, total, 5, 9).tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts.tolist(), total.tolist(), strict=True)]
