"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its odd cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import tracemalloc
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from coneflow.llm import bpe, chosen_path, cross_polytope, gru, lm_scoring, mixing, quality, queries, suffix_dedup, suffix_sort, toxicity, va_file, warc
from coneflow.llm.components import components
from coneflow.llm.common import shared_folder

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and wordless texts, a long one, repeated rows, and columns whose names clash."""
    rows = [
        (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0),
        (4, " \t\n ", "en", None, 4), (None, "no id here", "en", "t", 10), (5, "x" * 70_000, "en", "t", 70_000), (6, "word " * 30_000, "en", "t", 150_000), (7, "ünïcode <|endoftext|> ß\x1c\x85\xa0 ½ 日本", "de", "t", 20),
    ]
    df = spark.createDataFrame(rows, DOC)
    clash = ["size", "hash", "kept", "score", "copies", "id", "mark", "ids", "held_out", "rep", "component_id", "row", "y", "predicted"]
    return df.withColumns({c: F.lit("extra") for c in clash})


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    assert mixing.mix(none).count() == 0
    assert bpe.encode(none, queries.vocabulary_path()).count() == 0
    assert chosen_path.near_duplicates(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0
    assert toxicity.score(none, no_labels).count() == 0
    assert quality.score(none, no_labels).count() == 0
    assert lm_scoring.score(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cross_polytope.search(vectors).count() == 0 and va_file.top_k(vectors).count() == 0
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_odd_rows(odd, labels):
    n = odd.count()
    no_labels = labels.limit(0)
    for out in (mixing.mix(odd), bpe.encode(odd, queries.vocabulary_path(), with_ids=True), chosen_path.near_duplicates(odd), suffix_dedup.dedup(odd, with_text=True), toxicity.score(odd, no_labels), quality.score(odd, no_labels), lm_scoring.score(odd)):
        assert out.count() == n
    got = {r.doc_id: r for r in chosen_path.near_duplicates(odd).collect()}
    assert got[3].n_shingles == 0 and got[3].component_id == 3 and got[1].component_id == 1 and got[None].component_id is None
    cut = {r.doc_id: r for r in suffix_dedup.dedup(odd).collect()}
    assert cut[5].n_removed == 70_000 and cut[5].n_spans == 1 and cut[2].n_bytes == 0 and cut[1].n_removed == 0


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest and target[s] <= 2 * size[s] + 1e-6 for s in size)


def test_mixing_is_nested(docs):
    small = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.4).collect()}
    large = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.9).collect()}
    assert all(large[d] >= c for d, c in small.items())


def test_a_worker_keeps_what_one_call_needs():
    """Words met by the classifier go when the encoder comes, and the codec when the classifier comes again."""
    from coneflow.llm import common

    vocabulary = lambda: bpe.load_vocabulary(queries.vocabulary_path())
    seen = common.worker_keeps("classifier", dict)
    assert common.worker_keeps("classifier", dict) is seen
    bpe._codec("encoder", vocabulary)
    assert list(common._kept) == ["encoder"]
    common.worker_keeps("classifier again", dict)
    assert list(common._kept) == ["classifier again"] == list(bpe._codecs)
    common.given_back()
    assert not common._kept


def test_a_worker_gives_back_what_it_does_not_keep(monkeypatch):
    """What an earlier stage left goes even if that stage kept nothing."""
    from coneflow.llm import common

    common.given_back()
    freed = []
    monkeypatch.setattr(common.gc, "collect", lambda: freed.append("now"))
    common.worker_keeps("codec", dict)
    common.worker_keeps("codec", dict)
    assert freed == ["now"]
    common._kept.clear()


def test_a_worker_keeps_one_codec():
    vocabulary = lambda: bpe.load_vocabulary(queries.vocabulary_path())
    first = bpe._codec("a", vocabulary)
    assert bpe._codec("a", vocabulary) is first and bpe._codec("b", vocabulary) is not first
    assert list(bpe._codecs) == ["b"]


def test_bpe_against_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = collections.defaultdict(list)
    for r in bpe.encode(both, queries.vocabulary_path(), with_ids=True).collect():
        got[r.doc_id].append((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded))
    want = collections.defaultdict(list)
    for r in both.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id].append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_warc_round_trip(spark):
    same = "<p>" + "ä" * 120 + "</p>"
    rows = [(5, "http://a/ 20240101000000 {", same), (3, "http://b\r\nX: y", same), (9, None, same), (4, "u", None), (6, "v", "short"), (7, "w", "short"), (None, "z", same), (8, "r", "HTTP\r\n\r\nbody\r\n\r\n"), (3, "http://b", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(0)).repartition(3)
    manifest = warc.write(df, shared_folder(spark))
    got = sorted((tuple(r) for r in warc.read(manifest).collect()), key=str)
    want = []
    for page, _, html in rows:
        b = (html or "").encode()
        first = 3 if html == same else page
        want.append((page, len(b), hashlib.sha256(b).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    assert got == sorted(want, key=str)
    payloads = {r.page_id: r.payload for r in warc.read(manifest, with_payload=True).collect()}
    assert bytes(payloads[8]) == b"HTTP\r\n\r\nbody\r\n\r\n" and bytes(payloads[4]) == b""
    package = manifest.first().package
    with zipfile.ZipFile(package.removeprefix("file:")) as z:  # another reader finds the same members
        assert set(z.namelist()) == {warc.DATA, warc.INDEX} and z.testzip() is None


def test_zip64_directory(tmp_path):
    """A package whose directory entry and end record only fit the wide forms."""
    data, index = b"x" * 50, b"y 20240101000000 {\"offset\": 0, \"length\": 50}\n"
    out, entries = b"", b""
    for name, content in ((warc.DATA.encode(), data), (warc.INDEX.encode(), index)):
        at = len(out)
        wide = struct.pack("<HHQQ", 1, 16, len(content), len(content))
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(content), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide)) + name + wide + content
        wide = struct.pack("<HHQQQ", 1, 24, len(content), len(content), at)
        entries += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(content), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    place = len(out)
    out += entries
    end = len(out)
    out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 2, 2, len(entries), place) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
    out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "p.zip").write_bytes(out)
    package = warc.Package(str(tmp_path / "p.zip"))
    at, n = package.members[warc.DATA]
    assert package.range(at, n) == data and package.index() == [(0, 50)]


def _near_rows():
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    draw = lambda n: [random.choice(vocabulary) for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        return words

    base, passage, texts = draw(150), draw(60), []
    texts += [" ".join(edited(base, random.randrange(0, 9))) for _ in range(150)]
    texts += [" ".join(draw(60) + passage + draw(40)) for _ in range(80)]
    for _ in range(20):
        own = draw(random.randrange(3, 300))
        texts += [" ".join(edited(own, random.randrange(0, 3))) for _ in range(random.randrange(1, 6))]
    return [*enumerate(texts), (900, None), (901, ""), (902, "A"), (903, "a")]


def _near_truth(rows, words=5, percent=85):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("small", "pairwise", "block", "levels"), [(4096, 64, 192, 4), (16, 8, 40, 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, small, pairwise, block, levels):
    for name, value in (("SMALL", small), ("PAIRWISE", pairwise), ("BLOCK", block), ("LEVELS", levels), ("BROADCAST_ROWS", small)):
        monkeypatch.setattr(chosen_path, name, value)
    rows = _near_rows()
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _near_truth(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_twins_in_large_nodes_stay_together(spark, monkeypatch):
    """Families of texts that are half alike fill large nodes down to the last level; within them only twins are linked, at 0.85 to 0.9."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    hot = []
    real = chosen_path.joined
    monkeypatch.setattr(chosen_path, "joined", lambda rows, side, keys, copies: hot.append(keys) or real(rows, side, keys, copies))
    rng, rows = random.Random(17), []
    for family in range(25):
        base = [f"f{family}w{k}" for k in range(240)]
        for twin in range(8):
            own = [*base[:170], *[f"f{family}t{twin}x{k}" for k in range(70)]]
            for copy in range(2):
                text = own[:]
                for _ in range(copy * 3):
                    text[rng.randrange(240)] = f"y{rng.random()}"
                rows.append((len(rows), " ".join(text)))
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    truth = _near_truth(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == truth and ["node"] in hot
    assert 150 < len({c for _, c in truth.values()}) < 300


@pytest.mark.parametrize("percent", [30, 50, 80, 85, 95])
def test_chosen_path_misses_less_than_one_in_a_million(percent):
    p, n = percent / 100, chosen_path.COORDINATES
    assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(chosen_path.alike(percent))) <= 1e-6
    assert (1 - p) ** (chosen_path.BRANCHES * chosen_path.trees(percent)) <= 1e-6
    assert (n - chosen_path.BRANCHES * chosen_path.trees(percent)) // chosen_path.LEVELS > 1  # children have coordinates


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark), "t").collect()}
    assert got == {**{k: 0 for k in range(1, 21)}, 101: 100, 102: 100}


def test_small_tables_take_few_tasks(spark):
    """However many partitions a shuffle makes, a few edges or documents are not as many tasks and files, round by round."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    folder, cores = shared_folder(spark), spark.sparkContext.defaultParallelism
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = components(spark.createDataFrame([(k, k + 1 + k % 2) for k in range(0, 400)], "a long, b long"), folder, "t")
        assert got.groupBy("root").count().count() >= 1
        docs = spark.createDataFrame([(k, f"some words of text {k // 2}") for k in range(400)], "doc_id long, text string")
        out = chosen_path.near_duplicates(docs)
        assert out.filter("kept").count() == 200 and out.rdd.getNumPartitions() <= cores
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    tables = list(Path(folder.removeprefix("file:")).glob("t*"))
    assert len(tables) > 5 and all(len(list(t.glob("part-*.parquet"))) <= cores for t in tables)


def _vectors(n=1500, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.5, 1.5, (n, 1))
    x[1] = x[0]  # a tie
    return x.astype(np.float32).astype(float)


def test_cross_polytope_recall(spark):
    x = _vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2001, None), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (None, [1.0] * 24), (5, x[5].tolist()), (2004, [1.0, 2.0])]
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))).collect()
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -np.inf
    truth = {(20 * q, int(v)) for q in range(len(s)) for v in np.argsort(-s[q], kind="stable")[:20]}
    assert len(truth & {(r.query_id, r.vec_id) for r in got}) / len(truth) >= 0.9
    for r in got:
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-12)
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, -r.score, r.vec_id))
    for found in by.values():
        found.sort()
        assert [f[1:] for f in found] == sorted(f[1:] for f in found) and [f[0] for f in found] == list(range(1, len(found) + 1))


def test_cross_polytope_hashes_every_row(spark, monkeypatch):
    """No band is compared whole: all rows and queries of a small table are placed by their axes."""
    seen, real = [], cross_polytope.placed
    monkeypatch.setattr(cross_polytope, "placed", lambda rows, tables: seen.append(real(rows, tables)) or seen[-1])
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = cross_polytope.search(table).collect()
    data, asks = seen
    n = table.filter("embedding is not null").select("vec_id").distinct().count()
    assert data.count() >= 0.9 * n * cross_polytope.TABLES and data.filter("table < 0").count() == asks.filter("table < 0").count() == 0 and asks.select("vec_id").distinct().count() >= n / 25
    x = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        best = sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]
        hits, total = hits + len({r.vec_id for r in got if r.query_id == q} & set(best)), total + 20
    assert hits >= 0.9 * total


def test_cross_polytope_completes_short_lists(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 64))
    vectors = {i: x[i] for i in range(20)} | {100 + i: x[20 + i, :24] for i in range(10)} | {200: x[30, :16]}
    vectors |= {300 + i: (-1.0) ** (i > 0) * x[31, :8] + 1e-3 * i for i in range(30)}  # all rows opposite to the query
    got = cross_polytope.search(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"), every=100, k=20, tables=1).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        found[r.query_id].append(r.vec_id)
    for q in (0, 100, 200, 300):
        others = [i for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        assert found[q] == sorted(others, key=lambda i: (-float(vectors[i] @ vectors[q]), i))[:20]


#: Lengths of 4000 vectors: shares of long ones, a continuum, and clusters.
_LENGTHS = {"equal": lambda r: np.ones(4000), "lognormal": lambda r: np.exp(r.normal(size=4000)), "clusters": lambda r: r.uniform(0.5, 2.0, 4000)}
_LENGTHS |= {f"{n} percent long": lambda r, n=n: np.where(r.random(4000) < n / 100, 1.0, 0.1) for n in (5, 20, 50)}


@pytest.mark.parametrize("kind", sorted(_LENGTHS))
def test_cross_polytope_recall_on_mixed_lengths(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(80, 64)), 50, axis=0) + 0.4 * x
    x *= _LENGTHS[kind](rng)[:, None] / np.linalg.norm(x, axis=1)[:, None]
    got = cross_polytope.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), block=500).collect()
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -np.inf
    truth = {(20 * q, int(v)) for q in range(len(s)) for v in np.argsort(-s[q], kind="stable")[:20]}
    recall = len(truth & {(r.query_id, r.vec_id) for r in got}) / len(truth)
    print(f"recall {kind}: {recall:.3f}")
    assert recall >= 0.9


def test_vectors_with_clashing_names_and_copies(spark):
    """A third of all rows are one vector; extra columns bear the names of results and of inner columns."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(600, 16)), 2)
    x[100:300] = x[100]
    names = ["dim", "vec", "score", "rank", "query_id", "n", "band", "asks", "cut", "blocks", "place", "length"]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(700, []), (720, []), (740, None)], "vec_id long, embedding array<double>").withColumns({c: F.lit("extra") for c in names})
    for search, values in ((cross_polytope.search, x), (va_file.top_k, np.floor(64 * x))):
        got = collections.defaultdict(list)
        for r in search(rows).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        near = values[::20] @ values.T
        hits = 0
        for q in range(0, 600, 20):
            order = [int(i) for i in np.lexsort((np.arange(600), -np.round(near[q // 20], 9))) if i != q]
            place = {v: k for k, v in enumerate(order)}
            found = [v for v, _ in got[q]]
            assert len(found) == 20 and sorted(found, key=place.get) == found and np.allclose([s for _, s in got[q]], near[q // 20][found])
            hits += len(set(found) & set(order[:20]))
            assert search is cross_polytope.search or found == order[:20]
        assert hits >= 0.9 * 20 * 30
        assert got[700] == ([(720, 0)] if search is va_file.top_k else [])


@pytest.mark.parametrize("block", [64, 8192])
def test_va_file_against_all_products(spark, block):
    x = _vectors()
    x[200:400] = x[200]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2001, None), (2003, [float("inf")] * 24), (None, [1.0] * 24), (5, x[5].tolist())]
    got = va_file.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()
    v = np.floor(64 * x).astype(np.int64)
    s = v[::20] @ v.T
    want = []
    for q in range(len(s)):
        order = [i for i in np.lexsort((np.arange(len(v)), -s[q])) if i != 20 * q][:20]
        want += [(20 * q, k + 1, int(i), int(s[q, i])) for k, i in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_va_file_series_leave_few_rows():
    """Files seen one after another leave each query the rows that can be among its k best, and not k of every file."""
    rng, k = np.random.default_rng(8), 10
    x, q = np.floor(64 * rng.normal(size=(16, 500, 32))), np.floor(64 * rng.normal(size=(40, 32)))
    state = va_file.Running(len(q), k)
    for b, block in enumerate(x):
        codes, low, width = va_file.cells(block)
        for at in (0, 25):
            rows = slice(at, min(40, at + 25))
            state.seen(rows, *va_file.bounds(q[rows], codes, low, width), np.arange(500) + 500 * b)
    query, ids, upper, lower = state.left()
    exact = q @ x.reshape(-1, 32).T
    assert ((lower <= exact[query, ids]) & (exact[query, ids] <= upper)).all()
    for i in range(40):
        assert set(np.argsort(-exact[i])[:k]) <= set(ids[query == i].tolist())
    assert len(query) < 2 * 40 * k < 16 * 40 * k / 2


def test_shards_are_sorted_in_little_memory():
    """A worker holds less than 50 bytes for each byte of a shard; marks are those of a plain count."""
    rng, segments = random.Random(3), []
    words = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    for _ in range(300):
        text = bytearray(" ".join(rng.choice(words) for _ in range(60)).encode()[:330])
        for k in range(3):
            text[rng.randrange(330)] = 65 + k
            segments.append(bytes(text))
    counts = np.full(len(segments), 131)
    tracemalloc.start()
    got = suffix_dedup.repeated_windows(segments, counts, 200)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen = collections.Counter(s[k : k + 200] for s in segments for k in range(131))
    assert [g.tolist() for g in got] == [[seen[s[k : k + 200]] > 1 for k in range(131)] for s in segments]
    assert most < 50 * sum(map(len, segments))


def test_suffix_arrays_and_prefixes():
    random.seed(1)
    for trial in range(120):
        n, k = random.choice([0, 1, 2, 5, 23, 24, 30, 60, 200]), random.choice([1, 2, 3, 5, 60])
        t = np.array([random.randrange(k) for _ in range(n)], np.int64)
        if trial % 3 == 0 and n > 10:
            t[n // 2 :] = t[: n - n // 2]
        line = t.tolist()
        order = sorted(range(n), key=lambda i: line[i:])
        array = suffix_sort.suffix_array(t)
        assert array.tolist() == order
        want = [0] * n
        for a, b in zip(order, order[1:]):
            while b + want[b] < n and a + want[b] < n and line[a + want[b]] == line[b + want[b]]:
                want[b] += 1
        assert suffix_sort.permuted_prefixes(t, array).tolist() == want


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_passages_against_all_windows(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows += [(100_000, "é" * 150), (100_001, "ab" * 400), (100_002, "x" + "é" * 140), (100_000, rows[3][1])]
    rows += [(None, rows[5][1]), (None, "z".join(str(k * k) for k in range(90))), (None, "y".join(str(k * k) for k in range(90))), (100_003, "only once " + rows[6][1]), (100_003, "only once " + rows[6][1])]
    got = collections.defaultdict(list)
    for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    data = [(i, t.encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    want = collections.defaultdict(list)
    for i, b in data:
        cover = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        want[i].append((len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def _labelled(spark, n=1500):
    random.seed(8)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(600)]
    bad, rows, marks = ["zzidiot", "zztrash", "zzscum"], [], []
    for i in range(n):
        toxic, junk = random.random() < 0.2, random.random() < 0.3
        words = [random.choice(vocabulary) for _ in range(random.randrange(20, 120))]
        text = [w + (". " if random.random() < 0.1 else " ") for w in words]
        if toxic:
            text.insert(random.randrange(len(text)), random.choice(bad) + " ")
        text = "".join(text)
        if junk:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        marks.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def _held_accuracy(out, labels, label):
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    return np.mean([r.predicted == r[label] for r in rows]), len(rows)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = _labelled(spark)
    out = toxicity.score(docs, labels, with_spans=True)
    accuracy, n = _held_accuracy(out, labels, "toxic")
    assert accuracy > 0.97 and n == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1500))
    found = out.join(labels, "doc_id").filter("toxic = 1 and predicted = 1").collect()
    assert all(any("zz" in s.sentence for s in r.offending) for r in found)
    assert toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), labels).agg(F.max("score")).first()[0] == 0


def test_toxicity_keeps_every_feature_beyond_chance(spark):
    """More than four thousand words that tell, each of them in some thirty toxic documents only."""
    words = [f"q{k:04d}" for k in range(2100)]  # a word and its first five letters are two features
    rows = [(i, " ".join(words[(17 * i + j * 13) % 2100] for j in range(170)) + ". plain words here.", 1) for i in range(500)]
    rows += [(1000 + i, "plain words here. and more of them.", 0) for i in range(500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0, y) for d, _, y in rows], "doc_id long, quality int, toxic int")
    weights, _ = toxicity.train(docs, labels, 5, 0)
    assert {toxicity.features(w.encode())[0] for w in words} <= set(weights) and len(weights) > 4200


def test_toxicity_of_long_clean_texts(spark):
    docs, labels = _labelled(spark)
    long = [(9001, "a plain sentence of zq words. " * 10_000), (9002, "." * 10_000), (9003, "\n!? " * 10_000)]
    out = toxicity.score(docs.unionByName(spark.createDataFrame(long, "doc_id long, text string")), labels)
    assert [r.score for r in out.filter("doc_id > 9000").collect()] == [0.0] * 3
    accuracy, _ = _held_accuracy(out, labels, "toxic")
    assert accuracy > 0.97
    weights = toxicity.Weights({toxicity.features(b"weak")[0]: -0.5})
    assert toxicity.judged("weak. " * 10_000, weights, -9.0)[0] == 0.0


def test_quality_on_held_out_documents(spark):
    docs, labels = _labelled(spark)
    out = quality.score(docs, labels)
    accuracy, n = _held_accuracy(out, labels, "quality")
    assert accuracy > 0.97 and n == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1500))
    assert out.filter("score < 0 or score > 1 or (score >= 0.7) <> (predicted = 1)").count() == 0


def test_noisy_or_gradient():
    bags = [(1, 2, [[0], [1, 2]]), (0, 3, [[1]]), (1, 0, [[0, 2]])]
    w, bias = toxicity.fit(bags * 5, 3, rounds=300)
    p = lambda bare, sentences: 1 - math.exp(-(bare * math.log1p(math.exp(bias)) + sum(math.log1p(math.exp(min(40, bias + sum(w[f] for f in s)))) for s in sentences)))
    assert p(2, [[0], [1, 2]]) > 0.9 and p(3, [[1]]) < 0.1


def test_base_score_and_model(spark, docs):
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    words = {r.doc_id: [*WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")), None] for r in docs.collect()}
    count = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, ws in words.items():
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.01


@pytest.mark.parametrize("n", [1, 100, 511, 512, 40_000])
def test_training_reads_every_word(n, monkeypatch):
    """Whatever the number of words, each of them is once the target of a step (filled up with less than one end a stream)."""
    rng, end = np.random.default_rng(n), 5
    p = gru.start(np.log(np.full(gru.CLASSES + 3, 1 / (gru.CLASSES + 3))), np.zeros(gru.FREQUENT))
    stream = np.r_[end, rng.integers(0, gru.FREQUENT, n)]
    seen, real = collections.Counter(), gru.window_gradients
    monkeypatch.setattr(gru, "window_gradients", lambda p, x, y, *a: seen.update(y.ravel().tolist()) or real(p, x, y, *a))
    training = gru.Training(p)
    before = training.flat.copy()
    training.feed(stream, end)
    extra = seen - collections.Counter(stream[1:].tolist())
    assert not collections.Counter(stream[1:].tolist()) - seen and set(extra) <= {end} and sum(extra.values()) < gru.STREAMS
    assert not np.array_equal(before, training.flat)


def test_scores_do_not_hang_on_partitions(spark, docs):
    few, many = ({r.doc_id: r.score for r in lm_scoring.score(docs.repartition(n)).collect()} for n in (1, 64))
    assert all(few[i] == pytest.approx(many[i], rel=1e-5) for i in few)
    rows = lm_scoring.score(docs.repartition(64)).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    gain = (rows[0] - rows[1]) / rows[2]
    print(f"held-out gain: {gain:.4f} log10 a token")
    assert gain > 0.02


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    p = gru.start(np.log(np.full(gru.CLASSES + 3, 1 / (gru.CLASSES + 3))), np.zeros(gru.FREQUENT))
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in p.items()}
    ids = np.arange(gru.FREQUENT + 3)
    state = np.repeat(rng.normal(size=(1, gru.STATE)).astype(np.float32), len(ids), axis=0)
    assert np.exp(gru.log_probabilities(p, state, ids)).sum() == pytest.approx(1, rel=1e-4)


def test_model_gradients_and_carried_state():
    rng = np.random.default_rng(0)
    p = gru.start(np.log(np.full(gru.CLASSES + 3, 1 / 35)), np.zeros(gru.FREQUENT))
    p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in p.items()}
    ids, h, g = np.concatenate([rng.integers(0, gru.FREQUENT + 3, 8) for _ in range(3)]), rng.normal(size=(24, gru.STATE)), {}
    back = gru._head_gradients(p, h, ids, g)
    for array, gradient in ((p["classes"], g["classes"]), (p["class_bias"], g["class_bias"]), (h, back)):
        at = tuple(rng.integers(0, s) for s in array.shape)
        kept, e = array[at], 1e-5
        array[at] = kept + e
        up = -gru.log_probabilities(p, h, ids).mean()
        array[at] = kept - e
        down = -gru.log_probabilities(p, h, ids).mean()
        array[at] = kept
        assert (up - down) / (2 * e) == pytest.approx(gradient[at], rel=1e-4, abs=1e-9)
    texts = [rng.integers(0, gru.FREQUENT, n) for n in (3, 200, 61, 1)]
    together = gru.score_texts(p, texts, 0)
    assert np.allclose(together, [gru.score_texts(p, [t], 0, window=7)[0] for t in texts])


def test_gradients_through_time():
    rng = np.random.default_rng(2)
    p = gru.start(np.log(np.full(gru.CLASSES + 3, 1 / 35)), np.zeros(gru.FREQUENT))
    p = {k: v.astype(float) + rng.normal(0, 0.3, v.shape) for k, v in p.items()}
    ids, h0, end = rng.integers(0, gru.FREQUENT + 3, (10, 4)), rng.normal(size=(4, gru.STATE)), 5
    ids[3, 1] = ids[0, 2] = end
    inputs, targets = ids[:-1], ids[1:]

    def loss():
        h, total = h0, 0.0
        for x, y in zip(inputs, targets):
            h = gru.step(p, p["embed"] @ p["wx"] + p["b"], x, h * (x != end)[:, None])[0]
            total -= gru.log_probabilities(p, h, y).sum()
        return total / targets.size

    g, last = gru.window_gradients(p, inputs, targets, h0, end)
    assert last.shape == h0.shape
    places = {k: [tuple(rng.integers(0, s) for s in p[k].shape) for _ in range(6)] for k in p}
    places["embed"] += [(int(i), 3) for i in inputs.ravel()[:6]]
    for k, at_all in places.items():
        for at in at_all:
            kept, e = p[k][at], 1e-5
            p[k][at] = kept + e
            up = loss()
            p[k][at] = kept - e
            down = loss()
            p[k][at] = kept
            assert (up - down) / (2 * e) == pytest.approx(g[k][at], rel=1e-4, abs=1e-8), k


def test_score_against_a_plain_loop(spark, docs, monkeypatch):
    kept, trained = {}, lm_scoring.trained
    monkeypatch.setattr(lm_scoring, "trained", lambda d, vocab, folder: kept.setdefault("m", (vocab, trained(d, vocab, folder)))[1])
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    vocab, p = kept["m"]
    rows = docs.collect()
    count = collections.Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in lm_scoring.tokens(r.text).tolist())
    assert any(np.abs(p["classes"]).ravel() > 1e-3)  # the model has moved
    mass = collections.Counter()
    for w, n in count.items():
        mass[int(vocab.numbers(np.array([w], np.uint64))[0])] += n + 0.5
    logistic, lse = lambda x: 1 / (1 + np.exp(-x)), lambda x: float(np.log(np.exp(x.astype(float)).sum()))
    for row in rows[:12]:
        before, h, total, s = vocab.end, None, 0.0, gru.STATE
        for w in lm_scoring.tokens(row.text):
            h = np.zeros(s) if before == vocab.end else h
            x, own = p["embed"][before] @ p["wx"] + p["b"], h @ p["wh"]
            r, z = logistic(x[:s] + own[:s]), logistic(x[s : 2 * s] + own[s : 2 * s])
            h = (1 - z) * np.tanh(x[2 * s :] + r * own[2 * s :]) + z * h
            before = int(vocab.numbers(np.array([w]))[0])
            out = h @ p["classes"] + p["class_bias"]
            k = before // gru.WIDTH if before < gru.FREQUENT else before - gru.FREQUENT + gru.CLASSES
            total += float(out[k]) - lse(out)
            if before < gru.FREQUENT:
                words = p["words"][k * gru.WIDTH : (k + 1) * gru.WIDTH] @ h + p["word_bias"][k * gru.WIDTH : (k + 1) * gru.WIDTH]
                total += float(words[before % gru.WIDTH]) - lse(words)
            elif int(w) in count:
                total += math.log((count[int(w)] + 0.5) / mass[before])
        assert got[row.doc_id].score == pytest.approx(total / math.log(10), rel=1e-4)


def test_index_vectors_tell_words_apart():
    """Ten thousand words have as many vectors, and two of them have nothing in common on average."""
    hashes, _ = quality.words_of([" ".join(f"word{k}" for k in range(10_000))])
    x = quality.index_vectors(hashes)
    assert len(np.unique(x, axis=0)) == 10_000
    cosines = (x[:2000] @ x[2000:4000].T).ravel()
    assert abs(cosines.mean()) < 0.002 and cosines.std() < 0.08


def test_quality_scores_against_plain_loops(spark, monkeypatch):
    """Vectors, pooling, network and temperature recomputed word by word; some words are rarer than the common ones."""
    docs, labels = _labelled(spark, 300)
    monkeypatch.setattr(quality, "COMMON", 500)
    long = spark.createDataFrame([(7001, " ".join(f"w{k * k % 997}" for k in range(40_000)), "en", "s")], "doc_id long, text string, lang string, source string")
    docs = docs.select("doc_id", "text").unionByName(long.select("doc_id", "text"))  # longer than a slice
    kept = {}
    for name in ("word_vectors", "fit"):
        real = getattr(quality, name)
        monkeypatch.setattr(quality, name, lambda *a, name=name, real=real: kept.setdefault(name, (a, real(*a)))[1])
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    (_, common), vectors = kept["word_vectors"]
    (x, y), model = kept["fit"]
    place = {int(h): k for k, h in enumerate(common)}
    assert 0 < len(place) <= 500
    known = {}

    def word(w):
        if w not in known:
            h = int(quality.words_of([w])[0][0])
            v = np.zeros(quality.DIM)
            for k in range(8):  # of each byte five bits are a place among 32, and the last one is a sign
                v[32 * k + (h >> 8 * k & 31)] = 1 - 2 * (h >> 8 * k + 7 & 1)
            known[w] = h, v
        return known[w]

    texts = {r.doc_id: WORDS.findall(r.text) for r in docs.collect()}
    sums = np.zeros((len(common), quality.DIM))
    for ws in texts.values():
        for i, w in enumerate(ws):
            if (k := place.get(word(w)[0])) is not None:
                for j in range(max(0, i - quality.WINDOW), min(len(ws), i + quality.WINDOW + 1)):
                    if j != i:
                        sums[k] += word(ws[j])[1]
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    assert np.allclose(vectors, sums / np.where(length > 0, length, 1), atol=1e-6)
    assert any(word(w)[0] not in place for ws in texts.values() for w in ws)
    for i in [*list(texts)[:40], 7001]:
        v = []
        for w in texts[i]:
            h, own = word(w)
            v.append(vectors[place[h]].astype(float) if h in place else own / (np.linalg.norm(own) or 1.0))  # signs may cancel
        v = np.array(v)
        pooled = np.concatenate([v.mean(axis=0), (v * v)[:, :32].mean(axis=0), (v[:-1] * v[1:])[:, :32].sum(axis=0) / len(v)])
        z = np.tanh((pooled - model["centre"]) / model["spread"] @ model["a"] + model["b"]) @ model["c"] + model["d"]
        assert got[i] == pytest.approx(float(1 / (1 + np.exp(-z[0] / model["temperature"][0]))), abs=1e-4)
    # the temperature is the best for the fifth that the layers don't see
    part = np.arange(len(x)) % 5 == 4
    logits, sign = quality._logits(model, x[part]), np.where(y[part] > 0, -1, 1)
    loss = lambda t: float(np.logaddexp(0, sign * logits / t).mean())
    assert loss(model["temperature"][0]) <= min(loss(t) for t in (0.5, 1.0, 2.0, 4.0)) + 1e-3


def test_toxicity_scores_against_plain_loops(spark, monkeypatch):
    import xxhash

    docs, labels = _labelled(spark, 600)
    kept, real = {}, toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: kept.setdefault("t", real(*a)))
    got = {r.doc_id: r for r in toxicity.score(docs, labels, with_spans=True).collect()}
    weights, bias = kept["t"]
    assert weights
    logistic = lambda z: 1 / (1 + math.exp(-z))
    for r in docs.collect()[:150]:
        clean, found = 1.0, 0
        for sentence in re.split("[.!?\n\r]", r.text.lower()):
            z = bias
            for w in sentence.split():
                z += weights.get(xxhash.xxh3_64_intdigest(w.encode()) >> 1, 0.0)
                z += sum(weights.get(xxhash.xxh3_64_intdigest(f"{n}:{w[:n]}".encode()) >> 1, 0.0) for n in (4, 5, 6) if len(w) >= n)
            if z > bias:
                clean *= (1 - logistic(z)) / (1 - logistic(bias))
            found += z >= 0
        assert got[r.doc_id].score == pytest.approx(1 - clean, abs=1e-9)
        assert got[r.doc_id].toxic_sentences == len(got[r.doc_id].offending) == found


def test_unsupported_vocabularies_are_refused():
    good = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "decoder": {"type": "ByteLevel"}, "added_tokens": []}
    bpe.supported(good)
    changes = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"decoder": None}]
    changes += [{"model": good["model"] | {"ignore_merges": True}}, {"model": good["model"] | {"dropout": 0.1}}, {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}]
    for change in changes:
        with pytest.raises(ValueError):
            bpe.supported(good | change)
