"""Every stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import collections
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from coneflow.llm import chosen_path, mixing, queries, suffix_dedup, toxicity
from coneflow.llm.common import shared_folder, stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    folder, docs, found = shared_folder(spark), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out = stored(stage(spark, docs, SF), folder, name)
        found.append((docs, out))
        docs = out
    return found


def test_order_and_columns(spark, stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "source_mixing", "bpe"]
    assert all(out.columns == pipeline.COLUMNS for _, out in stages[:-1])
    assert stages[-1][1].count() == pipeline.run(spark, SF).count()


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    docs, out = stages[0]
    scores = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in scores.filter("predicted = 0").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0")
    clean = docs.join(labels, "doc_id").count()
    assert out.join(labels, "doc_id").count() >= 0.97 * clean


def test_one_of_each_group_stays(stages):
    """Against all pairs of full shingle sets, at four fifths."""
    docs, out = stages[1]
    sets, up = {}, {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id], up[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set(), r.doc_id

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= pipeline.ALIKE * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert pipeline.ALIKE == 80
    assert {r.doc_id for r in out.collect()} == {find(i) for i in ids}


def test_passages_are_cut(stages):
    docs, out = stages[2]
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
    assert before.keys() == after.keys()
    for r in suffix_dedup.dedup(docs).collect():
        own = len(after[r.doc_id].text.encode())
        assert r.n_bytes - r.n_removed <= own <= r.n_bytes - r.n_removed + 6 * r.n_spans
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        if not r.n_removed:
            assert after[r.doc_id].text == before[r.doc_id]


def test_mix_repeats_documents(stages):
    docs, out = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({d: c for d, c in copies.items() if c})


def test_encoded_texts(stages):
    from tokenizers import Tokenizer

    docs, out = stages[4]
    library = Tokenizer.from_file(queries.vocabulary_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert out.count() == docs.count()
    for r in out.collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_near_duplicates_from_four_fifths_on(spark):
    words = [f"w{i}" for i in range(104)]
    texts = {1: words, 2: words[:-11] + ["x"] * 11, 10: [f"v{w}" for w in words], 20: [f"u{w}" for w in words], 21: [f"u{w}" for w in words[:-12]] + [f"y{i}" for i in range(12)]}
    texts |= {100 * k + s: [f"{k}{w}" for w in words[: 104 - s]] for k in range(1, 41) for s in (0, 16 + k % 7)}  # cut short: similarity 0.78 to 0.84

    def similarity(a, b):
        x, y = ({tuple(texts[d][i : i + 5]) for i in range(len(texts[d]) - 4)} for d in (a, b))
        return len(x & y) / len(x | y)

    gone = {max(a, b) for a in texts for b in texts if a < b and similarity(a, b) >= 0.8}
    assert sum(0.8 <= similarity(100 * k, 100 * k + 16 + k % 7) < 0.85 for k in range(1, 41)) >= 20
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()} == texts.keys() - gone


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, repeated rows, and columns whose names clash, through every stage."""
    long = " ".join(f"passage{i}" for i in range(60))
    rows = [(1, long, "en", "s", 9), (1, long, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "t", 0), (None, long + " null id", None, "s", 4), (None, None, "en", None, 1), (4, "plain words of a clean text", "de", "t", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("extra") for c in ("copies", "size", "place", "count", "score", "id", "kept_text", "ids")})
    for table in (docs, docs.limit(0)):
        now, folder = table, shared_folder(spark)
        for name, stage in pipeline.STAGES:
            now = stored(stage(spark, now, SF), folder, name)
            if table is docs and name == "near_duplicates":
                kept = now.collect()
                assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4] and sum(r.doc_id is None for r in kept) == 2
            if table is docs and name == "repeated_passages":
                texts = {r.doc_id: r.text for r in now.collect() if r.doc_id is not None}
                assert texts[4] == "plain words of a clean text" and texts[2] == texts[3] == ""
        assert now.columns[:2] == ["doc_id", "source"] and (now.count() > 0) == (table is docs)


def test_a_repeated_document_keeps_its_text(spark):
    text = " ".join(f"word{i}" for i in range(100))
    docs = spark.createDataFrame([(7, text, "en", "s", 1)] * 2 + [(8, "another short text of six words", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = pipeline.cut_repeats(spark, pipeline.drop_near_duplicates(spark, docs, SF), SF).collect()
    assert sorted((r.doc_id, r.text) for r in cut) == [(7, text), (8, "another short text of six words")]


def test_workers_get_few_whole_texts_at_once(spark):
    """A stage bounds the rows of a batch; fewer that the session asks for stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(k, "word " * (k % 7), "en", "s", 1) for k in range(5000)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    sizes = lambda df: df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    try:
        for given, most in (("10000", 1024), ("0", 1024), ("100", 100)):
            spark.conf.set(name, given)
            assert pipeline.encode(spark, docs, SF).count() == 5000
            assert max(r.n for r in sizes(docs).collect()) == most
    finally:
        spark.conf.set(name, before)
