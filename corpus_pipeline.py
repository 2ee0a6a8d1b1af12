"""A training-data pipeline: drop toxic documents and near-duplicates, cut repeated passages, mix the sources, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept. All but the last return the columns of documents; a document whose
text a stage empties stays as a row, and one that the mix holds twice is two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coneflow.cluster import ship_package
from coneflow.llm import bpe, chosen_path, mixing, suffix_dedup, toxicity
from coneflow.llm.common import shared_folder, stored, whole_texts_in_batches
from coneflow.llm.queries import vocabulary_path

#: Percent of similarity from which documents are near-duplicates; operator 4 as a query has its own.
ALIKE = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    whole_texts_in_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (operator 9)."""
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, labels, keep=COLUMNS).filter("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each component at ALIKE percent of five-word shingles, and all rows without doc_id (operator 4).

    Rows that repeat a doc_id are one document, of which the greatest row stays.
    """
    _ready(spark)
    found = chosen_path.near_duplicates(docs, words=5, percent=ALIKE)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)
    repeated = stored(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), shared_folder(spark), "repeated")
    if not repeated.take(1):
        return kept
    w = Window.partitionBy("doc_id").orderBy(*[F.desc(c) for c in COLUMNS[1:]])
    one = kept.join(repeated, "doc_id", "left_semi").withColumn("place", F.row_number().over(w)).filter("place = 1")
    return kept.join(repeated, "doc_id", "left_anti").select(COLUMNS).unionByName(one.select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur anywhere else (operator 8)."""
    _ready(spark)
    kept = suffix_dedup.dedup(docs, keep=["doc_id", "lang", "source"], with_text=True)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it (operator 1)."""
    _ready(spark)
    mixed = mixing.mix(docs, carry=COLUMNS)
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row (operator 2)."""
    _ready(spark)
    out = bpe.encode(docs, vocabulary_path(), keep=["doc_id", "source"], with_ids=True)
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the encoder; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    folder, docs = shared_folder(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
