"""Bounded samples of labelled documents, and the split by crc32 of the doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(mod: int) -> Column:
    """crc32 of the doc_id as text, modulo ``mod``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents outside the held-out remainder, the same ones on every run.

    The documents of least hash are taken: at most ``most`` ids, a bounded
    table, meet the texts by broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.filter(remainder(mod) != held).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    # of very many labels only those that can be among the first are ordered: twice as many as wanted
    share = min(1.0, 2 * most / max(1, known.count()))
    chosen = known.filter(F.col("h") < F.lit(int(share * (1 << 30)))).orderBy("h", "doc_id").limit(most).drop("h")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")
