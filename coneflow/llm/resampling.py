"""Importance resampling towards a target distribution of hashed word runs.

Texts are lower-cased (ASCII) and pre-tokenised by an untrained Split of the
tokenizers library, which returns words with their offsets. Windows over
neighbouring words are pairs of offsets (start of the first, end of the last)
whose feature, the words joined by one space, falls into a CRC bucket. Bucket
histograms of all documents and of all target texts give each bucket's gain; a
document's weight is the mean gain of its features, and Gumbel noise from a hash
of its id turns the highest scores into a draw without replacement by weight.

Every text is tokenised once; buckets are stored with their document, so the
gains are summed over a narrow table.

Defined results: null and empty texts have no words, no features and weight 0;
a null doc_id hashes as empty text and sorts first among ties; rows that repeat a
doc_id share its noise and are drawn one by one, ties between them by weight and
size; an empty table gives no rows, an empty target (or no documents) leaves
gains finite. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, shared_folder, stored

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A word is a run of digits, small letters and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Characters that the tokenizers library is given at once; it holds some 50 bytes for each.
PIECE = 1 << 16


def splitter():
    """The library's Split by words: untrained, keeps matches and drops what lies between."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def words_of(split, text: bytes) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of the lower-cased text and their (start, end) in characters; long texts are cut where no word is."""
    lowered = text.translate(_LOWER).decode("utf-8", "replace")
    if len(lowered) <= PIECE:
        found = split.pre_tokenize_str(lowered)
        return [w for w, _ in found], [o for _, o in found]
    words, offsets, at = [], [], 0
    while at < len(lowered):
        gap = _GAP.search(lowered, at + PIECE)
        end = gap.start() if gap else len(lowered)
        for w, (s, e) in split.pre_tokenize_str(lowered[at:end]):
            words.append(w)
            offsets.append((at + s, at + e))
        at = end
    return words, offsets


def windows(words: list[str], offsets: list[tuple[int, int]], least: int, most: int):
    """(start, end, crc32) of every run of ``least`` to ``most`` words; a run's crc goes on from that of the run one word shorter."""
    crcs = [crc32(w.encode()) for w in words]
    for size in range(1, most + 1):
        if size > 1:
            crcs = [crc32(b" " + w.encode(), c) for c, w in zip(crcs, words[size - 1 :], strict=False)]
        if size >= least:
            yield from zip((s for s, _ in offsets), (e for _, e in offsets[size - 1 :]), crcs, strict=False)


def featurized(texts: DataFrame, keep: list[str], least: int, most: int, buckets: int, with_offsets: bool = False) -> DataFrame:
    """``keep`` columns, n_words, and the buckets of all runs of words; with their offsets in characters, if asked for."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema)
    names = [*keep, "n_words", "buckets", *(["starts", "ends"] if with_offsets else [])]

    def run(batches):
        split = splitter()
        for batch in batches:
            column = batch.column(len(keep))
            for at in range(0, batch.num_rows, 128):
                n, sizes, lists = [], [0], [[] for _ in names[len(keep) + 1 :]]
                for text in column.slice(at, 128):
                    words, offsets = words_of(split, text.as_py())
                    found = list(windows(words, offsets, least, most))
                    n.append(len(words))
                    sizes.append(len(found))
                    lists[0].append(np.fromiter((c for _, _, c in found), np.uint32, len(found)) % np.uint32(buckets))
                    if with_offsets:
                        lists[1].append(np.fromiter((s for s, _, _ in found), np.uint32, len(found)))
                        lists[2].append(np.fromiter((e for _, e, _ in found), np.uint32, len(found)))
                ends = pa.array(list(accumulate(sizes)), pa.int32())
                arrays = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 128) for k in range(len(keep))), pa.array(n, pa.int64()), *arrays], names=names)

    kinds = "".join(f", {x} array<int>" for x in names[len(keep) + 1 :])
    text = F.coalesce("text", F.lit("")).cast("binary").alias("__text")
    return texts.select(*keep, text).mapInArrow(run, (fields + ", " if keep else "") + "n_words bigint" + kinds)


def histogram(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how often each bucket occurs; every task sends one row a bucket at most."""

    def run(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(held[found])], names=["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int, folder: str) -> np.ndarray:
    """The gain of every bucket, in thousandths: floor(1000 ln of the smoothed target share over the smoothed source share)."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = stored(both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), folder, "counts")
    of_source, of_target = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(of_source + buckets)) / ((F.col("s") + 1) * F.lit(of_target + buckets))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).toArrow()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return out


def weighed(features: DataFrame, keep: list[str], table: np.ndarray) -> DataFrame:
    """``keep`` columns, n_words, n_features, and the floored mean gain of each document's features."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.select(*keep, "n_words").schema)

    def run(batches):
        for batch in batches:
            lists = batch.column(len(keep) + 1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(table[lists.flatten().to_numpy()])])
            n, total = np.diff(ends), np.diff(sums[ends - ends[0]])
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep) + 1)), pa.array(n), pa.array(mean)], names=[*keep, "n_words", "n_features", "weight"])

    return features.select(*keep, "n_words", "buckets").mapInArrow(run, fields + ", n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from 32 bits of sha256 of (seed, doc_id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def drawn(scored: DataFrame, least_words: int, percent: int, folder: str) -> DataFrame:
    """Add ``rank`` (1, 2, ...) to the highest ``percent`` of the scores of documents with ``least_words`` words; null elsewhere.

    Weights and noise are bounded, so a histogram of scores has at most some
    100,000 rows; it tells the score at which the draw ends, and only rows from
    there on are sorted.
    """
    eligible = F.col("n_words") >= least_words
    levels = stored(scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n")), folder, "levels")
    wanted = (levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))  # a bounded table
    end = levels.withColumn("upto", upto).filter(F.col("upto") >= wanted).agg(F.max("score")).first()[0]
    near = eligible & (F.col("score") >= end)
    order = [F.desc("score"), F.col("doc_id"), F.desc("weight"), F.desc("n_features"), F.desc("n_words")]
    ranked = numbered(scored.filter(near), order, folder, "near").withColumn("rank", F.when(F.col("number") < wanted, F.col("number") + 1))
    return ranked.drop("number").unionByName(scored.filter(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``target`` has the texts whose distribution is wanted."""
    folder = shared_folder(docs.sparkSession)
    features = stored(featurized(docs, ["doc_id"], least, most, buckets), folder, "features")
    table = gains(histogram(features, buckets), histogram(featurized(target, [], least, most, buckets), buckets), buckets, folder)
    scored = weighed(features, ["doc_id"], table).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(stored(scored, folder, "scored"), least_words, percent, folder)
