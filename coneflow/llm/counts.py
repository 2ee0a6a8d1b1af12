"""Counts of words over all documents, as 64-bit hashes, and the most common of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different words that a task holds before it sends their counts.
HELD = 3_000_000


def word_counts(docs: DataFrame, hashes: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(word, n) over all rows of ``text``; each task counts up to a few million words before it sends.

    ``hashes`` gives the words of some texts.
    """

    def merged(held):
        words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(back, np.concatenate([c for _, c in held]).astype(float)).astype(np.int64)

    def batch_of(words, n):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = hashes([t or "" for t in batch.column(0).slice(at, 512).to_pylist()])
                held.append(np.unique(found, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD * 2 // 3:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged(held))

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` words and their counts, the most frequent; their least count comes from a histogram of counts."""
    level = F.floor(F.log2("n") * 16)
    held, least = 0, None
    for lv, c in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows
        if held + c > most:
            break
        held, least = held + c, lv
    table = (counts.filter(level >= least) if least is not None else counts.limit(0)).toArrow()
    return table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
