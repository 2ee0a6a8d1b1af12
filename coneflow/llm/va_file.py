"""Exact top-k inner products by vector-approximation files.

1. The vectors are dealt to blocks of a bounded size, and each block becomes one
   row of a stored table, its approximation file: the ids, and one byte for each
   component, the number of its cell between the block's least and largest value.
2. Blocks of queries scan the files, and nothing but them. The product with the
   middles of the cells is one product with the codes; half of the cells' widths
   bounds what it may be off. A task scans a series of files one after another
   and keeps each query's k best lower bounds so far: rows stay whose upper bound
   reaches the k-th of them, so a series leaves little more than k rows of a
   query. The k-th lower bound over all series then drops most of these.
3. What is left is read exactly, in the order of the upper bounds: first
   FIRST * k rows of each query, then those whose upper bound still reaches the
   k-th exact score. No other row can be among the k best.

Blocks of queries meet series of up to SERIES files in separate tasks, so no task
holds more than these; queries are sent once for each series. A file is an eighth
of its vectors, and it is what is sent once for each block of queries. Exact
vectors meet only the pairs that are left. Of equal
vectors only the k + 1 smallest ids take part as candidates: ties go to smaller
ids and one may be the query's own, so no others can be found. The work is
(queries x rows): exact search has no other end.

Defined results: vectors that are null, or hold nulls or numbers that aren't
finite, take no part, nor do rows without an id; rows that repeat an id count
once; vectors of different length never meet; with fewer than k candidates all
are returned; a row never finds itself; products beyond 64 bits count as the
largest (smallest) number of 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_keys, joined_apart, shared_folder, stored
from .vectors import first_copies, matrix, merged, one_row_per_id

CELLS, BLOCK, FIRST = 256, 8192, 2
#: Files that a task scans at most, and series that there are at least where there are as many files.
SERIES, LEAST_SERIES = 16, 8
#: Bytes of exact vectors in a block at most, whatever their length.
BLOCK_BYTES = 1 << 25
#: Bounds that one step of a scan holds.
SCORES = 1 << 21
_LARGEST = 2**63 - 1


def cells(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximation of a block: a code for each component, and by dimension the least value and the width of a cell."""
    low = block.min(axis=0)
    width = block.max(axis=0) / CELLS - low / CELLS
    codes = np.floor((block - low) / np.where(width > 0, width, 1.0))
    return np.clip(codes, 0, CELLS - 1).astype(np.uint8), low, width


def bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products of queries and coded rows, and by how much each query's may be off."""
    middle = (queries * width) @ codes.T.astype(float) + (queries @ (low + width / 2))[:, None]
    size = np.abs(queries) @ (np.abs(low) + CELLS * width)
    return middle, np.abs(queries) @ (width / 2) + 1e-9 * (1.0 + size)  # the last part: rounding


class Running:
    """What a series of files leaves of each query: the k best lower bounds so far, and the rows that may still be among the k best."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.best = k, np.full((n, k), -np.inf)
        self.kept: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]]

    def seen(self, rows: slice, middle: np.ndarray, off: np.ndarray, ids: np.ndarray) -> None:
        """Products of the queries ``rows`` with a file's rows, and by how much each query's may be off."""
        k = min(self.k, middle.shape[1])
        top = -np.partition(-middle, k - 1, axis=1)[:, :k] - off[:, None] if k else np.empty((len(middle), 0))
        self.best[rows] = -np.partition(-np.concatenate([self.best[rows], top], axis=1), self.k - 1, axis=1)[:, : self.k]
        r, c = np.nonzero((middle + off[:, None] >= self.best[rows].min(axis=1)[:, None]) & (middle > -np.inf))
        for part, value in zip(self.kept, (r + rows.start, ids[c], middle[r, c] + off[r], middle[r, c] - off[r])):
            part.append(value)

    def left(self) -> tuple[np.ndarray, ...]:
        """Query, id, upper and lower bound of the rows that reach the k-th lower bound of the whole series."""
        query, ids, upper, lower = map(np.concatenate, self.kept)
        stay = upper >= self.best.min(axis=1)[query] if len(query) else np.empty(0, bool)
        return query[stay], ids[stay], upper[stay], lower[stay]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows; in doubles while these are exact, else in Python's integers."""
    if not a.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**52:
        return (a * b).sum(axis=1).astype(np.int64)
    whole = ((np.vectorize(int, otypes=[object])(x)) for x in (a, b))
    return np.array([max(-_LARGEST - 1, min(_LARGEST, int(s))) for s in np.multiply(*whole).sum(axis=1)], np.int64)


def _files(held: DataFrame) -> DataFrame:
    """One row for each block (dim, b): its series, ids, codes, and cells."""

    def run(group: pa.Table) -> pa.Table:
        codes, low, width = cells(matrix(group["vec"]))
        one = {c: group[c][:1] for c in ("dim", "s", "queues")}
        return pa.table({**one, "ids": pa.array([group["vec_id"].to_numpy()], pa.list_(pa.int64())), "low": pa.array([low], pa.list_(pa.float64())), "width": pa.array([width], pa.list_(pa.float64())), "codes": pa.array([codes.tobytes()], pa.binary())})

    return held.select("dim", "b", "s", "queues", "vec_id", "vec").groupBy("dim", "b").applyInArrow(run, "dim int, s int, queues int, ids array<bigint>, low array<double>, width array<double>, codes binary")


def _scanned(files: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, upper, lower) of the rows that each series of files leaves of each query."""

    def run(file: pa.Table, asking: pa.Table) -> pa.Table:
        queries, query_ids = (matrix(asking["vec"]), asking["vec_id"].to_numpy()) if asking.num_rows else (np.empty((0, 0)), np.empty(0, np.int64))
        state = Running(len(query_ids), k)
        for f in range(file.num_rows if asking.num_rows else 0):
            ids = file["ids"][f].values.to_numpy()
            low, width = (file[c][f].values.to_numpy() for c in ("low", "width"))
            codes = np.frombuffer(file["codes"][f].as_py(), np.uint8).reshape(len(ids), -1 if len(low) else 0)
            step = max(1, SCORES // len(ids))
            for at in range(0, len(queries), step):
                rows = slice(at, min(len(queries), at + step))
                middle, off = bounds(queries[rows], codes, low, width)
                middle[query_ids[rows, None] == ids[None, :]] = -np.inf
                state.seen(rows, middle, off, ids)
        query, ids, upper, lower = state.left()
        return pa.table({"query_id": query_ids[query], "vec_id": ids, "upper": upper, "lower": lower})

    key = ["dim", "s", "q"]
    sent = files.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("queues") - 1)))
    return sent.groupBy(key).cogroup(asks.select(*key, "vec_id", "vec").groupBy(key)).applyInArrow(run, "query_id bigint, vec_id bigint, upper double, lower double")


def _read(pairs: DataFrame, held: DataFrame, asks: DataFrame, folder: str, name: str) -> DataFrame:
    """(query_id, vec_id, score): exact products of pairs; only vectors that some pair asks for are read."""

    def run(batches):
        for batch in batches:
            score = exact_products(matrix(pa.chunked_array([batch.column(2)])), matrix(pa.chunked_array([batch.column(3)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    # two stored tables meet by plain shuffles, so Spark can split a vector that very many pairs ask for
    met = pairs.join(held.select("vec_id", "vec", "dim"), "vec_id").join(asks.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("ask")), "query_id")
    met = met.filter("dim > 0").select("query_id", "vec_id", "ask", "vec").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint").unionByName(met.filter("dim = 0").select("query_id", "vec_id", F.lit(0).cast("long").alias("score")))
    return stored(met, folder, name)


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(query_id, least): the k-th largest value of each query that has k."""
    w = Window.partitionBy("query_id").orderBy(F.desc(value))
    return rows.select("query_id", value, F.row_number().over(w).alias("place")).filter(F.col("place") <= k).filter(F.col("place") == k).select("query_id", F.col(value).alias("least"))


def top_k(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``, among all other rows.

    Components become floor(scale * x); the score is their integer product.
    """
    folder = shared_folder(table.sparkSession)
    rows = one_row_per_id(table, id_col, vec_col)
    rows = stored(rows.withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(scale) * x).cast("double"))), folder, "rows")
    asking = F.col("vec_id") % every == 0
    per = F.greatest(F.lit(64), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim") + 1))))
    counted = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(asking, 1)).alias("asked"))
    share = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / per)).cast("int")
    series = F.least(F.lit(SERIES), F.ceil(F.col("blocks") / LEAST_SERIES)).cast("int")
    sizes = stored(counted.select("dim", "n", share("n").alias("blocks"), share("asked").alias("queues")).withColumn("series", series), folder, "sizes")
    held = stored(first_copies(rows, k + 1), folder, "held")
    hot = hot_keys(sizes, ["dim"], "n")
    dealt = joined_apart(held, sizes, hot, ["dim"]).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("s", F.floor(F.col("b") / F.col("series")).cast("int"))
    files = stored(_files(dealt), folder, "files")
    asks = rows.filter(asking)
    sent = joined_apart(asks, sizes, hot, ["dim"]).withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.col("queues")).cast("int"))
    sent = sent.withColumn("s", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / F.col("series")).cast("int"))))
    found = stored(_scanned(files, sent, k), folder, "found")
    left = found.join(_kth(found, "lower", k), "query_id", "left").filter("least is null or upper >= least").select("query_id", "vec_id", "upper")
    w = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    left = stored(left.withColumn("place", F.row_number().over(w)), folder, "left")
    first = _read(left.filter(F.col("place") <= FIRST * k).select("query_id", "vec_id"), held, asks, folder, "first")
    rest = left.filter(F.col("place") > FIRST * k).join(_kth(first, "score", k), "query_id").filter("upper >= least").select("query_id", "vec_id")
    return merged(first.unionByName(_read(rest, held, asks, folder, "rest")), k)
