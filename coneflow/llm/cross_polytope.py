"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are cut into bands of length, STEPS to a factor of two, and brought to
the unit sphere by the longest of their band; one more component makes up for
the length. Queries are scaled to length one and have nothing in that component,
so that in a band the nearest point is the one of largest inner product. Points
are rotated by fast Hadamard pseudo-rotations and hashed to the nearest signed
axis. Each of TABLES independent tables is probed in every band at the axes
nearest to the query, and what they hold is ranked by exact products of the
original vectors. Every band is hashed, whatever its size.

How many axes are probed is fitted for each band to a sample (SAMPLE rows and
ASKING queries of least hash for each vector length): as many as find TARGET of
the k rows that are nearest in the sample. In the whole table the k nearest are
nearer, so more of them are found; where long vectors win whatever their
direction, more axes are probed, and fewer where vectors lie in clusters. Bands
that hold none of the sample's nearest rows are probed at a share of PROBES.

The axes of a band are dealt to as many groups as hold about BLOCK rows each,
and a group with more rows (a hot axis) is cut into salted blocks. A vector is
sent to its group's block once for each table (once more for every QUERIES
queries, which bounds the time of a task); a query goes to the groups that hold
an axis it probes. Each block reads its queries batch by batch and returns k rows
of each. Of equal vectors only the k + 1 smallest ids are candidates: ties go to
smaller ids and one may be the query's own, so no others can be found.

On vectors without any structure the probes needed for recall 0.9 reach about
half of all rows (see the README); clustered vectors need fewer. A query whose
probes met fewer than k rows is compared with all rows of its length, so its
list is short only if there are no more candidates.

Defined results: vectors that are null, zero, or hold nulls or numbers that
aren't finite take no part, nor do rows without an id; rows that repeat an id
count once; vectors of different length never meet; ties go to the smaller id.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_keys, joined, joined_apart, shared_folder, stored
from .vectors import best, first_copies, matrix, merged, one_row_per_id

TABLES, PROBES, BLOCK, QUERIES = 4, 0.23, 16384, 1 << 20
SAMPLE, ASKING, TARGET = 4096, 256, 0.94
#: Bytes of a sample at most, whatever the vectors' length.
SAMPLE_BYTES = 1 << 26
STEPS = 2
#: In place of a table's number and of an axis: all rows of a group are compared.
WHOLE = -1
#: Products that one task holds at once, and queries that it ranks at once.
SCORES, SLICE = 1 << 22, 2048
_KEY = ["dim", "table", "grp", "band", "cut", "turn"]
_PLACED = "dim int, table int, grp int, band int, asks boolean, vec_id bigint, vec array<double>, axes array<int>"
_NAMES = [c.split()[0] for c in _PLACED.split(", ")]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    x = x.copy()
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def padded(dim: int) -> int:
    """The least power of two, and at least 2, that holds one component more."""
    return 1 << max(1, int(dim).bit_length())


def rotated(vectors: np.ndarray, longest: np.ndarray, table: int, seed: int = 7) -> np.ndarray:
    """Unit vectors of one more component, padded to a power of two, after three rounds of signs and Hadamard transforms.

    ``longest``: for each row the length that counts as one, for queries their own.
    """
    n, dim = vectors.shape
    width = padded(dim)
    x = np.zeros((n, width))
    x[:, :dim] = vectors / longest[:, None]
    x[:, dim] = np.sqrt(np.maximum(0.0, 1.0 - (x[:, :dim] ** 2).sum(axis=1)))
    rng = np.random.default_rng([seed, table, width])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def axes(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: 2 * component, plus 1 if negative."""
    at = np.abs(x).argmax(axis=1)
    return 2 * at + (x[np.arange(len(x)), at] < 0)


def probes(x: np.ndarray, n_probes: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first."""
    signed = np.empty((len(x), 2 * x.shape[1]))
    signed[:, 0::2], signed[:, 1::2] = x, -x
    return np.argsort(-signed, axis=1, kind="stable")[:, :n_probes]


def fitted(rows: DataFrame, asking: DataFrame, tables: int, k: int) -> DataFrame:
    """(dim, band, probes): how many axes to probe in the bands that hold nearest rows of the sample.

    ``rows``: dim, band, longest, vec_id, vec; ``asking``: dim, vec_id, vec.
    """

    def run(group: pa.Table) -> pa.Table:
        asks, ids, x = group["asks"].to_numpy(), group["vec_id"].to_numpy(), matrix(group["vec"])
        band, longest = group["band"].to_numpy(), group["longest"].to_numpy()
        q, q_ids, x, ids, band, longest = x[asks], ids[asks], x[~asks], ids[~asks], band[~asks], longest[~asks]
        need: list[int] = []
        bands = np.empty(0, np.int32)
        if len(q) and len(x):
            scores = q @ x.T
            scores[q_ids[:, None] == ids[None, :]] = -np.inf
            r, c = np.nonzero((scores >= -np.partition(-scores, min(k, len(x)) - 1, axis=1)[:, [min(k, len(x)) - 1]]) & (scores > -np.inf))
            least = np.full(len(r), 2 * padded(x.shape[1]))
            for t in range(tables):
                order = probes(rotated(q, np.sqrt((q * q).sum(axis=1)), t), 2 * padded(x.shape[1]))
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
                np.minimum(least, place[r, axes(rotated(x, longest, t))[c]], out=least)
            bands = np.unique(band[c])
            for b in bands:
                own = np.sort(least[band[c] == b])
                need.append(int(own[min(len(own) - 1, int(TARGET * len(own)))]) + 1)
        return pa.table({"dim": pa.array([group["dim"][0].as_py()] * len(need), pa.int32()), "band": pa.array(bands, pa.int32()), "probes": pa.array(need, pa.int32())})

    most = F.least(F.lit(SAMPLE), F.floor(F.lit(SAMPLE_BYTES) / (8 * F.col("dim"))) + 1)
    w = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id")
    least_hash = lambda df, n: df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    some = least_hash(rows, SAMPLE).filter(F.col("place") <= most).select("dim", "vec_id", "vec", "band", "longest", F.lit(False).alias("asks"))
    few = least_hash(asking, ASKING).filter(F.col("place") <= most).select("dim", "vec_id", "vec", F.lit(0).alias("band"), F.lit(1.0).alias("longest"), F.lit(True).alias("asks"))
    return some.unionByName(few).groupBy("dim").applyInArrow(run, "dim int, band int, probes int")


def placed(rows: DataFrame, tables: int) -> DataFrame:
    """For each table a row with the group and the axis that a vector lies in; of queries one for each group that holds axes they probe.

    ``rows``: dim, band, groups, asks, vec_id, vec, longest (of the band, for queries their own length), probes.
    """

    def run(batches):
        for batch in batches:
            dims, n_groups, counts = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(7).to_numpy()
            asks, longest, vectors = batch.column(3).to_numpy(zero_copy_only=False), batch.column(6).to_numpy(), batch.column(5)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x, ask = matrix(pa.chunked_array([vectors.take(pa.array(at))])), asks[at]
                data, query = at[~ask], at[ask]
                for t in range(tables):
                    r = rotated(x, longest[at], t)
                    axis = axes(r[~ask])
                    yield from out(batch, data, t, axis % n_groups[data], axis, np.arange(len(data) + 1))
                    for n in np.unique(counts[query]):
                        own = query[counts[query] == n]
                        p = probes(r[ask][counts[query] == n], int(n))
                        group = p % n_groups[own][:, None]
                        order = np.argsort(group, axis=1, kind="stable")
                        p, group = np.take_along_axis(p, order, 1), np.take_along_axis(group, order, 1)
                        first = np.c_[np.ones((len(p), 1), bool), group[:, 1:] != group[:, :-1]]
                        yield from out(batch, own[np.nonzero(first)[0]], t, group[first], p.ravel(), np.r_[np.flatnonzero(first.ravel()), p.size])

    def out(batch, at, t, group, axis, begin):
        for s in range(0, len(at), 4096):
            take, ends = pa.array(at[s : s + 4096]), begin[s : s + 4097]
            lists = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(axis[ends[0] : ends[-1]], pa.int32()))
            own = {"dim": batch.column(0), "band": batch.column(1), "asks": batch.column(3), "vec_id": batch.column(4), "vec": batch.column(5)}
            columns = {c: v.take(take) for c, v in own.items()} | {"table": pa.array(np.full(len(take), t), pa.int32()), "grp": pa.array(group[s : s + 4096], pa.int32()), "axes": lists}
            yield pa.RecordBatch.from_arrays([columns[c] for c in _NAMES], names=_NAMES)

    return rows.select("dim", "band", "groups", "asks", "vec_id", "vec", "longest", "probes").mapInArrow(run, _PLACED)


class Block:
    """The vectors of one block, by axis."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts)
        axis = table["axes"].combine_chunks().flatten().to_numpy()
        order = np.argsort(axis, kind="stable")
        self.x, self.ids, self.axis = matrix(table["vec"])[order], table["vec_id"].to_numpy()[order], axis[order]
        self.size = float(np.sqrt((self.x**2).sum(axis=1)).max())

    def rank(self, asking: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
        """query ids, ids and scores of the k best that each query meets."""
        q, q_ids = matrix(pa.chunked_array([asking.column("vec")])), asking.column("vec_id").to_numpy()
        lists = asking.column("axes")
        who_all, axis = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        order = np.argsort(axis, kind="stable")
        who_all, axis = who_all[order], axis[order]
        size = float(np.sqrt((q**2).sum(axis=1)).max())
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        for a in np.intersect1d(axis, self.axis):
            lo, hi = np.searchsorted(self.axis, [a, a + 1])
            x, ids = self.x[lo:hi], self.ids[lo:hi]
            every = who_all[slice(*np.searchsorted(axis, [a, a + 1]))]
            step = max(1, SCORES // len(x))
            for who in (every[s : s + step] for s in range(0, len(every), step)):
                scores = q[who] @ x.T
                scores[q_ids[who][:, None] == ids[None, :]] = -np.inf
                r, c = best(scores, k, 1e-9 * size * self.size)
                found[0].append(q_ids[who[r]])
                found[1].append(ids[c])
                found[2].append((q[who[r]] * x[c]).sum(axis=1))  # summed alike wherever the pair meets: ties stay ties
        fq, fv, fs = map(np.concatenate, found)
        order = np.lexsort((fv, -fs, fq))
        starts = np.flatnonzero(np.r_[True, fq[order][1:] != fq[order][:-1]]) if len(order) else np.empty(0, int)
        keep = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k]
        return fq[keep], fv[keep], fs[keep]


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): in each block (_KEY) its vectors are held, and its queries pass by."""

    def run(batches):
        now, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_KEY, "asks")])
            edges = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0), True])
            for lo, hi in zip(edges, edges[1:]):
                key = tuple(marks[:-1, lo])
                if key != now:
                    now, parts, block = key, [], None
                if not marks[-1, lo]:
                    parts.append(batch.slice(lo, hi - lo).select(["vec_id", "vec", "axes"]))
                elif parts:
                    block = block or Block(parts)
                    for s in range(lo, hi, SLICE):
                        found = block.rank(batch.slice(s, min(SLICE, hi - s)), k)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*_KEY, "asks", "vec_id", "vec", "axes").repartition(n, *_KEY).sortWithinPartitions(*_KEY, "asks")
    return ordered.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def search(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, tables: int = TABLES, probe_share: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k nearest found.

    ``tables`` and ``probe_share`` (of the signed axes, in each table; fitted if absent) set the recall.
    """
    folder = shared_folder(table.sparkSession)
    rows = one_row_per_id(table, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0.0))
    largest = F.array_max(F.transform("vec", F.abs))
    length = F.col("largest") * F.sqrt(F.aggregate(F.transform("vec", lambda x: x / F.col("largest")), F.lit(0.0), lambda s, x: s + x * x))
    rows = stored(rows.withColumn("largest", largest).withColumn("length", F.least(length, F.lit(1e308))).drop("largest"), folder, "rows")
    asking = rows.filter(F.col("vec_id") % every == 0)
    # Bands below the longest of each dim, which has some room so that equal lengths fall together whatever their rounding.
    top = stored(rows.groupBy("dim").agg(F.max("length").alias("top"), F.count("*").alias("many"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")), folder, "top")
    turns = max(1, -(-(top.agg(F.sum("asked")).first()[0] or 0) // QUERIES))
    held = joined(first_copies(rows, k + 1), top, ["dim"], "many")
    held = held.withColumn("band", F.floor((F.log2("top") - F.log2("length") + 1e-6) * STEPS).cast("int")).drop("top", "many", "asked")
    held = stored(held, folder, "held")
    bands = held.groupBy("dim", "band").agg(F.max("length").alias("longest"), F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / block).cast("int"))
    share = F.floor(F.lit(PROBES if probe_share is None else probe_share) * 4 * F.pow(F.lit(2.0), F.floor(F.log2("dim"))) + 0.5)
    bands = stored(bands.withColumn("usual", F.greatest(F.lit(1), share).cast("int")), folder, "bands")
    held = joined(held.drop("length"), bands, ["dim", "band"], "n").withColumn("asks", F.lit(False))
    asking = asking.withColumn("asks", F.lit(True))
    if probe_share is None:
        fit = stored(fitted(held, asking, tables, k), folder, "fitted")
        bands = bands.join(fit, ["dim", "band"], "left").withColumn("probes", F.coalesce("probes", "usual"))
    else:
        bands = bands.withColumn("probes", F.col("usual"))
    by_id = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")

    def whole(df: DataFrame) -> DataFrame:
        return df.withColumns({"table": F.lit(WHOLE), "grp": F.lit(0), "band": F.lit(WHOLE), "axes": F.array(F.lit(WHOLE))}).select(_NAMES)

    def met(data: DataFrame, asks: DataFrame, name: str) -> DataFrame:
        """The k best of each query in each block of the groups it asks."""
        key = _KEY[:4]
        sizes = stored(data.groupBy(key).agg(F.count("*").alias("n")).withColumn("cuts", F.ceil(F.col("n") / block).cast("int")), folder, f"sizes_{name}")
        hot = hot_keys(sizes, key, "n")
        data = joined_apart(data, sizes, hot, key).withColumn("cut", by_id(F.col("cuts"))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        asks = joined_apart(asks, sizes, hot, key).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("turn", by_id(F.lit(turns)))
        columns = [*_NAMES, "cut", "turn"]
        return ranked(data.select(columns).unionByName(asks.select(columns)), k)

    data = stored(placed(held.withColumn("probes", F.lit(0)), tables), folder, "data")
    asked = asking.join(bands.select("dim", "band", "groups", "probes"), "dim")
    asks = placed(asked.withColumn("longest", F.col("length")), tables)
    found = stored(met(data, stored(asks, folder, "asks"), "all"), folder, "found")
    # Queries that found fewer than k rows, though their dim has more, go through all rows of the dim.
    have = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("have")).withColumnRenamed("query_id", "vec_id")
    short = joined(asking.select("dim", "vec_id"), top.select("dim", "many"), ["dim"], "many").join(have, "vec_id", "left")
    short = stored(short.filter(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.col("many") - 1)).select("vec_id", "dim"), folder, "short")
    if short.take(1):
        rest = stored(whole(held.join(short.select("dim").distinct(), "dim", "left_semi")), folder, "rest")
        found = found.unionByName(met(rest, whole(asking.join(short.select("vec_id"), "vec_id", "left_semi")), "rest"))
    return merged(found, k)
