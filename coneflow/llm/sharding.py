"""Sharding by a minimax contiguous partition of ordered atomic groups.

Documents with equal texts are one group; groups are ordered by 60 bits of the
text's md5 (two texts that share them count as one group). The smallest
capacity for which a greedy filling in that order needs no more than the wanted
shards is found by binary search, and shards are cut there, each cut as near to
an even share of what is left as that capacity allows.

The order is refined only where it matters. The first look is at sizes by the
leading 12 bits, on which the greedy check gives a lower bound of the capacity
(buckets can be cut anywhere) and an upper one (nowhere); only the buckets in
which some cut may fall are looked at with 8 more bits, until every cut is
between two groups. So the driver holds some ten thousand numbers whatever the
input, no group is gathered, and a document's shard follows from its own hash.
All work on rows is DataFrame operations.

Defined results: a null text has no bytes and goes with the empty ones; rows
that repeat a doc_id are rows of their own; with fewer groups than shards some
shards stay empty; an empty table gives no rows. Extra columns are ignored;
carried columns that bear the name of a result are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, shared_folder, stored

#: Bits of the order, those of the first look and those added by each further one, and buckets refined at a time.
KEY_BITS, FIRST_BITS, MORE_BITS, AT_ONCE = 60, 12, 8, 256


class Order:
    """Sizes along the order of groups, as buckets of keys: those that hold one group, and those that may hold more."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.buckets: dict[int, tuple[int, bool, int]] = {}  # first key: size, whether it is one group, bits
        self._take(F.shiftleft(F.shiftright("key", KEY_BITS - FIRST_BITS), KEY_BITS - FIRST_BITS), FIRST_BITS, rows)

    def _take(self, low, bits: int, rows: DataFrame) -> None:
        sums = rows.groupBy(low.alias("low")).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("one"))
        for r in sums.collect():  # at most 2**FIRST_BITS rows, or AT_ONCE * 2**MORE_BITS
            self.buckets[r["low"]] = (r["size"], r["one"], bits)
        self.lows = sorted(self.buckets)
        self.sizes = [self.buckets[k][0] for k in self.lows]
        self.one = [self.buckets[k][1] for k in self.lows]
        self.edges = [0, *accumulate(self.sizes)]

    @property
    def total(self) -> int:
        return self.edges[-1]

    def refine(self, wanted: set[int]) -> None:
        """Look at the largest of the wanted buckets with more bits."""
        chosen = sorted(wanted, key=lambda i: (-self.sizes[i], i))[:AT_ONCE]
        by_bits: dict[int, list[int]] = {}
        for low in [self.lows[i] for i in chosen]:
            by_bits.setdefault(self.buckets.pop(low)[2], []).append(low)
        for bits, lows in by_bits.items():
            more = min(KEY_BITS, bits + MORE_BITS)
            near = F.col("key").between(min(lows), max(lows) + (1 << (KEY_BITS - bits)) - 1)
            inside = F.shiftright("key", KEY_BITS - bits).isin([low >> (KEY_BITS - bits) for low in lows])
            self._take(F.shiftleft(F.shiftright("key", KEY_BITS - more), KEY_BITS - more), more, self.rows.filter(near & inside))

    def filled(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        """Ends of greedily filled shards; buckets of several groups can be cut ``anywhere`` or nowhere."""
        at, ends = 0, []
        for _ in range(shards):
            if (end := at + capacity) >= self.total:
                end = self.total
            else:
                i = bisect_right(self.edges, end) - 1  # the bucket in which it falls
                if self.one[i] or not anywhere:
                    end = self.edges[i]
            ends.append(at := end)
        return ends


def least_capacity(order: Order, shards: int, anywhere: bool) -> int:
    """Binary search for the smallest capacity at which ``shards`` greedily filled shards hold all."""
    low, high = -(-order.total // shards), order.total
    while low < high:
        mid = (low + high) // 2
        if order.filled(mid, shards, anywhere)[-1] >= order.total:
            high = mid
        else:
            low = mid + 1
    return low


def undecided(order: Order, shards: int) -> tuple[int, set[int]]:
    """The capacity by whole buckets, and the buckets of several groups in which a cut of a smaller one may fall."""
    low, high = least_capacity(order, shards, True), least_capacity(order, shards, False)
    first, last = [0, *order.filled(low, shards, False)], [0, *order.filled(high, shards, True)]
    found: set[int] = set()
    for a, b in zip(first[:-1], last[:-1], strict=True):
        i = bisect_right(order.edges, min(a + low, order.total - 1)) - 1
        j = bisect_right(order.edges, min(b + high, order.total - 1)) - 1
        found |= {k for k in range(i, j + 1) if not order.one[k]}
    return high, found


def even_cuts(order: Order, shards: int, capacity: int) -> tuple[list[int], set[int]]:
    """Edges between shards of at most ``capacity``, each nearest to an even share of what is left; and buckets in which one falls."""
    edges, total, inside = order.edges, order.total, set()

    def seen(i: int) -> None:
        if not order.one[i]:
            inside.add(i)

    latest = [total]  # the first edges from which the rest still fits
    for _ in range(shards - 1):
        i = bisect_left(edges, max(0, latest[-1] - capacity))
        if edges[i] != max(0, latest[-1] - capacity):
            seen(i - 1)
        latest.append(edges[i])
    cuts, at = [], 0
    for left, least in zip(range(shards, 1, -1), latest[:0:-1], strict=True):
        goal = at * left + total - at  # times ``left``
        i = bisect_right(edges, goal // left) - 1
        cut = edges[i]
        if i + 1 < len(edges) and cut * left != goal:
            seen(i)
            if 2 * goal > (cut + edges[i + 1]) * left:
                cut = edges[i + 1]
        if cut > at + capacity:
            i = bisect_right(edges, at + capacity) - 1
            if edges[i] != at + capacity:
                seen(i)
            cut = edges[i]
        cuts.append(at := max(cut, least, at))
    return cuts, inside


def cut_keys(rows: DataFrame, shards: int) -> list[int]:
    """The first keys of the second and all later shards, for rows of (key, size)."""
    order = Order(rows)
    if not order.total:
        return [1 << KEY_BITS] * (shards - 1)
    while True:
        capacity, wanted = undecided(order, shards)
        if not wanted:
            cuts, wanted = even_cuts(order, shards, capacity)
        if not wanted:
            return [order.lows[i] if (i := bisect_left(order.edges, c)) < len(order.lows) else 1 << KEY_BITS for c in cuts]
        order.refine(wanted)


def shard(docs: DataFrame, shards: int = 8, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns, size, text_crc32, law, shard, slot, grown_shard: every document's shard and its place there.

    ``law`` is ``bytes``: sizes are near equal, and equal texts stay together.
    Places follow the order of groups, and doc_id inside a group.
    """
    results = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    carry = [c for c in (carry or ["doc_id"]) if c not in results]
    folder = shared_folder(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    key = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    rows = stored(docs.select(F.struct(*carry).alias("kept"), "doc_id", key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), folder, "rows")
    cuts = cut_keys(rows.select("key", "size"), shards)
    of = sum(((F.col("key") >= c).cast("int") for c in cuts), F.lit(0))
    placed = numbered(rows.withColumn("shard", of), [F.col("shard"), F.col("key"), F.col("doc_id")], folder, "placed", within="shard")
    return placed.select("kept.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("number").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = 8) -> DataFrame:
    """Write whole documents as files below ``path/shard=N``, each in the order of its slots; returns the table of files' rows.

    Many tasks write a shard: slots are dealt by ranges, so a large shard is many files.
    """
    carried = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    out = shard(docs, shards, carry=carried)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
