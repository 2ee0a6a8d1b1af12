"""Exact removal of repeated byte strings with suffix arrays over shards.

Every string of LENGTH bytes (a window) holds a rarest-hashed piece of PIECE
bytes, its anchor: equal windows have equal anchors at equal places, so windows
that share an anchor can be sorted apart from all others. A text is cut into
runs of neighbouring windows with one anchor; a run's bytes are a segment.

1. Anchors are counted over all texts. A run whose anchor occurs once is unique.
2. Equal segments of an anchor (by two 64-bit hashes) are one string with a
   number of copies: all windows of a string with several copies are repeated.
   So an anchor with one string needs no sorting.
3. One copy of each string of anchors with several is fetched, anchors are dealt
   to shards of a bounded size, and each shard's suffix array is induced.
   A window is repeated if its permuted common prefix, or that of the suffix
   after it, reaches LENGTH.
4. Anchors with more than HOT different segments (a passage inside very many
   texts) would make a shard too large: their runs are halved instead, again and
   again, at places fixed relative to the anchor. A part that equals another is
   repeated; a part whose windows all hold a string that no other part has is
   unique; only what is left is halved further, to single windows.

Repeated windows become spans of their texts, and what no span covers is kept.
Rows are numbered in a stored table, so no two of them are ever taken for one;
runs are joined with the counts of their keys such that hot keys aren't shuffled.

Defined results: null text is empty; texts shorter than LENGTH stay whole; rows
that repeat a doc_id, or have none, are texts of their own; equal rows count as
copies of each other. Matches never cross texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, given_back, joined, shared_folder, stored
from .shingles import mixed, prefix_sums
from .suffix_sort import permuted_prefixes, suffix_array

LENGTH, PIECE, HOT, SHARD_BYTES = 200, 48, 4096, 500_000
#: Texts are cut into runs in stretches of so many windows, so that places fit beside a hash.
STRETCH = 1 << 22


def runs(data: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, ...]:
    """anchor, segment hash, first window, number of windows, and the anchor's place in the segment, of each run."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    sums, up = prefix_sums(data)
    hashes = mixed((sums[piece:] - sums[:-piece]) * up[: n - piece + 1])
    width = length - piece + 1  # pieces in a window
    firsts, places = [], []
    for at in range(0, n - length + 1, STRETCH):
        h = hashes[at : at + STRETCH + width - 1]
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        firsts.append(first + at)
        places.append(place[first] + at)
    first, place = np.concatenate(firsts), np.concatenate(places)
    count = np.diff(np.r_[first, n - length + 1])
    end = first + count - 1 + length
    segment = mixed((sums[end] - sums[first]) * up[first] + (count.astype(np.uint64) << np.uint64(20)) + (place - first).astype(np.uint64))
    return hashes[place].view(np.int64), segment.view(np.int64), first, count, place - first


def _packed(docs: DataFrame) -> DataFrame:
    """kept, id, and the text as compressed bytes, which is what is stored and crosses the network."""

    def run(batches):
        given_back()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], names=["kept", "id", "packed"])

    return docs.select("kept", "id", "text").mapInArrow(run, f"kept {docs.schema['kept'].dataType.simpleString()}, id bigint, packed binary")


def _cut(rows: DataFrame, length: int, piece: int) -> DataFrame:
    """A row for each run of each text."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ids = part.column(0).to_numpy()
                found = [runs(np.frombuffer(zlib.decompress(t), np.uint8), length, piece) for t in part.column(1).to_pylist()]
                n = [len(f[0]) for f in found]
                if not sum(n):
                    continue
                anchor, segment, first, count, place = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(segment), pa.array(np.repeat(ids, n)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(place.astype(np.int16))], names=["anchor", "segment", "id", "first", "count", "place"])

    return rows.select("id", "packed").mapInArrow(run, "anchor bigint, segment bigint, id bigint, first int, count smallint, place smallint")


def _fetched(samples: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Add the bytes of each sample segment (anchor, copies, variants, id, first, count, place)."""
    wanted = samples.groupBy("id").agg(F.collect_list(F.struct("anchor", "copies", "variants", "first", "count", "place")).alias("want"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out: list[list] = [[] for _ in range(8)]
                for r in batch.slice(lo, 64).to_pylist():
                    data = zlib.decompress(r["packed"])
                    for w in r["want"]:
                        row = (w["anchor"], w["copies"], w["variants"], r["id"], w["first"], w["count"], w["place"], data[w["first"] : w["first"] + w["count"] - 1 + length])
                        for c, v in zip(out, row):
                            c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    names = ["anchor", "copies", "variants", "id", "first", "count", "place", "bytes"]
    return rows.select("id", "packed").join(wanted, "id").mapInArrow(run, "anchor bigint, copies bigint, variants bigint, id bigint, first int, count smallint, place smallint, bytes binary")


def repeated_windows(segments: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment: which of its first ``counts`` windows start anywhere else in the shard."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    begin = np.r_[0, np.cumsum(sizes + 1)]
    text[begin[1:] - 1] = 0
    array = suffix_array(text)
    prefix = permuted_prefixes(text, array)
    repeated = prefix >= length
    repeated[array[:-1]] |= repeated[array[1:]]
    return [repeated[b : b + c] for b, c in zip(begin, counts)]


def _spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_shards(fetched: DataFrame, shards: int, length: int) -> DataFrame:
    """Spans of single segments, from the suffix arrays of shards."""

    def run(group: pa.Table) -> pa.Table:
        segments = group["bytes"].to_pylist()
        first, count, copies = (group[c].to_numpy().astype(np.int64) for c in ("first", "count", "copies"))
        row, start, end = [], [], []
        for k, flags in enumerate(repeated_windows(segments, count, length)):
            if copies[k] == 1 and flags.any():
                a, b = _spans_of(flags)
                row.extend([k] * len(a))
                start.extend((first[k] + a).tolist())
                end.extend((first[k] + b - 1 + length).tolist())
        at = pa.array(row, pa.int64())
        return pa.table({"id": group["id"].take(at), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})

    return fetched.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(run, "id bigint, start int, end int")


def _halved(fetched: DataFrame, folder: str, length: int, piece: int) -> DataFrame:
    """Spans of the segments of hot anchors, by halving runs at places fixed to the anchor.

    A window's turn is the place of its anchor in it, so equal windows have
    equal turns, and a part holds the turns of one aligned block. ``whole`` is
    all that a part's windows cover, ``core`` what they have in common.
    """
    size = 1
    while 2 * size <= length - piece + 1:
        size *= 2
    columns = "anchor bigint, copies bigint, id bigint, first int, place int, bytes binary, low int, high int"
    place = F.col("place").cast("int")
    rows = fetched.withColumns({"low": place - F.col("count") + 1, "high": place + 1, "place": place})
    out, level = None, 0
    digest = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    while True:

        def parts(batches, size=size):
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    cut = []
                    for r in batch.slice(lo, 256).to_pylist():
                        for block in range(r["low"] // size, (r["high"] - 1) // size + 1):
                            low, high = max(r["low"], block * size), min(r["high"], (block + 1) * size)
                            whole = r["bytes"][r["place"] - high + 1 : r["place"] - low + length]
                            core = r["bytes"][r["place"] - block * size : r["place"] - (block + 1) * size + 1 + length]
                            cut.append({**r, "low": low, "high": high, "part": block, "whole": digest(whole), "core": digest(core)})
                    if cut:
                        yield pa.Table.from_pylist(cut, schema=schema).to_batches()[0]

        kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        full = f"{columns}, part int, whole binary, core binary"
        schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in full.split(", "))])
        cut = stored(rows.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(parts, full), folder, f"parts{level}")
        row = F.struct("id", "first", "place", "low", "high", "core", "bytes")
        wholes = cut.groupBy("anchor", "part", "whole").agg(F.sum("copies").alias("copies"), F.min(row).alias("r"))
        wholes = stored(wholes.select("anchor", "part", "whole", "copies", "r.*"), folder, f"wholes{level}")
        got = joined(cut.filter("copies = 1").drop("copies"), wholes.filter("copies > 1").select("anchor", "part", "whole", "copies"), ["anchor", "part", "whole"], "copies")
        start, end = F.col("first") + F.col("place") - F.col("high") + 1, F.col("first") + F.col("place") - F.col("low") + length
        found = got.select("id", start.cast("int").alias("start"), end.cast("int").alias("end"))
        out = found if out is None else out.unionByName(found)
        if size == 1:
            return out
        # One of each different part goes on, if its core lies in another part as well.
        cores = stored(wholes.groupBy("anchor", "part", "core").agg(F.count("*").alias("n")).filter("n > 1"), folder, f"cores{level}")
        rows = joined(wholes, cores, ["anchor", "part", "core"], "n")
        size //= 2
        level += 1


def spans(rows: DataFrame, folder: str, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(id, start, end): byte ranges that repeated windows cover, not yet merged. ``rows``: a stored table of id and packed text."""
    cut = stored(_cut(rows, length, piece), folder, "cut")
    anchors = stored(cut.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), folder, "anchors")
    seen = stored(joined(cut, anchors, ["anchor"], "n").drop("n"), folder, "seen")
    discard(rows.sparkSession, folder, "cut")
    segments = seen.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("id", "first", "count", "place")).alias("x")).select("anchor", "segment", "copies", "x.*")
    segments = stored(segments, folder, "segments")
    copied = segments.filter("copies > 1").select("anchor", "segment", "copies")
    end = (F.col("first") + F.col("count") - 1 + length).cast("int").alias("end")
    again = joined(seen, copied, ["anchor", "segment"], "copies").select("id", F.col("first").alias("start"), end)
    variants = stored(segments.groupBy("anchor").agg(F.count("*").alias("variants")).filter("variants > 1"), folder, "variants")
    samples = stored(joined(segments, variants, ["anchor"], "variants"), folder, "samples")
    few = F.col("variants") <= HOT
    total = samples.filter(few).agg(F.sum(F.col("count") - 1 + length)).first()[0] or 0
    out = again.unionByName(_sorted_shards(_fetched(samples.filter(few), rows, length), max(1, -(-total // SHARD_BYTES)), length))
    hot = samples.filter(~few)
    return out.unionByName(_halved(_fetched(hot, rows, length), folder, length, piece)) if hot.take(1) else out


def merged_spans(pairs: list, n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def kept_bytes(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in cuts:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def kept_text(data: bytes, cuts: list[tuple[int, int]]) -> str:
    """The text without the cuts; letters that a cut would split stay whole."""
    inside = lambda i: 0 < i < len(data) and 0x80 <= data[i] < 0xC0
    out = []
    for a, b in cuts:
        while inside(a) and a < b:
            a += 1
        while inside(b) and b > a:
            b -= 1
        out.append((a, b))
    return kept_bytes(data, out).decode("utf-8", "replace")


def dedup(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """``keep`` columns (doc_id by default), n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds spans and kept_text."""
    folder = shared_folder(docs.sparkSession)
    keep = [c for c in (keep or ["doc_id"]) if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    numbered = docs.select(F.struct(*keep).alias("kept"), F.monotonically_increasing_id().alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = stored(_packed(numbered), folder, "rows")
    # stored, so that the join below is one of two plain shuffles
    ranges = stored(spans(rows, folder, length).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), folder, "ranges")
    texts = rows.join(ranges, "id", "left").select("kept", "packed", "ranges")

    def run(batches):
        given_back()
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 64):
                part = batch.slice(lo, 64)
                out: list[list] = [[] for _ in range(6)]
                for packed, pairs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = zlib.decompress(packed)
                    cuts = merged_spans([(p["start"], p["end"]) for p in pairs or []], len(data))
                    row = [len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept_bytes(data, cuts)).hexdigest()]
                    row += [[list(c) for c in cuts], kept_text(data, cuts)] if with_text else []
                    for c, v in zip(out, row):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(out, kinds)][: len(names) - 1]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    names = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["spans", "kept_text"] if with_text else [])
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", spans array<array<int>>, kept_text string" if with_text else "")
    return texts.mapInArrow(run, schema).select("kept.*", *names[1:])
