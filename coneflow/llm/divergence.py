"""Source divergence audit by in-mapper stripes.

Each partition folds whole documents into hash stripes: a term of a language has
its document frequency and its counts by source. A task that holds too many
cells spills its stripes into the shuffle. Spilled stripes meet sorted by
(term, language) and are merged as a stream, one key at a time. What is kept
after merging (terms in enough documents) directly emits divergences: every
source's smoothed share of a term against every other source's, and against the
language's. Shares are integers, so sums hang on no order of rows.

Defined results: null text, language and source are empty strings; a source
without kept terms, and a language without any, still has its pairs (with value
0 in the latter case); a document that stands in the table twice counts twice;
an empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder, stored

#: Bytes of terms are ASCII letters and all of other characters; capitals become small, the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Cells (a term's frequency, or its count in a source) that a task holds before it spills; rows of a batch sent.
CELLS, BATCH = 500_000, 20_000
#: Terms that one task compares at once, and numbers (terms x sources, or sources x sources) that it holds for that.
TERMS, NUMBERS = 4096, 1 << 20
STRIPE = "lang string, term binary, df bigint, sources array<string>, counts array<bigint>"
FOUND = "lang string, source string, part string, item string, value bigint"


def _batch(langs: list, terms: list, df: list, stripes: list[dict], names: pa.Array) -> pa.RecordBatch:
    """Rows of stripes {place in ``names``: count}."""
    ends = np.cumsum([0, *map(len, stripes)])
    places = np.fromiter(chain.from_iterable(stripes), np.int32, ends[-1])
    counts = np.fromiter(chain.from_iterable(s.values() for s in stripes), np.int64, ends[-1])
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (names.take(pa.array(places)), pa.array(counts))]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(df, pa.int64()), *lists], names=["lang", "term", "df", "sources", "counts"])


def _spilled(held: dict, places: dict[str, int]):
    """Batches of the stripes held; the frequency stands at -1."""
    names = pa.array(list(places), pa.string())
    for lang, stripes in held.items():
        terms, rows = list(stripes), list(stripes.values())
        df = [stripe.pop(-1) for stripe in rows]
        for at in range(0, len(rows), BATCH):
            part = slice(at, at + BATCH)
            yield _batch([lang] * len(rows[part]), terms[part], df[part], rows[part], names)


def _folded(most: int):
    """Stripes of (language, source, text) rows, ``most`` cells at a time. The empty term counts a language's documents by source."""

    def run(batches):
        held, cells, places = {}, 0, {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                stripes, place = held.setdefault(lang, {}), places.setdefault(source, len(places))
                terms = Counter(text.as_py().translate(_TERM_BYTES).split())
                terms[b""] = 1
                for term, n in terms.items():
                    if (stripe := stripes.get(term)) is None:
                        stripes[term] = {-1: 1, place: n}
                        cells += 2
                    else:
                        stripe[-1] += 1
                        if place in stripe:
                            stripe[place] += n
                        else:
                            stripe[place] = n
                            cells += 1
                if cells > most:
                    yield from _spilled(held, places)
                    held, cells, places = {}, 0, {}
        yield from _spilled(held, places)

    return run


def _merged(least: int):
    """Stripes of sorted rows with equal keys as one, if enough documents have the term.

    Frequencies are summed by batch; only stripes that are kept, and those at the
    edges of a batch, are added up cell by cell.
    """

    def run(batches):
        places: dict[str, int] = {}
        out, key, df, stripe = [], None, 0, {}

        def close():
            if key and (df >= least or not key[1]):
                out.append((*key, df, stripe))

        def sent():
            langs, terms, n, stripes = map(list, zip(*out, strict=True))
            return _batch(langs, terms, n, stripes, pa.array(list(places), pa.string()))

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            new = pc.or_(pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)), pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)))
            start = np.flatnonzero(np.concatenate([[True], new.to_numpy(zero_copy_only=False)]))
            end = np.append(start[1:], len(n))
            total = np.add.reduceat(n, start)
            needed = (total >= least) | (pc.binary_length(term).to_numpy()[start] == 0)
            needed[[0, -1]] = True
            sources, counts = batch.column(3), batch.column(4)
            for g in np.flatnonzero(needed):
                at = (lang[start[g]].as_py(), term[start[g]].as_py())
                if at != key:
                    close()
                    key, df, stripe = at, 0, {}
                df += int(total[g])
                of, size = sources.slice(start[g], end[g] - start[g]).flatten().to_pylist(), counts.slice(start[g], end[g] - start[g]).flatten().to_pylist()
                for s, c in zip(of, size, strict=True):
                    place = places.setdefault(s, len(places))
                    stripe[place] = stripe.get(place, 0) + c
            if len(out) > BATCH:
                yield sent()
                out.clear()
        close()
        if out:
            yield sent()

    return run


def shares(counts: np.ndarray, total: np.ndarray, add: int, scale_digits: int) -> np.ndarray:
    """1 + floor(10**scale_digits * (counts + add) / total), by long division, so that nothing passes 64 bits."""
    rest, out = counts + add, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(scale_digits):
        rest = rest * 10
        digit = rest // total
        out, rest = out * 10 + digit, rest - digit * total
    return out + 1


def _compared(add: int, digits: int, most: int):
    """Sums over a shard of a language's terms for a block of its sources, and the block's best terms."""

    def run(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, block = (x.as_py() for x in key)
        groups = groups.sort_by("place")
        names, blocks = groups["source"].to_pylist(), groups["block"].to_numpy()
        place = {s: i for i, s in enumerate(names)}
        words, stripes = terms["term"].to_pylist(), terms["sources"].combine_chunks()
        counts = np.zeros((len(words), len(names)), np.int64)
        if len(words):
            row = np.repeat(np.arange(len(words)), np.diff(stripes.offsets.to_numpy()))
            col = np.fromiter(map(place.__getitem__, stripes.flatten().to_pylist()), int, len(row))
            counts[row, col] = terms["counts"].combine_chunks().flatten().to_numpy()
            size = add * groups["kept"][0].as_py()
            p = shares(counts, groups["n"].to_numpy() + size, add, digits)
            q = shares(counts.sum(axis=1), groups["lang_n"][0].as_py() + size, add, digits)
        out = []
        for i in np.flatnonzero(blocks == block):
            sums = np.abs(p - p[:, i : i + 1]).sum(axis=0).tolist() if len(words) else [0] * len(names)
            out += [(lang, names[i], "pair", other, v) for other, v in zip(names, sums, strict=True) if other != names[i]]
            if len(words):
                over = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
                f = (p[:, i] - q)[over]
                if len(over) > most:
                    near = f >= np.partition(f, len(f) - most)[len(f) - most]
                    over, f = over[near], f[near]
                best = sorted(zip((-f).tolist(), map(words.__getitem__, over)))[:most]
                out += [(lang, names[i], "term", w, -v) for v, w in best]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.string()] * 3 + [pa.binary(), pa.int64()]
        items = pa.array([x.encode() if isinstance(x, str) else x for x in columns[3]], pa.binary()).cast(pa.string())
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True) if k != pa.binary()]
        return pa.Table.from_arrays([*made[:3], items, made[3]], names=["lang", "source", "part", "item", "value"])

    return run


def stripes_of(docs: DataFrame, least: int, folder: str, cells: int = CELLS) -> DataFrame:
    """(lang, term, df, sources, counts) of terms in at least ``least`` documents of a language; the empty term has all its sources."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    spilled = rows.mapInArrow(_folded(cells), STRIPE).repartition("lang", "term").sortWithinPartitions("term", "lang")
    return stored(spilled.mapInArrow(_merged(least), STRIPE), folder, "stripes")


def divergences(docs: DataFrame, least: int = 30, add: int = 5, digits: int = 9, most: int = 50, cells: int = CELLS, at_once: int = TERMS, numbers: int = NUMBERS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows tell how far a source is from each other one of its language,
    ``term`` rows the ``most`` terms that it has more of than the language as a whole.

    A share is 1 + floor(10**digits * (count + add) / (sum of counts + add * terms)).
    ``cells``, ``at_once`` and ``numbers`` bound what a task holds and change no result.
    """
    folder = shared_folder(docs.sparkSession)
    stripes = stripes_of(docs, least, folder, cells)
    kept = stripes.filter(F.length("term") > 0)
    cell = F.explode(F.arrays_zip("sources", "counts")).alias("x")
    sums = kept.select("lang", cell).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = stripes.groupBy("lang").agg(F.count_if(F.length("term") > 0).alias("kept"), F.max(F.when(F.length("term") == 0, F.size("sources"))).cast("long").alias("of"), F.sum(F.when(F.length("term") > 0, F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0)).alias("lang_n"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("kept") / at_once), F.ceil(F.col("kept") * F.col("of") / numbers)).cast("int")
    wide = F.greatest(F.lit(1), F.floor(F.lit(numbers) / F.col("of"))).cast("int")  # sources of a block
    langs = stored(langs.withColumn("shards", shards).withColumn("wide", wide).withColumn("blocks", F.ceil(F.col("of") / F.col("wide")).cast("int")), folder, "langs")
    names = stripes.filter(F.length("term") == 0).select("lang", F.posexplode(F.array_sort("sources")).alias("place", "source"))
    groups = names.join(sums, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", "place", F.coalesce("n", F.lit(0)).alias("n"), "kept", "lang_n", F.floor(F.col("place") / F.col("wide")).cast("int").alias("block"), "shards", "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    groups = groups.withColumn("shard", every("shards")).withColumn("of_block", every("blocks")).drop("shards", "blocks")
    groups = groups.toDF(*groups.columns)  # columns of its own: both sides come from the stripes
    terms = kept.join(langs.select("lang", "shards", "blocks"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
    terms = terms.withColumn("of_block", every("blocks")).select("lang", "shard", "of_block", "term", "sources", "counts")
    keys = ["lang", "shard", "of_block"]
    found = stored(terms.groupBy(*keys).cogroup(groups.groupBy(*keys)).applyInArrow(_compared(add, digits, most), FOUND), folder, "found")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= most)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
