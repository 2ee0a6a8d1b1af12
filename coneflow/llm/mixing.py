"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source's share of the budget is met by whole
passes over the source plus the documents whose hash lies below a threshold, so
a smaller budget's mix is contained in a larger one's. Thresholds come from
histograms of tokens by source and hash bucket; only the bucket in which a
budget ends is refined, and no row is ever sorted.

Defined results: null text has size 0; null sources form one source, last in
order; a document without words is taken with size 0; rows that repeat a doc_id
share its hash and so are taken or left together; an empty table gives an empty
mix. Extra columns are ignored; carried columns that bear the name of a result
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder, stored, word_count

#: Hashes have LEVELS * BITS bits; each level of the histogram looks at BITS of them.
BITS, LEVELS = 12, 5


def document_hash(doc_id: Column, seed: str) -> Column:
    """60 bits of md5, the same in any engine."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame, folder: str) -> DataFrame:
    """Position of each source in code-point order, nulls last, without a single-task window."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    ordered = stored(ordered, folder, "ordered").withColumn("part", F.shiftright("place", 33))
    parts = ordered.groupBy("part").count()  # one row for each partition of the sort
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(offsets, "part").select("source", "source_size", (F.col("before") + within).alias("position"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, folder: str) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all sizes divided by weight, at most ``most`` times a source.

    What exceeds a source's limit is divided again among the others. Each round
    is one sum over the sources and sends two numbers to the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    src = stored(_ranked(sizes, folder).withColumn("weight", weight.cast("long")), folder, "sources")
    total, all_weights = src.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return src.withColumn("target", F.lit(0.0))
    budget, capped, free, rate = share * total, -1, all_weights, 0.0
    limit = F.col("source_size") * F.lit(most)
    rate = budget / all_weights
    while True:
        over = F.col("weight") * F.lit(rate) > limit
        n, used, free = src.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, rate = n, (budget - used) / free
    return src.withColumn("target", F.least(F.col("weight") * F.lit(rate), limit))


def thresholds(slim: DataFrame, targets: DataFrame, folder: str) -> DataFrame:
    """(source, source_size, target, full, edge, whole): take ``full`` passes, and once more what hashes below ``edge``
    (and at it, if ``whole``)."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    src = targets.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    src = stored(src, folder, "passes")
    state = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        rows = slim.filter("size > 0").withColumn("bucket", F.shiftright("hash", shift))
        if state is None:
            base = src.select("source", "rest", F.lit(0).cast("long").alias("below"))
        else:  # only rows of the buckets in which a budget ends
            edge = state.select(F.col("source").alias("s"), F.col("bucket").alias("b"))
            rows = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("b")), "left_semi")
            base = state.select("source", "rest", "below")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2**BITS rows a source
        sums = sums.withColumn("upto", upto)
        b = base.select(F.col("source").alias("s"), "rest", F.col("below").alias("start"))
        ends = sums.join(b, F.col("source").eqNullSafe(F.col("s"))).filter(F.col("start") + F.col("upto") > F.col("rest"))
        state = ends.groupBy("source").agg(F.min_by(F.struct("bucket", "n", "least", "most", "rest", (F.col("start") + F.col("upto") - F.col("n")).alias("below")), "bucket").alias("x")).select("source", "x.*")
        state = stored(state, folder, f"edge{level}")
        if not state.filter("least < most").take(1):
            break
    done = state.select(F.col("source").alias("s"), F.col("least").alias("edge"), (F.col("below") + F.col("n") - F.col("rest") < F.col("rest") - F.col("below")).alias("whole"))
    return src.join(done, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "full", "edge", F.coalesce("whole", F.lit(False)).alias("whole"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``carry`` columns, size, source_size, target, copies, taken.

    ``copies`` is how often the mix holds the document and ``taken`` its words
    in the mix. Reruns agree: everything hangs on (seed, doc_id).
    """
    folder = shared_folder(docs.sparkSession)
    carry = [c for c in (carry or ["doc_id"]) if c not in ("size", "source_size", "target", "copies", "taken")]
    sized = docs.select(F.struct(*carry).alias("kept"), "doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), seed).alias("hash"))
    slim = stored(sized.select("doc_id", "source", "size", "hash"), folder, "slim")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    cut = stored(thresholds(slim, source_targets(sizes, weights, share, most, folder), folder), folder, "cut")
    cut = cut.withColumnRenamed("source", "of")
    rows = slim.withColumn("kept", F.struct(*carry)) if set(carry) <= {"doc_id", "source"} else sized
    below = F.coalesce((F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & F.col("whole")), F.lit(False))
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("copies", F.col("full") + below.cast("long"))
    return joined.select("kept.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
