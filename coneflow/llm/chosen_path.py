"""Near-duplicate documents by a chosen-path set similarity join.

A text is the set of its word shingles and a vector of minwise tokens. Texts
with the same set form a class at once. Each of several independent trees branches
the classes recursively: a node picks a few coordinates, and its members go to
the child named by their token at that coordinate, so similar texts stay
together. Nodes of at most SMALL members are compared exhaustively by their
signatures; a larger one compares its members with two of them (pivots), which
ends the branch if all belong together, and branches otherwise. A node that is
still large after LEVELS is compared exhaustively too, in blocks.

The pairs found join classes into clusters, and only then are texts read again:
within a cluster links are confirmed on full sets, in blocks of BLOCK texts (of
fewer, if they are long) that share two pivots. Where blocks leave parts of a cluster unconnected, those parts
are compared with every block, so that no link inside a cluster is lost. Neither
step emits all pairs of a group: a block returns one row for each text.

A pair at similarity p shares none of a tree's two first tokens with probability
(1 - p)^2; the number of trees follows from p such that all miss it with at most
MISS, one in a million, and so does the share of equal coordinates below which
a pair is not looked at further (binomial, over the COORDINATES that all trees
share). At p = 0.85 these are four trees (2.6e-7) and 39 of 64 coordinates, at
0.80 five trees (1.0e-7) and 34. Links at p are thus missed with less than two
in a million where nodes are small. A pair that shares large nodes down to the
last level can be parted at each of LEVELS levels, with at most (1 - p)^2 each,
so in a tree with at most (LEVELS + 1) (1 - p)^2, and in all trees with that to
the power of their number: 1.6e-4 at 0.85 and 3.2e-4 at 0.80, were trees
independent (below the roots they draw on the same coordinates, so it may be
more). What branches apart is joined again by any third text that is linked to both.

Defined results: null, empty and wordless texts have no shingles and stand
alone; texts of fewer words than a shingle are one shingle; rows without doc_id
stand alone with no component and are not kept; rows that repeat a doc_id are
one document. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, in_few_tasks, joined, shared_folder, stored
from .components import components
from .shingles import COORDINATES, Groups, minhash, set_key, shingle_set

BRANCHES, LEVELS, SMALL, BLOCK = 2, 4, 4096, 192
#: Chance at most that the trees, or the signatures, miss a pair of the least similarity asked for.
MISS = 1e-6
#: In large nodes members join a pivot's cluster from this share on: a wider cluster costs comparisons, never a link.
NEAR = 0.4
#: Nodes up to this size are compared many at a time.
PAIRWISE = 64
#: Rows and shingles that one group of the confirming step holds, about, and shingles in a block.
PACK, PACK_SHINGLES, BLOCK_SHINGLES = 1000, 1 << 22, 1 << 21
#: Places of at most so many texts (about 40 bytes each) are broadcast to the texts.
BROADCAST_ROWS = 1 << 20
_SIG = "sig array<int>"


def trees(percent: int) -> int:
    """Trees that together miss a pair at ``percent`` with at most MISS."""
    if not 26 <= percent <= 100:  # fewer would need more trees than there are coordinates for
        raise ValueError("percent must be from 26 to 100")
    return max(1, math.ceil(math.log(MISS) / (BRANCHES * math.log(1 - min(percent, 99) / 100))))


def alike(percent: int) -> int:
    """Most equal coordinates of which a pair at ``percent`` has fewer with at most MISS."""
    p, missed = percent / 100, 0.0
    for n in range(COORDINATES + 1):
        missed += math.comb(COORDINATES, n) * p**n * (1 - p) ** (COORDINATES - n)
        if missed > MISS:
            return n
    return COORDINATES


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), minhash signature and its low bytes of every row."""

    def run(batches):
        given_back()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                sizes, keys, sigs = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words)
                    sizes.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    sigs.append(minhash(s))
                flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)), pa.array(flat))
                code = pa.array([m.astype(np.uint8).tobytes() for m in sigs], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), sig, code], names=["doc_id", "n_shingles", "set_key", "sig", "code"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id bigint, n_shingles bigint, set_key binary, {_SIG}, code binary")


def whole_groups(batches, key: str):
    """Tables made of whole runs of equal keys from batches that are sorted by key."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and (not held or held[-1].column(key)[-1].as_py() == keys[-1]):
            held.append(batch)
            continue
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def compared(rows: DataFrame, least: int) -> DataFrame:
    """Edges (a, b) that span the similar members of each node, all of a node's pairs being compared.

    ``rows``: node, rep, label, code; nodes have a bounded number of members.
    Pairs are similar from ``least`` equal coordinates on.
    Members that bear the same label are known to belong together.
    """

    def run(batches):
        for table in whole_groups(batches, "node"):
            node, rep, label, sig = table["node"].to_numpy(), table["rep"].to_numpy(), table["label"].to_numpy(), _matrix(table["code"])
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[start, len(node)])
            out_a, out_b = [], []
            for at, n in zip(start[size > PAIRWISE], size[size > PAIRWISE]):
                own = slice(at, at + n)
                root = spanned(sig[own], least)
                joined = np.flatnonzero(root != np.arange(n))
                out_a.append(rep[own][joined])
                out_b.append(rep[own][root[joined]])
            left, right = [], []
            for g in np.unique(size[(size > 1) & (size <= PAIRWISE)]):
                i, j = np.triu_indices(g, 1)
                at = start[size == g]
                step = max(1, 100_000 // len(i))
                for k in range(0, len(at), step):
                    x = (at[k : k + step, None] + i).ravel()
                    y = (at[k : k + step, None] + j).ravel()
                    differ = label[x] != label[y]
                    x, y = x[differ], y[differ]
                    near = (sig[x] == sig[y]).sum(axis=1) >= least
                    left.extend(x[near].tolist())
                    right.extend(y[near].tolist())
            groups = Groups(len(node))
            for x, y in zip(left, right):
                groups.join(x, y)
            member = np.unique(np.array(left + right, int))
            root = np.array([groups.find(i) for i in member.tolist()], int)
            out_a.append(rep[member[root != member]])
            out_b.append(rep[root[root != member]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_b), pa.int64())], names=["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("node", "rep", "label", "code").repartition(n, "node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def spanned(sig: np.ndarray, least: int) -> np.ndarray:
    """For each member of one node the first member that it is connected with by similar pairs."""
    n = len(sig)
    equal = np.zeros((n, n), np.uint8)
    for column in sig.T:
        equal += column[:, None] == column[None, :]
    near = equal >= least
    root, seen = np.arange(n), np.zeros(n, bool)
    for i in range(n):
        if not seen[i]:
            edge = np.zeros(n, bool)
            edge[i] = seen[i] = True
            while edge.any():
                edge = near[edge].any(axis=0) & ~seen
                seen |= edge
                root[edge] = i
    return root


def _children(rows: DataFrame, level: int, first: int) -> DataFrame:
    """Branch every row (node, rep, label, sig) on BRANCHES coordinates of this level's range, chosen by the node. ``first``: coordinates of the roots."""
    width = (COORDINATES - first) // LEVELS
    base = first + (level - 1) * width
    pick = F.pmod(F.xxhash64("node", F.lit("pick")), F.lit(width)).cast("int")
    step = F.pmod(F.xxhash64("node", F.lit("step")), F.lit(width - 1)).cast("int") + 1
    at = [F.lit(base) + F.pmod(pick + step * k, F.lit(width)) for k in range(BRANCHES)]
    names = F.array(*[F.xxhash64("node", a, F.get("sig", a)) for a in at])
    return rows.select(F.explode(names).alias("node"), "rep", "label")


def candidates(reps: DataFrame, folder: str, percent: int) -> DataFrame:
    """Edges (a, b) that join all classes which some tree finds alike. ``reps``: rep, sig, code."""
    first, least = trees(percent) * BRANCHES, alike(percent)
    roots = F.array(*[F.xxhash64(F.lit(k // BRANCHES), F.lit(k), F.get("sig", F.lit(k))) for k in range(first)])
    rows = reps.select(F.explode(roots).alias("node"), "rep", F.col("rep").alias("label"))
    found = []
    for level in range(1, LEVELS + 2):
        rows = stored(rows, folder, f"rows{level}")
        by_hash = F.struct(F.xxhash64("rep", F.lit(level)).alias("h"), F.col("rep").alias("r"))
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(by_hash)["r"].alias("p1"), F.max(by_hash)["r"].alias("p2"))
        nodes = stored(in_few_tasks(nodes.filter("low < high").drop("low", "high"), rows.count()), folder, f"nodes{level}")
        members = joined(rows, nodes, ["node"], "n")
        coded = members.join(reps.select("rep", "code"), "rep")
        found.append(stored(compared(coded.filter(F.col("n") <= SMALL), least), folder, f"small{level}"))
        large = nodes.filter(F.col("n") > SMALL)
        if not large.take(1):
            break
        if level > LEVELS:  # the exact way for what is left: every pair of blocks
            blocks = F.ceil(F.col("n") / max(1, SMALL // 2)).cast("int")
            mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
            wide = coded.filter(F.col("n") > SMALL).withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
            wide = wide.withColumn("node", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")))
            found.append(stored(compared(wide, least), folder, "rest"))
            break
        big = members.filter(F.col("n") > SMALL).join(reps, "rep").select("node", "rep", "label", "sig", "code", "p1", "p2")
        big = stored(big, folder, f"big{level}")
        pivots = [big.filter(F.col("rep") == F.col(p)).select("node", F.col("sig").alias(f"{p}_sig")).dropDuplicates(["node"]) for p in ("p1", "p2")]
        same = lambda p: F.size(F.filter(F.zip_with("sig", f"{p}_sig", lambda x, y: x == y), lambda z: z)) >= NEAR * COORDINATES
        pivots = stored(large.select("node", "n").join(pivots[0], "node").join(pivots[1], "node"), folder, f"pivots{level}")
        near = joined(big, pivots, ["node"], "n").select("rep", F.explode(F.array(*[F.when(same(p) & (F.col("rep") != F.col(p)), F.col(p)) for p in ("p1", "p2")])).alias("b"))
        found.append(stored(near.filter("b is not null").select(F.col("rep").alias("a"), "b"), folder, f"near{level}"))
        # nodes whose members all belong together by now are done
        roots = components(_all(found), folder, f"labels{level}_")
        big = big.drop("label").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("root", "rep"))
        big = stored(big.select("node", "rep", "label", "sig", "code"), folder, f"labelled{level}")
        mixed = big.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low < high")
        mixed = stored(mixed.select("node", "n"), folder, f"mixed{level}")
        rows = _children(joined(big, mixed, ["node"], "n"), level, first)
        reps = stored(big.select("rep", "sig", "code").dropDuplicates(["rep"]), folder, f"reps{level}")
    return _all(found)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), parts)


def confirmed(docs: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) that span the links on full sets inside each block.

    ``placed``: rep, n_shingles, grp (the block), asks, comp. With ``asks`` null all pairs of
    a block are compared; otherwise only pairs of an asking and another row that
    differ in ``comp``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    n, shingles = placed.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    bins = max(1, -(-n // PACK), -(-shingles // PACK_SHINGLES))
    if n <= BROADCAST_ROWS:  # else texts and places meet by a shuffle
        placed = F.broadcast(placed)

    def run(group: pa.Table) -> pa.Table:
        grp = group["grp"].to_numpy()
        order = np.argsort(grp, kind="stable")
        a, b = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            own = group.take(pa.array(rows))
            rep = own["rep"].to_numpy()
            link = linked([shingle_set(t, words) for t in own["text"].to_pylist()], percent)
            asks = own["asks"].to_pylist()
            if asks[0] is not None:
                comp, asks = own["comp"].to_numpy(), np.array(asks)
                link &= (asks[:, None] | asks[None, :]) & (comp[:, None] != comp[None, :])
            groups = Groups(len(rows))
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(link, 1)))):
                groups.join(i, j)
            root = np.array([groups.find(i) for i in range(len(rows))])
            own = np.flatnonzero(rep != rep[root])
            a.extend(rep[own].tolist())
            b.extend(rep[root[own]].tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = placed.join(texts, "rep").select("grp", "rep", "asks", "comp", "text")
    return rows.withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins))).groupBy("bin").applyInArrow(run, "a bigint, b bigint")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For every pair of sets whether 100 * intersection >= percent * union, by products of blocks of the incidence matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(n), sizes)
    row, column = row[count[column] > 1], column[count[column] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
    both = np.zeros((n, n))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        lo, hi = np.searchsorted(column, [at, at + 8192])
        x = np.zeros((n, min(8192, int(column[hi - 1]) - at + 1)), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        both += x @ x.T
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents with 100 * intersection >= percent * union."""
    folder = shared_folder(docs.sparkSession)
    signed = stored(signatures(docs, words), folder, "signed")
    documents = signed.count()
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = stored(in_few_tasks(classes, documents), folder, "classes")
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").select(F.col("doc_id").alias("rep"), "sig", "code", "n_shingles").dropDuplicates(["rep"])
    reps = stored(in_few_tasks(reps, documents), folder, "reps")
    near = components(candidates(reps, folder, percent), folder, "near")
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    near = stored(in_few_tasks(near.join(reps.select("rep", "n_shingles"), "rep"), documents), folder, "clusters")
    by_hash = F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("r"))
    sizes = near.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.min(by_hash)["r"].alias("p1"), F.max(by_hash)["r"].alias("p2"))
    placed = near.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    placed = stored(in_few_tasks(placed, documents), folder, "placed")
    pivot = (F.col("rep") == F.col("p1")) | (F.col("rep") == F.col("p2"))
    where = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    none = F.lit(None).cast("boolean")
    first = placed.withColumn("block", F.explode(where)).select("rep", "n_shingles", F.xxhash64("cluster", "block").alias("grp"), none.alias("asks"), F.lit(None).cast("long").alias("comp"))
    links = stored(confirmed(docs, first, words, percent), folder, "links")
    roots = components(links, folder, "first")
    split = placed.filter("blocks > 1")
    if split.take(1):
        split = split.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
        parts = split.groupBy("cluster", "comp").count()
        main = parts.groupBy("cluster").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        split = split.join(main, "cluster").withColumn("asks", F.col("comp") != F.col("main"))
        split = stored(in_few_tasks(split, documents), folder, "split")
        queues = split.filter("asks").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("queues"))
        turn = F.pmod(F.xxhash64("rep", F.lit("queue")), F.col("queues")).cast("int")
        held = split.join(queues, "cluster").withColumn("queue", F.explode(F.sequence(F.lit(0), F.col("queues") - 1)))
        asking = split.filter("asks").join(queues, "cluster").withColumn("queue", turn).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        columns = ["rep", "n_shingles", F.xxhash64("cluster", "block", "queue").alias("grp"), "asks", "comp"]
        second = held.withColumn("asks", F.lit(False)).select(columns).unionByName(asking.select(columns))
        more = stored(confirmed(docs, second, words, percent), folder, "more")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), folder, "second")
    mine = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("found"))
    # Two classes may share a repeated doc_id; a document has one component.
    out = signed.select("doc_id", "n_shingles", "set_key").join(mine, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
    return in_few_tasks(out, documents)
