"""Log-likelihood of whole documents under a gated recurrent language model trained here.

1. All training documents' words are counted by a grouped sum (words as 64-bit
   hashes of the lower-cased word, one end mark for each text).
2. The counts give the unigram base score, the frequent words and the classes
   of the recurrent model, which starts from the unigram probabilities.
3. The model reads every word of all training documents once, in ROUNDS rounds
   that each take a part of the documents by hash. A round's documents are dealt
   by hash to groups of about GROUP words (at most GROUPS groups, which then are
   larger) and read there in the order of their hash: each group trains a copy by
   truncated backpropagation, and a grouped sum averages the copies by the words
   they read. So scores don't hang on how the table is partitioned.
4. One pass scores every document word by word, the state carried over its whole
   length.

Texts are cut into words twice: for the counts, and when one pass stores them as
the model's numbers for training and scoring. Counts of the COMMON most frequent
words are broadcast to it (a fixed bound); rarer words leave it as rows that are
joined with the counts.

Frequent words get their probability from the network; a rarer word gets its
class's probability times its share of the class's smoothed counts, in which
unknown words count as one more word of count 0. All probabilities of a step
sum to one over the words that the base score knows.

Defined results: null and empty texts are one end mark; without training
documents every word is unknown; held_out of a null doc_id follows the crc32 of
empty text; rows that repeat count each. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import shared_folder, stored
from .counts import most_common, word_counts
from .labelled import remainder
from .shingles import word_hashes

COMMON, ROUNDS = 1 << 19, 4
#: Words that a copy of the model reads in a round, and copies of a round at most.
GROUP, GROUPS = 1 << 20, 4096
#: Words that a task trains on at a time.
CHUNK = 1 << 20
END = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, and the end mark."""
    return np.append(word_hashes(text or ""), END)


class Vocabulary:
    """Common words and the model's classes: which number a word has, and what its share of its class is."""

    def __init__(self, words: np.ndarray, n: np.ndarray, total: int, distinct: int) -> None:
        order = np.argsort(words)
        self.words, self.n = words[order], n[order]
        self.total, self.distinct = total, distinct
        rank = np.lexsort((self.words, -self.n))
        self.ids = np.empty(len(rank), np.int32)
        frequent = rank[: gru.FREQUENT]
        self.ids[frequent] = np.arange(len(frequent))
        # classes of rarer words by quarters of their counts' logarithms
        rest = rank[gru.FREQUENT :]
        level = np.floor(np.log2(np.maximum(1, self.n[rest])) / 2).astype(int)
        self.levels = np.unique(level)[::-1]
        self.ids[rest] = gru.FREQUENT + np.searchsorted(-self.levels, -level)
        self.rare = gru.FREQUENT + len(self.levels)  # words that aren't common, known or not
        smooth = self.n + 0.5
        rare_mass = (total - self.n.sum()) + 0.5 * (distinct - len(words)) + 0.5
        kinds = len(self.levels) + 1
        mass = np.zeros(gru.CLASSES + kinds)
        by_id = np.full(gru.FREQUENT, 1e-9)
        by_id[: len(frequent)] = smooth[frequent]
        mass[: gru.CLASSES] = by_id.reshape(gru.CLASSES, gru.WIDTH).sum(axis=1)
        np.add.at(mass, self.ids[rest] - gru.FREQUENT + gru.CLASSES, smooth[rest])
        mass[-1] = rare_mass
        self.class_log = np.log(mass / mass.sum())
        self.word_log = np.log(by_id)
        self.share_log10 = np.zeros(len(words))  # of a word within its class, for rarer words
        self.share_log10[rest] = np.log10(smooth[rest] / mass[self.ids[rest] - gru.FREQUENT + gru.CLASSES])
        self.rare_log10 = math.log10(rare_mass)
        self.base_log10 = math.log10(total + 0.5 * (distinct + 1))
        self.smooth_log10 = np.log10(smooth)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the common words, and whether it is one."""
        if not len(self.words):
            return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at, known = self.find(hashes)
        return np.where(known, self.ids[at], self.rare) if len(self.words) else np.full(len(hashes), self.rare)

    @property
    def end(self) -> int:
        return int(self.numbers(np.array([END]))[0])


def vocabulary(counts: DataFrame, common: int = COMMON) -> Vocabulary:
    """At most ``common`` words, the most frequent, and the sums over all."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Vocabulary(*most_common(counts, common), total, distinct)


_NUMBERED = "kept {kept}, row bigint, n_tokens bigint, n_known bigint, base_score double, share double, rare array<bigint>, ids array<int>, h bigint, grp int, part int"


def numbered(docs: DataFrame, is_held: Column, keep: list[str], vocab: Vocabulary, path: str, rounds: int = ROUNDS) -> DataFrame:
    """Each text once as the model's numbers, with all of its scores that need no model; stored by round (-1: held out)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    groups = _groups(vocab, rounds)
    by_hash = lambda what, n: F.pmod(F.xxhash64("doc_id", "text", F.lit(what)), F.lit(n)).cast("int")
    dealt = docs.select(F.struct(*keep).alias("kept"), F.monotonically_increasing_id().alias("row"), "text", F.xxhash64("doc_id", "text", F.lit("order")).alias("h"), by_hash("group", groups).alias("grp"), F.when(is_held, -1).otherwise(by_hash("lm", rounds)).alias("part"))
    schema = _NUMBERED.format(kept=dealt.schema["kept"].dataType.simpleString())
    names = [c.split()[0] for c in _NUMBERED.replace("{kept}", "_").split(", ")]

    def run(batches):
        vocab = shared.value
        some = bool(len(vocab.words))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [tokens(t) for t in part.column(2).to_pylist()]
                n = np.array([len(t) for t in texts])
                flat = np.concatenate(texts)
                at, common = vocab.find(flat)
                begin = np.r_[0, np.cumsum(n)[:-1]]
                add = lambda x: np.add.reduceat(x, begin)  # noqa: B023, E731
                known = add(common.astype(np.int32)).astype(np.int64)
                base = add(np.where(common, vocab.smooth_log10[at], 0.0)) if some else np.zeros(len(n))
                share = add(np.where(common, vocab.share_log10[at], -vocab.rare_log10)) if some else -n * vocab.rare_log10
                ids = (np.where(common, vocab.ids[at], vocab.rare) if some else np.full(len(common), vocab.rare)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k)].astype(np.int32)), pa.array(x)) for k, x in ((n - known, flat[~common].view(np.int64)), (n, ids))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base - n * vocab.base_log10), pa.array(share), *lists, *part.columns[3:]], names=names)

    dealt.mapInArrow(run, schema).write.partitionBy("part").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _groups(vocab: Vocabulary, rounds: int) -> int:
    return max(1, min(GROUPS, -(-vocab.total // (rounds * GROUP))))


def trained(rows: DataFrame, vocab: Vocabulary, folder: str, rounds: int = ROUNDS) -> dict:
    """The model's weights after one pass over all ``numbered`` rows that aren't held out, a part of them in each of ``rounds`` rounds."""
    context, model, end = rows.sparkSession.sparkContext, gru.start(vocab.class_log, vocab.word_log), vocab.end
    groups = _groups(vocab, rounds)
    names = sorted(model)
    for turn in range(rounds):
        weights = context.broadcast(model)

        def run(batches, weights=weights):
            training, group, held, size, n = None, None, [], 0, 0

            def fed():
                if size:
                    training.feed(np.concatenate([[end], *held]), end)

            def copy():
                total = training.flat.astype(float) * n
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), float(n)))], names=["at", "w", "n"])

            for batch in batches:
                own = batch.column(1).to_numpy()
                edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else []
                for lo, hi in zip(edges, edges[1:]):
                    if own[lo] != group:
                        fed()
                        if n:
                            yield copy()
                        training, group, held, size, n = gru.Training(weights.value), own[lo], [], 0, 0
                    held.append(batch.column(0).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False))
                    size, n = size + len(held[-1]), n + len(held[-1])
                    if size >= CHUNK:
                        fed()
                        held, size = [], 0
            fed()
            if n:
                yield copy()

        own = rows.filter(F.col("part") == turn).repartitionById(groups, "grp").sortWithinPartitions("grp", "h")
        copies = own.select("ids", "grp").mapInArrow(run, "at int, w double, n double")
        mean = copies.groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).orderBy("at").toArrow()  # one row for each weight
        weights.unpersist()
        if mean.num_rows:
            flat, at = mean["w"].to_numpy().astype(np.float32), 0
            for k in names:
                model[k] = flat[at : at + model[k].size].reshape(model[k].shape)
                at += model[k].size
    return model


def score(docs: DataFrame, mod: int = 5, held: int = 1, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    folder = shared_folder(docs.sparkSession)
    keep = [c for c in (keep or ["doc_id"]) if c not in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    is_held = remainder(mod) == held
    training = docs.filter(~is_held).select("doc_id", "text")
    counts = stored(word_counts(training, lambda texts: np.concatenate([tokens(t) for t in texts])), folder, "counts")
    vocab = vocabulary(counts)
    rows = numbered(docs, is_held, keep, vocab, f"{folder}/numbered")
    model = trained(rows, vocab, folder)
    end, shared = vocab.end, docs.sparkSession.sparkContext.broadcast(model)
    texts = rows.select("kept", (F.col("part") < 0).alias("held_out"), "row", "n_tokens", "n_known", "base_score", "share", "ids")
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base_score double, score double"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(3).to_numpy()
            ids = batch.column(7).flatten().to_numpy(zero_copy_only=False).astype(np.int16)
            model_part = gru.score_texts(shared.value, np.split(ids, np.cumsum(n)[:-1]), end) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(model_part + batch.column(6).to_numpy())], names=["kept", "held_out", "row", "n_tokens", "n_known", "base_score", "score"])

    scored = stored(texts.mapInArrow(run, schema), folder, "scored")
    rare = rows.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"))
    out = scored.join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("kept.*", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
