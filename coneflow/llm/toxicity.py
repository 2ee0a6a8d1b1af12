"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Only documents have labels. A sentence's probability is the logistic of its
words' weights; a document's is the noisy-or of its sentences, one minus the
product of their complements; the weights are fitted to document labels through
that product by numpy gradient steps. Afterwards each sentence can be judged by
itself, so the offending ones are found. Only what a sentence's words add to the
bias counts for the document: sentences without a known feature, empty ones and
those whose weights don't exceed 0 add nothing, so a clean text's score doesn't
grow with its length.

Features are words and their first four to six letters, hashed; all that
occur more in toxic documents of a bounded sample (SAMPLE documents of least
hash, outside the held-out part) than CHANCE lets happen are kept. Each of them
is in several documents of the sample, which bounds their number. Nothing speaks for a clean text: one offending sentence is enough,
whatever stands around it. Scoring is one narrow pass over all texts.

Defined results: null and empty texts have no sentences and score 0; without
labelled documents of both kinds every score is 0; texts of any length are read
whole. Extra columns are ignored;
kept columns that bear the name of a result are left out.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_keeps
from .labelled import labelled_sample, remainder

SAMPLE, CHANCE, ROUNDS, PRIOR = 8000, 15.0, 400, -9.0
CACHE = 300_000
#: Bytes that end sentences become line ends, other punctuation and white space becomes blank.
_TABLE = bytearray(range(256))
for _b in b".!?\n\r":
    _TABLE[_b] = 10
for _b in b",|:;\"'()[]{}<>*#$%&/\\=+_~`^-\t\x0b\x0c":
    _TABLE[_b] = 32
_TABLE = bytes(_TABLE)


def sentences(text: str) -> list[bytes]:
    """The text's sentences in small letters without punctuation; ends are kept in place."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n")


def features(word: bytes) -> list[int]:
    out = [xxhash.xxh3_64_intdigest(word) >> 1]
    letters = word.decode("utf-8", "replace")
    out += [xxhash.xxh3_64_intdigest(f"{n}:{letters[:n]}".encode()) >> 1 for n in (4, 5, 6) if len(letters) >= n]
    return out


def _counted(sample: DataFrame) -> DataFrame:
    """In how many toxic and other documents of the sample each feature occurs."""
    key = uuid.uuid4().hex

    def run(batches):
        seen: dict[bytes, list[int]] = worker_keeps(key, dict)
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: set[int] = set()
                for w in set(b" ".join(sentences(text)).split()):
                    if (f := seen.get(w)) is None:
                        f = features(w)
                        if len(seen) < CACHE:
                            seen[w] = f
                    found.update(f)
                (toxic if y else other).update(found)
        keys = list(toxic.keys() | other.keys())
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([other[k] for k in part], pa.int64())], names=["feature", "toxic", "other"])

    rows = sample.select("text", "y").mapInArrow(run, "feature bigint, toxic bigint, other bigint")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(bags: list[tuple[int, int, list[list[int]]]], n_features: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, sentences without features, features of each other sentence) of documents.

    With S the sum of softplus(z) over a document's sentences, noisy-or gives
    1 - exp(-S); the loss is S for a clean document and -log(1 - exp(-S)) for a
    toxic one. Sentences without features are no part of S.
    """
    y = np.array([b[0] for b in bags], float)
    doc = np.array([d for d, b in enumerate(bags) for _ in b[2]], int)
    sizes = np.array([len(s) for b in bags for s in b[2]], int)
    flat = np.array([f for b in bags for s in b[2] for f in s], int)
    sent = np.repeat(np.arange(len(sizes)), sizes)
    w, bias = np.zeros(n_features), PRIOR
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    soft = lambda z: np.logaddexp(0, z)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sent, w[flat], len(sizes))
        s = np.bincount(doc, soft(z), len(bags))
        ds = np.where(y > 0, -1 / np.expm1(np.clip(s, 1e-9, 40)), 1.0) / len(bags)
        dz = ds[doc] * logistic(z)
        gradient = np.r_[np.bincount(flat, dz[sent], n_features) + 1e-5 * w, dz.sum()]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], min(PRIOR, bias - 0.1 * move[-1])
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, mod: int, held: int, sample: int = SAMPLE) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias, learned outside the held-out remainder."""
    rows = labelled_sample(docs, labels, "toxic", mod, held, sample)
    n = {y: c for y, c in rows.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}, -math.inf
    # the log-likelihood ratio of a feature that occurs more in toxic documents, above what chance gives among millions
    a, b, share = F.col("toxic"), F.col("other"), n[1] / (n[0] + n[1])
    part = lambda seen, rate: F.when(seen > 0, seen * F.log(seen / ((a + b) * rate))).otherwise(0.0)
    gain = part(a, share) + part(b, 1 - share)
    chosen = _counted(rows).filter(a > (a + b) * share).withColumn("gain", gain).filter(F.col("gain") > CHANCE).orderBy(F.desc("gain"), "feature").collect()
    place = {r["feature"]: k for k, r in enumerate(chosen)}
    if not place:
        return {}, PRIOR

    def bags(batches):
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept = [sorted({place[f] for w in s.split() for f in features(w) if f in place}) for s in sentences(text)]
                out.append({"y": y, "bare": sum(not k for k in kept), "kept": [k for k in kept if k]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("y", pa.int32()), ("bare", pa.int64()), ("kept", pa.list_(pa.list_(pa.int32())))]))

    found = rows.mapInArrow(bags, "y int, bare bigint, kept array<array<int>>").collect()
    w, bias = fit([(r["y"], r["bare"], r["kept"]) for r in found], len(place))
    return {f: float(w[k]) for f, k in place.items()}, bias


class Weights(dict):
    """Weight of a word: the sum of its features' weights."""

    def __init__(self, by_feature: dict[int, float]) -> None:
        self.by_feature = by_feature

    def __missing__(self, word: bytes) -> float:
        w = sum(self.by_feature.get(f, 0.0) for f in features(word))
        if len(self) >= CACHE:
            self.clear()
        if len(word) < 64:
            self[word] = w
        return w


def judged(text: str, weights: Weights, bias: float) -> tuple[float, list[float]]:
    """Probability of the document, and the logits of its sentences."""
    get = weights.__getitem__
    logits = [bias + sum(map(get, s.split())) for s in sentences(text)] if text else []
    base = math.log1p(math.exp(bias))
    total = sum(math.log1p(math.exp(min(z, 40.0))) - base for z in logits if z > bias)
    return -math.expm1(-total), logits


def score(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, keep: list[str] | None = None, with_spans: bool = False) -> DataFrame:
    """``keep`` columns, held_out, score, predicted, toxic_sentences; ``with_spans`` adds the offending sentences' byte
    ranges within the lower-cased text and the sentences."""
    keep = [c for c in (keep or ["doc_id"]) if c not in ("held_out", "score", "predicted", "toxic_sentences", "offending")]
    by_feature, bias = train(docs, labels, mod, held)
    shared, key = docs.sparkSession.sparkContext.broadcast(by_feature), uuid.uuid4().hex
    rows = docs.select(F.struct(*keep).alias("kept"), (remainder(mod) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kept = f"kept {rows.schema['kept'].dataType.simpleString()}, held_out boolean"

    def run(batches):
        weights = worker_keeps(key, lambda: Weights(shared.value))
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                p, n, spans = [], [], []
                for text in part.column(2).to_pylist():
                    value, logits = judged(text, weights, bias) if weights.by_feature else (0.0, [])
                    p.append(value)
                    n.append(sum(z >= 0 for z in logits))
                    if with_spans:
                        own, start = [], 0
                        for s, z in zip(sentences(text), logits):
                            if z >= 0:
                                own.append({"start": start, "end": start + len(s), "sentence": s.decode("utf-8", "replace")})
                            start += len(s) + 1
                        spans.append(own)
                columns = [part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array(n, pa.int32())]
                if with_spans:
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["kept", "held_out", "score", "toxic_sentences"] + ["offending"] * with_spans
    schema = f"{kept}, score double, toxic_sentences int" + (", offending array<struct<start:int,end:int,sentence:string>>" if with_spans else "")
    out = rows.mapInArrow(run, schema)
    return out.select("kept.*", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *names[3:])
