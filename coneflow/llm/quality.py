"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every word has a sparse random index vector, drawn from its hash alone. Words are
counted over all documents, and one pass adds up, for the COMMON most frequent
ones, the index vectors of their neighbours in all documents; partitions' sums
meet sorted by word and are added as a stream. That sum is the word's vector. A
rarer word, met too seldom for its neighbours to say much, has its own index
vector instead. Vectors count at length one, and a document is pooled as the mean
of its words' vectors, and the means of squares and of products of neighbours (in
which repetition shows) of their first FEW numbers. A network of two layers is fitted in numpy to a
bounded sample (SAMPLE labelled documents of least hash, outside the held-out
part); its temperature is set on a fifth of the sample that the layers don't see.

The table of vectors is broadcast, so COMMON bounds it (8 MB). To join vectors of
all words to the documents would move a kilobyte for each rarer occurrence.

Defined results: null and empty texts have zero features and a score like any
other; without labelled documents of both kinds every score is 0.5; texts of
any length are read whole, SLICE words at a time. Extra columns are ignored;
kept columns that bear the name of a result are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stored
from .counts import most_common, word_counts
from .labelled import labelled_sample, remainder
from .shingles import mixed, prefix_sums

SAMPLE, COMMON, DIM, PLACES, WINDOW, HIDDEN, EPOCHS = 8000, 1 << 13, 256, 8, 2, 24, 60
#: Numbers of a vector whose squares and products with the next word's are pooled: one part of the places.
FEW = DIM // PLACES
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of texts read at a time, and words whose vectors are held at once, to bound a task's memory.
CHUNK, SLICE = 1 << 19, 1 << 14


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of several texts, and each text's first word."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    lengths = [len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums, up = prefix_sums(data)
    hashes = mixed((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, np.r_[0, np.cumsum(lengths)])


def sparse(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PLACES places of each word's index vector, one in each part of DIM / PLACES numbers, and a sign at each."""
    part, at = DIM // PLACES, np.arange(PLACES, dtype=np.uint64)
    bits = hashes[:, None] >> at * np.uint64(8)
    return ((bits & np.uint64(part - 1)) + at * np.uint64(part)).astype(np.int64), 1 - 2 * (bits >> np.uint64(7) & np.uint64(1)).astype(np.float32)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The same as rows of DIM numbers, of length one."""
    x = np.zeros((len(hashes), DIM), np.float32)
    places, signs = sparse(hashes)
    np.put_along_axis(x, places, signs / np.float32(np.sqrt(PLACES)), 1)
    return x


def texts_in_chunks(column):
    """Lists of texts of about CHUNK bytes, with their places."""
    held, size, first = [], 0, 0
    for k in range(len(column)):
        t = column[k].as_py() or ""
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def found_in(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the sorted ``words``, and whether it is one of them."""
    if not len(words):
        return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def neighbours(hashes: np.ndarray, document: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For the sorted ``words``, the sum of index vectors of all words up to WINDOW away in the same document."""
    at, known = found_in(hashes, words)
    places, signs = sparse(hashes)
    cells, values = [], []
    for o in range(1, WINDOW + 1):
        same = document[o:] == document[:-o]
        for centre, near in ((slice(o, None), slice(None, -o)), (slice(None, -o), slice(o, None))):
            use = known[centre] & same
            cells.append((at[centre][use, None] * DIM + places[near][use]).ravel())
            values.append(signs[near][use].ravel())
    return np.bincount(np.concatenate(cells), np.concatenate(values), len(words) * DIM)


def added(batches):
    """Sums of the vectors of rows that are sorted by word, one word at a time over batches."""
    word, total = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        words, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, DIM).astype(float)
        start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        words, sums = words[start], np.add.reduceat(v, start, axis=0)
        if word is not None:
            if words[0] == word:
                sums[0] += total
            else:
                words, sums = np.r_[word, words], np.concatenate([total[None], sums])
        word, total = words[-1], sums[-1]
        yield _rows(words[:-1], sums[:-1])
    if word is not None:
        yield _rows(np.array([word]), total[None])


def _rows(words: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, DIM, dtype=np.int32)), pa.array(v.ravel().astype(np.float32)))
    return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), flat], names=["word", "v"])


def word_vectors(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Unit vectors of the sorted ``words``: sums of their neighbours' index vectors over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = shared.value
        total = np.zeros(len(words) * DIM)
        for batch in batches:
            for _, texts in texts_in_chunks(batch.column(0)):
                hashes, first = words_of(texts)
                document = np.repeat(np.arange(len(texts)), np.diff(first))
                for lo in range(0, len(hashes), SLICE):  # with the words before it that are near, whose pairs among themselves are taken off
                    before = max(0, lo - WINDOW)
                    total += neighbours(hashes[before : lo + SLICE], document[before : lo + SLICE], words)
                    if before < lo:
                        total -= neighbours(hashes[before:lo], document[before:lo], words)
        total = total.reshape(-1, DIM)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        yield _rows(some, total[some])

    if not len(words):
        return np.zeros((0, DIM), np.float32)
    parts = docs.select("text").mapInArrow(run, "word int, v array<float>")  # whole numbers, exact up to 2^24 in a task
    table, out = parts.repartition("word").sortWithinPartitions("word").mapInArrow(added, "word int, v array<float>").toArrow(), np.zeros((len(words), DIM))  # at most COMMON rows
    if table.num_rows:
        out[table["word"].to_numpy()] = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    return unit(out).astype(np.float32)


def document_features(texts: list[str], words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means over each text of its words' vectors, of their first FEW numbers squared, and of the products of these with the next word's; zeros without words."""
    out = np.zeros((len(texts), DIM + 2 * FEW))
    hashes, first = words_of(texts)
    document = np.repeat(np.arange(len(texts)), np.diff(first))
    last = None  # the first numbers and the document of the word before a slice
    for lo in range(0, len(hashes), SLICE):
        h, own = hashes[lo : lo + SLICE], document[lo : lo + SLICE]
        at, known = found_in(h, words)
        v = np.zeros((len(h), FEW), np.float32)
        common, rare = np.flatnonzero(known), np.flatnonzero(~known)
        if len(common):
            start = np.flatnonzero(np.r_[True, own[common[1:]] != own[common[:-1]]])
            out[own[common[start]], :DIM] += np.add.reduceat(vectors[at[common]], start, axis=0)
            v[common] = vectors[at[common], :FEW]
        if len(rare):
            places, signs = sparse(h[rare])
            signs /= np.float32(np.sqrt(PLACES))
            some = slice(own[rare[0]], own[rare[-1]] + 1)
            sums = np.bincount(((own[rare] - some.start)[:, None] * DIM + places).ravel(), signs.ravel(), (some.stop - some.start) * DIM)
            out[some, :DIM] += sums.reshape(-1, DIM)
            v[rare, places[:, 0]] = signs[:, 0]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        pairs = np.zeros_like(v)
        pairs[1:] = v[:-1] * v[1:] * (own[1:] == own[:-1])[:, None]
        if last is not None and last[1] == own[0]:
            pairs[0] = last[0] * v[0]
        out[own[start], DIM : DIM + FEW] += np.add.reduceat(v * v, start, axis=0)
        out[own[start], DIM + FEW :] += np.add.reduceat(pairs, start, axis=0)
        last = v[-1], own[-1]
    return (out / np.maximum(1, np.diff(first))[:, None]).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Two layers by mini-batches with Adam, then a temperature on every fifth row."""
    rng = np.random.default_rng(5)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / spread
    calibrate = np.arange(len(x)) % 5 == 4
    train = np.flatnonzero(~calibrate)
    p = {"a": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            step += 1
            h = np.tanh(z[rows] @ p["a"] + p["b"])
            error = (1 / (1 + np.exp(-(h @ p["c"] + p["d"]))) - y[rows]) / len(rows)
            back = error[:, None] * p["c"] * (1 - h * h)
            gradient = {"a": z[rows].T @ back + 1e-4 * p["a"], "b": back.sum(axis=0), "c": h.T @ error + 1e-4 * p["c"], "d": error.sum(keepdims=True)}
            for k, g in gradient.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = p | {"centre": centre, "spread": spread, "temperature": np.ones(1)}
    logits = _logits(model, x[calibrate])
    grid = np.geomspace(0.25, 8, 60)
    if calibrate.any():
        loss = [np.logaddexp(0, np.where(y[calibrate] > 0, -logits, logits) / t).mean() for t in grid]
        model["temperature"] = grid[[int(np.argmin(loss))]]
    return model


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    h = np.tanh((x - model["centre"]) / model["spread"] @ model["a"] + model["b"])
    return h @ model["c"] + model["d"]


def score(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.7, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``keep`` columns, held_out, score, predicted."""
    keep = [c for c in (keep or ["doc_id"]) if c not in ("held_out", "score", "predicted")]
    chosen = labelled_sample(docs, labels, "quality", mod, held, sample)
    counts = stored(word_counts(docs, lambda texts: words_of(texts)[0]), shared_folder(docs.sparkSession), "counts")
    words = np.sort(most_common(counts, COMMON)[0])
    tables = docs.sparkSession.sparkContext.broadcast((words, word_vectors(docs, words)))

    def measured(batches):
        words, vectors = tables.value
        for batch in batches:
            for at, texts in texts_in_chunks(batch.column(0)):
                x = document_features(texts, words, vectors)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([flat, batch.column(1).slice(at, len(texts))], names=["x", "y"])

    rows = chosen.mapInArrow(measured, "x array<float>, y int").toArrow()  # at most `sample` rows of fixed length
    y = rows["y"].to_numpy().astype(float)
    model = fit(rows["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1).astype(float), y) if 0 < y.sum() < len(y) else None
    learned = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(F.struct(*keep).alias("kept"), (remainder(mod) == held).alias("held_out"), "text")

    def run(batches):
        (words, vectors), model = tables.value, learned.value
        for batch in batches:
            for at, texts in texts_in_chunks(batch.column(2)):
                z = _logits(model, document_features(texts, words, vectors)) / model["temperature"] if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["kept", "held_out", "score"])

    out = ready.mapInArrow(run, f"kept {ready.schema['kept'].dataType.simpleString()}, held_out boolean, score double")
    return out.select("kept.*", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
