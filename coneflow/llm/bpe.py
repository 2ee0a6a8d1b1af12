"""Byte-pair encoding and decoding of whole texts.

A piece of text is a doubly linked list of symbols and a priority queue of
(merge rank, position); the best entry is popped, skipped when a neighbour has
changed since it was queued, and otherwise merged. Decoding concatenates
vocabulary strings. The vocabulary (a bounded file, read on the driver) goes to
the executors as one broadcast variable; documents are encoded where they lie,
without a shuffle.

Defined results: null and empty texts have no tokens and the hash of nothing;
special-token strings in a text become that token, as in the tokenizers
library; texts of any length are encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from array import array
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: How byte-level BPE splits a text, and the same for texts of Latin letters only.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN_PIECES = rf"'(?:[sdmt]|ll|ve|re)| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+"
NOT_PLAIN = "[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]"
#: Pieces kept with their ids in a worker's memory, and the longest of them.
CACHE, CACHE_CHARS = 200_000, 40


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def supported(spec: dict) -> None:
    """Raise where a file asks for something that this encoder does not do."""
    model, none = spec["model"], (None, False, "")
    for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"):
        if model.get(name) not in none:
            raise ValueError(f"{name} of the model is not supported: {model[name]!r}")
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") is not None:
        raise ValueError("only BPE models without a normalizer are supported")
    split = spec.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        raise ValueError(f"only a byte-level pre_tokenizer by its own pattern, without a prefix space, is supported: {split}")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("only a byte-level decoder is supported")
    for token in spec.get("added_tokens", []):
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"flags of an added token are not supported: {token}")


def load_vocabulary(path: str) -> dict:
    """Read a byte-level BPE file of the tokenizers library into plain tables."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    as_bytes = lambda token: bytes(letters[c] for c in token)
    supported(spec)
    ids = spec["model"]["vocab"]
    strings = {i: as_bytes(t) for t, i in ids.items()}
    merges = []
    for pair in spec["model"]["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((ids[a], ids[b], ids[a + b]))
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    strings |= {i: t.encode() for t, i in special.items()}
    return {"merges": merges, "strings": strings, "special": special}


class Codec(dict):
    """Encoder and decoder; as a dict it holds the packed ids of pieces met so far."""

    def __init__(self, vocabulary: dict) -> None:
        self.merges = vocabulary["merges"]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.merges)}
        self.strings = vocabulary["strings"]
        by_string = {s: i for i, s in self.strings.items()}
        self.byte_ids = [by_string[bytes([b])] for b in range(256)]
        self.special = vocabulary["special"]
        self.special_starts = {s[0] for s in self.special if s}
        self.special_split = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.pieces, self.latin_pieces = regex.compile(PIECES), re.compile(LATIN_PIECES)
        self.not_plain = re.compile(NOT_PLAIN)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        symbol = [self.byte_ids[b] for b in data]
        n = len(symbol)
        rank, merges, push, pop = self.rank, self.merges, heapq.heappush, heapq.heappop
        queue = [r * n + i for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        if not queue:
            return symbol
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            r, i = divmod(pop(queue), n)
            left, right, joined = merges[r]
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((joined, symbol[k]))) is not None:
                    push(queue, r * n + i)
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], joined))) is not None:
                push(queue, r * n + h)
        return [s for s in symbol if s >= 0]

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(c in text for c in self.special_starts) and (parts := self.special_split.split(text))[1:]:
            return b"".join(array("I", [self.special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        find = self.latin_pieces if self.not_plain.search(text) is None else self.pieces
        return b"".join(map(self.__getitem__, find.findall(text)))

    def decode_packed(self, packed: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


#: The codec of the broadcast value that a worker process met last.
_codecs: dict[str, Codec] = common._kept


def _codec(key: str, vocabulary: Callable[[], dict]) -> Codec:
    """The worker's codec; it takes the place of what another call kept."""
    return common.worker_keeps(key, lambda: Codec(vocabulary()))


def encode(docs: DataFrame, vocabulary_path: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of every text; ``with_ids`` adds the ids and the decoded text."""
    keep = [c for c in (keep or ["doc_id"]) if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")]
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    key = uuid.uuid4().hex
    extra = ", ids array<int>, decoded string" if with_ids else ""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        codec = _codec(key, lambda: shared.value)
        for batch in batches:
            texts = batch.column(len(keep))
            for at in range(0, max(1, len(texts)), 256):
                n, ids, decoded, raw, plain = [], [], [], [], []
                for text in texts.slice(at, 256).to_pylist():
                    packed = codec.encode_packed(text or "")
                    back = codec.decode_packed(packed)
                    n.append(len(packed) // 4)
                    ids.append(sha(packed))
                    decoded.append(sha(back.encode("utf-8")))
                    if with_ids:
                        raw.append(packed)
                        plain.append(back)
                columns = [batch.column(k).slice(at, 256) for k in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = pa.array([0, *accumulate(n)], pa.int32())
                    values = pa.array(np.frombuffer(b"".join(raw), np.int32))
                    columns += [pa.ListArray.from_arrays(offsets, values), pa.array(plain, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
