"""Word shingles of a whole text as sorted sets of 64-bit hashes, and minhash signatures, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: ASCII capitals to small letters; the bytes that part words are those of bytes.split().
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240611)
_odd = lambda n: _RNG.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _odd(256)
_BASE = int(_odd(1)[0])
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _odd(16)
COORDINATES = 64
_MULTIPLY = _odd(COORDINATES)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 2**64))
        done += take
    return out[:n]


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(_BASE, n), powers(_INVERSE, n)
        return self.up, self.down


_powers = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of bytes [s, e) is (sums[e] - sums[s]) * up[s]; also ``up``."""
    n = len(data)
    up, down = _powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * down[:n], out=sums[1:])
    return sums, up


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of the lower-cased text, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums, up = prefix_sums(data)
    return mixed((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64) * np.uint64(_INVERSE))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of the whole sequence if it has fewer words; empty without words."""
    w = word_hashes(text or "")
    n = len(w)
    if not n:
        return w
    if n < words:
        return mixed((w * powers(int(_STEP[15]), n)).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.full(n - words + 1, words, np.uint64)
    for k in range(words):
        total += w[k : n - words + 1 + k] * _STEP[k % 15] * np.uint64(2 * (k // 15) + 1)
    return np.unique(mixed(total))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima, one for each of as many orders of the shingles."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _MULTIPLY).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell different sets apart."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Groups:
    """Disjoint sets over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
