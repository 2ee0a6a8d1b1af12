"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

The text is a sequence of small non-negative integers. Suffixes are classed as
larger or smaller than their right neighbour; leftmost-smaller substrings are
sorted by induction, named, and, where names repeat, sorted by recursion on the
text of names; the whole array is then induced from them. Induction goes bucket
by bucket: all entries that a bucket holds at one time induce their left
neighbours together. A text of names has nearly as many letters as places, so
buckets hold next to nothing there, and suffixes are induced run by run instead.
"""

from __future__ import annotations

import numpy as np

#: Positions of texts up to this length are held in half the bytes.
NARROW = 2**31 - 16
#: With more than one letter to so many places, suffixes are induced run by run.
MANY = 64


def _positions(n: int) -> type:
    return np.int32 if n <= NARROW else np.int64


def _classes(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one is larger than nothing, so False."""
    n = len(t)
    rises = t[:-1] < t[1:]  # smaller than the right neighbour
    decided = np.flatnonzero(t[:-1] != t[1:])
    small = np.zeros(n, bool)
    if len(decided):  # what is equal to its right neighbour is as that one
        small[: decided[-1] + 1] = np.repeat(rises[decided], np.diff(np.r_[-1, decided]))
    return small


def _induce(t: np.ndarray, small: np.ndarray, ends: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Suffixes in order, induced from ``leftmost`` (leftmost-smaller positions in the order to begin with)."""
    n, narrow = len(t), len(ends) <= 1 << 16
    sa = np.full(n, -1, _positions(n))
    starts = np.r_[0, ends[:-1]]
    # the seeds go to the end of their buckets, in order
    letters = t[leftmost]
    by = np.argsort(letters.astype(np.uint16) if narrow else letters, kind="stable")
    seeds, letters = leftmost[by], letters[by]
    if len(seeds):
        first = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]])
        count = np.diff(np.r_[first, len(letters)])
        sa[np.repeat(ends[letters[first]] - count - first, count) + np.arange(len(letters))] = seeds
    head, tail = starts.copy(), ends.copy()
    used = np.flatnonzero(ends > starts)

    def place(found: np.ndarray, forward: bool) -> None:
        """Put suffixes at the free end of their buckets, in the order given."""
        letters = t[found]
        if forward:
            by = np.argsort(letters.astype(np.uint16) if narrow else letters, kind="stable")
            found, letters = found[by], letters[by]
            first = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]])
            count = np.diff(np.r_[first, len(letters)])
            names = letters[first]
            sa[np.repeat(head[names] - first, count) + np.arange(len(letters))] = found
            head[names] += count
        else:
            by = np.argsort(letters.astype(np.uint16) if narrow else letters, kind="stable")
            found, letters = found[by], letters[by]
            first = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]])
            count = np.diff(np.r_[first, len(letters)])
            names = letters[first]
            sa[np.repeat(tail[names] - 1 + first, count) - np.arange(len(letters))] = found
            tail[names] -= count

    # larger suffixes, from left to right; the last suffix comes before all others
    place(np.array([n - 1]), True)
    for c in used:
        done = starts[c]
        while done < head[c]:  # what was put here, also by this very bucket
            block = sa[done : head[c]]
            done = head[c]
            before = block[block > 0] - 1
            before = before[~small[before]]
            if len(before):
                place(before, True)
        seeds = sa[max(done, head[c]) : ends[c]]
        seeds = seeds[seeds > 0]
        before = seeds - 1
        before = before[~small[before]]
        if len(before):
            place(before, True)
    # smaller suffixes, from right to left, over the seeds
    for c in used[::-1]:
        done = ends[c]
        while done > tail[c]:
            block = sa[tail[c] : done][::-1]
            done = tail[c]
            before = block[block > 0] - 1
            before = before[small[before]]
            if len(before):
                place(before, False)
        block = sa[starts[c] : head[c]][::-1]
        before = block[block > 0] - 1
        before = before[small[before]]
        if len(before):
            place(before, False)
    return sa


def _run_order(codes: np.ndarray, at: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``at`` in the order of the code sequences from each place on, and where a sequence differs from the one before it.

    Sequences are read as long as others share what was read of them, or for
    ``length`` codes. A code above all others that ends a sequence must be unique.
    """
    wide, width = np.r_[codes, -1], int(codes.max()) + 2
    at = at[np.argsort(codes[at], kind="stable")]
    first = codes[at]
    new = np.r_[True, first[1:] != first[:-1]]
    live, k = np.arange(len(at)), 1
    while True:
        alone = new[live] & np.r_[new[live[1:]] | (np.diff(live) > 1), True]
        live = live[~alone]
        if length is not None:
            live = live[length[at[live]] > k]
        if not len(live):
            return at, new
        group, value = np.cumsum(new[live]), wide[at[live] + k]
        by = np.argsort(group * width + value, kind="stable")
        at[live] = at[live[by]]
        value = value[by]
        new[live[1:]] |= value[1:] != value[:-1]
        k += 1


def _induce_runs(t: np.ndarray, small: np.ndarray, ends: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The same for a text of names, in which few suffixes share their first letters: run by run.

    A larger suffix is in order by its run of letters up to the leftmost-smaller
    suffix that ends it, whose place is known; then smaller suffixes likewise by
    their run up to a larger one.
    """
    n, starts = len(t), np.r_[0, ends[:-1]]
    place = starts[t]  # of a larger suffix: before all smaller ones of its bucket
    seeds = leftmost[np.argsort(t[leftmost], kind="stable")]
    letter = t[seeds]
    last = np.searchsorted(letter, letter, side="right")
    place[seeds] = ends[letter] - last + np.arange(len(seeds))
    sa = np.empty(n, np.int64)
    for mine, before in ((np.flatnonzero(~small), True), (np.flatnonzero(small), False)):
        order = _run_order(place, mine)[0]
        letter = t[order]
        if before:
            slot = starts[letter] + np.arange(len(order)) - np.searchsorted(letter, letter, side="left")
        else:
            slot = ends[letter] - np.searchsorted(letter, letter, side="right") + np.arange(len(order))
        sa[slot] = order
        place = ends[t] - 1  # of a smaller suffix: behind all larger ones of its bucket
        place[order] = slot
    return sa


def _same_substrings(t: np.ndarray, small: np.ndarray, is_left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For leftmost-smaller substrings in order: whether each equals the one before it."""
    positions = np.flatnonzero(is_left)
    following = np.empty(len(t), _positions(len(t)))
    following[positions] = np.r_[positions[1:], len(t) - 1]
    length = following[order] - order + 1
    same = np.zeros(len(order), bool)
    same[1:] = (length[1:] == length[:-1]) & (order[1:] != positions[-1]) & (order[:-1] != positions[-1])
    k = 0
    live = np.flatnonzero(same)
    while len(live):
        live = live[length[live] > k]
        if not len(live):
            break
        a, b = order[live] + k, order[live - 1] + k
        differ = (t[a] != t[b]) | (small[a] != small[b])
        same[live[differ]] = False
        live = live[~differ]
        k += 1
    return same


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``t`` in order; a suffix that is a prefix of another comes before it."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    if n < 24 or int(t.max()) > 4 * n:  # few suffixes, or names to be made dense first
        if n < 24:
            return np.array(sorted(range(n), key=lambda i: t[i:].tolist()))
        t = np.unique(t, return_inverse=True)[1]
    ends = np.cumsum(np.bincount(t))
    small = _classes(t)
    is_left = np.zeros(n, bool)
    is_left[1:] = small[1:] & ~small[:-1]
    positions = np.flatnonzero(is_left).astype(_positions(n))
    few = len(ends) <= n // MANY
    if not few:  # codes of letter and class, and of places, are computed with it
        t = t.astype(np.int64, copy=False)
    induce = _induce if few else _induce_runs
    if not len(positions):
        return induce(t, small, ends, positions)
    if few:
        sa = _induce(t, small, ends, positions)
        order = sa[is_left[sa]]
        new = ~_same_substrings(t, small, is_left, order)
        del sa
    else:
        length = np.zeros(n, _positions(n))
        length[positions] = np.diff(np.r_[positions, n]) + 1
        order, new = _run_order(2 * t + small, positions, length)
    names = np.cumsum(new) - 1
    if names[-1] + 1 < len(order):
        by_place = np.empty(n, _positions(n))
        by_place[order] = names
        named = by_place[positions]
        del by_place, names, new, order  # not held while the names are sorted
        order = positions[suffix_array(named)]
    return induce(t, small, ends, order)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position: how many letters its suffix shares with the one before it in the suffix array.

    Where the letters to the left of both suffixes agree the value is one less
    than the position's left neighbour's, so only the others are compared.
    """
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    kind = _positions(n)
    before = np.full(n, -1, kind)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=kind)
    known = before >= 0
    follows = known & (at > 0) & (before > 0)
    follows[follows] = t[at[follows] - 1] == t[before[follows] - 1]
    follows[1:] &= before[:-1][...] >= 0
    own = np.flatnonzero(known & ~follows).astype(kind)
    length = np.zeros(n, kind)
    live, k = own, 0
    padded = np.append(t, t[:1])  # read where either suffix has ended, and not heeded
    while len(live):
        a, b = live + k, before[live] + k
        inside = (a < n) & (b < n)
        equal = inside & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        length[live[~equal]] = k
        live = live[equal]
        k += 1
    length += at
    length[follows] = 0
    np.maximum.accumulate(length, out=length)
    length -= at
    length[~known] = 0
    return length
