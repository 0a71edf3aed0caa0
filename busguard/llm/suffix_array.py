"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

``suffix_array`` classifies the suffixes (S: smaller than the next one, L: larger), sorts the leftmost-smaller (LMS)
substrings by one induction, names them, sorts the string of names recursively where names repeat, and induces all
suffixes from the sorted LMS suffixes.  An induction scans the array once in each direction; the scan takes as many
entries at a time as cannot reach each other's places, so it costs a bounded number of array operations.
"""

from __future__ import annotations

import numpy as np

FEW = 24


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last is the sentinel's."""
    n = len(t)
    out = np.ones(n, dtype=bool)
    if n > 1:
        differs = np.where(t[1:] != t[:-1], np.arange(n - 1), n - 1)
        following = np.minimum.accumulate(differs[::-1])[::-1]
        out[:-1] = t[following] < t[np.minimum(following + 1, n - 1)]
    return out


def _places(chars: np.ndarray, ends: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the entries by character, their places from the open end of each bucket, their characters."""
    narrow = chars.astype(np.uint16) if len(ends) <= 1 << 16 else chars  # numpy sorts 16 bits by radix
    order = narrow.argsort(kind="stable")
    sorted_chars = chars[order]
    number = np.arange(len(order))
    first = np.where(_changes(sorted_chars), number, 0)
    return order, ends[sorted_chars] + step * (number - np.maximum.accumulate(first)), sorted_chars


def _changes(values: np.ndarray) -> np.ndarray:
    """True at the first of each stretch of equal values."""
    out = np.empty(len(values), dtype=bool)
    out[:1] = True
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _scan(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, ends: np.ndarray, step: int) -> None:
    """Enter the predecessor of every entry, where ``wanted``, at the open end of its bucket; ``step`` is +1 for a
    scan from the left (ends are heads) and -1 from the right (ends are the last free places)."""
    n = len(sa)
    at, size = (0, 1024) if step > 0 else (n - 1, 1024)
    while 0 <= at < n:
        stop = min(n, at + size) if step > 0 else max(-1, at - size)
        block = sa[at:stop] if step > 0 else sa[stop + 1:at + 1][::-1]
        filled = (block > 0).nonzero()[0]
        before = block[filled] - 1
        taken = wanted[before]
        filled, before = filled[taken], before[taken]
        if not len(before):
            at = stop
            size = min(size * 2, 1 << 17)
            continue
        order, places, chars = _places(t[before], ends, step)
        nearest = int(places.min() if step > 0 else places.max())
        cut = nearest < stop if step > 0 else nearest > stop
        if cut:  # an entry of this block belongs inside it: end the block there
            stop = nearest
            inside = (filled[order] < (stop - at) * step)
            order, places, chars = order[inside], places[inside], chars[inside]
        sa[places] = before[order]
        ends[chars] = places + step  # of equal characters the last one counts
        done = abs(stop - at)
        at = stop
        size = max(256, 2 * done) if cut else min(size * 2, 1 << 17)


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the given order."""
    n = len(t)
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    tails = np.cumsum(counts) - 1
    sa = np.full(n, -1, dtype=np.int32)
    order, places, _ = _places(t[lms[::-1]], tails.copy(), -1)
    sa[places] = lms[::-1][order]
    _scan(sa, t, ~smaller, heads, 1)
    kept = sa >= 0
    kept[kept] = ~smaller[sa[kept]]
    kept[0] = True  # the sentinel
    sa[~kept] = -1
    _scan(sa, t, smaller, tails, -1)
    sa[0] = n - 1
    return sa


def _names(t: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0 for the first of the sorted LMS substrings, then one more wherever a substring differs from the last."""
    a, b = ordered[:-1], ordered[1:]
    length = ends[b] - b
    same = (ends[a] - a) == length
    open_ = np.flatnonzero(same)
    offset = 0
    while len(open_):
        equal = t[a[open_] + offset] == t[b[open_] + offset]
        same[open_[~equal]] = False
        open_ = open_[equal]
        open_ = open_[length[open_] > offset]
        offset += 1
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last is 0 and the only 0."""
    n = len(t)
    if n <= FEW:
        values = t.tolist()
        return np.array(sorted(range(n), key=lambda i: values[i:]), dtype=np.int32)
    t = np.ascontiguousarray(t, dtype=np.int32)
    smaller = s_types(t)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    counts = np.bincount(t)
    if len(lms) == 1:
        return _induce(t, smaller, lms, counts)
    rough = _induce(t, smaller, lms, counts)
    ordered = rough[is_lms[rough]]
    ends = np.zeros(n, dtype=np.int32)
    ends[lms] = np.append(lms[1:], n - 1)
    named = _names(t, ordered, ends)
    if named[-1] + 1 < len(lms):
        name_at = np.zeros(n, dtype=np.int32)
        name_at[ordered] = named
        ordered = lms[suffix_array(name_at[lms])]
    return _induce(t, smaller, ordered, counts)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, stops: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position, its predecessor in the suffix array (phi) and their common prefix, exact up to ``most``.

    Only irreducible positions (the characters before the two differ) and those marked in ``stops`` are compared;
    everywhere else the prefix is the one of the position before, less one.
    """
    n = len(t)
    phi = np.empty(n, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = n - 1
    begins = stops.copy()
    begins[0] = True
    inner = np.arange(1, n)
    before = np.maximum(phi[1:] - 1, 0)
    begins[1:] |= (t[inner - 1] != t[before]) | (phi[1:] == 0)
    begins[sa[0]] = True
    at = np.flatnonzero(begins)
    padded = np.concatenate([t.astype(np.uint16), np.zeros(most + 8, dtype=np.uint16)])
    words = np.zeros(n + most + 4, dtype=np.uint64)
    for i in range(4):
        words |= padded[i:i + n + most + 4].astype(np.uint64) << np.uint64(16 * i)
    common = np.zeros(len(at), dtype=np.int64)
    open_ = np.arange(len(at))
    a, b = at, phi[at]
    while len(open_):
        difference = words[a] ^ words[b]
        equal = difference == 0
        rest = difference[~equal]
        same = ((rest & np.uint64(0xFFFF)) == 0).astype(np.int64)
        same += (rest & np.uint64(0xFFFFFFFF)) == 0
        same += (rest & np.uint64(0xFFFFFFFFFFFF)) == 0
        common[open_[~equal]] += same
        open_, a, b = open_[equal], a[equal] + 4, b[equal] + 4
        common[open_] += 4
        going = (common[open_] < most) & (a < n) & (b < n)
        open_, a, b = open_[going], a[going], b[going]
    common[begins[at] & (at == sa[0])] = 0
    last = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    value = np.zeros(n, dtype=np.int64)
    value[at] = common
    return phi, np.maximum(value[last] - (np.arange(n) - last), 0)
