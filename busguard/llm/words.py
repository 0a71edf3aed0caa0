"""Word and word-shingle hashes of a text, as whole-array operations on its UTF-8 bytes.

A word is a maximal run of bytes that the byte table marks; A-Z count as a-z.  Hashes are 64 bits wide and
depend on the words alone, so equal word sequences get equal hashes in every process.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)  # odd
_JOIN = _U(0xD6E8FEB86659FD93)  # odd


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_values(separators) -> np.ndarray:
    """Value of each byte in a word's hash: 0 for separators, the same for A-Z as for a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    values[np.arange(65, 91)] = values[np.arange(97, 123)]
    values[list(separators)] = 0
    return values


#: Words between ASCII white space (space, tab to carriage return).
BY_SPACE = byte_values([0x20, *range(0x09, 0x0E)])
#: Words of 0-9, A-Z, a-z and every character beyond ASCII.
BY_ALNUM = byte_values([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def word_bounds(raw: bytes, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of every byte, and first and past-the-last byte of every word."""
    got = values[np.frombuffer(raw, dtype=np.uint8)]
    inside = np.empty(len(got) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.not_equal(got, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return got, edges[0::2], edges[1::2]


def word_hashes(raw: bytes, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, past the last byte) of every word."""
    got, first, last = word_bounds(raw, values)
    if not len(first):
        return np.empty(0, dtype=np.uint64), first, last
    spans = np.diff(np.append(first, len(got)))
    place = np.arange(first[0], len(got)) - np.repeat(first, spans)
    longest = int(spans.max())
    powers = np.multiply.accumulate(np.full(longest, _STEP, dtype=np.uint64))
    sums = np.add.reduceat(got[first[0]:] * powers[place], first - first[0])
    return mix(sums + (last - first).astype(np.uint64) * _JOIN), first, last


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _JOIN
        out += words[j:j + n]
    return mix(out + _U(k))


def shingle_set(raw: bytes, k: int, values: np.ndarray = BY_SPACE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a text of fewer words, but some, has one: all its words."""
    words, _, _ = word_hashes(raw, values)
    if not len(words):
        return words
    return np.unique(shingles(words, min(k, len(words))))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """``shingle_set`` of many texts (words between white space), their bytes hashed as one array."""
    raw = b"\n".join(texts)
    words, first, _ = word_hashes(raw, BY_SPACE)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.concatenate([[0], np.searchsorted(first, ends)])  # the words of text i: cuts[i] .. cuts[i + 1]
    whole = shingles(words, k)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(whole[a:b - k + 1]))
        elif b > a:
            out.append(shingles(words[a:b], b - a))
        else:
            out.append(words[:0])
    return out


def in_batches(texts: list[str], most_bytes: int = 1 << 20, most_texts: int = 256):
    """Lists of UTF-8 texts of about ``most_bytes`` each (a longer text has a list of its own)."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode()
        if part and (size + len(raw) > most_bytes or len(part) >= most_texts):
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield part
