"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Odd multipliers (fixed values, no meaning beyond being odd and spread out).
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        step = np.full(size, BASE, np.uint64)
        back = np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
        step[0] = back[0] = 1
        _powers, _inverse = np.cumprod(step), np.cumprod(back)
    return _powers[:n], _inverse[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of (byte + 1) * BASE ** place over i <= place < j."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=c[1:])
    return c


def span_hashes(c: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of byte spans: equal strings have equal hashes wherever they stand."""
    return mix((c[stop] - c[start]) * powers(len(c))[1][start] + (stop - start).astype(np.uint64) * STEP)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word: A-Z lower-cased, split at ASCII white space."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    stop = stop[len(stop) - len(start) :]
    hashes = span_hashes(prefix_hashes(data), start, stop)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, start, "right")


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text, as hashes in order, and offsets.

    A text of fewer words is one shingle; a text without words has none.
    """
    w, doc = words(texts)
    counts = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([w, np.zeros(n, np.uint64)])
    held = np.zeros(len(w), np.uint64)
    left = first[doc + 1] - np.arange(len(w))  # words from here to the end of the text
    for k in range(n):
        held = mix(held * STEP + np.where(left > k, padded[k : k + len(w)], np.uint64(k + 1)))
    starts = left >= n
    starts[first[:-1][(counts > 0) & (counts < n)]] = True
    held, doc = held[starts], doc[starts]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [np.unique(held[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else held), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def chunks(texts: list[bytes], size: int = 1 << 19):
    """Slices of a list of texts with about ``size`` bytes each."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield slice(begin, i)
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))
