"""Suffix array of an integer sequence by the difference cover modulo 3 (Kärkkäinen and Sanders), in whole-array steps.

Sort the triples at positions 1 and 2 modulo 3, name them, recurse on the names if they aren't all different, sort the
remaining suffixes by first symbol and the rank that follows, and merge.
"""

from __future__ import annotations

import numpy as np

#: Symbols and ranks fit in so many bits, three of them in a word: sequences are at most 2 million long.
BITS = 21


def _key(*columns: np.ndarray) -> np.ndarray:
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        out = (out << BITS) | c
    return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order. Symbols are at least 1."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    triples = _key(s[sampled], s[sampled + 1], s[sampled + 2])
    order = np.argsort(triples, kind="stable")
    ordered = triples[order]
    name = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if name[-1] < len(sampled):
        names = np.empty(len(sampled), np.int64)
        names[order] = name
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_key(s[rest], rank[rest + 1]), kind="stable")]
    by_rank = sampled[order]
    by_rank = by_rank[by_rank < n]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    below = np.searchsorted(_key(s[first], rank[first + 1]), _key(s[rest], rank[rest + 1]))
    below += np.searchsorted(_key(s[second], s[second + 1], rank[second + 2]), _key(s[rest], s[rest + 1], rank[rest + 2]))
    out = np.full(n, -1, np.int64)
    out[np.arange(len(rest)) + below] = rest
    out[out < 0] = by_rank
    return out


def equal_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each neighbouring pair of ``order``, whether the next ``length`` symbols of both are equal (all exist)."""
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for k in range(length):
        same = same[symbols[a[same] + k] == symbols[b[same] + k]]
        if not len(same):
            break
    out = np.zeros(len(a), bool)
    out[same] = True
    return out
