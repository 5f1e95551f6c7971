"""Suffix arrays by two-stage sorting, over arrays.

Only the suffixes smaller than their successors are sorted directly. The others
are induced: going through the buckets of first bytes in order, the suffix before
each one already placed comes next in its own bucket. Order is exact as far as a
given depth, which is all that common prefixes up to that depth need.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """At every place the eight bytes from there as one big-endian number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(depth + 3 * WORD, np.uint8)])
    return np.ndarray((len(padded) - WORD + 1,), ">u8", padded, 0, (1,))


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one; the end is smallest."""
    n = len(data)
    changes = np.flatnonzero(data[1:] != data[:-1])
    rises = data[changes + 1] > data[changes]
    at = np.searchsorted(changes, np.arange(n))
    out = np.zeros(n, bool)
    inside = at < len(changes)
    out[inside] = rises[at[inside]]
    return out


def direct_sort(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at ``places`` in the order of their first ``depth`` bytes; only ties go on to the next word."""
    if not len(places):
        return places
    key = words[places].astype(np.uint64)
    order = np.argsort(key)
    places, key = places[order], key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    group = np.cumsum(first)[tied]
    for at in range(WORD, depth, WORD):
        if not len(tied):
            break
        key = words[places[tied] + at].astype(np.uint64)
        order = np.lexsort((key, group))
        places[tied] = places[tied[order]]
        key, group = key[order], group[order]
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        still = ~(first & np.append(first[1:], True))
        tied, group = tied[still], np.cumsum(first)[still]
    return places


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """The starts of all suffixes, in the order of their first ``depth`` bytes at least."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    words = _words(data, depth)
    direct = direct_sort(words, np.flatnonzero(smaller_than_successor(data)), depth)
    ends = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
        induced = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        parts = [induced]
        # A run of one byte: each round induces the suffix one byte longer.
        while len(induced):
            before = induced[induced > 0] - 1
            induced = before[data[before] == byte]
            parts.append(induced)
        bucket = np.concatenate([*parts, direct[ends[byte] : ends[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        chars = data[before]
        later = chars > byte
        before, chars = before[later], chars[later]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        cuts = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(chars) else []
        for a, b in zip(cuts, [*cuts[1:], len(chars)]):
            waiting[chars[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, counted up to ``width``; 0 for the first."""
    words = _words(data, width)
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for depth in range(0, width, WORD):
        differ = words[order[at] + depth].astype(np.uint64) ^ words[order[at - 1] + depth].astype(np.uint64)
        same = differ == 0
        out[at[same]] = depth + WORD
        apart = at[~same]
        # Leading zero bytes of what differs; without the bit below the first, no rounding reaches the next power.
        differ = differ[~same]
        bits = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
        out[apart] = depth + (64 - bits) // 8
        at = at[same]
    return np.minimum(out, width)


def shared_prefixes(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each suffix whether it shares ``width`` bytes with the one before it in ``order``; that many are words or more.

    The same as whether ``common_prefixes`` gives ``width``, without the lengths of shorter ones.
    """
    words = _words(data, width)
    out = np.zeros(len(order), bool)
    first = words[order].astype(np.uint64)
    at = np.flatnonzero(first[1:] == first[:-1]) + 1
    for depth in [*range(WORD, width - WORD, WORD), width - WORD]:
        at = at[words[order[at] + depth] == words[order[at - 1] + depth]]
    out[at] = True
    return out
