"""Suffix arrays over bytes in numpy: Larsson-Sadakane refinement, Kasai common prefixes, binary search.

Suffixes are ordered in full; common prefixes are followed for `depth` bytes, which is all that is asked of them.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.words import ragged

PAD = 8


def padded(data: bytes | np.ndarray) -> np.ndarray:
    """data as uint8 with zero bytes behind, so that eight bytes can be read at every place."""
    return np.concatenate([np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray)) else data, np.zeros(PAD, np.uint8)])


def eights(text: np.ndarray, big: bool = True) -> np.ndarray:
    """For each place of the padded text, the eight bytes from there, as a number (first byte most significant if big)."""
    n = len(text) - PAD
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(text, ">u8" if big else "<u8", count=len(range(k, n, 8)), offset=k)
    return out


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes; words: eights(text). The end of the text, which is not a zero byte, sorts before any byte.

    First all suffixes are sorted by eight bytes. A group of equal ones is then refined by the rank of the suffix as
    many bytes further on as are known to agree; that number doubles. Only groups that are still unsorted are touched.
    """
    n = len(words)
    order = np.argsort(words)
    ordered = words[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.empty(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    known = 8
    unsorted = _unsorted(head)
    while len(unsorted) and known < 2 * n:
        at = order[unsorted]
        ahead = at + known
        key = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[unsorted] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = unsorted[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        unsorted = unsorted[~(new & np.r_[new[1:], True])]
        known *= 2
    return order, rank


def _unsorted(head: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~(head & np.r_[head[1:], True])) if len(head) else np.empty(0, np.int64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading bytes of numbers from eights(big=False)."""
    x = a ^ b
    low = x & (~x + np.uint64(1))
    return np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)


def common_prefixes(little: np.ndarray, order: np.ndarray, depth: int, lanes: int = 4096) -> np.ndarray:
    """Kasai: for each place in order, the length of the common prefix with the suffix before it, depth at most.

    order may list some of the suffixes only. The listed stretches of text are cut into lanes that advance together. In
    each, a suffix shares at least one byte less with the suffix before it in order than the text's previous suffix did
    (if the one behind that one's neighbour is listed too), so what is known is never compared again.
    """
    n, out = len(little), np.zeros(len(order), np.int64)
    if not len(order):
        return out
    before, rank = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    before[order[1:]], rank[order] = order[:-1], np.arange(len(order))
    listed = np.flatnonzero(rank >= 0)
    first = np.flatnonzero(np.r_[True, np.diff(listed) > 1])
    sizes, step = np.diff(np.r_[first, len(listed)]), max(64, -(-len(order) // lanes))
    cuts = -(-sizes // step)
    place = ragged(np.zeros(len(first), np.int64), cuts) * step + np.repeat(listed[first], cuts)
    stop = np.minimum(place + step, np.repeat(listed[first] + sizes, cuts))
    have = np.zeros(len(place), np.int64)
    while len(place):
        other = before[place]
        a, b = place + have, other + have
        can = (other >= 0) & (have < depth) & (np.maximum(a, b) < n)
        got = np.zeros(len(place), np.int64)
        c = np.flatnonzero(can)
        # no common prefix may run past the end of the text
        got[c] = np.minimum(agreeing(little[a[c]], little[b[c]]), n - np.maximum(a[c], b[c]))
        have = np.minimum(have + got, depth)
        done = (got < 8) | (have >= depth)
        d = np.flatnonzero(done)
        out[rank[place[d]]] = have[d]
        place[d] += 1
        have[d] = np.where(rank[other[d] + 1] >= 0, np.maximum(have[d] - 1, 0), 0)
        if (place >= stop).any():
            stay = place < stop
            place, stop, have = place[stay], stop[stay], have[stay]
    return out


def compare(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
    """Sign of the byte order of a's suffixes from at_a and b's from at_b, over depth bytes each; a, b: eights(big=True)."""
    out, depth = np.zeros(len(at_a), np.int64), np.broadcast_to(depth, len(at_a))
    left, k = np.flatnonzero(depth > 0), 0
    while len(left):
        x, y = a[np.minimum(at_a[left] + k, len(a) - 1)], b[np.minimum(at_b[left] + k, len(b) - 1)]
        rest = depth[left] - k
        short = np.flatnonzero(rest < 8)
        if len(short):
            keep = ~np.uint64(0) << (8 * (8 - rest[short])).astype(np.uint64)
            x[short] &= keep
            y[short] &= keep
        sign = (x > y).astype(np.int64) - (x < y)
        out[left] = sign
        k += 8
        left = left[(sign == 0) & (rest > 8)]
    return out


def found_in(queries: np.ndarray, at: np.ndarray, words: np.ndarray, order: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
    """For each query suffix (places `at` of queries) the place in order of an equal one by depth bytes, or -1; by binary search.

    order lists places of words in the order of their suffixes. No comparison may run past the end of either text: each
    place has depth bytes behind it, or one of the two ends in a byte that tells it from the other.
    """
    depth = np.broadcast_to(depth, len(at))
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            break
        mid = (low[live] + high[live]) >> 1
        more = compare(queries, at[live], words, order[mid], depth[live]) > 0
        low[live] = np.where(more, mid + 1, low[live])
        high[live] = np.where(more, high[live], mid)
    inside = np.flatnonzero(low < len(order))
    hit = np.full(len(at), -1, np.int64)
    if len(inside):
        same = compare(queries, at[inside], words, order[low[inside]], depth[inside]) == 0
        hit[inside[same]] = low[inside[same]]
    return hit
