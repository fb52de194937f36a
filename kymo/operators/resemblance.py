"""Which terms of one list have a given ratio by sequence matching: bounds over bits, then the matching of many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Longer terms are matched one pair at a time.
WIDE = 64


def _masks(terms: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each term 64 bits of its characters, a first and a further one of a kind apart, and 64 of its pairs of neighbours."""
    ones, twos = np.zeros(len(terms), np.uint64), np.zeros(len(terms), np.uint64)
    bit, high, before = np.uint64(1), np.uint64(32), np.zeros(len(terms), np.uint64)
    for c in codes.astype(np.uint64):
        one = np.where(c > 0, bit << c % 32, np.uint64(0))
        ones |= np.where(ones & one, one << high, one)
        twos |= np.where((c > 0) & (before > 0), bit << (before * np.uint64(31) + c) % 64, np.uint64(0))
        before = c
    for k in [k for k, t in enumerate(terms) if len(t) > WIDE]:
        one = two = last = 0
        for c in map(ord, terms[k]):
            one |= 1 << c % 32 + 32 * (one >> c % 32 & 1)
            two |= 1 << (last * 31 + c) % 64 if last else 0
            last = c
        ones[k], twos[k] = one, two
    return ones, twos


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair (columns of characters) the longest common run, of these the first in ``a``, then in ``b``: length and begins."""
    runs = np.zeros((len(b) + 1, b.shape[1]), np.uint8)
    best = np.zeros(b.shape[1], np.uint8)
    at, to = np.zeros(b.shape[1], np.int16), np.zeros(b.shape[1], np.int16)
    for i in range(len(a)):
        runs[1:] = (a[i] == b) * (runs[:-1] + np.uint8(1))
        most = runs.max(0)
        better = np.flatnonzero(most > best)
        if len(better):
            best[better], at[better], to[better] = most[better], i, runs[1:, better].argmax(0)
    return best.astype(np.int16), at - best + 1, to - best + 1


def matching(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Characters matched of term ``a`` and term ``b`` of each pair, as ``SequenceMatcher`` counts them; 0 once they can't reach ``least``."""
    total, bound = np.zeros(len(a), np.int64), np.minimum(lengths[a], lengths[b])
    pair, zero = np.arange(len(a)), np.zeros(len(a), np.int16)
    parts = np.stack([zero, lengths[a].astype(np.int16), zero, lengths[b].astype(np.int16)])
    while len(pair):
        low, high, first, last = parts
        place = np.arange(max(high.max(), last.max()))[:, None]
        left, right = codes[: len(place), a[pair]], codes[: len(place), b[pair]]
        none = codes.dtype.type(0)  # characters are from 2 on: outside of its part a term has 0 on the left, 1 on the right
        left = np.where((place >= low) & (place < high), left, none)[: high.max()]
        right = np.where((place >= first) & (place < last), right, none + codes.dtype.type(1))[: last.max()]
        size, i, j = _longest(left, right)
        total += np.bincount(pair, size, len(total)).astype(np.int64)
        rest = np.minimum(i - low, j - first) + np.minimum(high - i - size, last - j - size)
        bound -= np.bincount(pair, np.minimum(high - low, last - first) - np.where(size > 0, size + rest, 0), len(bound)).astype(np.int64)
        parts = np.concatenate([np.stack([low, i, first, j]), np.stack([i + size, high, j + size, last])], axis=1).astype(np.int16)
        pair = np.concatenate([pair, pair])
        more = (np.concatenate([size, size]) > 0) & (parts[1] > parts[0]) & (parts[3] > parts[2]) & (bound[pair] >= least[pair])
        pair, parts = pair[more], parts[:, more]
    return np.where(bound >= least, total, 0)


def resembling(lists: list[list[str]], ratio: float, swap: bool = False, alive: list[np.ndarray] | None = None, cells: int = 1 << 18) -> Iterator[tuple]:
    """Of each list, block by block of its places: which list, the block's first place and the one after it, and all pairs of a
    place there and an earlier one whose terms have ``ratio`` or more: both places, in ascending order, and the ratio.

    The later term is matched against the earlier one (``swap``: the earlier against the later). With M characters matched,
    la + lb - 2 M are not: so many bits of their characters may differ at most, and three times as many of their pairs,
    since a character that is not matched parts two pairs on its side and one on the other. Memory is ``cells`` pairs at a time;
    pairs of many short lists are matched together. Who sets places of ``alive`` to false leaves them out of later blocks.
    """
    terms = [t for part in lists for t in part]
    if not terms:
        return
    lengths = np.array([len(t) for t in terms], np.int64)
    spare = ((1 - ratio) * lengths + 1e-3).astype(np.float32)  # of both terms together, so many characters may be unmatched
    drawn = np.array([t if len(t) <= WIDE else "" for t in terms], f"U{max(1, min(WIDE, lengths.max(initial=0)))}").view(np.uint32).reshape(len(terms), -1).T
    ones, twos = _masks(terms, drawn)
    kinds, codes = np.unique(drawn, return_inverse=True)
    codes = (codes.reshape(drawn.shape) + 2).astype(np.uint8 if len(kinds) < 250 else np.uint32)
    waiting: list[tuple] = []

    def flush() -> Iterator[tuple]:
        if not waiting:
            return
        j, i = (np.concatenate([x[k] for x in waiting]) for k in (4, 5))
        both = lengths[i] + lengths[j]
        a, b = (i, j) if swap else (j, i)
        short = np.maximum(lengths[i], lengths[j]) <= WIDE
        found = np.zeros(len(j))
        n = matching(codes, lengths, a[short], b[short], np.ceil(ratio * both[short] / 2 - 1e-6))
        found[short] = np.where(both[short] > 0, 2.0 * n / np.maximum(both[short], 1), 1.0)
        matcher_of = -1
        for k in np.flatnonzero(~short):
            if b[k] != matcher_of:
                matcher, matcher_of = SequenceMatcher(None, "", terms[b[k]]), b[k]
            matcher.set_seq1(terms[a[k]])
            found[k] = matcher.ratio() if matcher.quick_ratio() >= ratio else 0.0
        end = 0
        for which, begin, low, high, part, _ in waiting:
            part = slice(end, end + len(part))
            near, end = found[part] >= ratio, part.stop
            yield which, low, high, j[part][near] - begin, i[part][near] - begin, found[part][near]
        waiting.clear()

    begin = held = 0
    for which, part in enumerate(lists):
        high = 0
        while high < len(part):
            low = high
            high = min(len(part), low + max(1, min(512, cells // (low + 512))))
            if low or held > cells:
                yield from flush()
                held = 0
            z = np.arange(begin + low, begin + high)
            y = z if not low else np.concatenate([begin + np.flatnonzero(alive[which][:low]) if alive else np.arange(begin, begin + low), z])
            j, i = np.nonzero(np.bitwise_count(ones[z, None] ^ ones[y]) <= spare[z, None] + spare[y])
            j, i = z[j], y[i]
            near = (i < j) & (np.bitwise_count(twos[i] ^ twos[j]) <= 3 * (spare[i] + spare[j])) & (2 * np.minimum(lengths[i], lengths[j]) >= ratio * (lengths[i] + lengths[j]) - 1e-6)
            waiting.append((which, begin, low, high, j[near], i[near]))
            held += np.count_nonzero(near)
        begin += len(part)
    yield from flush()
