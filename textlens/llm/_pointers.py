"""Pointers to word starts of a text buffer, sorted by multikey quicksort; eight bytes at a time stand for one character."""

from __future__ import annotations

import numpy as np

#: Bytes of terms: letters and everything beyond ASCII. A-Z are lower-cased.
TERM = np.ones(256, bool)
TERM[:0x41] = TERM[0x5B:0x61] = TERM[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: What is left of a key when r bytes of its term remain.
_LEFT = np.array([0] + [(1 << 64) - (1 << (64 - 8 * r)) for r in range(1, 9)], np.uint64)


def term_starts(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text number) of every term; texts lie one after the other in the buffer, terms never cross two of them."""
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = TERM[text]
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    before[offsets[:-1][offsets[:-1] < len(text)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1 - starts, np.searchsorted(offsets[1:], starts, "right")


def sort_pointers(text: np.ndarray, start: np.ndarray, length: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): pointers by slice, then by term; head marks the first of each run of equal terms. Equal ones keep their order.

    text: lower-cased, with 8 zero bytes behind. slices: sizes of the ranges of pointers to sort on their own. All slices take a
    step at once: each is split in three by the next eight bytes of a pivot; the middle part goes on eight bytes further, or is
    a run when its terms end there (terms hold no zero byte, so a zero at a key's end is the end of the term).
    """
    words = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))

    def keys(which: np.ndarray, depth: np.ndarray) -> np.ndarray:
        rest = np.clip(length[which] - depth, 0, 8)
        return words[np.where(rest > 0, start[which] + depth, 0)].astype(np.uint64) & _LEFT[rest]

    order, head = np.empty(len(start), np.int64), np.zeros(len(start), bool)
    size = slices[slices > 0]
    place, depth = np.cumsum(size) - size, np.zeros(len(size), np.int64)  # where a slice stands in the order
    which = np.arange(len(start))
    key = keys(which, np.zeros(len(start), np.int64)) if len(start) else np.empty(0, np.uint64)
    random = np.random.default_rng(0)
    while len(size):
        begin = np.cumsum(size) - size
        pivot = np.repeat(key[begin + random.integers(0, size)], size)
        low, same = key < pivot, key == pivot
        n_low, n_same = np.add.reduceat(low, begin, dtype=np.int64), np.add.reduceat(same, begin, dtype=np.int64)
        # stable three-way split: low and same elements are counted from the left, the others are what is between
        c_low, c_same = np.cumsum(low), np.cumsum(same)
        at = np.arange(len(key))
        to_low = np.repeat(begin - (c_low[begin] - low[begin]), size) + c_low - 1
        to_same = np.repeat(begin + n_low - (c_same[begin] - same[begin]), size) + c_same - 1
        before_low, before_same = np.repeat(c_low[begin] - low[begin], size), np.repeat(c_same[begin] - same[begin], size)
        to_high = at + np.repeat(n_low + n_same, size) - (c_low - before_low) - (c_same - before_same)
        to = np.where(low, to_low, np.where(same, to_same, to_high))
        moved, moved_key = np.empty_like(which), np.empty_like(key)
        moved[to], moved_key[to] = which, key
        parts = np.stack([n_low, n_same, size - n_low - n_same], 1)
        places = (place[:, None] + np.cumsum(parts, 1) - parts).ravel()
        deeper = np.tile([False, True, False], len(size))
        depth, size = np.repeat(depth, 3), parts.ravel()
        used = size > 0
        places, deeper, depth, size = places[used], deeper[used], depth[used], size[used]
        begin = np.cumsum(size) - size
        done = (size == 1) | (deeper & (moved_key[begin] & np.uint64(255) == 0))
        head[places[done]] = True
        over = np.repeat(done, size)
        order[(np.repeat(places - begin, size) + np.arange(len(moved)))[over]] = moved[over]
        which, key = moved[~over], moved_key[~over]
        place, deeper, depth, size = places[~done], deeper[~done], depth[~done] + 8 * deeper[~done], size[~done]
        again = np.repeat(deeper, size)
        key[again] = keys(which[again], np.repeat(depth, size)[again])
    return order, head


def gather(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the given ranges one after the other."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    return text[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])], offsets
