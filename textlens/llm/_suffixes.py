"""Suffix array and common prefixes of one shard by external induced sorting.

The priority queue of an induction holds tuples (first character, rank of the suffix one further, position) as sorted runs,
on disk beyond a budget. Tuples are taken in bulk: as many of the smallest as come before everything that they themselves will
insert. The order of the suffixes that begin an ascent comes from the recursion on their names.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of one array, and of a queue's runs, above which they are kept in a temporary file.
MEMORY = 32 << 20
#: Common prefixes are counted up to here unless the caller says otherwise.
CAP = 200
#: A text of so many characters at most ends the recursion: it is sorted in memory by doubling prefixes.
BASE = 1 << 16
#: Bits of a rank within a queue's key, and the bit that puts given suffixes behind induced ones of the same first character.
RANK_BITS = 38
GIVEN = 1 << RANK_BITS
RUNS = 12


def room(shape, dtype, memory: int = MEMORY) -> np.ndarray:
    """A zeroed array, in an unnamed temporary file if it is larger than `memory` bytes."""
    size = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if size <= memory:
        return np.zeros(shape, dtype)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype, "w+", shape=shape)


def kept(a: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """a itself, or a copy in an unnamed temporary file if it is larger than `memory` bytes."""
    if a.nbytes <= memory:
        return a
    out = room(a.shape, a.dtype, memory)
    out[:] = a
    return out


class RunQueue:
    """A priority queue of (key, value) pairs for bulk use: sorted runs, of which the small ones are merged now and then and
    the large ones live in temporary files."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.runs = memory, []

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(keys):
            order = np.argsort(keys, kind="stable")
            self.runs.append([self._kept(keys[order]), self._kept(values[order]), 0])
            if len(self.runs) > RUNS:
                self._merge()

    def _kept(self, a: np.ndarray) -> np.ndarray:
        out = room(a.shape, a.dtype, self.memory // (4 * RUNS))
        out[:] = a
        return out

    def _merge(self) -> None:
        """Puts the smaller runs together, so that each tuple moves a logarithmic number of times."""
        self.runs.sort(key=lambda r: len(r[0]) - r[2])
        small, self.runs = self.runs[: RUNS // 2 + 1], self.runs[RUNS // 2 + 1 :]
        self.push(np.concatenate([r[0][r[2] :] for r in small]), np.concatenate([r[1][r[2] :] for r in small]))

    def peek(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n smallest (keys, values, runs they are in), fewer at the end."""
        self.runs = [r for r in self.runs if r[2] < len(r[0])]
        if not self.runs:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        heads = [(r[0][r[2] : r[2] + n], r[1][r[2] : r[2] + n]) for r in self.runs]
        keys = np.concatenate([h[0] for h in heads])
        order = np.argsort(keys, kind="stable")[:n]
        which = np.repeat(np.arange(len(heads)), [len(h[0]) for h in heads])[order]
        return keys[order], np.concatenate([h[1] for h in heads])[order], which

    def drop(self, which: np.ndarray) -> None:
        for r, n in zip(self.runs, np.bincount(which, minlength=len(self.runs)).tolist(), strict=True):
            r[2] += n


def induce(chars: np.ndarray, target: np.ndarray, given: np.ndarray, given_lcp: np.ndarray, runs: np.ndarray, memory: int = MEMORY, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """(positions, common prefixes with the one before) of the given suffixes and all that they induce, in order.

    given: positions in order; a suffix p brings in p - 1 if target[p - 1]. Among suffixes of one first character the induced
    come before the given, ordered by the suffix one further. runs: how often the first character repeats.
    """
    total = len(given) + int(target.sum())
    small = np.uint8 if cap < 256 else np.int32
    out, lcp, rank = room(total, np.int64, memory), room(total, small, memory), room(len(chars) + 1, np.int64, memory)
    levels = max(1, int(total).bit_length())
    low = room((levels, total), small, memory)  # low[k, i]: the smallest lcp of the 2 ** k that end at i
    queue = RunQueue(memory)
    queue.push((chars[given].astype(np.int64) << (RANK_BITS + 1)) | GIVEN | np.arange(len(given)), given)
    done, step, last = 0, 4096, -1
    last_given = True
    while True:
        keys, at, which = queue.peek(step)
        if not len(keys):
            break
        new = done + np.arange(len(keys))
        before = at - 1
        brings = (at > 0) & target[before]
        pushed = np.where(brings, (chars[before].astype(np.int64) << (RANK_BITS + 1)) | new, np.iinfo(np.int64).max)
        least = np.minimum.accumulate(pushed)
        late = np.flatnonzero(keys[1:] > least[:-1])
        q = int(late[0]) + 1 if len(late) else len(keys)
        keys, at, brings, pushed, new = keys[:q], at[:q], brings[:q], pushed[:q], new[:q]
        queue.drop(which[:q])
        rank[at], out[new] = new, at
        mine = (keys & GIVEN) > 0
        prior, prior_given = np.append(last, at[:-1]), np.append(last_given, mine[:-1])
        same = prior >= 0
        same &= chars[prior] == chars[at]
        value = np.zeros(q, np.int64)
        both = same & mine & prior_given
        value[both] = given_lcp[keys[both] & (GIVEN - 1)]
        mixed = same & mine & ~prior_given
        value[mixed] = np.minimum(runs[prior[mixed]], runs[at[mixed]])
        made = np.flatnonzero(same & ~mine)
        if len(made):
            a, b = rank[prior[made] + 1] + 1, rank[at[made] + 1]
            k = np.floor(np.log2(b - a + 1)).astype(np.int64)
            value[made] = 1 + np.minimum(low[k, b], low[k, a + (1 << k) - 1]).astype(np.int64)
        lcp[new] = np.minimum(value, cap)
        low[0, done : done + q] = lcp[new]
        for k in range(1, levels):
            half = 1 << (k - 1)
            if done + q < 1 << k:
                break
            a = max(done, (1 << k) - 1)
            low[k, a : done + q] = np.minimum(low[k - 1, a : done + q], low[k - 1, a - half : done + q - half])
        queue.push(pushed[brings], at[brings] - 1)
        done, last, last_given = done + q, int(at[-1]), bool(mine[-1])
        step = step * 2 if q == step else max(1024, 2 * q)
        step = min(step, 1 << 20)
    return out, lcp


def names_of(text: np.ndarray, small: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-preserving numbers of the substrings from each start to the next one (included), compared by character and type;
    the last start is the end of the text. Character by character, over the substrings that aren't told apart yet."""
    ends = np.append(starts[1:], starts[-1])
    name = np.zeros(len(starts), np.int64)
    active = np.arange(len(starts))
    depth = 0
    while len(active):
        place = starts[active] + depth
        inside = place <= ends[active]
        key = np.where(inside, 2 * text[np.minimum(place, ends[active])] + small[np.minimum(place, ends[active])] + 1, 0)
        order = np.lexsort((key, name[active]))
        group, key = name[active][order], key[order]
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1])))
        fresh = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        begin = np.flatnonzero(fresh)
        # a substring's name is that of its old group plus how many of the group come before it
        base = np.repeat(first, np.diff(np.append(first, len(group))))
        begin_of = np.repeat(begin, np.diff(np.append(begin, len(group))))
        name[active[order]] = group + begin_of - base
        alone = np.repeat(np.diff(np.append(begin, len(group))) == 1, np.diff(np.append(begin, len(group))))
        finished = alone | (key == 0)
        active = active[order[~finished]]
        depth += 1
    return name


def _extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """How far the suffixes a[i] and b[i] agree, up to cap; they do for at[i] characters."""
    open_ = np.arange(len(a))
    while len(open_):
        open_ = open_[at[open_] < cap]
        x, y = a[open_] + at[open_], b[open_] + at[open_]
        ok = (x < len(text)) & (y < len(text))
        ok[ok] = text[x[ok]] == text[y[ok]]
        open_ = open_[ok]
        at[open_] += 1
    return np.minimum(at, cap)


def _in_memory(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """suffix_array() of a short text: ranks of prefixes of 1, 2, 4, ... characters until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    size = 1
    while rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        size *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, np.append(0, _extended(text, order[:-1], order[1:], np.zeros(n - 1, np.int64), cap))


def suffix_array(text: np.ndarray, memory: int = MEMORY, cap: int = CAP, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before, up to cap) of non-negative integers that end with their
    only, smallest element."""
    n = len(text)
    if n <= max(1, base):
        return _in_memory(text, cap)
    text = kept(np.unique(text, return_inverse=True)[1].astype(np.int64), memory)
    # a suffix is small if it is less than the one that follows: decided where the next different character stands
    differs = np.append(text[1:] != text[:-1], True)
    nxt = kept(np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1], memory)
    small = kept(np.append(text, -1)[nxt + 1] > text, memory)
    small[-1] = True
    runs = kept(nxt - np.arange(n) + 1, memory)
    del differs, nxt
    starts = kept(np.flatnonzero(small[1:] & ~small[:-1]) + 1, memory)
    name = kept(names_of(text, small, starts), memory)
    order = kept(np.argsort(name, kind="stable"), memory)
    if (np.diff(name[order]) == 0).any():
        order, named = suffix_array(name, memory, cap, base)
    else:
        named = np.zeros(len(order), np.uint8)
    # common prefixes of neighbours: equal names, then characters
    a, b = order[:-1], order[1:]
    same = np.minimum(named[1:].astype(np.int64), len(starts) - 1 - np.maximum(a, b))
    at = starts[np.minimum(a + same, len(starts) - 1)] - starts[a]
    lcp = np.append(0, _extended(text, starts[a], starts[b], at, cap))
    up, up_lcp = induce(text, ~small, starts[order], lcp, runs, memory, cap)
    large = ~small[up]
    given = np.append(up[large][::-1], n - 1)
    # between neighbours among the large ones nothing else of the same first character stands
    given_lcp = np.append(np.append(0, up_lcp[large][::-1][:-1]), 0).astype(np.int64)
    target = small.copy()
    target[-1] = False
    down, down_lcp = induce(text.max() - text, target, given, given_lcp, runs, memory, cap)
    return down[::-1], np.append(0, down_lcp[:0:-1])
