"""Suffix-array dedup: removes every byte of a 100-byte string that stands earlier in the corpus.

Strings that are equal agree on their minimizer, the smallest hash of a 50-byte string in them. Minimizers are counted over the
corpus first; only the surroundings of those that occur again are compared. All surroundings of a minimizer meet in one bucket,
those equal byte by byte collapse to the earliest, and what differs is sorted by an external suffix array of the bucket. Hashes
only choose what is compared: a string whose hash is its own equals no other and stays out of the sort; of equal hashes the sort
decides.

A minimizer with many different surroundings (both ends of a passage that many documents share) would make one large group. Its
strings are counted one by one, by their hashes, and only those that occur again meet, by hash of the string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._chunks import chunk_count, deal, spread, squeeze, thaw
from ._common import give_back, mix64, stored, table
from ._suffixes import suffix_array

#: Length of a repeated string, and of the strings that are hashed for minimizers.
LENGTH, K = 100, 50
#: Bytes of one shard whose suffixes are sorted together; a minimizer with more different strings is split, see remove_repeats().
SHARD_BYTES = 1 << 20
#: Strings of a chunk that are hashed at once. With a string's bytes it stays below 2 ** 16 places, so that of equal hashes the
#: leftmost is a string's minimizer everywhere and no run holds two equal strings.
BLOCK = (1 << 16) - 1024
#: Bytes of pieces that are compared at once.
COMPARED = 1 << 20
#: Bits of a minimizer's hash; the rest of its word tells equal hashes apart by place.
HASH_BITS = 48
NO_ID = -(2**63)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums modulo 2 ** 64 and the inverse powers that make their differences independent of place."""
    n = len(data)
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    inverse = np.ones(n + 1, np.uint64)
    inverse[1:] = _INVERSE
    return sums, np.cumprod(inverse)


def _range_hash(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((sums[b] - sums[a]) * inverse[a] ^ (b - a).astype(np.uint64))


def surroundings(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_surroundings() of data, BLOCK strings at a time; a run that crosses a block counts as two."""
    found = []
    block = min(BLOCK, (1 << 16) - length)
    for a in range(0, max(1, len(data) - length + 1), block):
        h, first, last, content = _surroundings(data[a : a + block + length - 1], starts[np.searchsorted(starts, a) : np.searchsorted(starts, a + block + length)] - a, length, k)
        found.append((h, first + a, last + a, content))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _surroundings(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, content hash) of each run of consecutive `length`-byte strings with one minimizer: the strings that
    start at first..last; together they cover [first, last + length). starts: where the documents begin."""
    n, w = len(data), length - k + 1
    none = np.empty(0, np.int64)
    if n < length:
        return np.empty(0, np.uint64), none, none, np.empty(0, np.uint64)
    sums, inverse = _prefix_hashes(data)
    at = np.arange(n - k + 1)
    value = mix64((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    value = value & ~np.uint64(0xFFFF) | (at & 0xFFFF).astype(np.uint64)
    smallest, have = value, 1  # minima over `have` places, doubled up to w
    while have * 2 <= w:
        smallest = np.minimum(smallest[:-have], smallest[have:])
        have *= 2
    if have < w:
        smallest = np.minimum(smallest[: len(smallest) - (w - have)], smallest[w - have :])
    window = np.arange(len(smallest))
    place = window + (((smallest & np.uint64(0xFFFF)).astype(np.int64) - window) & 0xFFFF)
    doc = np.searchsorted(starts, window, "right")
    inside = window + length <= np.append(starts, n)[doc]
    window, place = window[inside], place[inside]
    new = np.append(True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)) if len(window) else np.empty(0, bool)
    first = window[new]
    last = window[np.append(np.flatnonzero(new)[1:] - 1, len(window) - 1)] if len(window) else none
    # minimizers are small hashes; mixed again they fill all buckets alike
    return mix64(value[place[new]] >> np.uint64(16)) >> np.uint64(16), first, last, _range_hash(sums, inverse, first, last + length)


def _documents(held: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows in order, bytes of all, where each starts, ids, ties). Rows of one id stand by text hash, equal rows by number."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in held.column("_text").to_pylist()]
    ids = held.column("_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
    hashes = np.fromiter((xxhash.xxh32_intdigest(t) for t in texts), np.int64, len(texts))
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    same = np.append(False, (ids[1:] == ids[:-1]) & (hashes[1:] == hashes[:-1]))
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids)))) if len(ids) else ids
    ties = hashes << 24 | (np.arange(len(ids)) - run)
    texts = [texts[i] for i in order]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    return held.take(pa.array(order)), np.frombuffer(b"".join(texts), np.uint8), starts, ids, ties


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a row begins a group) by all columns but the last three, which order the rows of a group."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns[:-3]:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, new


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the sizes[i] bytes from a[i] on equal those from b[i] on; sizes are positive."""
    out = np.empty(len(a), bool)
    block = np.cumsum(sizes) // COMPARED
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(block) != 0)), len(a)) if len(a) else [0]
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        n = sizes[x:y]
        base = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(base, n)
        out[x:y] = ~np.logical_or.reduceat(raw[np.repeat(a[x:y], n) + within] != raw[np.repeat(b[x:y], n) + within], base)
    return out


def _collapsed(raw: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, the others) of pieces of raw grouped by columns as in _first_of(), which hold the size: a repeat has the bytes
    of the first of its group. Different bytes under one hash stay."""
    order, new = _first_of(*columns)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    again = np.flatnonzero(~new)
    again = again[_same_bytes(raw, offsets[order[again]], offsets[head[again]], sizes[order[again]])]
    gone = np.zeros(len(order), bool)
    gone[again] = True
    return order[gone], order[~gone]


def _merged(chunk: np.ndarray, ids: np.ndarray, ties: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Removed ranges [a, b), those of one document that touch joined."""
    order = np.lexsort((a, ties, ids))
    chunk, ids, ties, a, b = chunk[order], ids[order], ties[order], a[order], b[order]
    if len(a):
        doc = np.append(0, np.cumsum((ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])))
        reach = np.maximum.accumulate(b + doc * (1 << 40)) - doc * (1 << 40)
        new = np.append(True, (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1]))
        ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
        chunk, ids, ties, a, b = chunk[new], ids[new], ties[new], a[new], ends
    return pd.DataFrame({"chunk": chunk, "id": ids, "tie": ties, "a": a, "b": b})


def _gathered(raw: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of consecutive pieces, each followed by a zero; other bytes are raised by one."""
    out_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    index = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - offsets, sizes + 1)
    out = raw[np.minimum(index, len(raw) - 1)].astype(np.int64) + 2
    out[out_at[1:] - 1] = 1
    return np.append(out, 0)


def repeated_starts(raw: np.ndarray, offsets: np.ndarray, windows: np.ndarray, ids: np.ndarray, ties: np.ndarray, first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place in it) of every string that stands earlier among the pieces: piece i covers windows[i] strings, from
    first[i] of its document on. By the suffix array: runs of neighbours that share `length` characters hold equal strings."""
    sizes = windows + length - 1
    sa, lcp = suffix_array(_gathered(raw, offsets, sizes), cap=length)
    piece_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    group = np.cumsum(lcp < length)
    piece = np.searchsorted(piece_at, sa, "right") - 1
    inside = sa - piece_at[np.minimum(piece, len(windows))]
    real = piece < len(windows)
    real[real] = inside[real] < windows[piece[real]]
    piece, inside, group = piece[real], inside[real], group[real]
    order, new = _first_of(group, ids[piece], ties[piece], first[piece] + inside)
    return piece[order[~new]], inside[order[~new]]


def _string_hashes(raw: np.ndarray, offsets: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of the pieces of raw that begin at offsets, some pieces at a time."""
    sizes = windows + length - 1
    block = np.cumsum(sizes) // BLOCK
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(block) != 0)), len(block)) if len(block) else [0]
    out = [np.empty(0, np.uint64)]
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        sums, inverse = _prefix_hashes(raw[_ranges(offsets[x:y], sizes[x:y])])
        at = _ranges(np.cumsum(sizes[x:y]) - sizes[x:y], windows[x:y])
        out.append(_range_hash(sums, inverse, at, at + length))
    return np.concatenate(out)


def _bytes_of(raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """raw[begin[0] : begin[0] + sizes[0]], then the next piece, gathered COMPARED bytes at a time."""
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    block = ends // COMPARED
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(block) != 0)), len(block)) if len(block) else [0]
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        out[ends[x] - sizes[x] : ends[y - 1]] = raw[_ranges(begin[x:y], sizes[x:y])]
    return out


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... sizes[0] of them, then begin[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


def _recur(values: np.ndarray) -> np.ndarray:
    """Which of values occur more than once."""
    order = np.argsort(values)
    out = np.empty(len(values), bool)
    out[order] = _has_neighbour(values[order])
    return out


def _runs(use: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first string in it, strings) of each run of strings marked in `use` that lie side by side in one piece."""
    starts = np.cumsum(windows) - windows
    begin = np.zeros(len(use) + 1, bool)
    begin[starts] = True
    marked = np.append(use, False)
    new = np.flatnonzero(marked[:-1] & (begin[:-1] | ~np.append(False, use[:-1])))
    last = np.flatnonzero(marked[:-1] & (begin[1:] | ~marked[1:]))
    last = last[np.searchsorted(last, new)] if len(new) else new
    piece = np.searchsorted(starts, new, "right") - 1
    return piece, new - starts[piece], last - new + 1


def _has_neighbour(values: np.ndarray) -> np.ndarray:
    """Which of sorted values occur more than once."""
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[1:] == values[:-1]
    return (same[1:] | same[:-1])[: len(values)]


def _earlier(part: pd.DataFrame, length: int) -> pd.DataFrame:
    """Ranges of a bucket's surroundings that stand earlier. Minimizers go to shards of SHARD_BYTES in turn."""
    columns = {c: np.concatenate([spread(b, t) for b in part[c]]) for c, t in (("hash", np.uint64), ("content", np.uint64), ("id", np.int64), ("tie", np.int64), ("first", np.int64), ("windows", np.int64))}
    chunk = np.repeat(part["chunk"].to_numpy(), [len(spread(b)) for b in part["hash"]])
    raw = np.concatenate([spread(b, np.uint8) for b in part["raw"]])
    offsets = np.concatenate([[0], np.cumsum(columns["windows"] + length - 1)])[:-1]
    h, ids, ties, first, windows = (columns[c] for c in ("hash", "id", "tie", "first", "windows"))
    # identical surroundings: all but the earliest are repeats
    again, keep = _collapsed(raw, offsets, windows + length - 1, h, columns["content"], windows, ids, ties, first)
    out = [(chunk[again], ids[again], ties[again], first[again], first[again] + windows[again] - 1 + length)]
    keep = keep[_has_neighbour(h[keep])]
    # what differs is sorted, shard by shard, but for strings of a hash of their own: those equal no other
    which, place, n = _runs(_recur(_string_hashes(raw, offsets[keep], windows[keep], length)), windows[keep])
    which = keep[which]
    h, ids, ties, offsets, first, windows, chunk = h[which], ids[which], ties[which], offsets[which] + place, first[which] + place, n, chunk[which]
    keep = np.arange(len(which))
    total = np.cumsum(windows[keep] + length)
    shard = (total - 1) // SHARD_BYTES
    begin = np.append(True, h[keep][1:] != h[keep][:-1]) if len(keep) else np.empty(0, bool)
    shard = shard[np.maximum.accumulate(np.where(begin, np.arange(len(keep)), 0))] if len(keep) else shard
    for s in np.unique(shard):
        own = keep[shard == s]
        piece, inside = repeated_starts(raw, offsets[own], windows[own], ids[own], ties[own], first[own], length)
        which = own[piece]
        out.append((chunk[which], ids[which], ties[which], first[which] + inside, first[which] + inside + length))
    return _merged(*(np.concatenate(x) for x in zip(*out, strict=True)))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with `text` cut, and n_bytes, n_removed, n_spans, kept_sha256, spans added (same-named columns are replaced).

    Of each text as UTF-8 bytes (null: empty), every byte is removed that is covered by a `length`-byte string which also
    starts earlier: in a smaller doc_id, or earlier in the same document. Strings are judged on the input, may overlap, and
    don't cross documents. spans: removed runs as structs of start and end in bytes; kept_sha256: of the remaining bytes. The
    cut text leaves out what remains of a character of which bytes were removed; a null text stays null. A null id comes
    before all others. Rows that repeat an id count as documents of their own, ordered by a hash of the text; of equal rows
    all but one are repeats. doc_id must be an integer.
    """
    k, hot_above = length // 2, SHARD_BYTES // length
    parts = chunk_count(docs, text)
    slim = deal(docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")), F.pmod(F.xxhash64("_id", "_text"), F.lit(parts)))

    def edges(h: np.ndarray, bits: int = HASH_BITS) -> np.ndarray:
        bounds = np.array([-(-(b << bits) // parts) for b in range(1, parts)], np.uint64)
        return np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        """The chunk's distinct minimizers by bucket, which of them occur again within it, and how many different surroundings
        each has."""
        give_back()
        _, data, starts, _, _ = _documents(thaw(part["texts"]))
        found, _, _, content = surroundings(data, starts, length, k)
        h, n = np.unique(found, return_counts=True)
        order = np.lexsort((content, found))
        new = np.append(True, (np.diff(found[order]) != 0) | (np.diff(content[order]) != 0)) if len(order) else np.empty(0, bool)
        kinds = np.bincount(np.searchsorted(h, found[order[new]]), minlength=len(h))
        ends = edges(h)
        return pd.DataFrame([(b, int(part["chunk"].iloc[0]), squeeze(h[x:y]), np.packbits(n[x:y] > 1).tobytes(), squeeze(kinds[x:y])) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True))], columns=["bucket", "chunk", "hashes", "many", "kinds"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        """For each minimizer asked for whether it occurs again anywhere, and whether its surroundings are too many for a shard."""
        keys = [spread(b) for b in part["hashes"]]
        distinct, n = np.unique(np.concatenate(keys), return_counts=True)
        again = n > 1
        places = [np.searchsorted(distinct, x) for x in keys]
        total = np.zeros(len(distinct), np.int64)
        for place, kinds in zip(places, part["kinds"], strict=True):
            total[place] += spread(kinds, np.int64)
        hot = total > hot_above
        for place, many in zip(places, part["many"], strict=True):
            again[place[np.unpackbits(np.frombuffer(many, np.uint8), count=len(place)).astype(bool)]] = True
        return pd.DataFrame({"chunk": part["chunk"], "bucket": part["bucket"], "again": [np.packbits(again[p]).tobytes() for p in places], "hot": [np.packbits(hot[p]).tobytes() for p in places], "n": [len(p) for p in places]})

    def bits(answers: pd.DataFrame, name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=c).astype(bool) for b, c in zip(answers[name], answers["n"], strict=True))])

    names = ["bucket", "chunk", "hash", "content", "id", "tie", "first", "windows", "raw"]
    empty = np.empty(0, np.uint64)

    def settled(number: int, ids: np.ndarray, ties: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        """Removed ranges of a chunk as a row with bucket -1."""
        ranges = _merged(np.full(len(a), number), ids, ties, a, b)
        return (-1, number, squeeze(empty), squeeze(empty), *(squeeze(ranges[c].to_numpy()) for c in ("id", "tie", "a", "b")), b"")

    def pieces(bucket: int, number: int, h: np.ndarray, content: np.ndarray, ids: np.ndarray, ties: np.ndarray, own: np.ndarray, windows: np.ndarray, data: np.ndarray, first: np.ndarray) -> tuple:
        """A row with the bytes of pieces that begin at data[first]."""
        sizes = windows + length - 1
        raw = _bytes_of(data, first, sizes)
        return (bucket, number, *(squeeze(x) for x in (h, content, ids, ties, own, windows, raw)))

    def send(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """The surroundings of repeated minimizers by bucket; within the chunk identical ones are settled: only the earliest
        is sent on, the others are removed ranges (rows with bucket -1). Surroundings of hot minimizers stay with the chunk
        (bucket -2), of which only the strings' hashes are sent (buckets from `parts` on)."""
        if not len(part):
            return pd.DataFrame(columns=names)
        give_back()
        number = int(part["chunk"].iloc[0])
        _, data, starts, ids, ties = _documents(thaw(part["texts"]))
        h, first, last, content = surroundings(data, starts, length, k)
        answers = answers.sort_values("bucket")
        distinct = np.unique(h)
        hot_ones = distinct[bits(answers, "hot") & bits(answers, "again")]
        use = bits(answers, "again")[np.searchsorted(distinct, h)]
        h, first, last, content = h[use], first[use], last[use], content[use]
        doc = np.searchsorted(starts, first, "right") - 1
        # empty documents share their start with the next one, which is the last of those found
        windows, own = last - first + 1, first - starts[doc] if len(doc) else first
        gone, kept = _collapsed(data, first, windows + length - 1, h, content, windows, ids[doc], ties[doc], own)
        out = [settled(number, ids[doc[gone]], ties[doc[gone]], own[gone], own[gone] + windows[gone] - 1 + length)]
        hot = np.isin(h[kept], hot_ones)

        def row(bucket: int, o: np.ndarray) -> tuple:
            return pieces(bucket, number, h[o], content[o], ids[doc[o]], ties[doc[o]], own[o], windows[o], data, first[o])

        if hot.any():
            out.append(row(-2, kept[hot]))
            strings = np.unique(_string_hashes(data, first[kept[hot]], windows[kept[hot]], length))
            ends = edges(strings, 64)
            out += [(parts + b, number, squeeze(strings[x:y]), *[squeeze(empty)] * 6) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if x < y]
        kept = kept[~hot]
        ends = edges(h[kept])
        out += [row(b, kept[x:y]) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if x < y]
        return pd.DataFrame(out, columns=names)

    def again_anywhere(part: pd.DataFrame) -> pd.DataFrame:
        """For each string of hot minimizers whether another chunk holds its hash."""
        keys = [spread(b) for b in part["hash"]]
        distinct, n = np.unique(np.concatenate(keys), return_counts=True)
        return pd.DataFrame({"chunk": part["chunk"], "bucket": part["bucket"], "again": [np.packbits(n[np.searchsorted(distinct, x)] > 1).tobytes() for x in keys], "n": [len(x) for x in keys]})

    def split(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Of a chunk's surroundings of hot minimizers the strings that occur again, by bucket of the string; the chunk's own
        repeats are settled."""
        if not len(part):
            return pd.DataFrame(columns=names)
        number, row = int(part["chunk"].iloc[0]), part.iloc[0]
        ids, ties, first, windows = (spread(row[c], np.int64) for c in ("id", "tie", "first", "windows"))
        raw = spread(row["raw"], np.uint8)
        sizes = windows + length - 1
        hashes = _string_hashes(raw, np.cumsum(sizes) - sizes, windows, length)
        distinct, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        use = np.flatnonzero((bits(answers.sort_values("bucket"), "again") | (counts > 1))[place])
        before = np.cumsum(windows)
        piece = np.searchsorted(before, use, "right")
        within = use - (before - windows)[piece]
        h, ids, ties, own, at = hashes[use], ids[piece], ties[piece], first[piece] + within, (np.cumsum(sizes) - sizes)[piece] + within
        one = np.ones(len(use), np.int64)
        gone, kept = _collapsed(raw, at, one * length, h, ids, ties, own)
        out = [settled(number, ids[gone], ties[gone], own[gone], own[gone] + length)]
        ends = edges(h[kept], 64)
        for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if x < y:
                o = kept[x:y]
                out.append(pieces(parts + b, number, h[o], h[o], ids[o], ties[o], own[o], one[o], raw, at[o]))
        return pd.DataFrame(out, columns=names)

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        give_back()
        if part["bucket"].iloc[0] >= 0:
            return _earlier(part, length)
        found = [(np.full(len(i := spread(r["id"], np.int64)), r["chunk"]), i, *(spread(r[c], np.int64) for c in ("tie", "first", "windows"))) for r in part.to_dict("records")]
        return _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))

    range_schema = "chunk int, id long, tie long, a long, b long"
    asked = slim.groupBy("chunk").applyInPandas(ask, "bucket int, chunk int, hashes binary, many binary, kinds binary")
    answers = stored(asked.groupBy("bucket").applyInPandas(answer, "chunk int, bucket int, again binary, hot binary, n int"), "again")
    blob = "bucket int, chunk int, hash binary, content binary, id binary, tie binary, first binary, windows binary, raw binary"
    sent = stored(slim.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(send, blob), "surroundings")
    asked = sent.where(F.col("bucket") >= parts).select("bucket", "chunk", "hash")
    strings = asked.groupBy("bucket").applyInPandas(again_anywhere, "chunk int, bucket int, again binary, n int")
    hot = sent.where(F.col("bucket") == -2).groupBy("chunk").cogroup(strings.groupBy("chunk")).applyInPandas(split, blob)
    sent = sent.where(F.col("bucket").between(-1, parts - 1)).unionByName(hot)
    # settled ranges form groups by chunk, surroundings by bucket
    ranges = stored(sent.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("chunk")).alias("_own")).applyInPandas(settle, range_schema), "ranges")

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    keep = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType([*keep, *added])

    def cut(part: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        if not len(part):
            return to_arrow_schema(schema).empty_table()
        held, data, starts, ids, ties = _documents(thaw(part.column("texts").to_pylist()))
        ends = np.append(starts[1:], len(data))
        places = {(i, t): n for n, (i, t) in enumerate(zip(ids.tolist(), ties.tolist(), strict=True))}
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for i, t, a, b in zip(*(found.column(c).to_pylist() for c in ("id", "tie", "a", "b")), strict=True):
            by_doc.setdefault(places[i, t], []).append((a, b))
        texts, columns = held.column("_text").to_pylist(), [[] for _ in added]
        for d in range(len(ids)):
            spans: list[list[int]] = []
            for a, b in sorted(by_doc.get(d, ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            raw = data[starts[d] : ends[d]].tobytes()
            bounds = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            if spans:
                texts[d] = kept.decode("utf-8", "ignore")
            for column, value in zip(columns, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                column.append(value)
        out = held.drop_columns(["_id", "_text"])
        made = {text: pa.array(texts, pa.string())} | {a.name: pa.array(c, t) for a, c, t in zip(added, columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), strict=True)}
        return pa.table([made[f.name] if f.name in made else out.column(f.name) for f in schema.fields], names=schema.names)

    wide = deal(docs.select(*[f.name for f in keep if f.name != text], F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")), F.pmod(F.xxhash64("_id", "_text"), F.lit(parts)))
    return wide.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(cut, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
