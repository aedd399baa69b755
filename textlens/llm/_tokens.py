"""Cutting texts into repeating chunks and gathering their tokens with numpy; shared by the two tokenizing operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters whose chunks are looked up at once.
BATCH_CHARS = 2_000_000
#: Distinct chunks kept in one Python worker (some 100 MB).
CACHED = 500_000
#: Batches whose distinct chunks PieceEncoder finds together.
GROUP = 4

#: A blank before white space or the end, after which a text can't be cut by blanks alone.
_UNSAFE = re.compile(r" (?=\s|\Z)")
#: The same for Arrow, whose white space is that of ASCII; it may find more.
_MAYBE_UNSAFE = r" (?:[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|\z)"


def take(data: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `index` of a ragged array (data, offsets), as such an array."""
    lengths = np.diff(offsets)[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1][index], lengths)
    return data[at], out


def chunks(text: str) -> list[str]:
    """Cuts before each blank that a non-blank follows. No pre-token of the byte-level pattern spans such a place, and white
    space that runs up to it is matched alike without what follows, so the tokens of a text are those of its chunks."""
    if _UNSAFE.search(text) is None:
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]
    return [x for x in re.split(r"(?= \S)", text) if x]


#: Kinds of bytes: letters (1; of two bytes in UTF-8 up to U+027F and from U+0400 to U+047F), digits (2), signs but the apostrophe (3),
#: line feed (4), blank (5), second and later bytes (6), others (0).
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0xC3, 0xCA), 0xD0, 0xD1]] = 1
_KIND[[*b"0123456789"]] = 2
_KIND[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 3
_KIND[[*b"\n "]] = 4, 5
_KIND[0x80:0xC0] = 6


def pieces(chunks: pa.StringArray, whole: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Chunks cut further, and the number of the first piece of each and of the end; words recur more often than words with the
    signs and line ends after them. Pre-tokens end between letters, digits, signs and a single line feed, whatever else stands
    there; a blank belongs to what follows it. Chunks with anything but these, and those marked whole, are not cut."""
    at = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1] if len(chunks) else np.zeros(1, np.int32)
    if at[-1] == at[0]:
        return chunks.slice(0, 0), np.zeros(len(at), np.int64)
    raw, at = np.frombuffer(chunks.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    kind = _KIND[raw]
    later = np.flatnonzero(kind == 6)
    lead = raw[later - 1]
    kind[later] = (_KIND[lead] == 1) & (lead >= 0xC3) & ~((lead == 0xC3) & ((raw[later] == 0x97) | (raw[later] == 0xB7)))  # no letters: × and ÷
    begins = np.zeros(len(raw) + 1, bool)
    begins[at[:-1]] = True
    bad = kind == 0
    bad |= (kind == 5) & ~begins[:-1]
    bad[1:] |= (kind[1:] == 4) & (kind[:-1] >= 4) & ~begins[1:-1]
    sums = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(bad, out=sums[1:])
    edge = np.append(False, (kind[1:] != kind[:-1]) & (kind[:-1] != 5)) & np.repeat((sums[at[1:]] == sums[at[:-1]]) & ~whole, np.diff(at))
    cuts = np.flatnonzero(edge | begins[:-1])
    ends = np.append(cuts, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(cuts), pa.py_buffer(ends), pa.py_buffer(raw)), np.searchsorted(cuts, at)


def parts(text: str) -> Iterator[str]:
    """A very long text in pieces of about BATCH_CHARS, cut where chunks() may cut."""
    at = 0
    while len(text) - at > 2 * BATCH_CHARS:
        end = at + BATCH_CHARS
        while 0 <= (end := text.find(" ", end)) < len(text) - 1 and text[end + 1].isspace():
            end += 1
        if end < 0 or end >= len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _in_turn(index: np.ndarray, offsets: np.ndarray, cut: list[list[str]], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A ragged array of the texts that are not odd, followed by the chunks of those that are, in the order of the texts."""
    offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(x) for x in cut])])
    return take(index, offsets, np.argsort(np.argsort(odd, kind="stable"), kind="stable"))


class ChunkEncoder:
    """Ids of texts by way of their chunks, of which the distinct ones met so far are kept, `cached` and those of one batch at most.
    `encode` gets chunks and returns a ragged array of ids. `special` finds tokens that are cut out before anything else, as
    what stands before one is matched as if the text ended there; each is a chunk."""

    #: Batches that are handled together.
    group = 1

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: re.Pattern | None = None, cached: int = CACHED):
        self.encode, self.special, self.cached = encode, special, cached
        self._clear()

    def _segments(self, text: str) -> list[str]:
        if self.special is None or self.special.search(text) is None:
            return [text]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [text[at : m.start()], m.group()]
            at = m.end()
        return [x for x in (*out, text[at:]) if x]

    def _clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.data, self.offsets = np.empty(0, np.int32), np.zeros(2, np.int64)

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        """The rows of self.data that hold the ids of the chunks; new ones are encoded."""
        index = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(index < 0)
        if len(new):
            missing = [distinct[i] for i in new.tolist()]
            data, offsets = self.encode(missing)
            index[new] = np.arange(len(self.place), len(self.place) + len(missing))
            self.place.update(zip(missing, index[new].tolist(), strict=True))
            self.data = np.concatenate([self.data, data])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        return index

    def _at_blanks(self, texts: list[str]) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
        """(odd, words, keys, offsets): the texts that blanks alone don't cut right, and of the others the distinct chunks found by
        Arrow without the blank that a chunk has before it unless it begins its text: the ragged array of every text's chunks
        has twice the number of the word, and one more for the first."""
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, _MAYBE_UNSAFE).to_numpy(zero_copy_only=False)
        if self.special is not None:
            odd |= np.fromiter((self.special.search(x) is not None for x in texts), bool, len(texts))
        split = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        coded, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        keys = coded.indices.to_numpy().astype(np.int64) * 2
        keys[offsets[:-1]] += 1
        return odd, coded.dictionary, keys, offsets

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of every text, as numbers, in a ragged array."""
        odd, words, keys, offsets = self._at_blanks(texts)
        words, number = words.to_numpy(zero_copy_only=False), np.zeros(2 * len(words), np.int64)
        number[keys] = 1
        used = np.flatnonzero(number)
        number[used] = self._numbers([w if k else " " + w for w, k in zip(words[used >> 1].tolist(), (used & 1).tolist(), strict=True)])
        index = number[keys]
        if not odd.any():
            return index, offsets
        cut = [[c for segment in self._segments(texts[i]) for c in chunks(segment)] for i in np.flatnonzero(odd).tolist()]
        flat = list(chain.from_iterable(cut))
        self._numbers(list(dict.fromkeys(flat)))
        index = np.concatenate([index, np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))])
        return _in_turn(index, offsets, cut, odd)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number in each text)."""
        if len(self.place) > self.cached:
            self._clear()
        index, ends = self._cut(texts)
        ids, out = take(self.data, self.offsets, index)
        return ids, np.diff(out[ends])

    def _batches(self, batches: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, their number in each text) of each batch."""
        yield from map(self._ids, batches)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yields (first, last, ids, counts) for texts[first:last] in turn: their ids in a row and the number for each text. Null is empty."""
        waiting, first, held, size = [], 0, [], 0

        def done() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            for (a, batch), (ids, counts) in zip(waiting, self._batches([batch for _, batch in waiting]), strict=True):
                yield a, a + len(batch), ids, counts
            waiting.clear()

        for i, text in enumerate(texts):
            text = text or ""
            if size and size + len(text) > BATCH_CHARS:
                waiting.append((first, held))
                first, held, size = i, [], 0
                if len(waiting) == self.group:
                    yield from done()
            if len(text) > 2 * BATCH_CHARS:
                yield from done()
                ids = np.concatenate([self._ids([x])[0] for segment in self._segments(text) for x in parts(segment)])
                yield i, i + 1, ids, np.array([len(ids)])
                first = i + 1
                continue
            held.append(text)
            size += len(text) + 1
        if held:
            waiting.append((first, held))
        yield from done()


class PieceEncoder(ChunkEncoder):
    """Ids of texts by way of pieces(): the distinct chunks of some batches are found by Arrow and cut, and their pieces are what
    is kept, and what `encode` gets."""

    group = GROUP

    def _clear(self) -> None:
        super()._clear()
        self.uses = np.zeros(1, np.int64)

    def _thin(self) -> None:
        """Of more than `cached` pieces those stay that were met more than once, the most frequent ones, and two thirds of `cached`
        at most. Uses are halved, so that what doesn't recur goes in the end. All ids are the same, whatever stays."""
        if len(self.place) <= self.cached:
            return
        least = 2
        while np.count_nonzero(self.uses >= least) > self.cached * 2 // 3:
            least += 1
        stay = self.uses >= least
        stay[0] = True  # the empty one
        self.place = dict(zip(compress(self.place, stay.tolist()), range(np.count_nonzero(stay))))
        self.data, self.offsets = take(self.data, self.offsets, np.flatnonzero(stay))
        self.uses = self.uses[stay] // 2

    def _cut_further(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(data, offsets) with the ids of the distinct chunks, (index, ends) with the chunks of every text."""
        odd, words, keys, ends = self._at_blanks(texts)
        used = np.flatnonzero(np.bincount(keys, minlength=1))
        number = np.zeros(2 * len(words) + 2, np.int64)
        used = np.concatenate([used[used % 2 == 0], used[used % 2 == 1]])  # those with a blank before them, then those without
        number[used] = np.arange(len(used))
        index, blank = number[keys], int((used % 2 == 0).sum())
        words = words.take(pa.array(used >> 1))
        distinct = [pc.binary_join_element_wise(pa.scalar(""), words.slice(0, blank), " "), words.slice(blank)]
        whole = np.zeros(len(used), bool)
        if odd.any():
            cut = [[c for segment in self._segments(texts[i]) for c in chunks(segment)] for i in np.flatnonzero(odd).tolist()]
            coded = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
            distinct.append(coded.dictionary)
            if self.special is not None:
                whole = np.append(whole, np.fromiter((self.special.fullmatch(x) is not None for x in coded.dictionary.to_pylist()), bool, len(coded.dictionary)))
            else:
                whole = np.append(whole, np.zeros(len(coded.dictionary), bool))
            index, ends = _in_turn(np.concatenate([index, coded.indices.to_numpy() + len(used)]), ends, cut, odd)
        found, first = pieces(pa.concat_arrays(distinct), whole)
        coded = found.dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.uses = np.append(self.uses, np.zeros(len(self.place) - len(self.uses), np.int64))
        self.uses[number] += 1
        data, offsets = take(self.data, self.offsets, number[coded.indices.to_numpy()])
        return data, offsets[first], index, ends

    def _batches(self, batches: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._thin()
        data, offsets, index, ends = self._cut_further(list(chain.from_iterable(batches)))
        at = 0
        for batch in batches:
            here = ends[at : at + len(batch) + 1]
            ids, out = take(data, offsets, index[here[0] : here[-1]])
            yield ids, np.diff(out[here - here[0]])
            at += len(batch)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return next(self._batches([texts]))


def list_array(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
