"""Byte-level BPE: length-bucketed padded matrices in which every row merges its leftmost minimum-rank pair each round."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import give_back, table
from ._tokens import ChunkEncoder, list_array, take

#: Widths of the padded matrices; longer pieces are merged one by one with a heap.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Rows of one matrix at most.
ROWS = 65_536
#: Tokens decoded at once.
BATCH_TOKENS = 2_000_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> bytes:
    """The content of a rank file (base64 token, blank, rank on each line)."""
    return Path(path).read_bytes()


class ByteBPE:
    def __init__(self, content: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}
        self.pattern, self.plain = regex.compile(pattern), pattern == public_tokenizers.PATTERN
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.bytes_data = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes_offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        left, right, rank = [], [], []
        get = self.ranks.get
        for t, r in self.ranks.items():
            for cut in range(1, len(t)):
                if (a := get(t[:cut])) is not None and (b := get(t[cut:])) is not None:
                    left.append(a), right.append(b), rank.append(r)
        self._build(np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(rank, np.int32))

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probing, filled round by round: of the keys that want a slot the first gets it."""
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.values[slot[one]] = keys[one], ranks[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, ranks, slot = keys[rest], ranks[rest], (slot[rest] + ~free[rest]) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each merged pair, NONE where the two don't merge; negative ids are padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def _matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the rows of a matrix padded with -1 until none has a pair left; returns the matrix and each row's length."""
        width = ids.shape[1]
        out, length = np.full_like(ids, -1), (ids >= 0).sum(1)
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        rows, columns = np.arange(len(ids)), np.arange(width)
        while len(ids):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(ids)), at]
            done = best == NONE
            if done.any():  # finished rows leave the matrix
                out[rows[done], : ids.shape[1]] = ids[done]
                go = ~done
                ids, ranks, rows, at, best = ids[go], ranks[go], rows[go], at[go], best[go]
                most = int(length[rows].max(initial=1))
                ids, ranks, columns = ids[:, :most], ranks[:, :most], columns[:most]
                if not len(ids):
                    break
            each = np.arange(len(ids))
            ids[each, at] = best
            source = columns + (columns > at[:, None])  # what stands right of the pair moves one place left
            source[:, -1] = np.minimum(source[:, -1], len(columns) - 1)
            shifted = np.take_along_axis(ids, source, 1)
            moved = np.take_along_axis(ranks, source, 1)
            shifted[:, -1], moved[:, -1] = -1, NONE
            full = at == len(columns) - 1
            shifted[full, -1] = best[full]
            ids, ranks = shifted, moved
            length[rows] -= 1
            ranks[each, at] = self.pair_ranks(ids[each, at], np.where(at + 1 < len(columns), ids[each, np.minimum(at + 1, len(columns) - 1)], -1))
            has = at > 0
            ranks[each[has], at[has] - 1] = self.pair_ranks(ids[each[has], at[has] - 1], ids[each[has], at[has]])
        return out, length

    def _long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, by a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        token = {t: self.bytes_data[self.bytes_offsets[t] : self.bytes_offsets[t + 1]].tobytes() for t in set(ids)}

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids) and (r := self.ranks.get(token[ids[i]] + token[ids[j]])) is not None:
                heapq.heappush(heap, (r, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= len(ids) or self.ranks.get(both := token[ids[i]] + token[ids[j]]) != rank:
                continue
            ids[i], ids[j], token[rank] = rank, -1, both
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of pieces, each encoded on its own. A piece that is a token itself is that token."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.ones(len(pieces), np.int64)
        todo = np.flatnonzero(whole < 0)
        todo = todo[np.argsort(sizes[todo], kind="stable")]
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (piece of each id, ids)
        low = 0
        for width in WIDTHS:
            high = np.searchsorted(sizes[todo], width, "right")
            for a in range(low, high, ROWS):
                block = todo[a : min(a + ROWS, high)]
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in block), np.uint8).reshape(len(block), width)
                real = np.arange(width) < sizes[block][:, None]
                out, length = self._matrix(np.where(real, self.byte_ids[raw], np.int32(-1)))
                counts[block] = length
                found.append((np.repeat(block, length), out[out >= 0]))
            low = high
        for i in todo[low:]:
            ids = self._long(pieces[i])
            counts[i] = len(ids)
            found.append((np.full(len(ids), i), np.array(ids, np.int32)))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        data = np.empty(offsets[-1], np.int32)
        single = whole >= 0
        data[offsets[:-1][single]] = whole[single]
        for piece, ids in found:
            run = np.flatnonzero(np.diff(piece, prepend=-1))
            within = np.arange(len(piece)) - np.repeat(run, np.diff(np.append(run, len(piece))))
            data[offsets[piece] + within] = ids
        return data, offsets

    def _pieces(self, text: str) -> list[str]:
        """Matches of the pattern; a blank, ASCII letters and stops, by far the most common form, need no search."""
        if self.plain and text.isascii():
            word = text.rstrip(".,;:!?")
            if (word[1:] if word[:1] == " " else word).isalpha():
                return [word, text[len(word) :]] if len(word) < len(text) else [word]
        return self.pattern.findall(text)

    def encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of texts: each match of the pattern is a piece, distinct pieces are merged once."""
        matches = [self._pieces(t) for t in texts]
        flat = [m for ms in matches for m in ms]
        place = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        data, offsets = self.encode_pieces([p.encode("utf-8") for p in place])
        ids, out = take(data, offsets, np.fromiter(map(place.__getitem__, flat), np.int64, len(flat)))
        ends = np.concatenate([[0], np.cumsum([len(ms) for ms in matches])]).astype(np.int64)
        return ids, out[ends]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive runs of ids, and how many bytes each run has."""
        data, offsets = take(self.bytes_data, self.bytes_offsets, ids)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return data, np.diff(offsets[ends])


#: Distinct chunks that a task keeps (some 40 MB).
CACHED_CHUNKS = 200_000
_LOADED: dict[int, ByteBPE] = {}


def _loaded(content) -> ByteBPE:
    """The encoder of a broadcast rank file, built once in a Python worker."""
    key = hash(content.value)
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(content.value)
    return _LOADED[key]


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs without `text`, with `ids` array<int>: every whole text encoded as the tiktoken library does, no special tokens.

    Null is encoded as empty. A narrow map: no shuffle, rows in, rows out; other columns stay, one named as `ids` is replaced.
    ranks_path is read on the driver and broadcast (under 1 MB).
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_ranks(ranks_path))
    keep = [f for f in docs.schema.fields if f.name not in (ids, text)]
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(_loaded(content).encode_chunks, cached=CACHED_CHUNKS)
        for batch in batches:
            give_back()
            rest = batch.select([f.name for f in keep])
            for a, b, values, counts in encoder(batch.column(text).to_pylist()):
                part = rest.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, list_array(counts, values, pa.int32())], names=schema.names)

    return docs.select(*[f.name for f in keep], text).mapInArrow(rows, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with `out` binary: the bytes of each row's ids. Null ids give null; a column named as `out` is replaced."""
    content = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    keep = [f for f in encoded.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(content)
        for batch in batches:
            column = batch.column(ids)
            counts = np.diff(column.offsets.to_numpy()) * ~np.asarray(column.is_null())
            ends, a = np.cumsum(counts), 0
            while a < len(counts):
                start = ends[a] - counts[a]
                b = max(a + 1, int(np.searchsorted(ends, start + BATCH_TOKENS, "right")))
                part = batch.slice(a, b - a)
                values = part.column(ids).flatten().to_numpy(zero_copy_only=False)
                data, sizes = bpe.decode(values, counts[a:b])
                offsets = np.zeros(b - a + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                valid = pa.array(np.asarray(part.column(ids).is_valid()))
                made = pa.Array.from_buffers(pa.binary(), b - a, [valid.buffers()[1], pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([*part.select([f.name for f in keep]).columns, made], names=schema.names)
                a = b

    return encoded.select(*[f.name for f in keep]).mapInArrow(rows, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
