"""Token-ID output: shards of ids, each compressed by a Re-Pair grammar, with expansion lengths for random access."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import pack, scratch, shuffle_partitions, table, unpack
from ._tokens import PieceEncoder, take

#: Ids in one shard at least (a longer document has a shard of its own).
SHARD_TOKENS = 1_000_000
#: How often a pair must occur to be replaced.
MIN_COUNT = 16
#: Bytes of text that one task encodes, about.
TASK_BYTES = 16 << 20
#: Chunks that the library gets as one text.
JOINED = 2000
END_ID = 0

#: The file format, one row a shard. rules: (left, right) as byte planes of uint32, the k-th being symbol base + k; rule_lengths:
#: ids that each expands to; symbols: byte planes of uint32; doc_symbols, doc_tokens: symbols and ids of each document.
FILE_SCHEMA = "part int, shard int, base int, n_docs int, n_tokens long, doc_ids array<bigint>, rules binary, rule_lengths binary, symbols binary, doc_symbols binary, doc_tokens binary"


#: The rank of a place where no pair is to be replaced.
NONE = np.iinfo(np.int32).max


def _apart(rank: np.ndarray) -> np.ndarray:
    """Ascending places, no two of them neighbours: of neighbours with different ranks the lower one goes first, and of a run of one
    rank every second place. rank: of every place, with NONE at both ends."""
    rank = rank.copy()
    same = np.flatnonzero((rank[1:] == rank[:-1]) & (rank[1:] < NONE)) + 1
    begins = np.append(True, np.diff(same) > 1)
    rank[same[(same - np.maximum.accumulate(np.where(begins[: len(same)], same, 0))) % 2 == 0]] = NONE
    taken = np.zeros(len(rank), bool)
    np.logical_and(rank[1:-1] < rank[:-2], rank[1:-1] < rank[2:], out=taken[1:-1])
    open_ = rank < NONE
    open_ &= ~taken
    open_[1:] &= ~taken[:-1]
    open_[:-1] &= ~taken[1:]
    left = np.flatnonzero(open_)
    while len(left):
        at, r = left, rank[left]
        touch = np.diff(at) == 1
        first = ~np.append(False, touch & (r[:-1] < r[1:])) & ~np.append(touch & (r[1:] < r[:-1]), False)
        taken[at[first]] = True
        near = first.copy()
        near[1:] |= first[:-1] & touch
        near[:-1] |= first[1:] & touch
        left = left[~near]
    return np.flatnonzero(taken)


def _gathered(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by key; in one number each, if they fit, as numbers are sorted much faster than orders are found."""
    bits = int(places[-1]).bit_length() if len(places) else 0
    if len(keys) and int(keys.max()).bit_length() + bits < 64:
        both = np.sort(keys << bits | places)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


def repair(ids: np.ndarray, base: int, barrier: int | None = END_ID, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rounds until no pair occurs min_count times. Each round counts all pairs and ranks those of at least
    min_count, most frequent first; where two of them overlap, the more frequent one is replaced, and the other is counted
    anew in the next round. Only pairs that are replaced min_count times become rules. Pairs with `barrier` on either side
    stay, so that no rule crosses it. A pair that is rare once stays rare, so a round looks only at places where the round before
    found a frequent pair or put a symbol."""
    seq, rules, top = ids.astype(np.int32), [], base
    at = np.arange(len(seq) - 1)
    while len(at):
        left, right = seq[at], seq[at + 1]
        if barrier is not None:
            inside = np.flatnonzero((left != barrier) & (right != barrier))
            at, left, right = at[inside], left[inside], right[inside]
        half = top.bit_length()
        keys, places = _gathered(left.astype(np.int64) << half | right, at)
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        counts = np.diff(begins, append=len(keys))
        often = counts >= min_count
        pairs, places, counts = keys[begins[often]], places[np.repeat(often, counts)], counts[often]
        by_count = np.argsort(-counts, kind="stable")
        rank = np.empty(len(pairs), np.int32)
        rank[by_count] = np.arange(len(pairs))
        ranks = np.full(len(seq) + 2, NONE, np.int32)
        ranks[places + 1] = np.repeat(rank, counts)
        places = _apart(ranks)
        index = ranks[places]
        places -= 1
        uses = np.bincount(index, minlength=len(pairs))[rank]
        order = np.argsort(-uses, kind="stable")
        order = order[uses[order] >= min_count]
        if not len(order):
            break
        symbol = np.full(len(pairs), -1, np.int32)
        symbol[rank[order]] = top + np.arange(len(order))
        symbols = symbol[index]
        put = np.flatnonzero(symbols >= 0)
        places = places[put]
        seq[places] = symbols[put]
        live = ranks[1:-1] < NONE
        live[places] = True
        live[np.maximum(places - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq, live = seq[keep], live[keep]
        at = np.flatnonzero(live[:-1])
        rules.append(np.stack([pairs[order] >> half, pairs[order] & ((1 << half) - 1)], 1))
        top += len(order)
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.int64)).astype(np.uint32), seq.astype(np.uint32)


def _layers(rules: np.ndarray, base: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rules only name earlier symbols, so whole layers of them can be expanded at once: (symbol of the first, rules)."""
    done = base
    while done < base + len(rules):
        block = rules[done - base :]
        ready = int(np.argmax(np.append((block >= done).any(1), True)))  # up to the first rule that needs a later one
        yield done, block[:ready].astype(np.int64)
        done += ready


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every symbol as a ragged array."""
    data, offsets = np.arange(base, dtype=np.uint32), np.arange(base + 1, dtype=np.int64)
    for _, block in _layers(rules, base):
        new, ends = take(data, offsets, block.ravel())
        offsets = np.concatenate([offsets, offsets[-1] + ends[2::2]])
        data = np.concatenate([data, new])
    return data, offsets


def shard_row(part: int, shard: int, base: int, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> tuple:
    rules, symbols = repair(ids, base)
    lengths = np.ones(base + len(rules), np.int64)
    for first, block in _layers(rules, base):
        lengths[first : first + len(block)] = lengths[block].sum(1)
    ends = np.searchsorted(np.cumsum(lengths[symbols]), np.cumsum(counts)) + 1
    doc_symbols = np.diff(ends, prepend=0).astype(np.uint32)
    return (part, shard, base, len(doc_ids), int(counts.sum()), doc_ids, pack(rules.ravel()), pack(lengths[base:].astype(np.uint32)), pack(symbols), pack(doc_symbols), pack(counts.astype(np.uint32)))


def decode_shard(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids in each document) of a whole shard."""
    data, offsets = expansions(unpack(row["rules"], np.uint32).reshape(-1, 2), row["base"])
    return take(data, offsets, unpack(row["symbols"], np.uint32).astype(np.int64))[0], unpack(row["doc_tokens"], np.uint32).astype(np.int64)


def decode_document(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard alone: its slice of symbols, expanded by the rules it uses."""
    at = np.concatenate([[0], np.cumsum(unpack(row["doc_symbols"], np.uint32).astype(np.int64))])
    rules, lengths, base = unpack(row["rules"], np.uint32).reshape(-1, 2), unpack(row["rule_lengths"], np.uint32), row["base"]
    stack = unpack(row["symbols"], np.uint32)[at[k] : at[k + 1]][::-1].tolist()
    out = np.empty(sum(int(lengths[s - base]) if s >= base else 1 for s in stack), np.uint32)
    n = 0
    while stack:
        s = stack.pop()
        if s >= base:
            stack += [int(rules[s - base][1]), int(rules[s - base][0])]
        else:
            out[n] = s
            n += 1
    return out


_LOADED: dict[int, tuple] = {}


def _loaded(content: str) -> tuple[PieceEncoder, int]:
    """An encoder with the tokenizer of a file and the vocabulary size, built once in a Python worker, which keeps its chunks.
    The library uses the one core of its task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(content)
    if key not in _LOADED:
        tokenizer = Tokenizer.from_str(content)
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.content != t.content.strip() or " " in t.content for t in added):
            raise ValueError("added tokens that take blanks or look at their neighbours are not supported")
        names = sorted((t.content for t in added), key=len, reverse=True)

        size = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)  # bytes of each id: a byte is a letter of its name
        for name, i in tokenizer.get_vocab(with_added_tokens=False).items():
            size[i] = len(name)

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Pieces that begin with a blank and no further white space follow each other as in a text, JOINED to one, and are
            told apart by their bytes; the others are encoded one by one."""
            joined = np.fromiter((len(c) > 1 and c[0] == " " and not c[1].isspace() for c in chunks), bool, len(chunks))
            alone = [c for c, j in zip(chunks, joined.tolist(), strict=True) if not j]
            inside = [c for c, j in zip(chunks, joined.tolist(), strict=True) if j]
            found = [e.ids for e in tokenizer.encode_batch_fast(["".join(inside[k : k + JOINED]) for k in range(0, len(inside), JOINED)], add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(found), np.int32)
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            wanted = np.concatenate([[0], np.cumsum(pc.binary_length(pa.array(inside, pa.string())).to_numpy(zero_copy_only=False))]).astype(np.int64)
            offsets = np.searchsorted(ends, wanted)
            if ends[-1] != wanted[-1] or (ends[offsets] != wanted).any():
                raise ValueError("the tokenizer doesn't cut texts at blanks, or its ids don't stand for bytes")
            found = [e.ids for e in tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.int32)])
            offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(x) for x in found])]).astype(np.int64)
            return take(ids, offsets, np.argsort(np.argsort(~joined, kind="stable"), kind="stable"))

        special = re.compile("|".join(map(re.escape, names))) if names else None
        _LOADED[key] = PieceEncoder(encode, special), tokenizer.get_vocab_size(with_added_tokens=True)
    return _LOADED[key]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the ids in ascending doc_id order (null first, rows
    of one id by a hash of the text) as FILE_SCHEMA rows. (part, shard) is the order: one range exchange on id and hash, sampled
    bounds, then each task cuts its sorted run into shards. Strings of the tokenizer's added tokens in a text become these
    tokens, as the library does it. An empty table writes no shard; repeated rows are repeated; a document longer than a
    shard is a shard of its own, and so must fit a task's memory. Other columns of docs are not written."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = _loaded(content.value)
        part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made() -> pa.RecordBatch:
            ids, counts, names = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), sum((h[0] for h in held), [])
            row = shard_row(part, shard, base, names, ids, counts)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=fields)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, ids, counts in encoder(batch.column(1).to_pylist()):
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                held.append((names[a:b], ids, counts))
                size += len(ids)
                if size >= shard_tokens:
                    yield made()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield made()

    fields = [f.split()[0] for f in FILE_SCHEMA.split(", ")]
    types = [pa.int32()] * 4 + [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 5
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranged = slim.repartitionByRange(max(shuffle_partitions(spark), -(-size // TASK_BYTES)), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    ranged.mapInArrow(rows, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The shards as written (FILE_SCHEMA)."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, decoded from the grammars.

    start counts the ids of all documents before it: a running sum over the parts (one row per task that wrote) and over the
    shards within a part; payloads take no part in it.
    """
    schema = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = decode_shard(row)
                raw, ends = ids.astype("<u4"), np.cumsum(counts)
                crcs = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(counts)
                columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    sizes = shards.select("part", "shard", "n_tokens")
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(over_parts), F.lit(0)).alias("part_at"))
    begins = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("shard_at")).join(parts, "part")
    docs = shards.select("part", "shard", "base", "doc_ids", "rules", "symbols", "doc_tokens").mapInArrow(rows, schema)
    return docs.join(begins, ["part", "shard"]).select("doc_id", (F.col("at") + F.col("shard_at") + F.col("part_at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return document_tokens(read_token_files(spark, path))
