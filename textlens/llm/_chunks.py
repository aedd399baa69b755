"""Texts dealt into chunks that one task handles at once, as compressed Arrow tables, and compressed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import give_back, pack, unpack

#: Bytes of text in one chunk, about, and chunks at least.
CHUNK_BYTES = 6 << 20
MIN_CHUNKS = 24


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(pack(a), 1)


def spread(b: bytes, dtype=np.uint64) -> np.ndarray:
    return unpack(zstandard.decompress(b), dtype)


def chunk_count(docs: DataFrame, text: str, least: int = MIN_CHUNKS) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    return max(least, -(-size // CHUNK_BYTES))


def freeze(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t.combine_chunks())
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def thaw(blobs) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(zstandard.decompress(b)).read_all() for b in blobs)


def deal(docs: DataFrame, chunk: Column) -> DataFrame:
    """(chunk, texts): the rows of docs by chunk number, several blobs for each chunk."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            whole = pa.Table.from_batches([batch])
            number = batch.column(0).to_numpy()
            rest = whole.drop_columns(["_chunk"])
            for c in np.unique(number):
                yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([freeze(rest.filter(pa.array(number == c)))], pa.binary())], names=["chunk", "texts"])

    return docs.select(chunk.cast("int").alias("_chunk"), "*").mapInArrow(rows, "chunk int, texts binary")
