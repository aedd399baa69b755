"""LM scoring: deleted interpolation of bigram, unigram and uniform estimates, mixed by context frequency, weights by EM.

Counts cover the whole corpus. Texts are dealt into chunks; a chunk asks, once for each distinct n-gram it holds, for the
corpus count. Requests go to count buckets by hash, bucket totals come back in the order of the requests. So what is shuffled
is one hash for each distinct n-gram of a chunk, whatever its frequency: a word that makes up a third of all tokens is one
request a chunk, and no task sees all of its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mix64, pack, stored, table, unpack
from .language_id import held_out

#: Bytes of text in one chunk, about; also decides the number of chunks and count buckets, MIN_CHUNKS at least.
CHUNK_BYTES = 12 << 20
MIN_CHUNKS = 24
#: Bits of a bigram's hash. Two of n bigrams share one with probability n / 2 ** 48; words have 64.
PAIR_BITS = 48
#: EM rounds and the width of the histogram cells (natural logarithms) that held-out counts are gathered in.
EM_ROUNDS, CELL, CELLS = 60, 0.25, 160
END = xxhash.xxh64_intdigest(b"", seed=1)  # no word is empty


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(pack(a), 1)


def spread(b: bytes, dtype=np.uint64) -> np.ndarray:
    return unpack(zstandard.decompress(b), dtype)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit token hashes of all texts in a row, tokens of each). Words `[^\\x20\\x09-\\x0D]+` of the A-Z lower-cased text, then END."""
    digest, parts, counts = xxhash.xxh64_intdigest, [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both touch ASCII only
        own = np.empty(len(words) + 1, np.uint64)
        own[:-1] = np.fromiter(map(digest, words), np.uint64, len(words))
        own[-1] = END
        parts.append(own)
        counts[i] = len(own)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """Hashes of (previous token, token); END comes before a text's first word."""
    before = np.concatenate([[np.uint64(END)], tokens[:-1]])
    return mix64(tokens ^ (before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))) >> np.uint64(64 - PAIR_BITS)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table_ = pa.Table.from_batches([batch])
        chunk = batch.column(0).to_numpy()
        for c in np.unique(chunk):
            sink = pa.BufferOutputStream()
            part = table_.filter(pa.array(chunk == c)).drop_columns(["chunk"]).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 3)], pa.binary())], names=["chunk", "texts"])


def _unpack_texts(blobs) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(zstandard.decompress(b)).read_all() for b in blobs)


def _split(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's keys end among sorted keys; a bucket is a range of leading bits."""
    edges = [-(-(b << bits) // buckets) for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs in training texts."""
    distinct = np.unique(keys)
    known, n = np.unique(keys[train], return_counts=True)
    counts = np.zeros(len(distinct), np.uint64)
    counts[np.searchsorted(distinct, known)] = n
    return distinct, counts


class Corpus:
    """Counts of a corpus, stored: `rows` has one row for each chunk and bucket with the totals that the chunk asked for."""

    def __init__(self, texts: DataFrame, buckets: int, rows: DataFrame):
        self.texts, self.buckets, self.rows = texts, buckets, rows
        total = rows.select("bucket", "n_tokens", "n_words").groupBy("bucket").agg(F.max("n_tokens").alias("n"), F.max("n_words").alias("v")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        self.n, self.v = total["n"] or 0, total["v"] or 0


def count_corpus(docs: DataFrame, train: str = "train", doc_id: str = "doc_id", text: str = "text") -> Corpus:
    """Counts words and word pairs of the rows whose `train` is true, for all rows. Null texts are empty, a null flag false."""
    size = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    parts = max(MIN_CHUNKS, -(-size // CHUNK_BYTES))
    dealt = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(parts)).cast("int").alias("chunk"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(train), F.lit(False)).alias("train"), F.col(text).alias("text"))
    texts = dealt.mapInArrow(_pack_texts, "chunk int, texts binary")

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        chunk = int(part["chunk"].iloc[0])
        held = _unpack_texts(part["texts"])
        tokens, n = tokens_of(held.column("text").to_pylist())
        own = np.repeat(held.column("train").to_numpy(), n)
        out = []
        for keys, bits in ((tokens, 64), (pairs_of(tokens), PAIR_BITS)):
            distinct, counts = _distinct(keys, own)
            ends = _split(distinct, bits, parts)
            out.append([(squeeze(distinct[a:b]), squeeze(counts[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return pd.DataFrame([(b, chunk, *w, *p) for b, (w, p) in enumerate(zip(*out, strict=True))], columns=["bucket", "chunk", "words", "word_n", "pairs", "pair_n"])

    def total(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for kind in ("word", "pair"):
            keys = [spread(b) for b in part[f"{kind}s"]]
            distinct = np.unique(np.concatenate(keys))
            sums = np.zeros(len(distinct), np.uint64)
            places = [np.searchsorted(distinct, k) for k in keys]
            for place, n in zip(places, part[f"{kind}_n"], strict=True):
                sums[place] += spread(n)
            found.append([squeeze(sums[place]) for place in places])
            if kind == "word":
                n_tokens, n_words = int(sums.sum()), int((sums > 0).sum())
        return pd.DataFrame({"bucket": part["bucket"], "chunk": part["chunk"], "word_n": found[0], "pair_n": found[1], "n_tokens": n_tokens, "n_words": n_words})

    asked = texts.groupBy("chunk").applyInPandas(ask, "bucket int, chunk int, words binary, word_n binary, pairs binary, pair_n binary")
    rows = asked.groupBy("bucket").applyInPandas(total, "bucket int, chunk int, word_n binary, pair_n binary, n_tokens long, n_words long")
    return Corpus(texts, parts, stored(rows, "counts"))


def token_counts(corpus: Corpus) -> DataFrame:
    """One row a chunk: its documents with token numbers, and for each token the corpus counts of the word and of the pair."""

    def look_up(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["docs", "words", "pairs"]
        if not len(texts):
            return pd.DataFrame(columns=names)
        held = _unpack_texts(texts["texts"])
        tokens, n = tokens_of(held.column("text").to_pylist())
        answers = answers.sort_values("bucket")
        found = []
        for keys, column in ((tokens, "word_n"), (pairs_of(tokens), "pair_n")):
            totals = np.concatenate([spread(b) for b in answers[column]])
            found.append(totals[np.searchsorted(np.unique(keys), keys)])
        about = held.drop_columns(["text"]).append_column("n_tokens", pa.array(n))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as out:
            out.write_table(about)
        return pd.DataFrame([(zstandard.compress(sink.getvalue().to_pybytes()), squeeze(found[0]), squeeze(found[1]))], columns=names)

    return corpus.texts.groupBy("chunk").cogroup(corpus.rows.select("chunk", "bucket", "word_n", "pair_n").groupBy("chunk")).applyInPandas(look_up, "docs binary, words binary, pairs binary")


def _opened(row) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, tokens of each, c(w), c(v), c(v w)) of one row of token_counts, counts as doubles. Before a first word stands
    END, which occurs as often as there are training texts: as often as the END of the same text."""
    docs = pa.ipc.open_stream(zstandard.decompress(row["docs"])).read_all()
    n = docs.column("n_tokens").to_numpy()
    w, vw = spread(row["words"]).astype(np.float64), spread(row["pairs"]).astype(np.float64)
    v = np.concatenate([w[-1:], w[:-1]])
    return docs, n, w, v, vw


def context_bucket(v: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the binary logarithm of its count."""
    return np.where(v > 0, 1 + np.log2(np.maximum(v, 1)).astype(np.int64), 0)


def held_out_cells(counts: DataFrame, n: int) -> DataFrame:
    """Deleted estimates of all training tokens, each with its own occurrence taken out of the counts, as a histogram:
    (bucket, cell2, cell1, n, p2, p1), p the sums of the bigram and unigram estimates. Cells are logarithmic; 80 buckets at most."""
    names = ["bucket", "cell2", "cell1", "n", "p2", "p1"]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                docs, sizes, w, v, vw = _opened(row)
                own = np.repeat(docs.column("train").to_numpy(), sizes)
                w, v, vw = w[own] - 1, v[own] - 1, vw[own] - 1
                p2 = np.where(v > 0, vw / np.maximum(v, 1), 0.0)
                p1 = w / max(n - 1, 1)
                # cell k holds estimates of e ** (-CELL k) to e ** (-CELL (k - 1)); 0 is none, CELLS - 1 also what is smaller
                cell = [np.where(p > 0, np.clip(np.ceil(-np.log(np.maximum(p, 1e-300)) / CELL) + 1, 1, CELLS - 1), 0).astype(np.int64) for p in (p2, p1)]
                index = (context_bucket(v) * CELLS + cell[0]) * CELLS + cell[1]
                n_of = np.bincount(index, minlength=1)
                used = np.flatnonzero(n_of)
                yield pd.DataFrame({"bucket": used // CELLS**2, "cell2": used // CELLS % CELLS, "cell1": used % CELLS, "n": n_of[used], "p2": np.bincount(index, p2)[used], "p1": np.bincount(index, p1)[used]})

    cells = counts.mapInPandas(gather, "bucket long, cell2 long, cell1 long, n long, p2 double, p1 double")
    return cells.groupBy("bucket", "cell2", "cell1").agg(*[F.sum(x).alias(x) for x in names[3:]])


def fit_weights(cells: pd.DataFrame, v: int, rounds: int = EM_ROUNDS) -> dict[int, np.ndarray]:
    """EM: mixture weights (bigram, unigram, uniform) of each context bucket. An unseen context has no bigram estimate."""
    out = {}
    for bucket, own in cells.groupby("bucket"):
        n = own["n"].to_numpy(np.float64)
        p = np.stack([own["p2"] / n, own["p1"] / n, np.full(len(own), 1 / (v + 1))], 1)
        weights = np.array([0.0, 0.5, 0.5]) if bucket == 0 else np.full(3, 1 / 3)
        for _ in range(rounds):
            share = weights * p
            share /= share.sum(1, keepdims=True)
            weights = (share * n[:, None]).sum(0) / n.sum()
            weights[2] = max(weights[2], 1e-9)  # no text has probability zero
            weights /= weights.sum()
        out[int(bucket)] = weights
    return out


def score_corpus(docs: DataFrame, train: str = "train", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    base_score: log10 probability under add-one unigrams; score: under the interpolated model. Null texts are empty: one END.
    With no training text all counts are zero and both scores rest on the uniform estimate. Repeated rows are repeated, and
    count as often in training. Other columns are left out.
    """
    corpus = count_corpus(docs, train, doc_id, text)
    counts = stored(token_counts(corpus), "occurrences")
    n, v = corpus.n, corpus.v
    weights = fit_weights(held_out_cells(counts, n).toPandas(), v)
    seen = sorted(b for b in weights if b) or [0]
    mix = np.array([weights.get(b, weights.get(min(seen, key=lambda s: abs(s - b)), np.array([0.0, 0.5, 0.5])) if b else np.array([0.0, 0.5, 0.5])) for b in range(80)])
    id_type = docs.schema[doc_id].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs_, sizes, w, before, vw = _opened(row)
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                base = np.log10((w + 1) / (n + v + 1))
                a = mix[context_bucket(before)]
                p = a[:, 0] * np.where(before > 0, vw / np.maximum(before, 1), 0.0) + a[:, 1] * (w / max(n, 1)) + a[:, 2] / (v + 1)
                sums = [np.add.reduceat(x, at) for x in ((w > 0).astype(np.int64), base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [docs_.column("doc_id").combine_chunks(), docs_.column("train").combine_chunks(), pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(sizes), n)), pa.array(sums[1]), pa.array(sums[2])],
                    names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counts.mapInArrow(score, f"doc_id {id_type.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 7, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train"))
    return score_corpus(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
