"""Source divergence audit: terms of each (lang, source) by a sort of word-start pointers, compared within each language.

A shard is some MiB of texts in one Arrow buffer, ordered by language and source. Pointers to its word starts are sorted by
multikey quicksort, one slice a language; a run of equal terms gives document frequency and counts by source at once, since equal
pointers keep the order of the texts. So a task sends a term once a source, whatever its frequency, and Spark adds the shards up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import give_back, stored, table
from ._pointers import LOWER, TERM, gather, sort_pointers, term_starts

#: Bytes of text in one shard, about; a longer text is sorted in pieces of that size, cut between terms.
SHARD_BYTES = 4 << 20
#: Documents of a language a kept term is in at least, and the ranks of terms reported for a group.
MIN_DOCUMENTS, TOP_TERMS = 3, 200
#: Group statistics of up to so many (lang, source) groups (some 10 MB) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Parts of a language in that shuffle, so that a large one isn't one task's.
SALTS = 64
#: Sources whose pairs are held as one matrix, and bytes of matrices a task holds before it sends them.
SIDE, HELD_BYTES = 256, 32 << 20
UNIT = 1_000_000_000

_COUNTS = "lang string, source string, term string, n long, docs long"


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _runs(text: np.ndarray, offsets: np.ndarray, slices: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(first text, term, n, texts with it) of each term, source and slice; texts are ordered by slice and source."""
    padded = np.concatenate([LOWER[text], np.zeros(8, np.uint8)])
    start, length, number = term_starts(text, offsets)
    per_slice = np.diff(np.searchsorted(number, np.concatenate([[0], np.cumsum(slices)])))
    order, head = sort_pointers(padded, start, length, per_slice)
    number = number[order]
    first = head.copy()
    first[1:] |= source[number[1:]] != source[number[:-1]]
    fresh = first.copy()
    fresh[1:] |= number[1:] != number[:-1]
    begin = np.flatnonzero(first)
    n = np.diff(np.concatenate([begin, [len(order)]]))
    texts = np.add.reduceat(fresh, begin, dtype=np.int64) if len(begin) else n
    return number[begin], _strings(*gather(padded, start[order[begin]], length[order[begin]])), n, texts


def _long(text: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(term, n) of one very long text, sorted in pieces; only its distinct terms are held besides."""
    pieces, at = [], 0
    while at < len(text):
        end = min(at + SHARD_BYTES, len(text))
        while end < len(text) and TERM[text[end]]:
            end += 1
        _, term, n, _ = _runs(text[at:end], np.array([0, end - at]), np.array([1]), np.zeros(1, np.int64))
        pieces.append(pa.table({"term": term, "n": n}))
        if len(pieces) == 8:
            pieces = [pa.concat_tables(pieces).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])]
        at = end
    merged = pa.concat_tables(pieces).group_by("term").aggregate([("n", "sum")])
    return merged.column("term").combine_chunks(), merged.column("n_sum").to_numpy()


def _count_shard(shard: pa.Table) -> pa.RecordBatch:
    shard = shard.take(pc.sort_indices(shard, [("lang", "ascending"), ("source", "ascending")])).combine_chunks()
    texts = shard.column("text").chunk(0).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lang, source = (shard.column(c).chunk(0) for c in ("lang", "source"))
    if len(texts) == 1 and len(text) > 2 * SHARD_BYTES:
        term, n = _long(text)
        first, docs = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    else:
        code = lambda c: c.dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.diff(code(lang))) + 1
        slices = np.diff(np.concatenate([[0], edges, [len(texts)]]))
        first, term, n, docs = _runs(text, offsets - offsets[0], slices, code(source))
    return pa.RecordBatch.from_arrays([lang.take(pa.array(first)), source.take(pa.array(first)), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SHARD_BYTES, "right")))
            yield _count_shard(whole.slice(at, end - at))
            at = end
        give_back()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, source, n, docs): occurrences of each term and rows of docs it is in, by group. Nulls are ''.

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. Texts without a term, and empty tables, give no row;
    repeated rows count as often as they occur.
    """
    each = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    return each.mapInArrow(_count, _COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)) of three columns, exact."""
    return F.expr(f"1 + (cast({UNIT} as decimal(20,0)) * ({n} + 1)) div ({total} + {terms})")


def _shares(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """share() of arrays by long division in base 1000, exact up to d of 9e15."""
    q, r = np.zeros(np.broadcast(n, d).shape, np.int64), n + 1
    for _ in range(3):
        q, r = q * 1000 + r * 1000 // d, r * 1000 % d
    return q + 1


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, other, value): sums over the terms of the batches for every ordered pair of sources of a language."""
    held: dict[tuple, np.ndarray] = {}
    names: dict[str, np.ndarray] = {}

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), sums in held.items():
            a, b = (np.broadcast_to(x, sums.shape).ravel() for x in (names[lang][i * SIDE : (i + 1) * SIDE, None], names[lang][None, j * SIDE : (j + 1) * SIDE]))
            other = a != b
            yield pa.RecordBatch.from_arrays([pa.array([lang] * int(other.sum()), pa.string()), pa.array(a[other], pa.string()), pa.array(b[other], pa.string()), pa.array(sums.ravel()[other])], names=["lang", "source", "other", "value"])
        held.clear()

    for batch in batches:
        code = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(code.dictionary.to_pylist()):
            rows = batch.filter(pc.equal(code.indices, k))
            info = rows.column("groups")[0].values
            sources, totals = info.field("source"), info.field("total").to_numpy()
            names[lang] = np.array(sources.to_pylist(), object)
            d = totals + rows.column("kept")[0].as_py()
            per = rows.column("per")
            row = pc.list_parent_indices(per).to_numpy()
            at, n = pc.index_in(per.flatten().field("source"), value_set=sources).to_numpy(), per.flatten().field("n").to_numpy()
            step = max(1, (1 << 20) // min(SIDE, len(d)) ** 2)
            for low in range(0, len(rows), step):
                a, b = np.searchsorted(row, [low, low + step])
                counts = np.zeros((min(step, len(rows) - low), len(d)), np.int64)
                counts[row[a:b] - low, at[a:b]] = n[a:b]
                p = _shares(counts, d)
                for i in range(0, len(d), SIDE):
                    for j in range(0, len(d), SIDE):
                        q = p[:, None, j : j + SIDE]
                        off = p[:, i : i + SIDE, None] - q
                        f = ((off * off).view(np.uint64) // q.view(np.uint64)).sum(0, dtype=np.uint64).view(np.int64)
                        key = (lang, i // SIDE, j // SIDE)
                        held[key] = held[key] + f if key in held else f
                        if sum(x.nbytes for x in held.values()) > HELD_BYTES:
                            yield from send()
    yield from send()


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the term shares of a source are from those of others and of its language.

    A language keeps the V terms that are in min_documents of its rows or more. A kept term's share in a group, or in the language, is
    p = 1 + floor(10**9 * (count + 1) / (N + V)), N all occurrences of kept terms there; f = floor((p - q)**2 / q), all exact.
    Part `pair`: item is every other source of the language, value f summed over the kept terms, q the other's share (0 without
    kept terms). Part `term`: the top_terms kept terms of the group with p above the language's share q by f. Ranks from 1 by value
    descending, then item ascending by bytes.

    Null texts, languages and sources are ''. Groups without terms have pairs, no terms. Very long texts are sorted in pieces.
    Repeated rows count each time, ties are ranked by item, an empty table gives no row. Other columns don't matter.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    per = F.collect_list(F.struct("source", "n")).alias("per")
    kept = stored(term_counts(docs, text, lang, source).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), per).where(F.col("docs") >= min_documents).drop("docs"), "terms")
    totals = kept.select("lang", F.explode("per").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("all_total"))
    stats = stored(
        groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept", "all_total")]), "groups"
    )
    small = stats.count() <= BROADCAST_GROUPS
    by_lang = stats.groupBy("lang", "kept").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"))

    each = kept.select("lang", "term", "all", F.explode("per").alias("e")).select("lang", "term", "all", "e.*").join(F.broadcast(stats) if small else stats, ["lang", "source"])
    terms = each.select("lang", "source", F.col("term").alias("item"), share("n", "total", "kept").alias("p"), share("all", "all_total", "kept").alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    if small:
        rows = kept.join(F.broadcast(by_lang), "lang")
    else:
        salted = by_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    sums = rows.select("lang", "kept", "groups", "per").mapInArrow(_pairs, "lang string, source string, other string, value long")
    # every pair, also those of languages without kept terms
    none = by_lang.select("lang", "groups", F.explode("groups.source").alias("source")).select("lang", "source", F.explode("groups.source").alias("other")).where("source <> other").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.unionByName(none).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return terms.withColumn("rank", rank).where(F.col("rank") <= top_terms).unionByName(pairs.withColumn("rank", rank))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language of `documents`."""
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT lang, source, id, unnest(ws) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
l AS MATERIALIZED (SELECT g.lang, count(k.term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k ON g.lang = k.lang GROUP BY g.lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 200
"""
