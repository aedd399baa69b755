"""Benchmark decontamination with DataFrame functions only: a hash set of item windows, document windows scanned against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, table

WINDOW = 10
#: Up to this many distinct item windows (about 60 MB) are broadcast; beyond it the same join shuffles.
BROADCAST_WINDOWS = 500_000
#: Words of a document whose windows are made at once, so that a very long text never becomes one huge array.
BLOCK = 8192

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: digits, letters and everything beyond ASCII. Null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS, -1), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (w, size, items): every run of `window` words of an item, or the whole item if it is shorter but not empty."""
    b = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(window))
    each = F.transform(F.sequence(F.lit(0), F.size("ws") - size), lambda i: F.array_join(F.slice("ws", i + 1, size), " "))
    return b.select("item", size.alias("size"), F.explode(each).alias("w")).groupBy("w", "size").agg(F.collect_set("item").alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, text_md5, n_words, n_hit, items, spans, contaminated).

    spans: merged runs of hit words as structs of `start` and `end` (word positions, end excluded); items: ids as strings,
    sorted, of the items with an occurring window (a null id never shows, but its words count as hit). Null and empty texts
    have no words. An empty benchmark hits nothing. Rows that repeat an id and text give equal, repeated rows. The join
    compares whole windows, so every hit is verified. Other columns of docs are left out; join them back by id and text_md5.
    """
    found = item_windows(benchmark, window)
    sizes = found.groupBy("size").agg(F.count("*").alias("n")).collect()  # at most `window` rows
    if sum(r["n"] for r in sizes) <= BROADCAST_WINDOWS:
        found = F.broadcast(found)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"), words_of(F.col(text)).alias("ws"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = base.select(
        "doc_id", "text_md5", F.size("ws").alias("n_words"), F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("ws", s + 1, BLOCK + window - 1).alias("b")))).alias("x")
    ).select("doc_id", "text_md5", "n_words", "x.at", "x.b")

    def windows(size: int) -> Column:
        last = F.least(F.size("b") - size, F.lit(BLOCK - 1))
        one = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((F.col("at") + i).alias("pos"), F.array_join(F.slice("b", i + 1, size), " ").alias("w")))
        return F.when(F.size("b") >= size, one)

    # the first entry of a document stands for its row and matches nothing; null characters are no word characters
    mark = F.when(F.col("at") == 0, F.array(F.struct(F.lit(-1).alias("pos"), F.concat(F.lit("\0"), "text_md5").alias("w"))))
    each = F.flatten(F.array_compact(F.array(mark, *[windows(r["size"]) for r in sizes])))
    joined = (
        blocks.select("doc_id", "text_md5", "n_words", F.explode(each).alias("e")).select("doc_id", "text_md5", "n_words", "e.pos", "e.w")
        .join(found, "w", "left").where((F.col("pos") < 0) | F.col("items").isNotNull())
    )
    hit = F.when(F.col("pos") >= 0, F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end")))
    grouped = joined.groupBy("doc_id", "text_md5").agg(
        F.max("n_words").alias("n_words"), F.sum((F.col("pos") < 0).cast("long")).alias("copies"), F.collect_set(hit).alias("hits"), F.flatten(F.collect_set("items")).alias("items")
    )
    merged = F.aggregate(
        F.array_sort("hits"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(-1)) >= x["start"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    return (
        grouped.withColumns({"spans": F.when(F.size("hits") > 0, merged).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)")), "items": F.array_sort(F.array_distinct("items"))})
        .withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "text_md5", "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without what find_contamination() hits; all columns stay.

    remove="documents" drops every document with a hit; remove="spans" cuts the hit words, each with the separators before
    it, and keeps the rest of the text as it is. Null texts and ids are kept.
    """
    hits = find_contamination(docs, benchmark, window, doc_id, text).where("contaminated").groupBy(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).agg(F.any_value("spans").alias("_spans"))
    same = docs[doc_id].eqNullSafe(hits["_id"]) & (F.md5(F.coalesce(docs[text], F.lit(""))) == hits["_md5"])
    if remove == "documents":
        return docs.join(hits, same, "left_anti")
    pieces = F.regexp_extract_all(F.col(text), F.lit(_RAW_WORD), F.lit(0))
    tail = F.regexp_extract(F.col(text), r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    kept = F.filter(pieces, lambda p, i: ~F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    cut = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return docs.join(hits, same, "left").withColumn(text, cut).select(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
m AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, m WHERE len(ws) >= m)),
h AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw USING (m, w)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
