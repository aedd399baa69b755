"""Sentiment, summaries, corrections, assembled analyses (group G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.substrings import containing


def lexicon_sentiment(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, positive, negative, label, score): terms contained in the lower-cased text, anywhere. lexicon: (term, polarity)."""
    hits = containing(docs.select("doc_id", F.lower("text").alias("t")), "t", lexicon.select("term", "polarity"), "term")
    p = hits.groupBy("doc_id").pivot("polarity", ["positive", "negative"]).count()
    x = docs.select("doc_id").join(p, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("positive", "negative")])
    label = F.when(F.col("positive") > F.col("negative"), "positive").when(F.col("negative") > F.col("positive"), "negative").otherwise("neutral")
    return x.withColumn("label", label).withColumn("score", F.when(label == "positive", 0.6).when(label == "negative", -0.6).otherwise(0.0))


def combine_sentence_scores(scores: DataFrame, cut: float = 0.2) -> DataFrame:
    """(doc_id, mean, label) from class scores (doc_id, sent_id, class, score): a sentence counts its best class, signed."""
    sign = F.when(F.col("c") == "positive", 1.0).when(F.col("c") == "negative", -1.0).otherwise(0.0)
    s = scores.groupBy("doc_id", "sent_id").agg(F.max_by("class", F.struct("score", "class")).alias("c"), F.max("score").alias("s"))
    g = s.groupBy("doc_id").agg(F.avg(sign * F.col("s")).alias("mean"))
    return g.withColumn("label", F.when(F.col("mean") > cut, "positive").when(F.col("mean") < -cut, "negative").otherwise("neutral"))


def extractive_summary(docs: DataFrame, short: int = 50) -> DataFrame:
    """(doc_id, summary, n_text, n_summary): first, middle and last sentence; short texts and those of up to three stay."""
    s, n = F.col("_s"), F.size("_s")
    three = F.concat_ws(" ", F.get(s, F.lit(0)), F.get(s, F.floor(n / 2).cast("int")), F.get(s, n - 1))
    text = F.coalesce("text", F.lit(""))
    x = docs.select("doc_id", text.alias("text"), tx.sentences(F.col("text"), "after").alias("_s"))
    x = x.select("doc_id", "text", F.when((F.char_length("text") < short) | (n <= 3), F.col("text")).otherwise(three).alias("summary"))
    return x.select("doc_id", "summary", F.char_length("text").alias("n_text"), F.char_length("summary").alias("n_summary"))


def apply_corrections(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, text, n_changes): literal replacements in order, blanks collapsed; n_changes counts the hits of all rules."""
    t, n = F.coalesce("text", F.lit("")), F.lit(0)
    for old, new in rules:
        n = n + ((F.char_length(t) - F.char_length(F.replace(t, F.lit(old), F.lit("")))) / len(old)).cast("int")
        t = F.replace(t, F.lit(old), F.lit(new))
    return docs.select("doc_id", F.regexp_replace(t, " +", " ").alias("text"), n.alias("n_changes"))


def changed_words(docs: DataFrame, corrected: DataFrame) -> DataFrame:
    """(doc_id, pos, original, corrected) of the blank-separated words that differ."""
    a = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), " +", -1).alias("a")).join(corrected.select("doc_id", F.split("text", " ", -1).alias("b")), "doc_id")
    return a.select("doc_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "x")).where(~F.col("x.a").eqNullSafe(F.col("x.b"))).select("doc_id", "pos", F.col("x.a").alias("original"), F.col("x.b").alias("corrected"))


def correction_report(changes: DataFrame, k: int = 20) -> DataFrame:
    return changes.groupBy("original", "corrected").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "original", "corrected").limit(k)


def assemble_analysis(requests: DataFrame, **services: DataFrame) -> DataFrame:
    """requests (request_id) with each service's result, `missing` service names and `partial`. services: (request_id, result)."""
    out = requests
    for name, df in services.items():
        out = out.join(df.select("request_id", F.col("result").alias(name)), "request_id", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in services]))
    return out.withColumn("missing", F.array_join(missing, ",")).withColumn("partial", F.col("missing") != "")
