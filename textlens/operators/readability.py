"""Readability indices, bands, recommendations, sentence and word analysis (group C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.checks import checked_small
from .text import split_paragraphs, tokenize


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def text_statistics(docs: DataFrame, simple: bool = False, paragraph_separator: str = r"\n\s*\n") -> DataFrame:
    """One row a document: counts, means and shares. Array expressions only, so there is no shuffle; every other column of docs
    stays but those of the same names. Null and empty texts have zeros."""
    made = ("n_words", "n_sentences", "n_long", "n_very_long", "n_paragraphs", "n_letters", "avg_sentence_length", "avg_word_length", "long_words_percentage", "very_long_words_percentage")
    keep = [c for c in docs.columns if c not in (*made, "_w")]
    base = docs.select(*keep, tx.words(F.col("text")).alias("_w")).withColumns(
        {"n_words": F.size("_w"), "n_sentences": F.size(tx.sentences(F.col("text"))), "n_long": tx.long_words(F.col("_w")), "n_very_long": tx.long_words(F.col("_w"), tx.DOC_VERY_LONG)}
    )
    base = base.withColumns({"avg_sentence_length": _ratio(F.col("n_words"), F.col("n_sentences")), "long_words_percentage": _share(F.col("n_long"), F.col("n_words"))})
    if not simple:
        letters = F.aggregate("_w", F.lit(0), lambda s, w: s + F.char_length(w))
        base = base.withColumns({"n_paragraphs": F.size(tx.paragraphs(F.col("text"), paragraph_separator)), "n_letters": letters, "very_long_words_percentage": _share(F.col("n_very_long"), F.col("n_words"))})
        base = base.withColumn("avg_word_length", _ratio(F.col("n_letters"), F.col("n_words")))
    return base.drop("_w")


def lix(stats: DataFrame) -> DataFrame:
    """stats with lix: words per sentence plus the percentage of long words; 0 without words or sentences. Unrounded."""
    value = F.col("n_words") / F.col("n_sentences") + 100.0 * F.col("n_long") / F.col("n_words")
    return stats.withColumn("lix", F.when((F.col("n_words") > 0) & (F.col("n_sentences") > 0), value).otherwise(F.lit(0.0)))


def rix(stats: DataFrame) -> DataFrame:
    return stats.withColumn("rix", _ratio(F.col("n_long"), F.col("n_sentences")))


def classify(scores: DataFrame, bands: DataFrame, index: str, value: str) -> DataFrame:
    """scores with <index>_ord, <index>_band and <index>_audience: a range join to the band table, lo <= value < hi."""
    b = F.broadcast(checked_small(bands.where(F.col("index") == index)))
    b = b.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("ord").alias(f"{index}_ord"), F.col("band").alias(f"{index}_band"), F.col("audience").alias(f"{index}_audience"))
    return scores.join(b, (F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi")), "left").drop("_lo", "_hi")


def combined_description(scores: DataFrame) -> DataFrame:
    """scores (lix, rix and both bands) with agreement: consistent, near, short_sentences, long_sentences or mixed."""
    gap = F.abs(F.col("lix_ord") - F.col("rix_ord"))
    kind = (
        F.when(gap == 0, F.concat(F.lit("consistent "), F.col("lix_band"))).when(gap == 1, F.concat(F.lit("mainly "), F.col("lix_band"), F.lit(" to "), F.col("rix_band")))
        .when((F.col("lix") > 40) & (F.col("rix") < 2.5), "short sentences with long words").when((F.col("lix") < 30) & (F.col("rix") > 3.5), "short words in long sentences")
        .otherwise(F.concat(F.lit("mixed: LIX "), F.col("lix_band"), F.lit(", RIX "), F.col("rix_band")))
    )
    return scores.withColumn("agreement", kind)


def syllable_stats(docs: DataFrame, lang: str = "no") -> DataFrame:
    """docs with n_chars_trimmed, n_sentences, n_words, n_long, n_letters, n_syllables and n_complex (three syllables or more)."""
    ws = tx.words(F.lower("text"))
    s = F.transform("_w", lambda w: tx.syllables(w, lang))
    return (
        docs.select("doc_id", F.char_length(tx.strip(F.coalesce("text", F.lit("")))).alias("n_chars_trimmed"), F.size(tx.sentences(F.col("text"), "runs")).alias("n_sentences"), ws.alias("_w"))
        .withColumns({"n_words": F.size("_w"), "n_long": tx.long_words(F.col("_w")), "n_letters": F.aggregate("_w", F.lit(0), lambda a, w: a + F.char_length(w)), "_s": s})
        .withColumns({"n_syllables": F.aggregate("_s", F.lit(0), lambda a, x: a + x), "n_complex": F.size(F.filter("_s", lambda x: x >= 3))})
        .drop("_w", "_s")
    )


def readability_indices(stats: DataFrame) -> DataFrame:
    """syllable_stats() with smog, coleman_liau, flesch, flesch_kincaid, fog, ari and lix; zeros without words or sentences."""
    w, s = F.col("n_words"), F.col("n_sentences")
    asl, spw = w / s, F.col("n_syllables") / w
    both = (w > 0) & (s > 0)
    zero = F.lit(0.0)
    return stats.withColumns(
        {
            "smog": F.when(s > 0, 1.043 * F.sqrt(F.col("n_complex") * (30 / s)) + 3.1291).otherwise(zero),
            "coleman_liau": F.when(w > 0, 0.0588 * (F.col("n_letters") / w * 100) - 0.296 * (s / w * 100) - 15.8).otherwise(zero),
            "flesch": F.when(both, 206.835 - 1.015 * asl - 84.6 * spw).otherwise(zero),
            "flesch_kincaid": F.when(both, 0.39 * asl + 11.8 * spw - 15.59).otherwise(zero),
            "fog": F.when(both, 0.4 * (asl + 100 * (F.col("n_complex") / w))).otherwise(zero),
            "ari": F.when(both, 4.71 * (F.col("n_chars_trimmed") / w) + 0.5 * asl - 21.43).otherwise(zero),
            "lix": F.when(both, asl + 100.0 * F.col("n_long") / w).otherwise(zero),
        }
    )


def _steps(c: Column, steps: list[tuple[float, str]], last: str, above: bool) -> Column:
    out = None
    for edge, name in steps:
        test = c > edge if above else c < edge
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def difficulty(indices: DataFrame) -> DataFrame:
    """indices with lix_level, flesch_level, education_level, age_group and complexity (0 to 10)."""
    between = lambda c, top: F.least(F.lit(float(top)), F.greatest(F.lit(0.0), c))
    education = _steps(F.col("flesch_kincaid"), [(6, "elementary"), (10, "middle_school"), (13, "high_school"), (16, "college")], "graduate", False)
    return indices.withColumns(
        {
            "lix_level": _steps(F.col("lix"), [(25, "very_easy"), (35, "easy"), (45, "medium"), (55, "difficult")], "very_difficult", False),
            "flesch_level": _steps(F.col("flesch"), [(90, "very_easy"), (80, "easy"), (70, "fairly_easy"), (60, "medium"), (50, "fairly_difficult"), (30, "difficult")], "very_difficult", True),
            "education_level": education,
            "age_group": _steps(F.col("flesch_kincaid"), [(6, "6-11"), (10, "11-14"), (13, "14-18"), (16, "18-22")], "22+", False),
            "complexity": 0.4 * (between(F.col("lix"), 100) / 10) + 0.3 * ((100 - between(F.col("flesch"), 100)) / 10) + 0.3 * (between(F.col("flesch_kincaid"), 20) / 2),
        }
    )


def recommend(scores: DataFrame, rules: DataFrame, purpose: str | None = None) -> DataFrame:
    """(doc_id, type, title, impact): every rule of which a metric exceeds the threshold, else one row of praise."""
    tall = scores.selectExpr("doc_id", "stack(4, 'lix', lix, 'rix', rix, 'avg_sentence_length', avg_sentence_length, 'long_words_percentage', long_words_percentage) AS (metric, value)")
    r = F.broadcast(checked_small(rules.where(F.col("purpose").isNull() | (F.col("purpose") == F.lit(purpose)))))
    hits = tall.join(r, (tall.metric == r.metric) & (tall.value > r.threshold)).select("doc_id", "type", "title", F.when(F.col("value") > F.col("high"), "high").otherwise(F.col("impact")).alias("impact"))
    praised = (F.col("lix") > 40) | (F.col("rix") > 4) | (F.col("avg_sentence_length") > 18) | (F.col("long_words_percentage") > 25)
    none = scores.join(hits.select("doc_id").distinct(), "doc_id", "left_anti") if purpose else scores.where(~praised)
    title = F.when(F.col("lix") < 30, "Utmerket lesbarhet").otherwise("God lesbarhet")
    return hits.union(none.select("doc_id", F.lit("positive_feedback"), title, F.lit("low")))


def sentence_analysis(docs: DataFrame, policy: str = "after") -> DataFrame:
    """(doc_id, sent_id, n_words, n_long, n_very_long, avg_word_length, lix, level, very_long): one row a sentence."""
    s = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"), policy)).alias("sent_id", "sentence")).withColumn("_w", tx.words(F.col("sentence")))
    very = F.filter("_w", lambda w: F.char_length(w) >= tx.VERY_LONG)
    s = s.withColumns({"n_words": F.size("_w"), "n_long": tx.long_words(F.col("_w")), "n_very_long": F.size(very), "first_very_long": F.array_join(F.slice(very, 1, 3), ", "), "_l": F.aggregate("_w", F.lit(0), lambda a, w: a + F.char_length(w))})
    score = F.when(F.col("n_words") > 0, F.col("n_words") + 100.0 * F.col("n_long") / F.col("n_words")).otherwise(F.lit(0.0))
    s = s.withColumns({"avg_word_length": _ratio(F.col("_l"), F.col("n_words")), "lix": score})
    level = F.when(F.col("n_words") == 0, "N/A").when(F.col("lix") > 60, "svært kompleks").when(F.col("lix") > 50, "kompleks").when(F.col("lix") > 40, "moderat").otherwise("enkel")
    return s.withColumn("level", level).drop("_w", "_l", "sentence")


def sentence_issues(sentences: DataFrame, medium: int = 20, long: int = 25, some: float = 30.0, many: float = 40.0) -> DataFrame:
    """(doc_id, sent_id, type, severity, tip): long sentences and many long words."""
    share = _share(F.col("n_long"), F.col("n_words"))
    replace = F.when(F.col("n_very_long") > 0, F.concat(F.lit("replace: "), F.col("first_very_long"))).otherwise("use shorter synonyms")
    row = lambda test, kind, severity, tip: F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), tip.alias("tip")))
    split = F.lit("split the sentence")
    found = F.array_compact(F.array(
        row(F.col("n_words") > long, "long_sentence", "high", split), row((F.col("n_words") > medium) & (F.col("n_words") <= long), "medium_sentence", "medium", split),
        row(share > many, "long_words", "high", replace), row((share > some) & (share <= many), "long_words", "medium", replace),
    ))
    return sentences.select("doc_id", "sent_id", F.explode(found).alias("i")).select("doc_id", "sent_id", "i.type", "i.severity", "i.tip")


def word_analysis(docs: DataFrame, limit: int = 200) -> DataFrame:
    """The first `limit` words of each document with frequency, rank (ties by first use), significance, style, complexity."""
    # a word's first places stand in its row, so that words need no join with their frequencies
    shown = F.collect_list(F.when(F.col("tok_id") < limit, F.struct("tok_id", "form")))
    freq = tokenize(docs).where("doc_id is not null").groupBy("doc_id", "lower").agg(F.count("*").alias("frequency"), F.min("tok_id").alias("first_tok"), shown.alias("shown"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("frequency"), "first_tok")
    freq = freq.withColumns({"rank": F.row_number().over(w), "n_distinct": F.count("*").over(Window.partitionBy("doc_id"))})
    n = F.char_length("form")
    long, very = n >= tx.LONG, n >= tx.VERY_LONG
    return (
        freq.select("doc_id", "frequency", "rank", "n_distinct", F.explode("shown").alias("x")).select("doc_id", "frequency", "rank", "n_distinct", "x.tok_id", "x.form")
        .select(
            "doc_id", "tok_id", "form", "frequency", F.col("rank").alias("frequency_rank"), (F.col("frequency") / F.col("n_distinct")).alias("freq_per_distinct"),
            (0.4 * (1 - F.col("rank") / F.col("n_distinct")) + 0.3 * (n / 12) + 0.3 * F.when(long, 1.0).otherwise(0.5)).alias("significance"),
            F.when(n <= 3, "kort").when(very, "svært lang").when(long, "lang").otherwise("vanlig").alias("style"),
            F.when(very & (F.col("frequency") <= 1), "kompleks").when(long & (F.col("frequency") <= 2), "moderat").otherwise("enkel").alias("complexity"),
        )
    )


def length_distribution(docs: DataFrame, unit: str = "word") -> DataFrame:
    items = tx.words(F.col("text")) if unit == "word" else F.transform(tx.sentences(F.col("text")), lambda s: tx.words(s))
    size = F.char_length("x") if unit == "word" else F.size("x")
    return docs.select("doc_id", F.explode(items).alias("x")).groupBy("doc_id", size.alias("length")).agg(F.count("*").alias("n"))


def most_common_words(docs: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent words of each document, ties by first use."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_tok")
    counts = tokenize(docs).groupBy("doc_id", "lower").agg(F.count("*").alias("n"), F.min("tok_id").alias("first_tok"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", F.col("lower").alias("word"), "n", "rank")


def lexical_diversity(docs: DataFrame) -> DataFrame:
    ws = tx.words(F.lower("text"))
    return docs.select("doc_id", F.size("_w").alias("n_words"), F.size(F.array_distinct("_w")).alias("n_distinct"), _ratio(F.size(F.array_distinct("_w")), F.size("_w")).alias("diversity")) if "_w" in docs.columns else lexical_diversity(docs.select("doc_id", ws.alias("_w")))


def word_batch_stats(docs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, least and greatest word length and the share of long words for each group; partial and final aggregation."""
    n = F.char_length("form")
    return tokenize_keep(docs, by).groupBy(*by).agg(F.count("*").alias("n_words"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), (100.0 * F.count_if(n >= tx.LONG) / F.count("*")).alias("long_share"))


def tokenize_keep(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*columns, F.explode(tx.words(F.col("text"))).alias("form"))


def progressive_readability(docs: DataFrame, chunk: int = 2, separator: str = r"\n\s*\n") -> DataFrame:
    """Cumulative lix and rix after every `chunk` paragraphs, with progress in percent and a flag on the last row."""
    p = split_paragraphs(docs, separator).withColumn("_w", tx.words(F.col("paragraph")))
    p = p.withColumns({"w": F.size("_w"), "s": F.greatest(F.size(tx.sentences(F.col("paragraph"))), F.lit(1)), "l": tx.long_words(F.col("_w"))})
    so_far = Window.partitionBy("doc_id").orderBy("par_id").rowsBetween(Window.unboundedPreceding, 0)
    p = p.select("doc_id", "par_id", *[F.sum(c).over(so_far).alias(c) for c in "wsl"], F.count("*").over(Window.partitionBy("doc_id")).alias("n"))
    last = F.col("par_id") + 1 == F.col("n")
    score = F.when(F.col("w") > 0, F.col("w") / F.col("s") + 100.0 * F.col("l") / F.col("w")).otherwise(F.lit(0.0))
    return p.where(last | ((F.col("par_id") + 1) % chunk == 0)).select("doc_id", "par_id", score.alias("lix"), (F.col("l") / F.col("s")).alias("rix"), (100.0 * (F.col("par_id") + 1) / F.col("n")).alias("progress"), last.alias("is_final"))


def grammar_statistics(tokens: DataFrame, complexity: DataFrame) -> DataFrame:
    """Of word tokens (doc_id, lower, kind): words, distinct, complex (lexicon complexity over 0.7, else length over 7), a 0-100
    score. complexity: (word, complexity)."""
    known = complexity.select(F.lower("word").alias("lower"), F.col("complexity").alias("_c"))
    t = tokens.where("kind = 'word'").join(known, "lower", "left")
    hard = F.when(F.col("_c").isNotNull(), F.col("_c") > 0.7).otherwise(F.char_length("lower") > 7)
    g = t.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_distinct("lower").alias("n_distinct"), F.count_if(hard).alias("n_complex"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 100.0 * F.col("n_complex") / F.col("n_words")))
    return g.withColumn("score", score)


def batch_summary(results: DataFrame, *by: str) -> DataFrame:
    """Rollup over `by`: documents, completed and failed (empty content), and those in the two hardest bands."""
    ok = F.col("status") == "ok"
    return results.rollup(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.count_if(F.col("lix_ord") >= 3).alias("difficult"))


def simpler_words(tokens: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Words with a simpler alternative and how often they occur; counted before the join."""
    counts = tokens.groupBy("lower").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(checked_small(alternatives)), counts.lower == F.col("word")).select("word", "alternative", "n")
