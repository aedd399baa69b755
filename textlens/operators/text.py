"""Texts to tokens, sentences, paragraphs and chunks; validation and normalisation (group B)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Words that end with a period without ending a sentence. Fixed values.
ABBREVIATIONS = ("f.eks.", "bl.a.", "osv.", "dvs.", "m.m.", "ca.", "nr.", "dr.", "mr.", "prof.", "jf.", "kl.")
#: Closed word classes of the rule tagger. Fixed values.
CLOSED = {
    "DET": ("en", "ei", "et", "den", "det", "de", "denne", "dette", "disse", "the", "a", "an", "this"),
    "PRON": ("jeg", "du", "han", "hun", "vi", "dere", "meg", "deg", "seg", "he", "she", "they", "it"),
    "PREP": ("i", "på", "til", "fra", "med", "av", "om", "for", "ved", "of", "in", "to", "with", "by"),
    "CONJ": ("og", "men", "eller", "for", "så", "and", "or", "but"),
    "SUBJ": ("at", "som", "fordi", "hvis", "når", "da", "mens", "that", "because", "if"),
}


def tokenize(docs: DataFrame, policy: str = "unicode", text: str = "text") -> DataFrame:
    """(doc_id, tok_id, form, lower) by one of the word patterns; no shuffle."""
    return docs.select("doc_id", F.posexplode(tx.words(F.col(text), policy)).alias("tok_id", "form")).withColumn("lower", F.lower("form"))


def tokenize_with_offsets(docs: DataFrame, policy: str = "unicode") -> DataFrame:
    """tokenize() with start and end (excluded) in characters, from the lengths of gaps and words, added up within the row."""
    pairs = rf"([\s\S]*?)({tx.WORD[policy]})"
    cut = docs.select("doc_id", *[F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pairs), F.lit(i)).alias(c) for i, c in ((1, "gap"), (2, "form"))])
    ends = tx.running_sum(F.zip_with("gap", "form", lambda g, f: F.char_length(g) + F.char_length(f)))
    rows = cut.select("doc_id", F.posexplode(F.arrays_zip(ends.alias("end"), F.col("form"))).alias("tok_id", "p"))
    end = F.col("p.end").cast("long")
    return rows.select("doc_id", "tok_id", F.col("p.form").alias("form"), (end - F.char_length("p.form")).alias("start"), end.alias("end"))


def tokenize_punct(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tok_id, form, lower, kind): words, numbers and single punctuation characters."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(tx.TOKEN), F.lit(0))
    kind = F.when(F.col("form").isin(*tx.PUNCT_CHARS), "punct").when(F.col("form").rlike("^[0-9]+$"), "number").otherwise("word")
    return docs.select("doc_id", F.posexplode(found).alias("tok_id", "form")).withColumns({"lower": F.lower("form"), "kind": kind})


def split_sentences(docs: DataFrame, policy: str = "ends") -> DataFrame:
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"), policy)).alias("sent_id", "sentence"))


def split_sentences_abbrev(docs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Sentences of blank-separated tokens; a token ends one if it ends with .!? and isn't a listed abbreviation (a small table)."""
    from ..functions.checks import checked_small

    tokens = docs.select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+", -1), lambda x: x != "")).alias("tok_id", "form"))
    known = F.broadcast(checked_small(abbreviations.select(F.lower("abbreviation").alias("lower")).distinct()).withColumn("abbr", F.lit(True)))
    w = Window.partitionBy("doc_id").orderBy("tok_id")
    ends = F.col("form").rlike("[.!?]$") & F.col("abbr").isNull()
    marked = tokens.withColumn("lower", F.lower("form")).join(known, "lower", "left").withColumn("ends", ends.cast("int"))
    sent = F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return (
        marked.withColumn("sent_id", sent).groupBy("doc_id", "sent_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", "form"))), lambda x: x["form"]), " ").alias("sentence"))
    )


def split_paragraphs(docs: DataFrame, separator: str = r"\n\s*\n") -> DataFrame:
    return docs.select("doc_id", F.posexplode(tx.paragraphs(F.col("text"), separator)).alias("par_id", "paragraph"))


def cut_points(text: str, size: int) -> list[int]:
    """Where the chunks of a text end: near `size`, at a paragraph, else a sentence, else a blank."""
    ends, at = [], 0
    while len(text) - at > size:
        cut = -1
        for mark in ("\n\n", ". ", " "):
            found = text.rfind(mark, at + size // 2, at + size)
            if found >= 0:
                cut = found + len(mark)
                break
        at = cut if cut > at else at + size
        ends.append(at)
    return [*ends, len(text)] if text else []


def chunk_documents(docs: DataFrame, size: int = 5000) -> DataFrame:
    """(doc_id, chunk_id, chunk); the chunks of a text in order are the text. Null and empty texts have none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, value in zip(batch["doc_id"], batch["text"], strict=True):
                at = 0
                for k, end in enumerate(cut_points(value or "", size)):
                    out.append((doc_id, k, value[at:end]))
                    at = end
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, chunk_id int, chunk string")


def _pos(punct: Column, number: Column, low: Column, before: Column) -> Column:
    """The tag of a token: punctuation, numbers, closed classes, VERB after `å`, then suffixes; NOUN otherwise."""
    ends = lambda *suffixes: reduce(lambda a, b: a | b, [low.endswith(x) for x in suffixes])
    pos = F.when(punct, "PUNCT").when(number, "NUM")
    for name, members in CLOSED.items():
        pos = pos.when(low.isin(*members), name)
    return (
        pos.when(before == "å", "VERB").when(ends("erer", "ere", "ed", "ing"), "VERB")
        .when(ends("ig", "sk", "able", "ible"), "ADJ").when(ends("vis", "ly"), "ADV").otherwise("NOUN")
    )


def tag_pos(tokens: DataFrame) -> DataFrame:
    """tokens with pos, see _pos()."""
    w = Window.partitionBy("doc_id").orderBy("tok_id")
    return tokens.withColumn("pos", _pos(F.col("kind") == "punct", F.col("kind") == "number", F.col("lower"), F.lag("lower").over(w)))


def tag_sentences(docs: DataFrame, text: str = "text", arrays: tuple[str, ...] = ("form", "lower", "pos")) -> DataFrame:
    """(doc_id, sent_id, first, and of form, lower, pos those in `arrays`): a row for each stretch of text up to one of .!? that has tokens, with arrays of its
    tokens as of tokenize_punct(), tagged as by tag_pos(); first: the tok_id of the first, sent_id: how many of .!? stand before.

    All is done within the row of the text, so nothing is sorted and no task holds more than a text. The stretches are exploded last:
    what is asked of the arrays later is then not put in place of them.
    """
    stretches = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^.!?]*[.!?]|[^.!?]+"), F.lit(0))
    x = docs.select("doc_id", F.transform(stretches, lambda s: F.regexp_extract_all(s, F.lit(tx.TOKEN), F.lit(0))).alias("form"))
    x = x.select("doc_id", "form", F.transform("form", lambda s: F.transform(s, F.lower)).alias("lower"))
    # no token but .!? ends a stretch, so the one before its first is none of `å`
    number = lambda low: low.between("0", "9\uffff") & low.rlike("^[0-9]+$")  # noqa: E731  (few are between: the pattern is dear)
    tags = lambda s: F.zip_with(s, shifted(s, -1), lambda low, before: _pos(low.isin(*tx.PUNCT_CHARS), number(low), low, before))
    x = x.withColumns({"pos": F.transform("lower", tags), "first": F.concat(F.array(F.lit(0)), tx.running_sum(F.transform("form", F.size)))})
    first = F.slice("first", F.lit(1), F.size("form"))
    rows = x.select("doc_id", F.posexplode(F.arrays_zip(first.alias("first"), *arrays)).alias("sent_id", "x"))
    return rows.where(F.size(f"x.{arrays[0]}") > 0).select("doc_id", "sent_id", *[F.col(f"x.{c}").alias(c) for c in ("first", *arrays)])


def shifted(a: Column | str, by: int) -> Column:
    """An array of texts moved by so many places: at each place what stands so much later (earlier, if negative), null beyond its ends."""
    if by >= 0:
        return F.slice(F.concat(a, F.array_repeat(F.lit(None).cast("string"), by)), F.lit(by + 1), F.size(a))
    return F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), -by), a), F.lit(1), F.size(a))


def explode_sentences(sentences: DataFrame) -> DataFrame:
    """tag_sentences() as tokens (doc_id, tok_id, form, lower, kind, pos, sent_id)."""
    x = sentences.select("doc_id", "sent_id", "first", F.posexplode(F.arrays_zip("form", "lower", "pos")).alias("_i", "x"))
    kind = F.when(F.col("x.pos") == "PUNCT", "punct").when(F.col("x.pos") == "NUM", "number").otherwise("word")
    return x.select("doc_id", (F.col("first") + F.col("_i")).alias("tok_id"), "x.form", "x.lower", kind.alias("kind"), "x.pos", "sent_id")


def normalize_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): entities decoded, quotes and dashes unified, control characters dropped, blanks collapsed."""
    t = F.coalesce("text", F.lit(""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.translate(t, "“”„«»‘’–—", "\"\"\"\"\"''--")
    t = F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"\s+", " ")
    return docs.select("doc_id", F.trim(t).alias("text"))


#: What spell checking leaves out. Fixed values.
SKIP = (r"^[0-9]+([.,][0-9]+)*$", r"^(https?://|www\.)", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"^[#@]")
SKIP_NO = (r"^[0-9]{4}$", r"^\+?[0-9]{8,}$")


def spell_skip_filter(tokens: DataFrame, lang: str = "en") -> DataFrame:
    rules = SKIP + (SKIP_NO if lang == "no" else ())
    return tokens.where(~F.greatest(*[F.col("form").rlike(p) for p in rules]))


def clean_domain(df: DataFrame, column: str, out: str = "domain") -> DataFrame:
    return df.withColumn(out, tx.clean_host(F.col(column)))


#: Validation patterns. Fixed values.
DOMAIN = r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE = r"^\+[1-9][0-9]{1,14}$"
URL = r"^https?://[^\s/?#]+\.[^\s/?#]+"


def validate(df: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """df with `failed`, the names of the rules (name: (column, pattern)) that a row breaks; null breaks all of its rules."""
    broken = [F.when(~F.coalesce(F.col(c).rlike(p), F.lit(False)), F.lit(name)) for name, (c, p) in rules.items()]
    return df.withColumn("failed", F.array_compact(F.array(*broken)))


def extract_keywords(docs: DataFrame) -> DataFrame:
    return tokenize_punct(docs).where((F.col("kind") == "word") & (F.char_length("lower") > 2)).select("doc_id", F.col("lower").alias("keyword")).distinct()


def tag_lexicon(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens with is_stopword and the sorted categories of each word."""
    known = lexicon.groupBy(F.lower("word").alias("lower")).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    return tokens.join(known, "lower", "left").select(*tokens.columns, F.col("categories").isNotNull().alias("is_stopword"), F.array_join(F.coalesce("categories", F.array().cast("array<string>")), ",").alias("categories"))
