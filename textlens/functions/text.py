"""Column expressions over text, in the common subset of Java and RE2 patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word patterns by policy. Fixed values.
WORD = {
    "unicode": r"[\p{L}\p{M}\p{N}_]+",
    "nordic": r"[a-zA-ZæøåÆØÅ0-9]+",
    "spell": r"""[^\s,.;!?"'()]+""",
}
PUNCT = r"""[.,;:!?"'()\[\]{}«»]"""
PUNCT_CHARS = tuple(""".,;:!?"'()[]{}«»""")
TOKEN = r"""[.,;:!?"'()\[\]{}«»]|[^\s.,;:!?"'()\[\]{}«»]+"""
#: Word lengths: from LONG on a word is long, from VERY_LONG on very long; DOC_VERY_LONG is the document-level limit.
LONG, VERY_LONG, DOC_VERY_LONG = 7, 10, 11


def words(text: Column, policy: str = "unicode") -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD[policy]), F.lit(0))


def _not_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sentences(text: Column, policy: str = "ends") -> Column:
    """Non-blank sentences, stripped. ends: cut at runs of .!? (with a closing quote) and at blank lines; after: cut at white
    space after .!?; runs: cut at runs of .!?; scan: each run of other characters with what ends it."""
    t = F.coalesce(text, F.lit(""))
    if policy == "ends":
        return _not_blank(F.split(t, r'[.!?]+["»]?|\n\n', -1))
    if policy == "after":
        return _not_blank(F.split(F.regexp_replace(t, r"([.!?])\s+", "$1\u0001"), "\u0001", -1))
    if policy == "runs":
        return _not_blank(F.split(t, r"[.!?]+", -1))
    if policy == "scan":
        return _not_blank(F.regexp_extract_all(t, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)))
    raise ValueError(policy)


def paragraphs(text: Column, separator: str = r"\n\s*\n") -> Column:
    return _not_blank(F.split(strip(F.coalesce(text, F.lit(""))), separator, -1))


def long_words(ws: Column, least: int = LONG) -> Column:
    return F.size(F.filter(ws, lambda w: F.char_length(w) >= least))


def syllables(word: Column, lang: str = "no") -> Column:
    """Vowel groups of a word, one at least; in English a final e doesn't count."""
    w = F.lower(word)
    if lang == "en":
        return F.greatest(F.regexp_count(F.regexp_replace(w, "e$", ""), F.lit("[aeiouy]+")), F.lit(1))
    return F.greatest(F.regexp_count(w, F.lit("[aeiouyæøå]+")), F.lit(1))


def clean_host(url: Column) -> Column:
    """Lower-case host of a domain or url: without scheme, `www.`, path and port."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[/?#:].*$", ""), r"^www\.", "")


def running_sum(sizes: Column) -> Column:
    """Sums of an array up to each place, by doubling the stretch that is added at each step: n log n."""

    def step(sums: Column, j: Column) -> Column:
        by = F.pow(F.lit(2), j).cast("int")
        shifted = F.concat(F.array_repeat(F.lit(0), F.least(by, F.size(sums))), F.slice(sums, F.lit(1), F.greatest(F.size(sums) - by, F.lit(0))))
        return F.when(by < F.size(sums), F.zip_with(sums, shifted, lambda a, b: a + b)).otherwise(sums)

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), sizes, step)
