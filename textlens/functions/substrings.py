"""Which of many terms a text contains, without trying each on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import COMMON, SIZE

#: Terms up to this many (some 20 MB) are broadcast by their string of three; more are joined by a shuffle.
BROADCAST_TERMS = 200_000


def grams(text: Column) -> Column:
    """The distinct strings of three characters without white space of a text, one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=(\S{{{SIZE}}}))"), F.lit(1)))


def rarest_gram(term: Column) -> Column:
    """Of a term's strings of three the one of the rarest letters; null if it has none."""
    letter = lambda g, i: F.call_function("instr", F.lit(COMMON), F.substring(g, i, 1))
    weight = lambda g: sum((F.when(letter(g, i) == 0, len(COMMON) + 1).otherwise(letter(g, i)) for i in range(1, SIZE + 1)), F.lit(0))
    return F.array_max(F.transform(grams(term), lambda g: F.struct(weight(g).alias("w"), g.alias("g"))))["g"]


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """texts with the columns of each term that `text` contains, as they stand (fold case before). Columns must not clash.

    A text is cut into its strings of three characters; an equi-join with the rarest such string of each term hands it the terms
    that it may contain, which are then looked for. Terms that have no such string, being shorter or cut by white space, are tried on
    every text. Null texts contain nothing, the empty term is in every other one; repeated texts and terms give repeated rows.
    """
    keyed = terms.withColumn("_gram", F.coalesce(rarest_gram(F.col(term)), F.lit("")))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    cut = texts.where(F.col(text).isNotNull()).withColumn("_gram", F.explode(F.array_append(grams(F.col(text)), F.lit(""))))
    return cut.join(F.broadcast(keyed) if few else keyed, "_gram").where(F.contains(text, F.col(term))).drop("_gram")
