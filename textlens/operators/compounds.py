"""Compounds: words cut into known parts over a lattice, and neighbours in a text that are one word (F6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Words that are no part of a compound, and pairs written apart after English. Fixed values.
FUNCTION_WORDS = ("og", "eller", "men", "for", "som", "med", "til", "på", "av", "den", "det", "de")
WRITTEN_APART = ("e post", "e mail", "web side", "new york", "los angeles")
MAX_PARTS = 4
#: Compounds up to this many are broadcast to the texts; more are joined by a shuffle of neighbours.
BROADCAST_COMPOUNDS = 200_000
#: Rows of 64 bits (some 12 MB to every task) that tell which neighbours may be one of many compounds: of three million, some 3 per
#: cent of other neighbours pass. A power of two.
FILTER_ROWS = 1 << 19


def segment(words: DataFrame, vocabulary: DataFrame, max_parts: int = MAX_PARTS, least: int = 2) -> DataFrame:
    """(word, parts): the best cut of each word into 2 to max_parts words of `vocabulary` (word, weight) of `least` letters or more:
    the greatest sum of weights, then the fewest parts, then the first as text with + between. Words that can't be cut give no row.

    The lattice of a word has an edge for each stretch that is a word. One step a part: of all ways to reach a place with so many
    parts only the best goes on, so a long word costs no more than places times edges. Nulls and repeated words give none, one row.
    """
    known = vocabulary.groupBy(F.col("word").alias("part")).agg(F.max("weight").alias("weight")).where(F.char_length("part") >= least)
    n = F.char_length("word")
    each = words.select("word").where(F.col("word").isNotNull() & (n >= 2 * least)).distinct()
    starts = each.withColumn("i", F.explode(F.sequence(F.lit(0), n - least)))
    cuts = starts.withColumn("j", F.explode(F.sequence(F.col("i") + least, n))).where((F.col("i") > 0) | (F.col("j") < n))
    cuts = cuts.withColumn("part", F.substring(F.col("word"), F.col("i") + 1, F.col("j") - F.col("i")))
    edges = possible(cuts, known, "part").join(known, "part")
    # the lattice of a word as one row, its edges by their ends: at most as many as it has stretches
    rows = edges.groupBy("word").agg(F.collect_list(F.struct("i", "j", F.col("weight").cast("long").alias("weight"), "part")).alias("edges"))
    rows = rows.select("word", F.transform(F.sequence(F.lit(least), n), lambda j: F.filter("edges", lambda e: e["j"] == j)).alias("ends"))

    def onward(ways: Column):
        """Of edges the best way (s, t) over one of them, after the best ways to the places where they start; null if there is none."""
        before = lambda e: F.get(ways, e["i"] - least)
        longer = lambda e: F.struct((before(e)["s"] - e["weight"]).alias("s"), F.concat(before(e)["t"], F.lit("+"), e["part"]).alias("t"))
        return lambda edges: F.array_min(F.transform(edges, lambda e: F.when(before(e).isNotNull(), longer(e))))

    first = lambda edges: F.array_min(F.transform(F.filter(edges, lambda e: e["i"] == 0), lambda e: F.struct((-e["weight"]).alias("s"), e["part"].alias("t"))))
    rows = rows.withColumn("w1", F.transform("ends", first))
    for k in range(2, max_parts):
        rows = rows.withColumn(f"w{k}", F.transform("ends", onward(F.col(f"w{k - 1}"))))
    rows = rows.withColumn(f"w{max_parts}", F.array(onward(F.col(f"w{max_parts - 1}"))(F.element_at("ends", -1))))
    whole = [F.element_at(f"w{k}", -1) for k in range(2, max_parts + 1)]
    ways = F.array_min(F.array(*[F.when(w.isNotNull(), F.struct(w["s"].alias("s"), F.lit(k).alias("k"), w["t"].alias("t"))) for k, w in enumerate(whole, 2)]))
    # exploded, as a filter would go down to the edges and take each step's text with it as often as it is named
    return rows.select("word", F.explode(F.array_compact(F.array(ways))).alias("best")).select("word", F.split("best.t", r"\+", -1).alias("parts"))


def compound_confidence(neighbours: Column, joined: Column, parts: Column, frequency: Column, noun: Column) -> Column:
    """0 to 1: by how many neighbours there are, how they match the parts, how often the compound occurs, its length and class."""
    k = F.size(neighbours)
    base = F.when(k == 2, F.lit(0.7)).otherwise(0.6 + 0.1 * F.least(F.size(parts), k))
    matches = F.size(F.filter(F.zip_with(neighbours, parts, lambda a, b: F.contains(a, b) | F.contains(b, a)), lambda x: x))
    value = base + F.when(F.size(parts) == k, 0.2 * matches / k).otherwise(0.0) + F.least(F.lit(0.2), frequency / 1000)
    value = value - F.when(F.char_length(joined) < 8, 0.1).otherwise(0.0) - F.when(F.array_join(neighbours, " ").isin(*WRITTEN_APART), 0.3).otherwise(0.0) + F.when(noun, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)  # sums of tenths in any order


def _bits(word: Column) -> tuple[Column, Column]:
    """The row of a word and its two bits there."""
    h = F.xxhash64(word)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return h.bitwiseAND(F.lit(FILTER_ROWS - 1)), bit(30).bitwiseOR(bit(45))  # never null, so that a join adds no test of them to what stands below


def possible(near: DataFrame, compounds: DataFrame, word: str = "word") -> DataFrame:
    """The rows of `near` (word, ...) whose word may be a compound: all that are, few others. Bits of the compounds go to every task,
    a table of bounded size."""
    row, bits = _bits(F.col(word))
    held = compounds.select(row.alias("_row"), bits.alias("_bits")).groupBy("_row").agg(F.bit_or("_bits").alias("_held"))
    x = near.withColumns({"_row": row, "_bits": bits}).join(F.broadcast(held), "_row")
    return x.where(F.col("_held").bitwiseAND(F.col("_bits")) == F.col("_bits")).drop("_row", "_bits", "_held")


def split_compound_issues(docs: DataFrame, compounds: DataFrame, max_parts: int = MAX_PARTS, threshold: float = 0.7) -> DataFrame:
    """(doc_id, start, end, issue, suggestion, n_parts, confidence): 2 to max_parts neighbouring words that together are a compound.
    compounds: (word, parts, frequency, noun), words in lower case, parts as of segment().

    Neighbours are put together within the row; only they, not the tokens, meet the compounds, by an equi-join; of many compounds
    (over BROADCAST_COMPOUNDS) only neighbours that may be one are shuffled. Words of one letter
    and function words are no parts. Null and empty texts have no issues, repeated rows have theirs each time.
    """
    word = tx.WORD["unicode"]
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.split(text, word, -1).alias("gap"), F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("form"))
    cut = cut.withColumn("end", tx.running_sum(F.zip_with(F.slice("gap", F.lit(1), F.size("form")), "form", lambda g, f: F.char_length(g) + F.char_length(f))))
    content = lambda w: (F.char_length(w) >= 2) & ~F.lower(w).isin(*FUNCTION_WORDS)
    cut = cut.select("doc_id", "end", F.zip_with("end", "form", lambda e, f: e - F.char_length(f)).alias("start"), F.transform("form", lambda w: F.when(content(w), w)).alias("s1"))
    # s2, s3 ...: so many words from each place on, with blanks between; null unless all may be parts
    later = lambda c, k: F.slice(c, k, F.size(c))
    for k in range(2, max_parts + 1):
        cut = cut.withColumn(f"s{k}", F.zip_with(f"s{k - 1}", later(F.col("s1"), k), lambda a, b: F.concat(a, F.lit(" "), b)))
    ks = range(2, max_parts + 1)
    # only what a row needs is exploded, not the text's arrays with it
    places = cut.select("doc_id", F.explode(F.arrays_zip("start", *[later(F.col("end"), k).alias(f"e{k}") for k in ks], *[f"s{k}" for k in ks])).alias("x")).where("x.s2 is not null")
    near = places.select("doc_id", "x.start", F.explode(F.array(*[F.struct(F.col(f"x.e{k}").alias("end"), F.col(f"x.s{k}").alias("issue")) for k in ks])).alias("y")).select("doc_id", "start", "y.end", "y.issue").where("issue is not null")
    near = near.withColumn("word", F.lower(F.replace("issue", F.lit(" "), F.lit(""))))
    few = compounds.limit(BROADCAST_COMPOUNDS + 1).count() <= BROADCAST_COMPOUNDS
    hit = near.join(F.broadcast(compounds), "word") if few else possible(near, compounds).join(compounds, "word")
    low = F.transform(F.split("issue", " ", -1), F.lower)
    scored = hit.withColumn("confidence", compound_confidence(low, F.col("word"), F.col("parts"), F.col("frequency"), F.col("noun")))
    return scored.where(F.col("confidence") >= threshold).select("doc_id", "start", "end", "issue", F.col("word").alias("suggestion"), F.size(F.split("issue", " ", -1)).alias("n_parts"), "confidence")
