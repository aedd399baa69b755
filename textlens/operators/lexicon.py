"""Lexicon and morphology joins, vocabulary operators (groups D and E)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import MAX_THETA_ROWS, checked_small
from ..functions.substrings import containing
from .text import shifted

#: Longest word for which deletion keys are made (their number grows with the square of the length).
MAX_FUZZY_LENGTH = 30
#: Terms up to this many have their deletion keys broadcast (at most some 500 a term, of some 60 bytes).
BROADCAST_NEAR = 2_000


def build_word_forms(lemma: DataFrame, lemma_paradigm: DataFrame, paradigm: DataFrame, paradigm_inflection: DataFrame, inflections: DataFrame, compounds: DataFrame) -> DataFrame:
    """(form, lemma, word_class, tag): every lemma with the endings of its paradigms (`~` stands for the lemma), and compounds."""
    f = (
        lemma.select("lemma_id", F.col("grunnform").alias("lemma")).join(lemma_paradigm, "lemma_id").join(F.broadcast(checked_small(paradigm.select("paradigm_id", F.col("ordklasse").alias("word_class")))), "paradigm_id")
        .join(F.broadcast(checked_small(paradigm_inflection)), "paradigm_id").join(F.broadcast(checked_small(inflections.select("boy_nummer", "boy_tekst", F.col("ordbok_tekst").alias("tag")))), "boy_nummer")
    )
    form = F.when(F.col("boy_tekst").contains("~"), F.replace("boy_tekst", F.lit("~"), F.col("lemma"))).otherwise(F.concat("lemma", "boy_tekst"))
    forms = f.select(F.lower(form).alias("form"), "lemma", "word_class", "tag")
    return forms.union(compounds.select(F.lower("word"), "word", F.lit("compound"), F.lit(""))).distinct()


def lookup(words: DataFrame, forms: DataFrame) -> DataFrame:
    """words (word) with their lemmas and classes; a word that is no form is tried without its last letter; absent: null."""
    known = forms.groupBy("form").agg(F.array_join(F.array_sort(F.collect_set("lemma")), ",").alias("lemmas"), F.array_join(F.array_sort(F.collect_set("word_class")), ",").alias("classes"))
    base = known.select(F.col("form").alias("_base"), F.col("lemmas").alias("_l"), F.col("classes").alias("_c"))
    w = words.withColumn("form", F.lower("word")).join(known, "form", "left")
    return w.join(base, F.expr("substr(form, 1, length(form) - 1)") == F.col("_base"), "left").select("word", F.coalesce("lemmas", "_l").alias("lemmas"), F.coalesce("classes", "_c").alias("classes"))


def existing(words: DataFrame, forms: DataFrame) -> DataFrame:
    return words.join(forms.select(F.col("form").alias("_f")).distinct(), F.lower("word") == F.col("_f"), "left_semi")


def missing(words: DataFrame, forms: DataFrame) -> DataFrame:
    return words.join(forms.select(F.col("form").alias("_f")).distinct(), F.lower("word") == F.col("_f"), "left_anti")


def parse_tags(forms: DataFrame) -> DataFrame:
    """forms with number, definiteness, gender, tense and degree read from the blank-separated tag."""
    parts = F.split(F.coalesce("tag", F.lit("")), " ", -1)

    def read(pairs: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for mark, value in reversed(pairs.items()):
            out = F.when(F.array_contains(parts, mark), value).otherwise(out)
        return out

    return forms.withColumns({
        "number": read({"ent": "sing", "fl": "plur"}), "definiteness": read({"be": "def", "ub": "indef"}), "gender": read({"mask": "masc", "fem": "fem", "noyt": "neut"}),
        "tense": read({"pres": "present", "pret": "past", "inf": "infinitive", "perf-part": "perfect", "imp": "imperative"}), "degree": read({"pos": "positive", "komp": "comparative", "sup": "superlative"}),
    })


def noun_gender(words: DataFrame, forms: DataFrame) -> DataFrame:
    g = parse_tags(forms.where("word_class = 'NOUN'")).where("gender is not null").groupBy("form").agg(F.min("gender").alias("gender"))
    return words.join(g, F.lower("word") == F.col("form"), "left").select("word", "gender")


def compound_parts(words: DataFrame, compounds: DataFrame) -> DataFrame:
    c = compounds.select(F.lower("word").alias("_w"), "components")
    return words.join(c, F.lower("word") == F.col("_w")).select("word", F.posexplode(F.split("components", r"\+", -1)).alias("n", "part"))


def inverted_index(forms: DataFrame, compounds: DataFrame) -> DataFrame:
    """(kind, key, start, n, words): classes to words, lemmas to forms, components to compounds. A key's words are listed by their
    first three letters, so that the list of a common key isn't one row."""
    c = compounds.select(F.lit("component").alias("kind"), F.explode(F.split("components", r"\+", -1)).alias("key"), F.col("word"))
    rows = forms.select(F.lit("class").alias("kind"), F.col("word_class").alias("key"), F.col("form").alias("word")).union(forms.select(F.lit("lemma"), "lemma", "form")).union(c)
    return rows.distinct().groupBy("kind", "key", F.substring("word", 1, 3).alias("start")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("word")), ",").alias("words"))


def word_complexity(forms: DataFrame, compounds: DataFrame) -> DataFrame:
    """(word, complexity) from 0 to 1 by length, compound parts, ambiguity and a verb reading."""
    g = forms.groupBy("form").agg(F.count_distinct("word_class").alias("k"), F.max((F.col("word_class") == "VERB").cast("int")).alias("v"))
    parts = compounds.select(F.lower("word").alias("form"), F.size(F.split("components", r"\+", -1)).alias("p")).groupBy("form").agg(F.max("p").alias("p"))
    value = F.least(F.char_length("form") / 20.0, F.lit(0.5)) + F.when(F.coalesce("p", F.lit(1)) > 1, 0.2).otherwise(0.0) + F.when(F.col("k") > 1, 0.1).otherwise(0.0) + F.when(F.col("v") == 1, 0.1).otherwise(0.0)
    return g.join(parts, "form", "left").select(F.col("form").alias("word"), F.least(F.lit(1.0), value).alias("complexity"))


def derivations(words: DataFrame, forms: DataFrame, affixes: DataFrame) -> DataFrame:
    """(word, affix, derived): prefixed and suffixed words that are forms. affixes: (kind, affix), a small table."""
    made = words.crossJoin(F.broadcast(checked_small(affixes))).withColumn("derived", F.when(F.col("kind") == "prefix", F.concat("affix", "word")).otherwise(F.concat("word", "affix")))
    return made.join(forms.select(F.col("form").alias("derived")).distinct(), "derived", "left_semi").select("word", "affix", "derived")


def word_frequencies(tokens: DataFrame, least: int = 2) -> DataFrame:
    return tokens.where(F.char_length("lower") >= least).groupBy(F.col("lower").alias("word")).agg(F.count("*").alias("n"))


def top_words(frequencies: DataFrame, k: int = 100) -> DataFrame:
    return frequencies.orderBy(F.desc("n"), "word").limit(k)


def frequency_from_feedback(frequencies: DataFrame, feedback: DataFrame) -> DataFrame:
    """An accepted suggestion counts 2, a modification 3. feedback: (word, action)."""
    more = feedback.select("word", F.when(F.col("action") == "accepted", 2).when(F.col("action") == "modified", 3).otherwise(0).cast("long").alias("n"))
    return frequencies.select("word", "n").union(more).groupBy("word").agg(F.sum("n").alias("n"))


def synonyms(words: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select(F.lower("word").alias("_w"), F.replace("synonym", F.lit("�"), F.lit("")).alias("synonym")).distinct()
    return words.join(e, F.lower("word") == F.col("_w")).where("synonym <> ''").select("word", "synonym").distinct()


def category_mates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    a, b = lexicon.select("category", F.col("word").alias("_w")), lexicon.select("category", F.col("word").alias("mate"))
    return words.join(a, F.lower("word") == F.col("_w")).join(b, "category").where("mate <> _w").select("word", "mate").distinct()


def fuzzy_candidates(words: DataFrame, vocab: DataFrame, distance: int = 2, prefix: int = 3, k: int = 5) -> DataFrame:
    """(word, candidate, distance): a known word itself, else the k nearest of those with the same first letters. Two such words
    share, behind these, a string that is left when at most `distance` letters of each are deleted; only words that are longer
    than MAX_FUZZY_LENGTH there meet by the first letters alone."""
    v = vocab.select(F.col("word").alias("candidate")).distinct()
    same = words.join(v, F.col("word") == F.col("candidate")).select("word", "candidate", F.lit(0).alias("distance"))
    unknown = words.join(v, F.col("word") == F.col("candidate"), "left_anti").distinct()

    def cut(df: DataFrame, c: str) -> DataFrame:
        return df.select(c, F.substring(c, 1, prefix).alias("_p"), F.expr(f"substr({c}, {prefix + 1})").alias("_rest"))

    a, b = cut(unknown, "word"), cut(v, "candidate")
    size = F.char_length("_rest")
    keyed = lambda df, c, most: df.where(size <= most).select(c, "_p", F.explode(_deletions(F.col("_rest"), distance)).alias("_k"))
    pairs = keyed(a, "word", MAX_FUZZY_LENGTH).join(keyed(b, "candidate", MAX_FUZZY_LENGTH + distance), ["_p", "_k"]).select("word", "candidate")
    long_ones = a.where(size > MAX_FUZZY_LENGTH).join(b.where(size > MAX_FUZZY_LENGTH - distance).drop("_rest"), "_p").select("word", "candidate")
    near = pairs.union(long_ones).distinct().withColumn("distance", F.expr(f"levenshtein(word, candidate, {distance})")).where("distance >= 0")
    w = Window.partitionBy("word").orderBy("distance", "candidate")
    return same.union(near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("word", "candidate", "distance"))


def _deletions(word: Column, distance: int) -> Column:
    once = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
    keys = F.array(word)
    level = F.array(word)
    for _ in range(distance):
        level = F.flatten(F.transform(F.filter(level, lambda w: F.char_length(w) > 0), once))
        keys = F.concat(keys, level)
    return F.array_distinct(keys)


def near_terms(words: DataFrame, terms: DataFrame, distance: int = 2) -> DataFrame:
    """(word, term, distance) within an edit distance, no common prefix needed: two such words share a string that is left when
    at most `distance` letters of each are deleted. Words over MAX_FUZZY_LENGTH letters meet by their halves instead: of two
    of equal edit distance up to 2, cut into 3 parts, one part stands in the other, so long ones join on all thirds."""
    short = lambda df, c: df.select(F.col(c)).distinct().where(F.char_length(c) <= MAX_FUZZY_LENGTH + distance)
    a = short(words, "word").select("word", F.explode(_deletions(F.col("word"), distance)).alias("_k"))
    b = short(terms, "term").select("term", F.explode(_deletions(F.col("term"), distance)).alias("_k"))
    # keys of few terms go to every task, so that those of the words, some hundred each, are neither shuffled nor sorted
    few = terms.limit(BROADCAST_NEAR + 1).count() <= BROADCAST_NEAR
    pairs = a.join(F.broadcast(b) if few else b, "_k").select("word", "term").distinct()
    long_w = words.select("word").distinct().where(F.char_length("word") > MAX_FUZZY_LENGTH)
    long_t = terms.select("term").distinct().where(F.char_length("term") > MAX_FUZZY_LENGTH)
    n = distance + 1
    piece = F.floor(F.char_length("word") / n).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.substring(F.col("word"), i * piece + 1, piece).alias("s"), piece.alias("m")))
    wp = long_w.select("word", F.explode(cuts).alias("x")).select("word", "x.s", "x.m")
    sizes = F.sequence(F.floor((F.char_length("term") - distance) / n).cast("int"), F.floor((F.char_length("term") + distance) / n).cast("int"))
    tp = long_t.select("term", F.explode(sizes).alias("m")).select("term", "m", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("term") - F.col("m") + 1), lambda i: F.substring(F.col("term"), i, F.col("m")))).alias("s"))
    pairs = pairs.union(wp.join(tp, ["m", "s"]).select("word", "term")).distinct()
    return pairs.withColumn("distance", F.expr(f"levenshtein(word, term, {distance})")).where("distance >= 0")


def letter_variants(words: DataFrame, dictionary: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, variant): one letter swapped by a pair (either way), if that is a word."""
    both = F.broadcast(checked_small(pairs.select("a", "b").union(pairs.select("b", "a"))))
    letters = words.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("i")).withColumn("a", F.substring("word", F.col("i"), F.lit(1)))
    made = letters.join(both, "a").select("word", F.concat(F.substring("word", F.lit(1), F.col("i") - 1), F.col("b"), F.substring("word", F.col("i") + 1, F.char_length("word"))).alias("variant"))
    return made.join(dictionary.select(F.col("word").alias("variant")).distinct(), "variant", "left_semi").select("word", "variant").distinct()


def spelling_variants(words: DataFrame, pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("_w"), F.col("b").alias("variant")).union(pairs.select("b", "a"))
    return words.join(both, F.lower("word") == F.col("_w")).select("word", "variant").distinct()


def merge_vocabularies(sources: DataFrame, enabled: list[str]) -> DataFrame:
    return sources.where(F.col("dialect").isin(*enabled)).select(F.lower("word").alias("word")).distinct()


def hyphenate_vocabulary(words: DataFrame, patterns: DataFrame, exceptions: DataFrame, left_min: int = 2, right_min: int = 2) -> DataFrame:
    """(word, hyphenated) of distinct words: all substrings of `.word.` meet the patterns (pattern, pos, level: the level stands
    before the pattern's letter pos); a break is where the highest level is odd. Exceptions: (word, hyphenated)."""
    v = words.select(F.lower("word").alias("word")).distinct()
    dotted = F.concat(F.lit("."), F.col("word"), F.lit("."))
    n = F.char_length("word") + 2
    at = F.explode(F.sequence(F.lit(1), n))
    spans = v.select("word", dotted.alias("d"), n.alias("n"), at.alias("i")).select("word", "d", "i", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("i") + 1, F.lit(8)))).alias("k")).select("word", "i", F.substring("d", F.col("i"), F.col("k")).alias("pattern"))
    levels = spans.join(F.broadcast(checked_small(patterns)), "pattern").groupBy("word", (F.col("i") + F.col("pos") - 2).alias("gap")).agg(F.max("level").alias("level"))
    breaks = levels.where((F.col("level") % 2 == 1) & (F.col("gap") >= left_min) & (F.col("gap") <= F.char_length("word") - right_min)).groupBy("word").agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
    cut = F.aggregate("gaps", F.struct(F.lit("").alias("s"), F.lit(0).alias("p")), lambda a, g: F.struct(F.concat(a["s"], F.substring(F.col("word"), a["p"] + 1, g - a["p"]), F.lit("-")).alias("s"), g.cast("int").alias("p")), lambda a: F.concat(a["s"], F.substring(F.col("word"), a["p"] + 1, F.char_length("word"))))
    e = exceptions.select(F.col("word").alias("_w"), F.col("hyphenated").alias("_h"))
    return v.join(breaks, "word", "left").join(e, F.col("word") == F.col("_w"), "left").select("word", F.coalesce("_h", F.when(F.col("gaps").isNotNull(), cut), "word").alias("hyphenated"))


def valid_hyphen_parts(hyphenated: DataFrame, dictionary: DataFrame, special: DataFrame) -> DataFrame:
    p = hyphenated.select("word", F.explode(F.split("hyphenated", "-", -1)).alias("part")).where(F.char_length("part") > 1)
    p = p.join(dictionary.select(F.col("word").alias("part")).distinct(), "part", "left_semi")
    return p.join(special.select(F.col("word").alias("part")).distinct(), "part", "left_anti").select("word", "part").distinct()


def pos_ngrams(sentences: DataFrame) -> DataFrame:
    """(ngram, n) of tag pairs and triples within sentences (pos: their tags): tags with the next two are counted, then put together."""
    t = sentences.select(F.explode(F.arrays_zip("pos", shifted("pos", 1).alias("p1"), shifted("pos", 2).alias("p2"))).alias("x")).select("x.*").where("p1 is not null")
    grams = F.array_compact(F.array(F.concat_ws("_", "pos", "p1"), F.when(F.col("p2").isNotNull(), F.concat_ws("_", "pos", "p1", "p2"))))
    return t.groupBy("pos", "p1", "p2").agg(F.count("*").alias("k")).select(F.explode(grams).alias("ngram"), "k").groupBy("ngram").agg(F.sum("k").alias("n"))


def _triples(pos: str) -> Column:
    """The runs of three tags of a sentence, joined by _."""
    join = lambda a, b: F.concat(a, F.lit("_"), b)
    later = lambda i: F.slice(pos, i + 1, F.size(pos))
    return F.slice(F.zip_with(F.zip_with(pos, later(1), join), later(2), join), F.lit(1), F.greatest(F.size(pos) - 2, F.lit(0)))


def score_pos_sequence(sentences: DataFrame, ngrams: DataFrame, least: float = 0.5) -> DataFrame:
    """sentences (doc_id, sent_id, pos: their tags) of three tokens and more with n, known, share, unusual: the share of a sentence's tag
    triples that the treebank has. Of up to MAX_THETA_ROWS n-grams every task holds the set, so sentences stay where they are; of more,
    the triples are joined."""
    s = sentences.where(F.size("pos") > 2)
    some = [r["ngram"] for r in ngrams.select("ngram").distinct().limit(MAX_THETA_ROWS + 1).collect()]
    if len(some) <= MAX_THETA_ROWS:
        known = F.size(F.filter(_triples("pos"), lambda g: g.isin(*some))).cast("long")
        s = s.withColumns({"n": (F.size("pos") - 2).cast("long"), "known": known})
    else:
        t = s.select("doc_id", "sent_id", F.explode(_triples("pos")).alias("ngram")).join(ngrams.select("ngram").distinct().withColumn("k", F.lit(1)), "ngram", "left")
        s = s.join(t.groupBy("doc_id", "sent_id").agg(F.count("*").alias("n"), F.count("k").alias("known")), ["doc_id", "sent_id"])
    return s.withColumns({"share": F.col("known") / F.col("n"), "unusual": F.col("known") / F.col("n") < least})


def word_relations(words: DataFrame | None, dependencies: DataFrame) -> DataFrame:
    """(word, gov, rel, sent_id) of the dependencies (sent_id, dep, gov, rel) of each word. words None: the distinct lower-cased `dep`
    themselves; as each dependency then meets just its own, they need no join."""
    d = dependencies.select("sent_id", F.col("dep").alias("_d"), "gov", "rel")
    if words is None:
        return d.select(F.lower("_d").alias("word"), "gov", "rel", "sent_id")
    return words.join(d, F.lower("word") == F.lower("_d")).select("word", "gov", "rel", "sent_id")


def examples(words: DataFrame, sentences: DataFrame, k: int = 5) -> DataFrame:
    """The first k sentences (by id) that contain each word, whatever the case; see containing() for many words."""
    w = Window.partitionBy("word").orderBy("item_id")
    hits = containing(sentences.select("item_id", F.lower("text").alias("_text")), "_text", words.select("word", F.lower("word").alias("_lower")), "_lower")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("word", "item_id", "rank")


def upsert_lexicon(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries by (word, form): the last change (by ts) wins over the current one. changes: (ts, word, form, tag)."""
    last = changes.groupBy("word", "form").agg(F.max_by("tag", "ts").alias("_tag"))
    return current.join(last, ["word", "form"], "full").select("word", "form", F.coalesce("_tag", "tag").alias("tag"))


def parse_flat_entries(lines: DataFrame) -> DataFrame:
    """`word<TAB>description` lines to key, genders and classes named in the description."""
    parts = F.split("line", "\t", -1)
    key = F.regexp_replace(F.lower(parts[0]), r"[.,;:!?]+$", "")
    names = ("mask", "fem", "nøyt", "subst", "verb", "adj", "adv")
    found = F.array_join(F.filter(F.array(*map(F.lit, names)), lambda x: F.array_contains(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), " ", -1), x)), ",")
    return lines.select(key.alias("word"), found.alias("attributes")).where("word <> ''")


def check_words(words: DataFrame, dictionary: DataFrame, custom: DataFrame, special: DataFrame, accepted: DataFrame) -> DataFrame:
    """(word, correct, source): special or custom words first, then user-accepted, then the dictionary; one join a source."""

    def known(df: DataFrame, flag: str) -> DataFrame:
        return df.select(F.lower("word").alias("_l")).distinct().withColumn(flag, F.lit(True))

    w = words.select("word", F.lower("word").alias("_l"))
    for df, flag in ((special, "special"), (custom, "custom"), (accepted, "feedback"), (dictionary, "dictionary")):
        w = w.join(known(df, flag), "_l", "left")
    source = F.when(F.col("special"), "special").when(F.col("custom"), "custom").when(F.col("feedback"), "feedback").when(F.col("dictionary"), "dictionary")
    return w.select("word", source.isNotNull().alias("correct"), F.coalesce(source, F.lit("none")).alias("source"))


def suggest(words: DataFrame, candidates: list[DataFrame], k: int = 10) -> DataFrame:
    """(word, candidate, distance, rank): distinct candidates of all sources, nearest first, ties by text."""
    c = reduce(DataFrame.union, [df.select("word", "candidate") for df in candidates]).join(words.select("word").distinct(), "word", "left_semi").where("word <> candidate").distinct()
    c = c.withColumn("distance", F.levenshtein("word", "candidate"))
    w = Window.partitionBy("word").orderBy("distance", "candidate")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def check_text(tokens: DataFrame, checked: DataFrame) -> DataFrame:
    """Per document: words, misspelled ones and their rate. checked: check_words() over the distinct vocabulary."""
    wrong = checked.where("not correct").select(F.col("word").alias("lower"), F.lit(1).alias("_e"))
    g = tokens.join(wrong, "lower", "left").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count("_e").alias("n_errors"))
    return g.withColumn("error_rate", F.col("n_errors") / F.col("n_words"))


def suggestion_sources(words: DataFrame, forms: DataFrame, compounds: DataFrame, lexicon: DataFrame, dictionary: DataFrame, swaps: DataFrame, spellings: DataFrame, hyphenated: DataFrame) -> list[DataFrame]:
    """The candidates (word, candidate) of each source for suggest(): lemmas of the word or of it without its last letter, parts of a
    compound, words of the same category, near words of the dictionary, words with one letter swapped, other spellings, and parts
    between hyphens that are words."""
    named = lambda df, c: df.select("word", F.col(c).alias("candidate"))
    bases = lookup(words, forms).where("lemmas is not null").select("word", F.explode(F.split("lemmas", ",", -1)).alias("candidate"))
    parts = valid_hyphen_parts(hyphenated, dictionary, dictionary.limit(0))
    return [
        bases, named(compound_parts(words, compounds), "part"), named(category_mates(words, lexicon), "mate"), named(fuzzy_candidates(words, dictionary), "candidate"),
        named(letter_variants(words, dictionary, swaps), "variant"), named(spelling_variants(words, spellings), "variant"), named(parts, "part"),
    ]


def misspelled_tokens(docs: DataFrame, checked: DataFrame, suggested: DataFrame, lang: str = "en") -> DataFrame:
    """(doc_id, tok_id, form, start, end, suggestions): every misspelled word of a text with its place and its suggestions, nearest
    first, null for none. Numbers, addresses and the like are skipped. checked: check_words() of the lower-cased vocabulary;
    suggested: suggest() for its misspelled words. Words are looked up once each and hang on their tokens by equi-joins."""
    from .text import spell_skip_filter, tokenize_with_offsets

    listed = suggested.groupBy(F.col("word").alias("lower")).agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("_c")).select("lower", F.array_join(F.col("_c.candidate"), ",").alias("suggestions"))
    wrong = checked.where("not correct").select(F.col("word").alias("lower")).distinct().join(listed, "lower", "left")
    t = spell_skip_filter(tokenize_with_offsets(docs), lang).withColumn("lower", F.lower("form"))
    return t.join(wrong, "lower").select("doc_id", "tok_id", "form", "start", "end", "suggestions")


def retry_without_apostrophe(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    d = dictionary.select(F.lower("word").alias("_d")).distinct()
    first = words.join(d, F.lower("word") == F.col("_d"), "left_semi").select("word", F.col("word").alias("accepted_as"))
    rest = words.join(d, F.lower("word") == F.col("_d"), "left_anti").where(F.col("word").contains("'"))
    bare = F.replace("word", F.lit("'"), F.lit(""))
    return first.union(rest.join(d, F.lower(bare) == F.col("_d"), "left_semi").select("word", bare))


def custom_suggestions(words: DataFrame, custom: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("word").orderBy("distance", "term")
    return near_terms(words, custom.select(F.col("word").alias("term"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dialect_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, known_in): both, first or second, by a full outer join of two dictionaries."""
    x, y = a.select(F.col("word").alias("x")).distinct(), b.select(F.col("word").alias("y")).distinct()
    known = F.when(F.col("x").isNull(), "second").when(F.col("y").isNull(), "first").otherwise("both")
    return x.join(y, F.col("x") == F.col("y"), "full").select(F.coalesce("x", "y").alias("word"), known.alias("known_in"))
