"""Cuts of words over a lattice, and neighbours that are one word, against plain Python."""

import itertools
import random
import re

from textlens.operators import compounds


def best(word, weights, most=4, least=2):
    ways = []
    for k in range(2, most + 1):
        for cut in itertools.combinations(range(1, len(word)), k - 1):
            parts = [word[a:b] for a, b in zip((0, *cut), (*cut, len(word)), strict=True)]
            if all(p in weights and len(p) >= least for p in parts):
                ways.append((-sum(weights[p] for p in parts), k, "+".join(parts)))
    return min(ways)[2].split("+") if ways else None


def test_cuts_against_all_ways(spark):
    rng = random.Random(8)
    weights = {"".join(rng.choice("abå") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 6) for _ in range(60)}
    words = ["".join(rng.choice("abå") for _ in range(rng.randrange(0, 13))) for _ in range(120)] + [None, "", "a"]
    got = compounds.segment(spark.createDataFrame([(w,) for w in words * 2], "word string"), spark.createDataFrame([*weights.items(), *list(weights.items())[:3]], "word string, weight long"))
    want = {w: b for w in words if w and (b := best(w, weights))}
    rows = got.collect()
    assert {r.word: r.parts for r in rows} == want and len(rows) == len(want) > 20


def test_golden_compounds(spark):
    docs = spark.createDataFrame([(1, "Han har en bok hylle og Stor bil hus."), (2, "sommer tid på skole hus"), (3, "e post"), (4, None), (5, ""), (6, "hylle"), (7, "bok og hylle")], "doc_id long, text string")
    known = spark.createDataFrame(
        [("bokhylle", ["bok", "hylle"], 100, True), ("storbilhus", ["stor", "bil", "hus"], 0, True), ("bilhus", ["bil", "hus"], 0, False), ("sommertid", ["som", "mer", "tid"], 0, False), ("skolehus", ["skole", "hus"], 900, True), ("epost", ["e", "post"], 0, True)],
        "word string, parts array<string>, frequency long, noun boolean")
    got = {(r.doc_id, r.start, r.end, r.issue, r.suggestion, r.n_parts, r.confidence) for r in compounds.split_compound_issues(docs, known).collect()}
    assert got == {
        (1, 11, 20, "bok hylle", "bokhylle", 2, 1.0), (1, 24, 36, "Stor bil hus", "storbilhus", 3, 1.0), (1, 29, 36, "bil hus", "bilhus", 2, 0.8),
        (2, 0, 10, "sommer tid", "sommertid", 2, 0.7), (2, 14, 23, "skole hus", "skolehus", 2, 1.0),
    }
    plan = compounds.split_compound_issues(docs, known)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan
    assert compounds.split_compound_issues(docs.limit(0), known).collect() == []


def test_only_possible_neighbours_are_shuffled(spark, monkeypatch):
    """Many compounds: the rows that are dealt by word are those of compounds and few others, and the issues are the same."""
    from pyspark.sql import functions as F

    from textlens.operators import compounds as cm

    known = spark.range(20_000).select(F.concat(F.lit("bil"), F.col("id").cast("string")).alias("word"), F.array(F.lit("bil"), F.col("id").cast("string")).alias("parts"), F.lit(5).cast("long").alias("frequency"), F.lit(True).alias("noun"))
    near = known.select("word").union(spark.range(50_000).select(F.concat(F.lit("hus"), F.col("id").cast("string"))))
    kept = cm.possible(near, known)
    assert kept.where("word like 'bil%'").count() == 20_000 and kept.where("word like 'hus%'").count() < 500
    docs = spark.createDataFrame([(1, "En bil 12345 og Bil 777 her."), (2, None), (3, "bil og 12"), (1, "bil 19999")], "doc_id long, text string")
    small = sorted(map(tuple, cm.split_compound_issues(docs, known).collect()))
    monkeypatch.setattr(cm, "BROADCAST_COMPOUNDS", 10)
    assert len(small) == 3 and sorted(map(tuple, cm.split_compound_issues(docs, known).collect())) == small


def test_cuts_in_few_steps(spark):
    """A long word with many parts: each step's expression stands once in the plan, and only stretches that may be words are shuffled."""
    from pyspark.sql import functions as F

    known = spark.createDataFrame([("ab" * k, k) for k in range(1, 9)] + [("a", 1)], "word string, weight long")
    df = compounds.segment(spark.createDataFrame([("ab" * 12,), ("abc",), ("xyzx",)], "word string"), known)
    assert [(r.word, "+".join(r.parts)) for r in df.collect()] == [("ab" * 12, "ab" * 4 + "+" + "ab" * 8)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min(") == 5 and "_held" in plan


def test_arrays_of_a_text_are_not_exploded_with_its_neighbours(spark):
    known = spark.createDataFrame([("bokhylle", ["bok", "hylle"], 100, True), ("abcd", ["ab", "cd"], 2, True)], "word string, parts array<string>, frequency long, noun boolean")
    docs = spark.createDataFrame([(1, "😀 (bok) hylle, a b ab\n\ncd"), (2, "bok"), (3, " bok hylle")], "doc_id long, text string")
    df = compounds.split_compound_issues(docs, known)
    assert sorted((r.doc_id, r.start, r.end, r.issue, r.suggestion, r.n_parts) for r in df.collect()) == [(1, 3, 13, "bok hylle", "bokhylle", 2), (1, 19, 25, "ab cd", "abcd", 2), (3, 1, 10, "bok hylle", "bokhylle", 2)]
    wide = [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines() if "Generate" in x]
    assert len(wide) == 2 and all(re.search(r"\), \[doc_id#\d+L(, x#\d+)?\], false", x) for x in wide)
