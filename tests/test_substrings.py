"""Terms in texts by an index of three-letter strings."""

import random

from textlens.functions.substrings import containing


def test_against_every_pair(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abåé  .") for _ in range(n))
    texts = [(i, rng.choice([None, "", make(rng.randrange(60))])) for i in range(60)] * 2
    terms = ["", "a", "ab", "åé", "a b", " . ", "abå", *[make(rng.randrange(1, 7)) for _ in range(300)]] * 2
    t = spark.createDataFrame(texts, "doc_id long, text string")
    w = spark.createDataFrame(list(enumerate(terms)), "n long, term string")
    got = sorted((r.doc_id, r.n) for r in containing(t, "text", w, "term").collect())
    assert got == sorted((i, n) for i, x in texts for n, term in enumerate(terms) if x is not None and term in x)
    assert containing(t.limit(0), "text", w, "term").collect() == [] == containing(t, "text", w.limit(0), "term").collect()


def test_many_terms_without_a_nested_loop(spark):
    rng = random.Random(3)
    words = list({"".join(rng.choice("abcdefghijkl") for _ in range(8)) for _ in range(100_000)})
    t = spark.createDataFrame([(i, " ".join(rng.sample(words, 20)) + "x") for i in range(50)], "doc_id long, text string")
    found = containing(t, "text", spark.createDataFrame([(x,) for x in words], "term string"), "term")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 50 * 20
