"""Language ID: Kneser-Ney probabilities sum to one, held-out accuracy, rejection and odd rows."""

import random

import numpy as np
import pandas as pd

from textlens.llm import language_id as li

WORDS = {"aa": "the and with for this that from have been".split(), "bb": "der und mit für diese dass von haben sein".split(), "cc": "los que con para este esa desde haber sido".split()}


def sentence(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", ",", "."]) for _ in range(n))


def direct(grams, k, context, c):
    """Interpolated Kneser-Ney probability of c after context from counts of n-grams of `k` characters, by its definition."""
    if k == 0:
        return 1 / (len(grams[1]) + 1)
    n1, n2 = (sum(n == i for n in grams[k].values()) for i in (1, 2))
    discount = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
    after = {g: n for g, n in grams[k].items() if g[:-1] == context}
    lower = direct(grams, k - 1, context[1:], c)
    if not after:
        return lower
    total = sum(after.values())
    return max(after.get(context + c, 0) - discount, 0) / total + discount * len(after) / total * lower


def test_model_equals_direct_computation():
    texts = {0: "abab abba baab aab", 1: "abc cab bca ccab"}
    counts = {}
    for language, text in texts.items():
        s = "  " + li.letters_of(text)
        own = {}
        for i in range(len(s) - li.ORDER + 1):
            own[s[i : i + li.ORDER]] = own.get(s[i : i + li.ORDER], 0) + 1
        by_order = {li.ORDER: own}
        for k in range(li.ORDER - 1, 0, -1):
            by_order[k] = {}
            for g in by_order[k + 1]:
                by_order[k][g[1:]] = by_order[k].get(g[1:], 0) + 1
        counts[language] = by_order
    grams = pd.DataFrame([(i, g, n) for i in counts for g, n in counts[i][li.ORDER].items()], columns=["language", "gram", "n"])
    model = li.fit(grams, ["x", "y"])
    alphabet = sorted(set("".join(grams["gram"])))
    for context in ("   ", "  a", " ab", "bab", "zzz", "cab", "zab", "bza"):
        for i in counts:
            assert abs(sum(direct(counts[i], li.ORDER, context, c) for c in sorted({g for g in counts[i][1]})) - 1) < 0.5
            for c in [*alphabet, "q"]:
                h, n = model.entropies(li._codes(context + c), np.array([0]))
                assert n[0] == 1 and abs(np.exp(-h[0, i]) - direct(counts[i], li.ORDER, context, c)) < 1e-5, (context, c, i)


def test_long_texts_are_scored_whole(monkeypatch):
    texts = ["the and with for this that " * 40, "der und mit", None, "x"]
    grams = pd.DataFrame([(0, g, 2) for g in ("  th", " the", "the ", "and ", " and")] + [(1, g, 1) for g in (" der", "und ", "der ")], columns=["language", "gram", "n"])
    model = li.fit(grams, ["x", "y"])
    whole = model.predict(texts)
    monkeypatch.setattr(li, "BATCH_CHARS", 50)
    assert all(np.allclose(a, b, equal_nan=True) for a, b in zip(whole[1:], model.predict(texts)[1:], strict=True))


def test_accuracy_and_odd_rows(spark):
    rnd = random.Random(0)
    rows = [(i, sentence(rnd, lang, rnd.randrange(3, 40)), lang) for i, lang in enumerate(list(WORDS) * 150)]
    docs = spark.createDataFrame(rows + [(9001, None, "aa"), (9002, "", None), (None, "the and", "aa"), (9003, "the", None)], "doc_id long, text string, lang string").repartition(5)
    held = li.held_out(li.F.col("doc_id"), 3, 1)
    model = li.train(docs.where(~held), docs_per_language=60)
    out = li.identify(docs.withColumn("score", li.F.lit("old")), model).collect()
    assert len(out) == docs.count()
    tested = [r for r in out if r.lang and r.text and r.doc_id is not None]
    assert np.mean([r.lang_pred == r.lang for r in tested]) > 0.97
    assert not any(r.rejected for r in tested) and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "жжжж щщщщ ъъъъ " * 30), (5, "the and that " * 3000)], "doc_id long, text string")
    got = {r.doc_id: r for r in li.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected for i in (1, 2, 3, 4)) and not got[5].rejected
    assert li.identify(odd.limit(0), model).collect() == []


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert li.identify(docs, li.train(docs)).first().lang_pred == "und"


def test_held_out_texts_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = li.held_out(li.F.col("doc_id"), 3, 1)
    out = li.identify(docs, li.train(docs.where(~held))).where(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and np.mean([r.rejected for r in out]) < 0.02


def test_rejection_with_few_labels(spark):
    # a common language and two rare ones; foreign text of which each nearest language is rare
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, lang, rnd.randrange(10, 40)), lang) for i, lang in enumerate(["aa"] * 60 + ["bb"] * 9 + ["cc"] * 6)] + [(1000 + i, "12 !", "cc") for i in range(50)]
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    foreign = ["быстрая лисица прыгает через ленивую собаку " * 8, "μια γρήγορη αλεπού πηδάει πάνω από τον σκύλο " * 8, "zürück für äöü ßß " * 20]
    assert all(model.predict(foreign)[3])
    known = [sentence(rnd, lang, 30) for lang in WORDS for _ in range(20)]
    names, _, _, rejected = model.predict(known)
    assert names == [lang for lang in WORDS for _ in range(20)] and not rejected.any()


def test_calibration_pools_languages():
    told = pd.DataFrame({"language": ["x"] * 6 + ["y"], "h": [2.0, 2.1, 1.9, 2.0, 2.2, 1.8, 2.6], "n": [500] * 7})
    x, y, z = li._calibration(told, ["x", "y", "z"])
    assert x[0] == 2.0 and y[0] == z[0] == 2.6 and (y[1:] == x[1:]).all() and (z[1:] == x[1:]).all()


def test_letters_are_those_of_unicode(spark):
    assert [li.letters_of(t) for t in ("½ ² ①", "Ⅷ", "一二", "a½b", "é", "́", "_1_", "ªb")] == ["", "", " 一二 ", " a b ", " é ", "", "", " ªb "]
    rows = [(i, f"the quick brown fox number {i} runs over the lazy dog and the cat", "en") for i in range(30)]
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ"), (3, "́"), (4, "123"), (5, "the fox")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in li.identify(odd, model).collect()}
    assert {got[i][0] for i in (1, 2, 3, 4)} == {"und"} and all(got[i][1] for i in (1, 2, 3, 4)) and got[5][0] == "en"
