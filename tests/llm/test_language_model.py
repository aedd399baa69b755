"""LM scoring against a direct computation with dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from textlens.llm import language_model as lm

SPACE = " \t\n\x0b\x0c\r"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def rows():
    rnd = random.Random(5)
    vocabulary = ["the", "The", "of", "Ä", "ä", "x" * 300, "né", " ", "\x1c"] + [f"w{i}" for i in range(40)]
    out = [(i, "".join(rnd.choice(vocabulary) + rnd.choice(SPACE) for _ in range(rnd.randrange(60)))) for i in range(120)]
    return out + [(200, None), (201, ""), (202, " \n "), (None, "the of"), (3, out[3][1]), (5, "the of " * 4000)]


def test_scores(spark, monkeypatch):
    data = [(i, t, (i or 0) % 7 != 2, 1) for i, t in rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, train boolean, score int").repartition(5)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.train, r.base_score, r.score) for r in lm.score_corpus(docs).collect()), key=repr)
    unigram, pair = Counter(), Counter()
    for _, text, train, _ in data:
        if train:
            ws = tokens(text)
            unigram.update(ws)
            pair.update(zip([None, *ws[:-1]], ws, strict=True))
    n, v = sum(unigram.values()), len(unigram)
    want = []
    for i, text, train, _ in data:
        ws = tokens(text)
        want.append((i, len(ws), sum(unigram[w] > 0 for w in ws), n, train, sum(math.log10((unigram[w] + 1) / (n + v + 1)) for w in ws), None))
    want.sort(key=repr)
    for g, w in zip(sorted(got, key=lambda r: repr(r[:5])), sorted(want, key=lambda r: repr(r[:5])), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and g[6] < 0
    # the interpolated model beats the base on held-out texts
    held = [g for g in got if not g[4] and g[1] > 5]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_weights_increase_the_likelihood():
    rnd = np.random.default_rng(0)
    cells = pd.DataFrame({"bucket": [0, 0, 3, 3, 3], "n": [5, 7, 10, 20, 1], "p2": [0, 0, 5.0, 0.0, 0.1], "p1": rnd.uniform(0, 0.1, 5)})
    first, last = lm.fit_weights(cells, 100, 1), lm.fit_weights(cells, 100, 50)

    def likelihood(weights):
        return sum(r.n * math.log(weights[r.bucket] @ np.array([r.p2 / r.n, r.p1 / r.n, 1 / 101])) for r in cells.itertuples())

    assert likelihood(last) >= likelihood(first) and all(abs(w.sum() - 1) < 1e-9 for w in last.values()) and last[0][0] == 0


def test_model_sums_to_one():
    """For a seen context the three estimates each sum to one over the vocabulary and one unknown word."""
    unigram, pair = Counter("aabbbc"), Counter({("a", "b"): 2})
    v, n, w = len(unigram), 6, np.array([0.5, 0.3, 0.2])
    total = sum(w[0] * pair[("a", x)] / unigram["a"] + w[1] * unigram[x] / n + w[2] / (v + 1) for x in [*unigram, "unknown"])
    assert abs(total - 1) < 1e-12


@pytest.mark.parametrize("train", [None, False])
def test_nothing_to_learn(spark, train):
    docs = spark.createDataFrame([(1, "a b", train), (2, None, train)], "doc_id long, text string, train boolean")
    got = lm.score_corpus(docs).collect()
    assert len(got) == 2 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert lm.score_corpus(docs.limit(0)).collect() == []
