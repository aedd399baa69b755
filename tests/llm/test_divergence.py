"""Source divergence and its pointer sort against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from textlens.llm import _pointers, divergence


def terms_of(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, least=3, top=200):
    """Sorted result for rows (text, lang, source)."""
    rows = [(t or "", a or "", b or "") for t, a, b in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        docs = Counter(t for text, _, _ in own for t in set(terms_of(text)))
        kept = {t for t, n in docs.items() if n >= least}
        sources = sorted({r[2] for r in own})
        count = {s: Counter(t for text, _, b in own if b == s for t in terms_of(text) if t in kept) for s in sources}
        everything = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for s in sources:
            pairs = [(o, sum((share(count[s], t) - share(count[o], t)) ** 2 // share(count[o], t) for t in kept)) for o in sources if o != s]
            found = [(t, (share(count[s], t) - q) ** 2 // q) for t in kept if count[s][t] and share(count[s], t) > (q := share(everything, t))]
            for part, items in (("pair", pairs), ("term", found)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ordered) if part == "pair" or k < top]
    return sorted(out)


def rows_of(n, seed=0):
    rng = random.Random(seed)
    words = ["a", "A", "bb", "über", "abcdefgh", "abcdefghi", "abcdefghij" * 3, "abcdefghij" * 3 + "k", "é", "x1y", "--", "the", "the", "the", "日本語"]
    return [(rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(40)))]), rng.choice([None, "", "en", "en", "en", "de"]), rng.choice([None, "s", "t", "hot", "hot", "Ü"])) for _ in range(n)]


def collect(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def test_pointer_sort():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 500, 4000):
        text = rng.choice(np.frombuffer("abABz \n.é".encode("latin-1"), np.uint8), n)
        cuts = np.unique(np.concatenate([[0], rng.integers(0, n + 1, 12), [n]]))
        cuts = np.sort(np.concatenate([cuts, cuts[:2]]))  # with empty texts
        low = np.concatenate([_pointers.LOWER[text], np.zeros(8, np.uint8)])
        start, length, number = _pointers.term_starts(text, cuts)
        found = [(k, m.start() + a, m.end() - m.start()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) for m in re.finditer(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text[a:b].tobytes())]
        assert list(zip(number, start, length, strict=True)) == found
        slices = np.array([len(start) // 3, 0, len(start) - len(start) // 3])
        order, head = _pointers.sort_pointers(low, start, length, slices)
        term = [low[a : a + b].tobytes() for a, b in zip(start, length, strict=True)]
        part = np.repeat(np.arange(3), slices)
        want = sorted(range(len(start)), key=lambda i: (part[i], term[i], i))
        assert order.tolist() == want
        assert head.tolist() == [k == 0 or (part[want[k - 1]], term[want[k - 1]]) != (part[i], term[i]) for k, i in enumerate(want)]


@pytest.mark.parametrize("n", [1, 5, 60, 200])
def test_against_brute_force(spark, n):
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    assert collect(divergence.divergence(docs)) == brute(rows)
    assert collect(divergence.divergence(docs, min_documents=1, top_terms=2)) == brute(rows, 1, 2)


def test_small_shards_and_shuffled_statistics(spark, monkeypatch):
    rows = rows_of(80, 9) + [("über the x " * 3000 + "abcdefghij" * 40, "en", "s")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    want = brute(rows)
    for name, value in (("SHARD_BYTES", 300), ("BROADCAST_GROUPS", 0), ("SALTS", 3), ("SIDE", 2), ("HELD_BYTES", 40)):
        monkeypatch.setattr(divergence, name, value)
    assert collect(divergence.divergence(docs)) == want


def test_long_shares_are_exact():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 10**13, 200)
    d = n + rng.integers(1, 10**14, 200)
    assert divergence._shares(n, d).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, d, strict=True)]


def test_empty_and_without_terms(spark):
    docs = spark.createDataFrame([(None, None, None), ("1 2", None, "b"), ("", "x", "c")], "text string, lang string, source string")
    assert collect(divergence.divergence(docs)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]
    assert divergence.divergence(docs.limit(0)).collect() == []
