"""N-gram Jaccard join: signatures against all pairs, components against brute force."""

import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from textlens.llm import jaccard
from textlens.llm._components import connected_components


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 6, 8, 9, 12, 20, 40, 90, 200, 400]))]
        rows.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):  # near copies around the threshold
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 25)):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randrange(2)] = [rnd.choice(vocabulary)]
            rows.append(" ".join(copy).upper() if rnd.random() < 0.2 else "\t".join(copy))
        if i % 3 == 0:
            rows.append(passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([10, 20, 100]))))
    rnd.shuffle(rows)
    return rows


def test_linked_sets_share_a_signature():
    """All pairs of sets over the threshold, of every small size and some large ones, with the worst allowed differences."""
    rnd = np.random.default_rng(1)
    enum = jaccard.PartEnum()
    for size in [*range(1, 70), 100, 301, 1000]:
        for _ in range(30 if size < 70 else 3):
            a = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
            b = int(np.ceil(len(a) / 0.8)) if rnd.random() < 0.3 else len(a)
            # from a drop x and add y elements so that the similarity is just enough
            best = [(x, y) for x in range(len(a)) for y in (b - len(a) + x,) if y >= 0 and 100 * (len(a) - x) >= 80 * (len(a) + y)]
            if not best:
                continue
            x, y = best[-1]
            c = np.unique(np.concatenate([rnd.permutation(a)[x:], rnd.integers(0, 2**63, y).astype(np.uint64)]))
            both = len(np.intersect1d(a, c))
            if 100 * both >= 80 * (len(a) + len(c) - both):
                owner, sigs, needs = enum.signatures([a, c])
                both = set(sigs[owner == 0]) & set(sigs[owner == 1])
                assert both, (size, x, y)
                bands = [{(int(b), int(n)) for i, b, n in needs if i == j} for j in (0, 1)]
                shared = {b: sum(int(s) & 255 == b for s in both) for s in both for b in (int(s) & 255,)}
                # in some band that both take part in, they share as many as either needs
                assert any(shared.get(b, 0) >= n and shared.get(b, 0) >= m for b, n in bands[0] for c_, m in bands[1] if c_ == b), (size, x, y)


def test_components_equal_brute_force(spark, monkeypatch):
    for seed, group in ((0, 1024), (1, 3)):
        monkeypatch.setattr(jaccard, "GROUP", group)
        rows = list(enumerate(corpus(seed), 10)) + [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (None, "a"), (None, "only null"), (4, "a"), (7, "x " * 3000), (8, "x " * 2000)]
        docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, digest string").repartition(6)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()), key=repr)
        assert got == components(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for d, n, c in components(rows) if c is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want
    assert jaccard.link_components(docs.limit(0)).collect() == []


def test_chain_of_near_copies(spark):
    """Every text is near the next one only; the ends share little but belong together. One large group of copies beside it."""
    words = [f"v{i}" for i in range(400)]
    rows = [(100 + i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)] + [(i, "copy " + " ".join(words[:30])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()), key=repr)
    assert got == components(rows)


def test_large_group_hands_on_forests(spark):
    """A group of near copies of which every two may link hands on pairs in proportion to its rows, and what it kept back if these fail."""
    enum, base, m = jaccard.PartEnum(), np.arange(1, 101, dtype=np.uint64), 60
    vectors = [zstandard.compress(enum.vector(enum.band(100), np.append(base, np.uint64(1000 + i))).tobytes()) for i in range(m)]

    def found(forests, failed):
        rows = [(7, enum.band(100), 0, 0, 0, i, 101, i, False, failed.get(i), bytes(v)) for i, v in enumerate(vectors)]
        schema = "hub long, band long, x int, y int, block int, cls long, n long, comp long, pivot boolean, failed array<long>, vector binary"
        return jaccard._near(spark.createDataFrame(rows, schema), 2, forests, 80).collect()

    first = found(1, {})
    assert len(first) == m - 1 and all(r.more for r in first)
    failed = {}
    for r in first:
        failed.setdefault(r.b, []).append(r.a)
    second = found(4, failed)
    assert len(second) <= 4 * (m - 1)
    pairs = [frozenset((r.a, r.b)) for r in (*first, *second)]
    assert len(set(pairs)) == len(pairs)
    every = found(m, failed)
    assert len(every) == m * (m - 1) // 2 - (m - 1) and not any(r.more for r in every)


def test_near_copies_around_the_threshold(spark, monkeypatch):
    """Most of a large group may link by the bound, half of these pairs do; several rounds, in small blocks, find all components."""
    rnd = random.Random(5)
    base = [f"u{i}" for i in range(100)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(1 + i % 3):
            words[rnd.randrange(100)] = f"n{i}x{rnd.randrange(1000)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard, "GROUP", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()), key=repr)
    assert got == components(rows)


def test_filter_of_ids(spark):
    """Every wanted id passes, a null one by its stand-in, and few others do."""
    docs = spark.range(-5000, 5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    wanted = [-5000, -1, 0, 1, 4999, jaccard.NO_ID, 2**62]
    got = jaccard._maybe_among(docs.union(spark.createDataFrame([(jaccard.NO_ID, "null")], docs.schema)), spark.createDataFrame([(i,) for i in wanted], "id long"))
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) < 100 and set(ids) >= {-5000, -1, 0, 1, 4999, jaccard.NO_ID}
    assert jaccard._maybe_among(docs, spark.createDataFrame([], "id long")).count() == 0


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(250)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
