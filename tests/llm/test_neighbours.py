"""Nearest neighbours against brute force: recall, exact scores, order, ties and odd rows."""

import numpy as np

from textlens.llm import neighbours


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q, v in queries:
        score = x @ np.array(v, np.float64)
        pairs = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in pairs]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, base[i].astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(60)]  # one vector many times
    odd = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [float("inf")] + [0.0] * 23), (9006, [None] + [1.0] * 23), (None, rows[1][1]), (9020, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>").withColumn("score", neighbours.F.lit("x")).repartition(4)
    queries = df.where("vec_id % 20 = 0")
    got = {}
    for r in neighbours.nearest(df, queries, block_rows=800).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(got) == set(want)  # the short vector is alone in its space
    recall = []
    score = {q: dict(brute(rows, [(q, v)], len(rows))[q]) for q, v in rows[:100:20]}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        recall.append(len({i for _, i, _ in found} & {i for i, _ in want[q]}) / 20)
        if q in score:
            assert all(abs(score[q][i] - s) < 1e-9 for _, i, s in found)
    assert np.mean(recall) >= 0.9
    assert {5000, 5001} <= {i for _, i, _ in got[5020]} and 5020 not in {i for _, i, _ in got[5020]}


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert neighbours.nearest(df.limit(0), df).collect() == [] and neighbours.nearest(df, df.limit(0)).collect() == []


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in neighbours.op8_neighbours(spark, "/root/testdata/sf0.01").collect())
    assert hits >= 0.9 * sum(map(len, want.values()))
