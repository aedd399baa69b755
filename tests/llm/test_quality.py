"""The quality classifier against direct counts, a direct density computation, and held-out labels."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import quality

SF = "/root/testdata/sf0.001"


def direct(text):
    """Counts of COUNTS by plain Python."""
    b = (text or "").encode()
    words = [w for w in re.split(rb"[\x09-\x0D\x20]+", b) if w]
    marks = b".,;:!?'\"()-"
    symbol = lambda w: any(x < 128 and not chr(x).isalnum() and x not in marks and x not in b"\t\n\x0b\x0c\r " for x in w)
    same = [[k for k in range(1, quality.NEAR + 1) if i >= k and words[i - k] == w] for i, w in enumerate(words)]
    return [
        sum(x in b"\t\n\x0b\x0c\r " for x in b), sum(x >= 128 or 97 <= x <= 122 for x in b), sum(65 <= x <= 90 for x in b), sum(48 <= x <= 57 for x in b), sum(x in marks for x in b),
        sum(symbol(bytes([x])) for x in b), b.count(b"\n"), len(words), sum(map(len, words)), sum(map(symbol, words)),
        sum(1 in s for s in same), sum(bool(s) and 1 not in s for s in same), sum(len(w) <= 3 for w in words), sum(len(w) >= 16 for w in words), sum(w[-1:] in b".!?" for w in words),
    ]


def texts():
    rng = random.Random(5)
    odd = [None, "", " ", "\n\n", "a", "a a b a", "É É!", "\0\0 \0", "x" * 3000, "| || !! 12-3", " a "]
    return odd + ["".join(rng.choice("ab AB1.|é\n\t!") for _ in range(rng.randrange(200))) for _ in range(60)]


@pytest.mark.parametrize("piece", [quality.PIECE_BYTES, 64])
def test_counts(spark, monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE_BYTES", piece)
    made = [quality.count_texts, quality._count_long]
    for text in texts():
        data = np.frombuffer((text or "").encode(), np.uint8)
        got = made[0](data, np.array([0, len(data)]))[0] if piece > 64 else made[1](data)
        assert got.tolist() == [direct(text)], text
    if piece > 64:
        rows = [(i, t, "x") for i, t in enumerate(texts() * 2)]
        got = quality.document_counts(spark.createDataFrame(rows, "doc_id long, text string, counts string")).collect()
        assert sorted((r.doc_id, list(r.counts)) for r in got) == [(i, direct(t)) for i, t, _ in rows]


def test_density(spark):
    rng = np.random.default_rng(1)
    counted = [(i, rng.integers(1, 90, len(quality.COUNTS)).tolist(), int(i % 3 > 0)) for i in range(60)] + [(99, [0] * len(quality.COUNTS), None), (100, [5] * len(quality.COUNTS), 7)]
    frame = spark.createDataFrame(counted, "doc_id long, counts array<long>, quality int")
    model = quality.fit(frame)
    c = np.array([x for _, x, q in counted if q in (0, 1)])
    label = np.array([q for _, _, q in counted if q in (0, 1)])
    own, of = quality._parts(c)
    np.testing.assert_allclose(model.usual, own.sum(0) / of.sum(0))
    x = quality.angles(c, model.usual)
    np.testing.assert_allclose(model.centre, x.mean(0))
    z = (x - x.mean(0)) / x.std(0)
    logs = []
    for k in (0, 1):
        part = z[label == k]
        covariance = quality.shrink(np.cov(part.T, bias=True), len(part))[0] + quality.FLOOR * np.eye(z.shape[1])
        off = z - part.mean(0)
        logs.append(np.log(len(part) / len(z)) - 0.5 * (np.linalg.slogdet(covariance)[1] + np.einsum("ij,jk,ik->i", off, np.linalg.inv(covariance), off)))
    np.testing.assert_allclose(model.score(c), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), rtol=1e-6, atol=1e-12)
    got = {r.doc_id: r.score for r in quality.score_documents(frame, model).collect()}
    assert len(got) == len(counted) and all(0 <= s <= 1 for s in got.values())


def test_shrinkage_limits():
    s = np.diag([4.0, 1.0, 1.0])
    assert quality.shrink(s, 1)[1] == 1.0 and quality.shrink(np.eye(3), 50)[1] == 1.0
    assert quality.shrink(s, 10**6)[1] < 1e-4


def test_odd_tables(spark):
    docs = spark.createDataFrame([(i, t, "a", 0.0) for i, t in enumerate(texts())] + [(None, "x y", "b", 1.0)] + [(3, "z", "c", 2.0)] * 2, "doc_id long, text string, counts string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    for k in (0, 1):
        one = spark.createDataFrame([(1, k), (1, k), (None, 1 - k), (2, None), (5, 9)], "doc_id long, quality int")
        found = quality.classify(docs, one).collect()
        assert len(found) == docs.count() and {r.score for r in found} == {float(k)}
    both = spark.createDataFrame([(3, 0), (3, 1), (8, 1)], "doc_id long, quality int")
    found = quality.classify(docs, both)
    assert found.columns == ["doc_id", "score"] and all(0 <= r.score <= 1 for r in found.collect())
    assert quality.classify(docs.limit(0), both).collect() == []


def test_held_out_labels(spark):
    found = quality.op11_quality(spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("held_out").cache()
    good = found.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right"), F.count("*").alias("n")).collect()
    assert {r.quality for r in good} == {0, 1} and all(r.right >= 0.9 for r in good), good
    assert next(r.right for r in good if r.quality == 1) >= 0.98
    found.unpersist()
