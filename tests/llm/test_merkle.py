"""The manifest against a plain tree built in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textlens.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    """All levels, each a list of digests, up to one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
        yield [level[j] for j in run if j < i], [level[j] for j in run if j > i]
        i //= 3


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, steps) of rows (doc_id, source, text)."""
    groups = {}
    for doc_id, source, text in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, text), doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, doc_id) in enumerate(sorted(groups[s])):
            steps = list(siblings(trees[s], i)) + list(siblings(top, k))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], steps))
    return sorted(out, key=repr)


def tabled(spark, rows):
    docs = spark.createDataFrame([(a, b, c, "x", 1, "y", 7) for a, b, c in rows], "doc_id long, source string, text string, g string, r int, h string, height int")
    return merkle.manifest(docs, merkle.leaf_digest(*map(F.col, ("doc_id", "source", "text"))), carry=[F.length("text").alias("size")])


def rows_of(n, seed=3):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "é", "Z", "hot", "hot", "hot", "hot", "hot"]
    return [(rng.choice([None, i, i, i, 5]), rng.choice(names), rng.choice([None, "", "x", "y\n" * 3, f"t{i}"])) for i in range(n)]


@pytest.mark.parametrize("rows", [rows_of(1), rows_of(2), rows_of(40), rows_of(200), [(None, None, None)] * 5, [(1, "a", "é" * 100_000)] * 2 + [(2, "b", "")]])
def test_against_a_plain_tree(spark, monkeypatch, rows):
    monkeypatch.setattr(merkle, "LEVELS", 2)  # so that few rows make several tiers
    monkeypatch.setattr(merkle, "BLOCK", 9)
    got = tabled(spark, rows).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(list(s.left), list(s.right)) for s in r.steps]) for r in got), key=repr) == brute(rows)
    assert sorted((r.size or 0) for r in got) == sorted(len(t or "") for _, _, t in rows)


def test_whole_blocks(spark):
    rows = rows_of(1700)
    got = merkle.verify(tabled(spark, rows)).withColumn("proof", merkle.proof_digest(F.col("steps"))).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == sorted(((*x[:4], digest(*[h for left, right in x[4] for h in left + right])) for x in want), key=repr)
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_tampering_shows(spark):
    proofs = tabled(spark, rows_of(30)).withColumn("other", F.when(F.col("doc_id") % 2 == 0, F.sha2(F.concat("leaf", F.lit("x")), 256)).otherwise(F.col("leaf")))
    for r in merkle.verify(proofs, "other").collect():
        assert r.verified == (r.doc_id is None or r.doc_id % 2 == 1)
    assert not merkle.verify(proofs.withColumn("other", F.lit(None).cast("string")), "other").first().verified


def test_empty(spark):
    assert tabled(spark, []).collect() == []


def test_no_join_for_proofs(spark):
    plan = tabled(spark, rows_of(20))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "Python" not in plan
