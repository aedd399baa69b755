"""Suffix-array dedup: suffix arrays against sorting, removal against a direct search for repeated strings."""

import hashlib
import random

import numpy as np
import pytest

from textlens.llm import _suffixes, repeats


def plain(t):
    t = t.tolist()
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(sa, sa[1:], strict=False):
        k = 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(min(k, _suffixes.CAP))
    return sa, lcp


@pytest.mark.parametrize("memory", [_suffixes.MEMORY, 64])
@pytest.mark.parametrize("base", [1, 20, _suffixes.BASE])
def test_suffix_arrays(memory, base):
    rnd = np.random.default_rng(0)
    for i in range(150):
        t = rnd.integers(1, int(rnd.choice([1, 2, 3, 10, 1000])) + 1, int(rnd.integers(0, 120)))
        t = np.append(np.tile(t, 3) if i % 5 == 0 else t, 0)
        sa, lcp = _suffixes.suffix_array(t, memory, base=base)
        assert (list(sa), list(lcp)) == plain(t)


def test_queue_order():
    rnd = np.random.default_rng(1)
    queue, keys = _suffixes.RunQueue(64), []
    for _ in range(60):
        new = rnd.integers(0, 1000, rnd.integers(0, 30))
        queue.push(new, new)
        keys = sorted([*keys, *new.tolist()])
        got, values, which = queue.peek(7)
        queue.drop(which)
        assert got.tolist() == values.tolist() == keys[:7]
        keys = keys[7:]


def direct(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                gone[a : a + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.setdefault(rows[i][0], []).append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def corpus():
    rnd = random.Random(4)
    syllables = ["the", "an", "is", "é", "ing", " ", " ", ". ", "日"]
    text = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    passages = [text(60) for _ in range(4)]
    rows = []
    for i in range(60):
        t = text(rnd.choice([0, 3, 40, 200, 600]))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(t) + 1)
            p = rnd.choice(passages)
            cut = rnd.randrange(20)
            t = t[:at] + p[cut : len(p) - rnd.randrange(20)] + t[at:]
        rows.append((i, t))
        if i % 7 == 0:
            rows.append((100 + i, t[:50] + "x" + t[50:]))
        if i % 9 == 0:
            rows.append((200 + i, t))
    rows += [(300, None), (301, ""), (302, "a" * 450), (303, "ab" * 300), (304, "a" * 150), (305, "x" * 99), (306, "x" * 100), (307, "x" * 100), (None, rows[8][1]), (308, rows[3][1] * 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [100, 150, 200, 250, 300])
def test_long_strings(length):
    rnd = np.random.default_rng(3)
    shared = rnd.integers(97, 123, 330)
    pieces = [np.concatenate([rnd.integers(97, 123, 20), shared, rnd.integers(97, 123, 30)]).astype(np.uint8) for _ in range(2)]
    windows = np.array([len(p) - length + 1 for p in pieces])
    piece, _ = repeats.repeated_starts(np.concatenate(pieces), np.array([0, len(pieces[0])]), windows, np.array([1, 2]), np.zeros(2, np.int64), np.zeros(2, np.int64), length)
    assert len(piece) == 331 - length and (piece == 1).all()


@pytest.mark.parametrize("shard", [repeats.SHARD_BYTES, 300])
def test_removal(spark, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7, "old") for i, t in rows], "doc_id long, text string, n_bytes int, _x string").repartition(5)
    for length in (100, 101, 250):
        got = {}
        for r in repeats.remove_repeats(docs, length=length).collect():
            got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
            source = dict(rows)[r.doc_id]
            if source is None or not r.n_removed:
                assert r.text == source
            else:
                raw, keep = source.encode(), np.ones(len(source.encode()), bool)
                for s in r.spans:
                    keep[s.start : s.end] = False
                assert r.text == bytes(b for b, k in zip(raw, keep, strict=True) if k).decode("utf-8", "ignore")
        assert {d: sorted(v) for d, v in got.items()} == direct(rows, length)
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_equal_rows(spark):
    t = "".join(f"{i} " for i in range(80))
    docs = spark.createDataFrame([(1, t), (1, t), (1, t), (1, "other " * 3)], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.remove_repeats(docs).collect()) == [0, 0, len(t), len(t)]


def test_two_equal_strings_in_one_run(spark):
    # 101 equal bytes across place 2 ** 16 of a chunk: two equal strings whose minimizer occurs nowhere else
    rnd = random.Random(5)
    filler = lambda n: "".join(rnd.choice("bcdefghijklmnop") for _ in range(n))
    rows = [(1, filler(65_500) + "a" * 101 + filler(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs).first()
    assert got.n_removed == 100 and [(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)] == direct(rows, 100)[1]


def test_equal_hashes_settle_nothing():
    # two different surroundings under one minimizer and one content hash, as if it collided
    rnd = random.Random(6)
    a, b = (np.frombuffer(bytes(rnd.randrange(97, 123) for _ in range(120)), np.uint8) for _ in range(2))
    two = np.array([7, 7], np.uint64)
    part = repeats.pd.DataFrame({"chunk": [0], "hash": [repeats.squeeze(two)], "content": [repeats.squeeze(two)]} | {c: [repeats.squeeze(np.array(v))] for c, v in (("id", [1, 2]), ("tie", [0, 0]), ("first", [0, 0]), ("windows", [21, 21]))} | {"raw": [repeats.squeeze(np.concatenate([a, b]))]})
    assert not len(repeats._earlier(part, 100))


def test_hot_minimizer(spark, monkeypatch, tmp_path):
    # one passage in many documents, with another context at both its ends in each
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = text(260)
    rows = [(i, text(150) + passage + text(150)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 5_000)
    sizes = []
    stored = repeats.stored

    def watched(df, what):
        out = stored(df, what)
        if what == "surroundings":
            groups = out.where("bucket >= 0").toPandas().groupby("bucket")
            sizes.extend(g["windows"].map(lambda b: len(repeats.spread(b, np.int64))).sum() for _, g in groups)
        return out

    monkeypatch.setattr(repeats, "stored", watched)
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in repeats.remove_repeats(docs).collect()}
    assert got == direct(rows, 100)
    # the 200 surroundings of an end don't meet in one group
    assert sizes and max(sizes) <= 150
