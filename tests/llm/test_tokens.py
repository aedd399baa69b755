"""Byte-level BPE against tiktoken; token files against the tokenizers library and by round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textlens.llm import _tokens, bpe, token_files
from textlens.llm._common import pack, unpack

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  ", " a", "a  b", " \n x", "x" * 900, "ab" * 700, " " * 500, "\n\n a\n", "日本語 テキスト" * 30, "it's I'LL don't 's", "a\x1c b", "　 x  y \n z ", "²³ 12½ x²", "é" * 300, "word, word. Word; word", "<|endoftext|>"]


def texts(n=300):
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice(" \n\t　ab'sé1.,") for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("batch", [50, 2_000_000])
def test_encoder_equals_tiktoken(batch, monkeypatch):
    monkeypatch.setattr(_tokens, "BATCH_CHARS", batch)
    encoder = bpe.ByteBPE(bpe.read_ranks(RANKS))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    got, all_texts = [], texts()
    for a, b, ids, counts in _tokens.ChunkEncoder(encoder.encode_chunks)(all_texts):
        ends = np.concatenate([[0], np.cumsum(counts)])
        got += [ids[ends[i] : ends[i + 1]].tolist() for i in range(b - a)]
        data, _ = encoder.decode(ids, counts)
        assert data.tobytes() == "".join(t or "" for t in all_texts[a:b]).encode()
    assert got == [reference.encode_ordinary(t or "") for t in all_texts]


def test_cache_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr(_tokens, "CACHED", 3)
    monkeypatch.setattr(_tokens, "BATCH_CHARS", 10)
    encoder = bpe.ByteBPE(bpe.read_ranks(RANKS))
    made = _tokens.ChunkEncoder(encoder.encode_chunks)
    found = [ids.tolist() for _, _, ids, _ in made(["one two three four", "five six seven", "one two three four"])]
    assert found[0] == found[2]


def library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return token_files._loaded(f.read())[0], Tokenizer.from_file(path)


SIGNED = ["one,", "two.\nThree", "x\n\ny", "a\nb 7\n8", "don't 's 'tis", "\nq", "z\n", "12ab34,!", "×a÷b", "ÀÉîø,ɏĳ.", "Привет, мир!\nДа", "½a ²b", "é\u0301,a", "<|endoftext|>,a", "a<|endoftext|>\nb  c", "( [a]) --b", "αβ, γ", "日,本.a"]


@pytest.mark.parametrize("batch, group, cached", [(50, 1, 3), (300, 4, 20), (2_000_000, 4, 500_000)])
def test_pieces_equal_the_library(batch, group, cached, monkeypatch):
    monkeypatch.setattr(_tokens, "BATCH_CHARS", batch)
    made, tokenizer = library()
    encoder, rnd = _tokens.PieceEncoder(made.encode, made.special, cached), random.Random(2)
    encoder.group = group
    all_texts = texts() + SIGNED + [" " + x for x in SIGNED] + ["".join(rnd.choice(["ab", "É", "ж", "\n", " ", " c", "7", ",", "'", "'s", "×", "½", "中"]) for _ in range(rnd.randrange(30))) for _ in range(2000)]
    got, at = [], 0
    for a, b, ids, counts in encoder(all_texts):
        assert a == at
        at, ends = b, np.concatenate([[0], np.cumsum(counts)])
        got += [ids[ends[i] : ends[i + 1]].tolist() for i in range(b - a)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in all_texts]


def test_words_with_signs_are_encoded_once(monkeypatch):
    monkeypatch.setattr(_tokens, "BATCH_CHARS", 40)
    made, _ = library()
    given = []
    encoder = _tokens.PieceEncoder(lambda x: given.extend(x) or made.encode(x), cached=4)
    for _ in encoder([" word word, word. word.\nword: word;", " word! (word) word\nword7 word", " other word, other?"]):
        pass
    assert given.count(" word") == 1  # met often, so it stays when the others go
    assert all(x.strip() == x or x[1:].strip() == x[1:] or x == "\n" for x in given)
    assert not any(len(x) > 1 and "word" in x and x.strip() != "word" for x in given)


def test_encode_decode_rows(spark):
    rows = [(i, t, "kept", "x") for i, t in enumerate(ODD)] + [(3, "  ", "kept", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    out = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out) == sorted((i, (t or "").encode()) for i, t, *_ in rows)
    assert bpe.encode(docs.limit(0), RANKS).collect() == []
    blank = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(blank, RANKS).orderBy("doc_id").collect()] == [None, bytearray()]


@pytest.mark.parametrize("seed", range(6))
def test_repair_round_trip(seed):
    rnd = np.random.default_rng(seed)
    ids = rnd.integers(0, [2, 5, 50, 500, 50_000, 3][seed], [0, 1, 5000, 20_000, 3000, 999][seed]).astype(np.int32)
    if seed == 2:
        ids = np.tile(ids[:100], 50)
    rules, symbols = token_files.repair(ids, 50_257, min_count=2)
    data, offsets = token_files.expansions(rules, 50_257)
    assert _tokens.take(data, offsets, symbols.astype(np.int64))[0].tolist() == ids.tolist()
    if seed == 2:
        assert len(symbols) < len(ids) / 10


@pytest.mark.parametrize("seed", range(4))
def test_places_apart_and_pairs_gathered(seed):
    rnd = np.random.default_rng(seed)
    rank = np.append(np.append(token_files.NONE, rnd.integers(0, [2, 3, 9, 40][seed], 500)), token_files.NONE).astype(np.int32)
    rank[rnd.random(502) < 0.1] = token_files.NONE
    found = token_files._apart(rank)
    assert (rank[found] < token_files.NONE).all() and (np.diff(found) > 1).all()
    free = np.flatnonzero(rank < token_files.NONE)
    lowest = free[(rank[free] < rank[free - 1]) & (rank[free] < rank[free + 1])]
    assert np.isin(lowest, found).all()
    keys, places = rnd.integers(0, 7, 300), np.arange(300)
    for high in (0, 1 << 60):  # the second doesn't fit one number with the place
        got = token_files._gathered(keys + high, places)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip((keys + high).tolist(), places.tolist(), strict=True))


def test_shard_random_access():
    rnd = np.random.default_rng(0)
    docs = [np.append(rnd.integers(1, 9, rnd.integers(0, 300)), 0) for _ in range(40)]
    counts = np.array([len(d) for d in docs])
    row = dict(zip([f.split()[0] for f in token_files.FILE_SCHEMA.split(", ")], token_files.shard_row(0, 0, 50_257, list(range(40)), np.concatenate(docs), counts), strict=True))
    assert len(unpack(row["rules"], np.uint32)) > 0
    for k in range(40):
        assert token_files.decode_document(row, k).tolist() == docs[k].tolist()


def test_grammar_ends_when_no_pair_is_frequent():
    rnd = np.random.default_rng(1)
    phrase = rnd.integers(1, 50_000, 300)
    ids = np.concatenate([np.append(phrase, rnd.integers(1, 50_000, 5)) for _ in range(40)] + [np.full(5000, 7)])
    rules, symbols = token_files.repair(ids, 50_257)
    pairs = {}
    for a, b in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True):
        pairs[a, b] = pairs.get((a, b), 0) + 1
    assert max(pairs.values()) < 2 * token_files.MIN_COUNT  # overlapping ones, such as x x x, count twice
    assert len(symbols) < 40 * 7 + 40  # the whole phrase is one symbol
    data, offsets = token_files.expansions(rules, 50_257)
    assert token_files.take(data, offsets, symbols.astype(np.int64))[0].tolist() == ids.tolist()


def test_planes():
    a = np.array([1, 70_000, 2**63], np.uint64)
    assert unpack(pack(a), np.uint64).tolist() == a.tolist()


def test_token_files_equal_the_library(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    all_texts = texts(60) + ["hi <|endoftext|> you", "a \n<|endoftext|>", "two  <|endoftext|><|endoftext|>\tx <|endoftext", "<|endoftext|>" * 3]
    rows = [(1000 - i, t, i) for i, t in enumerate(all_texts)] + [(None, "no id", 0), (1000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = str(tmp_path / "files")
    token_files.write_token_files(docs, out, path, shard_tokens=100)
    shards = token_files.read_token_files(spark, out)
    assert shards.count() > 1
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in token_files.document_tokens(shards, with_ids=True).collect())
    want, at = [], 0
    for doc_id, text, _ in docs.orderBy("doc_id", F.xxhash64("text")).collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert found == want
    token_files.write_token_files(docs.limit(0), out + "0", path)
    assert token_files.document_tokens(token_files.read_token_files(spark, out + "0")).collect() == []
