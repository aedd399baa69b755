"""The pipeline's stages against brute force on a small table, and whole on a given one."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from textlens.llm import bpe

from .test_filters import contaminated
from .test_jaccard import components
from .test_repeats import direct

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = whole.where("doc_id < 80 and char_length(text) < 3000")
    first, second = docs.orderBy("doc_id").limit(2).collect()
    planted = [(80_001, first.text + " more", "en"), (80_002, "New words here. " + second.text[:400], "en"), (80_003, "Some text. " + items[0][1] + " More text.", "en"), (90_001, None, "en"), (90_002, "", None), (90_003, "1234 %%%", None)]
    docs = docs.union(spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in planted], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text) for r in before]
        got = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(got) == {i for i, t in rows if i < 90_000}
        elif name == "jaccard_join":
            assert set(got) == {c for _, _, c in components(rows)} and len(got) < len(rows)
        elif name == "suffix_dedup":
            want = direct(rows, 100)
            assert set(got) == {i for i, _ in rows if want[i][0][1] < want[i][0][0] or not want[i][0][1]}
            source = dict(rows)
            for i, r in got.items():
                n_bytes, removed, _, _ = want[i][0]
                assert r.text == source[i] if not removed else n_bytes - removed - 6 <= len(r.text.encode()) <= n_bytes - removed
            assert any(v[0][1] for v in want.values())
        elif name == "decontamination":
            hit = {d for d, _, n, _ in contaminated(rows, items, 10) if n}
            assert set(got) == {i for i, _ in rows} - hit and hit
        else:
            encoder = bpe.ByteBPE(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
            reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
            assert {i: r.ids for i, r in got.items()} == {i: reference.encode_ordinary(t) for i, t in rows}
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS


def test_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("n_tokens = 0 or n_tokens <> size(ids)").count() == 0


def test_foreign_text_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = ["быстрая лисица прыгает через ленивую собаку " * 8, "μια γρήγορη αλεπού πηδάει πάνω από τον σκύλο " * 8, "素早い茶色の狐がのろまな犬を飛び越える " * 12]
    docs = docs.union(spark.createDataFrame([(90_000 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)], docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()}
    assert not [i for i in kept if i >= 90_000] and len(kept) >= 0.98 * (docs.count() - len(foreign))
