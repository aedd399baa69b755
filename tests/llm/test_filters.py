"""WARC, URL filters and decontamination against brute force on small tables."""

import base64
import gzip
import hashlib
import re

from pyspark.sql import functions as F

from textlens.llm import decontaminate, url_filter, warc


def judge(url, rules, default):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, action = max(fits, default=(0, None, default))
    return host, path, rule, action


def test_urls(spark):
    rules = url_filter.OP10_RULES + [("block", "a.example.org", "/es/"), ("allow", "É.org", ""), ("allow", "x..com", "/")]
    urls = [None, "", "no", "http://", "http://EXAMPLE.org/es/", "https://a.example.org/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "ftp://badexample.org/es/", "http://org/", "http://org", "http://b.com/fr/://x.org/", "http://x.com/de/", "http://x.com?/fr/", "http://x..com/", "http://É.org", "a\nhttp://y.org/es/\nz", "http://" + "a." * 300 + "com/de/" + "p" * 5000]
    rows = [(i % 7, u, "old", 1) for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, r_host int")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "action string, host string, path string"), default="block").collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i % 7, *judge(u, rules, "block")) for i, u in enumerate(urls * 2)) or sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(repr, ((i % 7, *judge(u, rules, "block")) for i, u in enumerate(urls * 2))))
    none = url_filter.judge_urls(pages, spark.createDataFrame([], "action string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(rows)
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "action string, host string, path string")).collect() == []


def test_urls_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(1, "http://a.example.org/es/1")], "page_id long, url string")
    assert url_filter.judge_urls(pages, spark.createDataFrame(url_filter.OP10_RULES, "action string, host string, path string")).first().verdict == "block"


def test_warc_round_trip(spark, tmp_path):
    odd = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nzz\r\n\r\n"
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/\r\nWARC-Type: x", odd), (4, "d", ""), (5, "e", None), (None, "f", "same"), (6, "é", "é" * 100_000), (6, "é", "é" * 100_000), (7, "g", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = str(tmp_path / "w")
    warc.write_warc(pages, out)
    records = warc.read_warc(spark, out)
    assert records.count() == 3 * len(rows)
    found = warc.assemble_captures(records).collect()
    assert sum(r.copies for r in found) == len(rows)
    by_id = {r.capture_id: r for r in found}
    for r in found:
        body = r.source.payload if r.response.type == "revisit" else r.response.payload
        assert r.request.concurrent_to == r.metadata.concurrent_to == r.capture_id
        digest = base64.b32encode(hashlib.sha1(bytes(body)).digest()).decode()
        assert r.response.payload_digest == "sha1:" + digest
        if r.response.type == "revisit":
            assert by_id[r.response.refers_to].response.type == "response"
    # the null page comes first among equal payloads; 4 and 5 are both empty; 3 and 7 are equal
    kinds = {bytes(r.metadata.payload).decode(): r.response.type for r in found}
    assert kinds == {"": "response", "page-id: 1\r\n": "revisit", "page-id: 2\r\n": "revisit", "page-id: 3\r\n": "response", "page-id: 4\r\n": "response", "page-id: 5\r\n": "revisit", "page-id: 6\r\n": "response", "page-id: 7\r\n": "revisit"}
    warc.write_warc(pages, out + "2", min_revisit_bytes=5)
    assert warc.read_warc(spark, out + "2").where("type = 'revisit'").count() == 1
    # pages of one id and payload keep their urls
    twice = spark.createDataFrame([(1, "http://a/", "x"), (1, "http://b/", "x")], pages.schema)
    warc.write_warc(twice, out + "3")
    assert sorted(r.response.target_uri for r in warc.assemble_captures(warc.read_warc(spark, out + "3")).collect()) == ["http://a/", "http://b/"]
    warc.write_warc(pages.limit(0), out + "4")
    assert warc.assemble_captures(warc.read_warc(spark, out + "4")).collect() == []


def test_warc_plain_and_members():
    record = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r[-1] for r in warc.parse_warc(record * 3)] == [b"abc"] * 3
    assert [r[-1] for r in warc.parse_warc(gzip.compress(record) * 3)] == [b"abc"] * 3
    assert list(warc.parse_warc(b"")) == []


def test_base32(spark):
    got = spark.createDataFrame([(b"",), (b"abc",), (b"\xff" * 99,)], "x binary").select("x", warc.base32_sha1(F.col("x")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(bytes(r.x)).digest()).decode() for r in got)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def contaminated(docs, items, window):
    gone = {}
    for item, text in items:
        ws = words(text)
        for i in range(len(ws) - min(window, len(ws)) + 1 if ws else 0):
            gone.setdefault(tuple(ws[i : i + min(window, len(ws))]), set()).add(item)
    out = []
    for d, text in docs:
        ws, hit, ids = words(text), set(), set()
        for m in {len(g) for g in gone}:
            for i in range(len(ws) - m + 1):
                if found := gone.get(tuple(ws[i : i + m])):
                    hit |= set(range(i, i + m))
                    ids |= {str(x) for x in found if x is not None}
        out.append((d, len(ws), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def test_contamination(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 16)
    item = " ".join(f"w{i}" for i in range(14))
    items = [(1, item), (2, "Tiny ITEM"), (3, ""), (4, None), (10, item.upper()), (None, "only null here"), (5, "Ä ä é")]
    filler = " ".join(f"f{i}" for i in range(70))
    docs = [(0, None), (1, ""), (2, filler), (3, f"{filler} {item.upper()}! {filler}"), (4, "a tiny, item; tiny item"), (5, " ".join(item.split()[:9])), (3, f"{filler} {item.upper()}! {filler}"), (6, "only NULL here"), (7, "ä ä é Ä ä é"), (None, item), (8, " ".join([item] * 30))]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for limit in (10**6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        got = decontaminate.find_contamination(table, bench).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == contaminated(docs, items, 10)
    kept = decontaminate.decontaminate(table, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5] and kept.columns == table.columns
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(table, bench, remove="spans").collect()}
    assert cut[3] == f"{filler}! {filler}" and cut[4] == "a" and cut[0] is None and cut[None] == "" and len(cut) == len({d for d, _ in docs})
    assert decontaminate.find_contamination(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(table.limit(0), bench).count() == 0


def test_decontamination_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontaminate.find_contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan


def test_captures_without_reference_are_dealt_out(spark):
    from textlens.llm.warc import assemble_captures

    rows = [(f"r{i}", "response", None, None) for i in range(200)] + [("v", "revisit", None, "r7")]
    records = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string, refers_to string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        sizes = assemble_captures(records).rdd.glom().map(len).collect()
        found = {r.capture_id: r.source and r.source.record_id for r in assemble_captures(records).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == len(rows) and max(sizes) < len(rows) / 2
    assert found == {f"r{i}": None for i in range(200)} | {"v": "r7"}
