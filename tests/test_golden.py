"""Golden sentences and hand-computed figures of the reference operators, sources and streams."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textlens.operators import domains, feedback, issues, lexicon, nlp, readability, text
from textlens.plans import QUERIES, SQL, queries_issues, registry_ext, tables
from textlens.plans import rules as rules_tables
from textlens.functions import patterns
from textlens.functions.checks import checked_small
from textlens.sources import files
from textlens.streaming import streams


def docs(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_every_query_but_a_few_has_sql():
    assert set(QUERIES) - set(SQL) <= {"b7_chunks", "k2_model_scores", "c15_corpus_diversity"}


def test_readability_by_hand(spark):
    row = readability.rix(readability.lix(readability.text_statistics(docs(spark, "a bb ccccccc. d!", None, "", "...")))).orderBy("doc_id").collect()
    assert (row[0].n_words, row[0].n_sentences, row[0].lix, row[0].rix) == (4, 2, 27.0, 0.5)
    assert [(r.n_words, r.lix, r.rix) for r in row[1:]] == [(0, 0.0, 0.0)] * 3


def test_bands_cover_edges(spark):
    x = spark.createDataFrame([(0, 20.0), (1, 19.9), (2, 0.0), (3, 500.0)], "doc_id long, lix double")
    got = [r.lix_band for r in readability.classify(x, tables.BANDS.df(spark), "lix", "lix").orderBy("doc_id").collect()]
    assert got == ["lett", "svært lett", "svært lett", "svært vanskelig"]


def test_offsets_and_chunks(spark):
    source = "Hei på deg,og  hva?"
    x = docs(spark, source, None, "")
    assert [r.start for r in text.tokenize_with_offsets(x).orderBy("tok_id").collect()] == [0, 4, 7, 11, 15]
    long = "En setning her. " * 40 + "\n\n" + "x" * 300
    parts = sorted((r.chunk_id, r.chunk) for r in text.chunk_documents(docs(spark, long), 100).collect())
    assert "".join(c for _, c in parts) == long and all(len(c) <= 100 for _, c in parts)


def scan(spark, value, rules):
    found = issues.scan_rules(docs(spark, value), queries_issues.RULES[rules].df(spark), rules_tables.FORMS.df(spark))
    return {(r.type, r.start, r.issue, r.suggestion) for r in found.collect()}


def test_golden_rules(spark):
    assert scan(spark, "Dette er feks et eksempel, osv. Imorgen", "f1c_abbreviations") == {("abbreviation", 9, "feks", "f.eks."), ("abbreviation", 27, "osv", "o.s.v."), ("split_time", 32, "Imorgen", "i morgen")}
    assert scan(spark, "Hei på deg,og hvordan har du det ?", "f1a_spacing") == {("missing_space", 10, ",o", ", o"), ("space_before", 32, " ?", "?"), ("space_before_mark", 31, "t ?", "t?")}
    assert scan(spark, "Dette er en test!! Hva??", "f1b_repeats") == {("repeated_mark", 16, "!!", "!"), ("repeated_mark", 22, "??", "?")}
    assert scan(spark, "", "f1b_repeats") == scan(spark, None, "f1b_repeats") == set()
    assert scan(spark, "på 1990-tallet kom i sommer i Mandag", "f1f_prepositions") == {("decade", 0, "på 1990-tallet", "i 1990-tallet"), ("season", 19, "i sommer", "til sommeren"), ("weekday", 28, "i Mandag", "på Mandag")}
    assert scan(spark, "jeg har grammatik feil og skrivd røde bil som lovte butikken åpent", "f1i_words") == {("grammar", 8, "grammatik", "grammatikk"), ("grammar", 26, "skrivd", "skrevet"), ("style", 33, "røde bil", "rød bil"), ("spelling", 46, "lovte", "lovet"), ("grammar", 61, "åpent", "åpen")}
    assert scan(spark, "grammatik åpent blåse", "f1i_words") == set()


def test_golden_grammar_rules(spark):
    found = scan(spark, "Han ikke er her. Hvorfor du ikke kommer, prøver å spiser. I går kjøper han. Til butikk går han. En stort bil, et stor hus. Butikk nå.", "f1h_grammar")
    assert found >= {
        ("negation_before_verb", 0, "Han ikke er", "Han er ikke"), ("question_order", 17, "Hvorfor du ikke kommer", "Hvorfor kommer du ikke"), ("present_after_marker", 50, "spiser", "spise"),
        ("present_after_past_time", 64, "kjøper", "kjøpte"), ("bare_noun_after_preposition", 80, "butikk", "butikken"), ("masculine_adjective", 96, "En stort bil", "En stor bil"), ("neuter_adjective", 110, "et stor hus", "et stort hus"), ("missing_article", 123, "Butikk", "en butikk"),
    }
    assert not {t for t, *_ in scan(spark, "han går til butikk", "f1h_grammar")} & {"missing_article"}  # behind a preposition
    assert scan(spark, "Han er glad og hun er trist", "f1e_comma_context") == {("comma_conjunction", 10, "d og h", "d, og")}
    assert scan(spark, "egg og melk", "f1e_comma_context") == scan(spark, "Han er glad og noe mugg", "f1e_comma_context") == set()
    assert {t for t, *_ in scan(spark, "Er du her fordi han ikke er glad", "f1j_clauses")} == {"question_order", "subclause_negation", "informal", "main_clause_v2"}
    assert {t for t, *_ in scan(spark, "Glad er han", "f1j_clauses")} == set()


def test_rules_index(spark):
    for pattern, grams in ((r"\bfeks\b", ["fek"]), ("!!+", []), (r"(?i)\b(?:Hvorfor|når)\s+x", ["hvo", "når"]), (r"(?:abc|de)", []), ("(?:foo)?bar", ["bar"]), ("a b c", []), ("abc(?:d|e)+", ["abc"])):
        assert patterns.index_grams(pattern) == grams, pattern
    # every rule is found by its index wherever its pattern hits: 1,000 made-up rules and the fixed ones against a plain scan
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeæå") for _ in range(rng.randrange(1, 7))) for _ in range(1000)]
    rows = [("c", f"t{i}", rng.choice([rf"\b{w}\b", f"(?i){w} ?\\w", f"(?:{w}|{words[i - 1]})", f"{w}+", f"[{w}]{w}"]), "<$0>", "low", 0.5, rng.choice([None, None, words[i - 2]])) for i, w in enumerate(words)]
    values = [" ".join(rng.choice(words).capitalize() if rng.random() < 0.2 else rng.choice(words) for _ in range(60)) for _ in range(8)] + [None, "", "a"]
    table = spark.createDataFrame(rows, "checker string, type string, pattern string, suggestion string, severity string, confidence double, requires string")
    got = sorted((r.doc_id, r.type, r.start, r.end, r.issue, r.suggestion) for r in issues.scan_rules(docs(spark, *values), table).collect())
    want = []
    for i, value in enumerate(values):
        for _, kind, pattern, _, _, _, requires in rows:
            if value and (requires is None or requires in value):
                want += [(i, kind, m.start(), m.end(), m[0], f"<{m[0]}>") for m in re.finditer(pattern.replace("\\b", r"(?a:\b)").replace("\\w", "[a-zA-Z0-9_]"), value)]
    assert got == sorted(want)
    plan = issues.scan_rules(docs(spark, *values), table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Exchange hash" not in plan


def test_running_sum(spark):
    sizes = [[], [3], [1, 2], list(range(1, 40)), [1] * 1000]
    x = spark.createDataFrame(list(enumerate(sizes)), "i int, s array<int>")
    got = {r.i: r.s for r in x.select("i", issues.running_sum(F.col("s")).alias("s")).collect()}
    assert got == {i: list(itertools.accumulate(s)) for i, s in enumerate(sizes)}


def test_confidence_and_levels(spark):
    i = spark.createDataFrame([
        (1, "spacing", [], None, "rule_based", "high"), (2, "no such type", None, None, None, None), (3, "noun_declension", ["properNoun", "inQuote", "unheard of"], None, "gpt", "low"), (4, "spacing", ["confirmedByUser"], None, "other", None), (5, "style_formality", [], 0.2, "rule_based", None), (6, "passive_voice", [], None, "rule_based", None), (7, "word_order_error", ["inHeading"], None, "other", "low"),
    ], "issue_id int, type string, factors array<string>, own double, source string, severity string")
    rates = spark.createDataFrame([("spacing", 10, 0.0), ("style_formality", 11, 1.0), ("passive_voice", 100, 0.0)], "type string, total int, rate double")
    got = issues.score_confidence(i, queries_issues.BASE.df(spark), queries_issues.FACTORS.df(spark), rates)
    assert {r.issue_id: r.confidence for r in got.collect()} == {1: 1.0, 2: 0.5, 3: 0.47, 4: 1.0, 5: 0.3, 6: 0.55, 7: 0.55}
    known = i.select("issue_id", "type").join(got, "issue_id")
    levels = {level: {r.issue_id: r.decision for r in issues.display_for_level(known, level).collect()} for level in ("minimal", "standard", "all")}
    assert levels["all"] == {1: "show", 2: "suggest", 3: "hide", 4: "show", 5: "hide", 6: "suggest", 7: "suggest"}
    assert levels["standard"] == levels["all"] | {2: "hide", 6: "hide"} and levels["minimal"] == levels["standard"]
    empty = spark.createDataFrame([], "type string, base double")
    assert {r.confidence for r in issues.score_confidence(i.where("issue_id = 2"), empty, queries_issues.FACTORS.df(spark).limit(0), rates).collect()} == {0.5}


def test_many_suggestions(spark):
    value = "ab " * 700
    i = spark.createDataFrame([(0, 3 * k, 3 * k + 2, "X") for k in range(700)] + [(0, 3 * k + 1, 3 * k + 2, "no") for k in range(700)], "doc_id long, start int, end int, suggestion string")
    got = issues.apply_suggestions(docs(spark, value), i).first()
    assert (got.text, got.n_applied) == ("X " * 700, 700)


def test_golden_tokens(spark):
    t = text.tag_pos(text.tokenize_punct(docs(spark, "hei på deg. Hvordan har du det?", "Den bok er god.", "Jeg leser en boken.", "Han ikke spiserer.")))
    assert [(r.issue, r.suggestion) for r in issues.sentence_start_case(t).collect()] == [("hei", "Hei")]
    forms = spark.createDataFrame([("bok", "bok", "NOUN", "subst fem ent ub"), ("boken", "bok", "NOUN", "subst fem ent be")], "form string, lemma string, word_class string, tag string")
    got = {(r.doc_id, r.type, r.issue) for r in issues.definite_form(t, forms).collect()}
    assert got == {(1, "missing-definite-form", "bok"), (2, "indefinite-article-with-definite-form", "boken")}
    assert [r.type for r in issues.negation_position(issues.with_sentences(t)).collect()] == ["negation-before-verb"]


def test_apply_suggestions(spark):
    i = spark.createDataFrame([(0, 0, 2, "XX"), (0, 1, 3, "no"), (0, 4, 5, "Y"), (0, 4, 6, "ZZZ")], "doc_id long, start int, end int, suggestion string")
    got = issues.apply_suggestions(docs(spark, "ab cdefg"), i).first()
    assert (got.text, got.n_applied) == ("XX cZZZfg", 2)  # the longer of two that start together
    assert issues.apply_suggestions(docs(spark, "ab cdefg"), i.limit(1), mark=True).first().text == "[ab] cdefg"


def test_near_terms_of_long_words(spark):
    long = "abcdefghij" * 4
    w = spark.createDataFrame([(long,), ("kort",)], "word string")
    t = spark.createDataFrame([(long[:5] + "X" + long[5:],), (long[1:-1],), (long[::-1],), ("kart",), ("kor",)], "term string")
    got = {(r.word[:4], r.term[:4], r.distance) for r in lexicon.near_terms(w, t).collect()}
    assert got == {("abcd", "abcd", 1), ("abcd", "bcde", 2), ("kort", "kart", 1), ("kort", "kor", 1)}


def test_rule_tables_are_checked(spark):
    with pytest.raises(ValueError):
        checked_small(spark.range(20), 10)


def test_checkers_are_isolated(spark):
    r = registry_ext.CheckerRegistry()
    r.register("bad", lambda d: d.select("nothing"))
    r.register("good", lambda d: d.select("doc_id"))
    assert r.run(docs(spark, "a")).count() == 1 and list(r.failed) == ["bad"]


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"domains": [{"name": "a.no", "isActive": True, "lastChecked": "2024-01-01T00:00:00Z", "history": [{"timestamp": "2024-01-01T00:00:00Z", "isWebsiteUp": True, "isRegistered": True}]}, {"name": "b.no"}]}, indent=1))
    reg = files.read_domain_registry(spark, str(tmp_path / "r.json"))
    assert sorted((r.name, r.n_history) for r in reg.collect()) == [("a.no", 1), ("b.no", 0)]
    assert files.read_domain_registry(spark, str(tmp_path / "r.json"), history=True).count() == 2
    files.write_domain_registry(reg, str(tmp_path / "out"), "now")
    assert files.read_domain_registry(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "l.tsv").write_text("# x\na\tb\n1\t2\n\n# y\n3\t4\n")
    assert [tuple(r) for r in files.read_lexicon_tsv(spark, str(tmp_path / "l.tsv"), ["b", "a"]).collect()] == [("2", "1"), ("4", "3")]
    with pytest.raises(ValueError):
        files.read_lexicon_tsv(spark, str(tmp_path / "l.tsv"), ["c"])
    (tmp_path / "c.json").write_text(json.dumps([{"category": "x", "purpose": "p", "words": ["a", "b"]}], indent=1))
    assert files.read_category_lexicon(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "t.dat").write_text("UTF-8\nbil|1\n-|kjøretøy|vogn\nhus|1\n-|bolig\n")
    assert {tuple(r) for r in files.read_thesaurus(spark, str(tmp_path / "t.dat")).collect()} == {("bil", "kjøretøy"), ("bil", "vogn"), ("hus", "bolig")}
    (tmp_path / "x-latin1.txt").write_bytes("ISO-8859-1\nblåbær".encode("latin-1"))
    assert files.read_text_encoded(spark, str(tmp_path / "x-latin1.txt")).first().text.endswith("blåbær")
    (tmp_path / "w.json").write_text(json.dumps({"words": {"no": {"ord": {"addedBy": "u", "category": "c"}}}}, indent=1))
    custom = files.read_custom_words(spark, str(tmp_path / "w.json"))
    files.write_custom_words(custom, str(tmp_path / "w2"))
    assert [r.word for r in files.read_custom_words(spark, str(tmp_path / "w2")).collect()] == ["ord"]
    (tmp_path / "tb.json").write_text(json.dumps({"sentences": [{"text": "a b", "words": [{"pos": "N"}, {"pos": "V"}], "dependencies": [{"dep": "a", "gov": "b", "rel": "r"}]}]}, indent=1))
    words, deps = files.read_treebank(spark, str(tmp_path / "tb.json"))
    assert words.count() == 2 and deps.first().rel == "r"


def test_requests(spark):
    raw = spark.createDataFrame([('{"id":"1","text":"a"}',), ('{"id":"2","content":{"text":"b"}}',), ('{"id":"3","text":" "}',), ("nope",)], "value string")
    assert sorted((r.id or "", r.text, r.error) for r in files.parse_requests(raw).collect()) == [("", None, "bad_json"), ("1", "a", None), ("2", "b", None), ("3", " ", "empty_text")]


def run_stream(spark, df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_readability_stream(spark, tmp_path):
    d = docs(spark, "a bb ccccccc. d!", "e f")
    d.write.parquet(str(tmp_path / "d"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "d"))
    assert sorted((r.doc_id, r.lix) for r in run_stream(spark, streams.stream_readability(s), "lix", "append")) == [(0, 27.0), (1, 2.0)]
    assert {(r.word, r.n) for r in run_stream(spark, streams.online_word_counts(s), "counts", "complete")} == {(w, 1) for w in "a bb ccccccc d e f".split()}


def test_plans_have_no_python_or_cartesian(spark):
    for name in ("c4_classify", "c9_recommend", "d14_fuzzy_candidates", "f14_merge_issues"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "EvalPython" not in plan and "CartesianProduct" not in plan


def test_small_pieces(spark):
    assert nlp.extractive_summary(docs(spark, "kort", None)).count() == 2
    assert feedback.trust_scores(spark.createDataFrame([(1, 1, 1, True)], "event_id int, ts int, user_id int, positive boolean")).first().trust == 1.0


def test_registry_without_a_working_checker(spark):
    from textlens.plans.registry_ext import CheckerRegistry

    registry = CheckerRegistry()
    registry.register("bad", lambda docs: docs.select("no_such_column"))
    assert registry.run(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect() == [] and "bad" in registry.failed


def test_fuzzy_candidates_by_brute_force(spark):
    from textlens.operators.lexicon import fuzzy_candidates

    words = ["abcdef", "abcdxf", "abcef", "abc", "ab", "abxdef", "abcdefgh", "abc" + "q" * 40, "abc" + "q" * 29]
    vocab = ["abcdef", "abcde", "abcdefg", "abcq", "ab", "abc" + "q" * 39 + "r", "abc" + "q" * 31]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = []
    for w in words:
        near = [(0, w)] if w in vocab else sorted((distance(w, v), v) for v in vocab if w[:3] == v[:3] and distance(w, v) <= 2)[:5]
        want += [(w, v, n) for n, v in near]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    assert sorted((r.word, r.candidate, r.distance) for r in fuzzy_candidates(frame(words), frame(vocab)).collect()) == sorted(want)
