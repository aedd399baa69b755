"""What is not shuffled: tokens of texts that are dealt by document, keys of words that meet few terms."""

from pyspark.sql import functions as F

from textlens.operators import issues, lexicon, readability
from textlens.operators import text as op


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def texts(spark):
    return spark.createDataFrame([(1, "Den boken er 3 hus. to hus og 4x hus"), (2, None), (None, "x y")], "doc_id long, text string").repartition("doc_id")


def test_word_analysis_deals_texts_only(spark):
    df = readability.word_analysis(texts(spark), limit=3)
    assert "Join" not in plan(df) and plan(df).count("Exchange") == 1
    assert sorted((r.tok_id, r.form, r.frequency, r.frequency_rank) for r in df.collect()) == [(0, "Den", 1, 2), (1, "boken", 1, 3), (2, "er", 1, 4)]


def test_few_terms_are_broadcast(spark):
    words = spark.range(2000).select(F.concat(F.lit("ord"), F.col("id").cast("string")).alias("word"))
    df = lexicon.near_terms(words, spark.createDataFrame([("ord1999",)], "term string"), 1)
    assert "_k" not in "".join(x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x)
    assert df.where("distance = 0").count() == 1 and df.count() == 30  # itself, three digits by nine others, two without a digit


def test_heads_by_place_or_id(spark):
    """Ids from 1, with gaps, repeated, and heads that aren't there: as a join on the head would find them."""
    rows = [(1, 0, 1, "den", "DET", 2, "det", {"Gender": "Masc"}), (1, 0, 2, "hus", "NOUN", 0, "root", {"Gender": "Neut"}), (1, 1, 3, "en", "DET", 7, "det", {"Number": "Sing"}), (1, 1, 7, "biler", "NOUN", 0, "root", {"Number": "Plur"}),
            (2, 0, 1, "et", "DET", 2, "det", {"Gender": "Neut"}), (2, 0, 2, "bok", "NOUN", 0, "root", {"Gender": "Fem"}), (2, 0, 2, "jente", "NOUN", 0, "root", {"Gender": "Fem"}), (3, 0, 1, "et", "DET", 9, "det", {"Gender": "Neut"}), (3, 0, 2, "bok", "NOUN", 1, "det", None), (4, 0, 1, "et", "DET", None, "det", {})]
    p = spark.createDataFrame(rows, "doc_id long, sent_id int, id int, form string, upos string, head int, deprel string, feats map<string,string>")
    df = issues.determiner_agreement(p)
    assert "Join" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [(1, 0, 1, "den hus"), (1, 1, 3, "en biler"), (2, 0, 1, "et bok"), (2, 0, 1, "et jente")]


def test_numerals_are_cast_only_if_digits(spark):
    forms = spark.createDataFrame([("hus", "hus", "NOUN", "subst noyt ent ub")], "form string, lemma string, word_class string, tag string")
    df = issues.noun_form(op.tokenize_punct(texts(spark)), forms)
    assert "RLIKE" in plan(df).upper() and sorted(r.tok_id for r in df.collect()) == [4, 7]


TEXTS = ["Den boken er 3 hus. å og! å spise? vis 4x «hus» 12 9\uffff9 de", None, "", " . \n..  ", "jeg\n\nliker å. fisk", "Ø og Å vi liker en stor bil fordi hun leser", "the rig is 12, er rig bok rig. That dog was ibly", "İstanbul ΟΔΟΣ å K 😀 rer."]


def sentences(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition("doc_id")
    return docs, op.tag_sentences(docs)


def test_tagged_sentences_as_by_windows(spark):
    """Tags, sentences and token numbers as windows over the text's tokens give them, without a sort."""
    docs, s = sentences(spark)
    df = op.explode_sentences(s)
    assert "Window" not in plan(df) and "Sort" not in plan(df) and plan(df).count("Exchange") == 1
    want = issues.with_sentences(op.tag_pos(op.tokenize_punct(docs))).select(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) and df.count() > 50 and df.dtypes == want.dtypes


def test_queries_on_sentences_sort_no_tokens(spark, monkeypatch):
    from textlens.plans import queries_issues as qi
    from textlens.plans import queries_lexicon as ql

    monkeypatch.setattr(ql, "docs", lambda s, d: sentences(spark)[0])
    from textlens.plans import QUERIES

    for name, most in (("d21_pos_ngrams", 3), ("d22_score_pos_sequence", 2), ("d23_word_relations", 2), ("f12b_v2", 2), ("f12c_adjective", 2), ("f12d_unusual_order", 2), ("f13a_determiner", 2), ("f13b_subject_verb", 2)):
        p = plan(QUERIES[name](spark, ""))
        assert not any(x in p for x in ("Window", "Sort", "Join")) and p.count("Exchange") <= most, name
    assert qi.sentences is ql.sentences


def test_more_triples_than_a_task_holds(spark, monkeypatch):
    _, s = sentences(spark)
    known = lexicon.pos_ngrams(s.where("doc_id % 2 = 0"))
    columns = ("doc_id", "sent_id", "n", "known", "share", "unusual")
    few = lexicon.score_pos_sequence(s, known).select(*columns)
    monkeypatch.setattr(lexicon, "MAX_THETA_ROWS", 3)
    many = lexicon.score_pos_sequence(s, known).select(*columns)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.where("known > 0 and known < n").count() and few.dtypes == many.dtypes
    assert lexicon.score_pos_sequence(s, known.limit(0)).where("known = 0").count() == few.count()


def test_words_of_the_dependencies_themselves(spark):
    d = spark.createDataFrame([(1, "Den", "boken", "det"), (2, "den", "er", "det"), (2, "İ", None, "x")], "sent_id long, dep string, gov string, rel string")
    df = lexicon.word_relations(None, d)
    assert "Join" not in plan(df)
    assert sorted(map(str, df.collect())) == sorted(map(str, lexicon.word_relations(d.select(F.lower("dep").alias("word")).distinct(), d).collect()))


def test_heads_beside_their_tokens(spark):
    """Tokens with their heads beside them give what a look-up in the sentence gives, without a grouping."""
    rows = [(1, 0, 1, "den", "DET", 2, "det", {"Gender": "Masc"}), (1, 0, 2, "hus", "NOUN", 0, "root", {"Gender": "Neut"}), (1, 1, 1, "en", "DET", 2, "det", {"Number": "Sing"}), (1, 1, 2, "biler", "NOUN", 0, "root", {"Number": "Plur"}), (2, 0, 1, "en", "DET", 2, "det", None), (2, 0, 2, "bil", "NOUN", 0, "root", {"Gender": "Masc"})]
    p = spark.createDataFrame(rows, "doc_id long, sent_id int, id int, form string, upos string, head int, deprel string, feats map<string,string>")
    h = p.select("doc_id", "sent_id", F.col("id").alias("head"), *[F.col(c).alias(f"h_{c}") for c in ("form", "upos", "feats")])
    df = issues.determiner_agreement(p.join(F.broadcast(h), ["doc_id", "sent_id", "head"], "left"))
    assert "Aggregate" not in plan(df)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, issues.determiner_agreement(p).collect())) == [(1, 0, 1, "den hus"), (1, 1, 1, "en biler")]
