"""Queries of groups A to C over `documents`, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import readability as rd
from ..operators import text as op
from . import tables as tb
from .literal import Literal
from .registry import query, table

W = r"[\p{L}\p{M}\p{N}_]+"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _not_blank(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


WORDS = f"regexp_extract_all(coalesce(text, ''), '{W}')"
ENDS = _not_blank(r"""regexp_split_to_array(coalesce(text, ''), '[.!?]+["»]?|\n\n')""")
AFTER = _not_blank(r"string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")
RUNS = _not_blank(r"regexp_split_to_array(coalesce(text, ''), '[.!?]+')")
PARS = _not_blank(r"regexp_split_to_array(" + STRIP.format("coalesce(text, '')") + r", '\n')")


def longer(words: str, n: int) -> str:
    return f"len(list_filter({words}, lambda w: length(w) >= {n}))"


def letters(words: str) -> str:
    return f"coalesce(list_sum(list_transform({words}, lambda w: length(w))), 0)::INT"


def exploded(expr: str, index: str, name: str, source: str = "documents", keep: str = "doc_id") -> str:
    return f"SELECT {keep}, (unnest(range(len(l))))::INT AS {index}, unnest(l) AS {name} FROM (SELECT {keep}, {expr} AS l FROM {source})"


def docs(s, d):
    return table(s, d, "documents")


def by_document(texts):
    """Texts dealt by document: windows and groups over their tokens then need no shuffle, and texts are a tenth of them."""
    return texts.select("doc_id", "text").repartition("doc_id")


STATS = f"""
w AS (SELECT doc_id, lang, source, text, {WORDS} AS w, {ENDS} AS s FROM documents),
st AS (SELECT doc_id, lang, source, text, len(w)::INT AS n_words, len(s)::INT AS n_sentences, {longer('w', 7)}::INT AS n_long, {longer('w', 11)}::INT AS n_very_long, {letters('w')} AS n_letters FROM w),
sc AS (SELECT *, CASE WHEN n_words > 0 AND n_sentences > 0 THEN n_words / n_sentences + 100.0::DOUBLE * n_long / n_words ELSE 0 END AS lix,
  CASE WHEN n_sentences > 0 THEN n_long / n_sentences ELSE 0 END AS rix, CASE WHEN n_sentences > 0 THEN n_words / n_sentences ELSE 0 END AS avg_sentence_length,
  CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_long / n_words ELSE 0 END AS long_words_percentage FROM st)"""
BANDED = STATS + f""",
bands AS ({tb.BANDS.sql()}),
bd AS (SELECT sc.*, a.ord AS lix_ord, a.band AS lix_band, a.audience AS lix_audience, b.ord AS rix_ord, b.band AS rix_band, b.audience AS rix_audience FROM sc
  LEFT JOIN bands a ON a.index = 'lix' AND sc.lix >= a.lo AND sc.lix < a.hi LEFT JOIN bands b ON b.index = 'rix' AND sc.rix >= b.lo AND sc.rix < b.hi)"""


def scores(s, d):
    return rd.rix(rd.lix(rd.text_statistics(docs(s, d).select("doc_id", "lang", "source", "text"), simple=True)))


def banded(s, d, f=None):
    x, bands = (f or scores)(s, d), tb.BANDS.df(s)
    return rd.classify(rd.classify(x, bands, "lix", "lix"), bands, "rix", "rix")


@query("a1_read_corpus", rf"SELECT doc_id, CASE WHEN {STRIP.format('''coalesce(text, '')''')} = '' THEN 'failed: Empty content' ELSE 'ok' END AS status, length(text)::INT AS n FROM documents")
def _(s, d):
    from ..sources.files import read_corpus

    return read_corpus(s, f"{d}/documents.parquet").select("doc_id", "status", F.char_length("text").alias("n"))


for _policy, _sql in (("unicode", W), ("nordic", "[a-zA-ZæøåÆØÅ0-9]+"), ("spell", r"[^\s,.;!?\"''()]+".replace('\\"', '"'))):

    @query(f"b1_tokenize_{_policy}", f"SELECT *, lower(form) AS lower FROM ({exploded(f'''regexp_extract_all(coalesce(text, ''), '{_sql}')''', 'tok_id', 'form')})")
    def _(s, d, policy=_policy):
        return op.tokenize(docs(s, d), policy)


@query("b2_offsets", rf"""WITH p AS (SELECT doc_id, (unnest(range(len(f))))::INT AS tok_id, unnest(g) AS gap, unnest(f) AS form FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '((?s:.*?))({W})', 1) AS g, regexp_extract_all(coalesce(text, ''), '((?s:.*?))({W})', 2) AS f FROM documents)),
e AS (SELECT *, sum(length(gap) + length(form)) OVER (PARTITION BY doc_id ORDER BY tok_id) AS e FROM p)
SELECT doc_id, tok_id, form, (e - length(form))::BIGINT AS start, e::BIGINT AS "end" FROM e""")
def _(s, d):
    return op.tokenize_with_offsets(docs(s, d))


PUNCT_TOKENS = r"""pt AS (SELECT *, lower(form) AS lower, CASE WHEN regexp_full_match(form, '[.,;:!?"''()\[\]{}«»]') THEN 'punct' WHEN regexp_full_match(form, '[0-9]+') THEN 'number' ELSE 'word' END AS kind FROM (
  SELECT doc_id, (unnest(range(len(l))))::INT AS tok_id, unnest(l) AS form FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[.,;:!?"''()\[\]{}«»]|[^\s.,;:!?"''()\[\]{}«»]+') AS l FROM documents)))"""


@query("b3_tokenize_punct", f"WITH {PUNCT_TOKENS} SELECT * FROM pt")
def _(s, d):
    return op.tokenize_punct(docs(s, d))


for _policy, _sql in (("ends", ENDS), ("after", AFTER), ("runs", RUNS), ("scan", _not_blank("regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]*')"))):

    @query(f"b4_sentences_{_policy}", exploded(_sql, "sent_id", "sentence"))
    def _(s, d, policy=_policy):
        return op.split_sentences(docs(s, d), policy)


BLANKS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"
ABBR = Literal("abbreviation string", tuple((a,) for a in (*op.ABBREVIATIONS, "the.", "ou.", "en.")))


@query("b5_sentences_abbrev", rf"""WITH a AS ({ABBR.sql()}), t AS ({exploded(BLANKS, 'tok_id', 'form')}),
m AS (SELECT t.*, (regexp_matches(form, '[.!?]$') AND NOT lower(form) IN (SELECT abbreviation FROM a))::INT AS e FROM t),
i AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sent_id FROM m)
SELECT doc_id, sent_id, string_agg(form, ' ' ORDER BY tok_id) AS sentence FROM i GROUP BY ALL""")
def _(s, d):
    return op.split_sentences_abbrev(docs(s, d), ABBR.df(s))


@query("b6_paragraphs", exploded(PARS, "par_id", "paragraph"))
def _(s, d):
    return op.split_paragraphs(docs(s, d), r"\n")


@query("b7_chunks")
def _(s, d):
    return op.chunk_documents(docs(s, d), 1000)


def _case(lists) -> str:
    return " ".join(f"WHEN lower IN ({', '.join(repr(x) for x in ws)}) THEN '{k}'" for k, ws in lists.items())


TAGGED = PUNCT_TOKENS + f""", tg AS (SELECT *, CASE WHEN kind = 'punct' THEN 'PUNCT' WHEN kind = 'number' THEN 'NUM' {_case(op.CLOSED)}
  WHEN lag(lower) OVER (PARTITION BY doc_id ORDER BY tok_id) = 'å' THEN 'VERB' WHEN regexp_matches(lower, '(erer|ere|ed|ing)$') THEN 'VERB'
  WHEN regexp_matches(lower, '(lig|ig|sk|able|ible)$') THEN 'ADJ' WHEN regexp_matches(lower, '(vis|ly)$') THEN 'ADV' ELSE 'NOUN' END AS pos FROM pt)"""


@query("b8_tag_pos", f"WITH {TAGGED} SELECT * FROM tg")
def _(s, d):
    return op.tag_pos(op.tokenize_punct(docs(s, d)))


@query("b9_normalize", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(
  replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '“”„«»‘’–—', repeat(chr(34), 5) || repeat(chr(39), 2) || '--'), '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def _(s, d):
    return op.normalize_text(docs(s, d))


@query("b10_spell_skip", r"""SELECT doc_id, tok_id, form, lower(form) AS lower FROM (""" + exploded(r"""regexp_extract_all(coalesce(text, ''), '[^\s,.;!?"''()]+')""", "tok_id", "form") + r""")
WHERE NOT (regexp_matches(form, '^[0-9]+([.,][0-9]+)*$') OR regexp_matches(form, '^(https?://|www\.)') OR regexp_matches(form, '^[^@\s]+@[^@\s]+\.[^@\s]+$') OR regexp_matches(form, '^[#@]') OR regexp_matches(form, '^[0-9]{4}$') OR regexp_matches(form, '^\+?[0-9]{8,}$'))""")
def _(s, d):
    return op.spell_skip_filter(op.tokenize(docs(s, d), "spell"), "no")


HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z]+://', ''), '[/?#:].*$', '', 's'), '^www\.', '')"


@query("b11_clean_domain", f"SELECT page_id, {HOST} AS domain FROM pages")
def _(s, d):
    return op.clean_domain(table(s, d, "pages"), "url").select("page_id", "domain")


CONTACTS = Literal("id int, domain string, email string, phone string, url string", ((1, "a.no", "a@b.no", "+4712345678", "http://a.no/"), (2, "-a.no", "a b@c.no", "12345", "ftp://x"), (3, None, None, None, None), (4, "x.y.co.uk", "a@b", "+0123", "https://x.y/z")))


@query("b12_validate", rf"""WITH c AS ({CONTACTS.sql()} UNION ALL SELECT 1000 + page_id::INT, {HOST}, 'p@' || {HOST}, NULL, url FROM pages)
SELECT id, array_to_string(list_filter([CASE WHEN NOT coalesce(regexp_matches(domain, '{op.DOMAIN}'), false) THEN 'domain' END, CASE WHEN NOT coalesce(regexp_matches(email, '{op.EMAIL}'), false) THEN 'email' END,
 CASE WHEN NOT coalesce(regexp_matches(phone, '{op.PHONE}'), false) THEN 'phone' END, CASE WHEN NOT coalesce(regexp_matches(url, '{op.URL}'), false) THEN 'url' END], lambda x: x IS NOT NULL), ',') AS failed FROM c""")
def _(s, d):
    host = tx.clean_host(F.col("url"))
    pages = table(s, d, "pages").select((F.lit(1000) + F.col("page_id").cast("int")).alias("id"), host.alias("domain"), F.concat(F.lit("p@"), host).alias("email"), F.lit(None).cast("string").alias("phone"), "url")
    rules = {"domain": ("domain", op.DOMAIN), "email": ("email", op.EMAIL), "phone": ("phone", op.PHONE), "url": ("url", op.URL)}
    return op.validate(CONTACTS.df(s).union(pages), rules).select("id", F.array_join("failed", ",").alias("failed"))


@query("b13_keywords", f"WITH {PUNCT_TOKENS} SELECT DISTINCT doc_id, lower AS keyword FROM pt WHERE kind = 'word' AND length(lower) > 2")
def _(s, d):
    return op.extract_keywords(docs(s, d))


@query("b14_tag_lexicon", f"""WITH {PUNCT_TOKENS}, x AS ({tb.LEXICON.sql()}), k AS (SELECT lower(word) AS lower, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM x GROUP BY 1)
SELECT pt.*, k.lower IS NOT NULL AS is_stopword, coalesce(categories, '') AS categories FROM pt LEFT JOIN k USING (lower)""")
def _(s, d):
    return op.tag_lexicon(op.tokenize_punct(docs(s, d)), tb.LEXICON.df(s))


@query("c1_text_statistics", f"""WITH {STATS}, p AS (SELECT doc_id, len({PARS})::INT AS n_paragraphs FROM documents)
SELECT doc_id, n_words, n_sentences, n_long, n_very_long, n_letters, n_paragraphs, avg_sentence_length, long_words_percentage, CASE WHEN n_words > 0 THEN n_letters / n_words ELSE 0 END AS avg_word_length,
 CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_very_long / n_words ELSE 0 END AS very_long_words_percentage FROM sc JOIN p USING (doc_id)""")
def _(s, d):
    return rd.text_statistics(docs(s, d).select("doc_id", "text"), paragraph_separator=r"\n").drop("text")


@query("c2_lix", f"WITH {STATS} SELECT doc_id, lix FROM sc")
def _(s, d):
    return scores(s, d).select("doc_id", "lix")


@query("c3_rix", f"WITH {STATS} SELECT doc_id, rix FROM sc")
def _(s, d):
    return scores(s, d).select("doc_id", "rix")


@query("c4_classify", f"WITH {BANDED} SELECT doc_id, lix_ord, lix_band, lix_audience, rix_ord, rix_band, rix_audience FROM bd")
def _(s, d):
    return banded(s, d).select("doc_id", "lix_ord", "lix_band", "lix_audience", "rix_ord", "rix_band", "rix_audience")


@query("c5_combined", f"""WITH {BANDED} SELECT doc_id, CASE WHEN lix_ord = rix_ord THEN 'consistent ' || lix_band WHEN abs(lix_ord - rix_ord) = 1 THEN 'mainly ' || lix_band || ' to ' || rix_band
 WHEN lix > 40 AND rix < 2.5 THEN 'short sentences with long words' WHEN lix < 30 AND rix > 3.5 THEN 'short words in long sentences' ELSE 'mixed: LIX ' || lix_band || ', RIX ' || rix_band END AS agreement FROM bd""")
def _(s, d):
    return rd.combined_description(banded(s, d)).select("doc_id", "agreement")


def _syl(vowels: str, word: str) -> str:
    return f"greatest(1, len(regexp_extract_all({word}, '[{vowels}]+')))"


SYL = {
    lang: f"""w AS (SELECT doc_id, length({STRIP.format("coalesce(text, '')")})::INT AS n_chars_trimmed, len({RUNS})::INT AS n_sentences, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS w FROM documents),
sy AS (SELECT *, list_transform(w, lambda x: {_syl(v, x)}) AS y FROM w),
ss AS (SELECT doc_id, n_chars_trimmed, n_sentences, len(w)::INT AS n_words, {longer('w', 7)}::INT AS n_long, {letters('w')} AS n_letters, coalesce(list_sum(y), 0)::INT AS n_syllables, len(list_filter(y, lambda x: x >= 3))::INT AS n_complex FROM sy)"""
    for lang, v, x in (("no", "aeiouyæøå", "x"), ("en", "aeiouy", "regexp_replace(x, 'e$', '')"))
}
for _lang in SYL:

    @query(f"c6_syllables_{_lang}", f"WITH {SYL[_lang]} SELECT * FROM ss")
    def _(s, d, lang=_lang):
        return rd.syllable_stats(docs(s, d), lang)


INDEX = SYL["en"] + """, ix AS (SELECT *, CASE WHEN n_sentences > 0 THEN 1.043::DOUBLE * sqrt(n_complex * (30 / n_sentences)) + 3.1291::DOUBLE ELSE 0 END AS smog,
 CASE WHEN n_words > 0 THEN 0.0588::DOUBLE * (n_letters / n_words * 100) - 0.296::DOUBLE * (n_sentences / n_words * 100) - 15.8::DOUBLE ELSE 0 END AS coleman_liau,
 CASE WHEN n_words > 0 AND n_sentences > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (n_words / n_sentences) - 84.6::DOUBLE * (n_syllables / n_words) ELSE 0 END AS flesch,
 CASE WHEN n_words > 0 AND n_sentences > 0 THEN 0.39::DOUBLE * (n_words / n_sentences) + 11.8::DOUBLE * (n_syllables / n_words) - 15.59::DOUBLE ELSE 0 END AS flesch_kincaid,
 CASE WHEN n_words > 0 AND n_sentences > 0 THEN 0.4::DOUBLE * ((n_words / n_sentences) + 100 * (n_complex / n_words)) ELSE 0 END AS fog,
 CASE WHEN n_words > 0 AND n_sentences > 0 THEN 4.71::DOUBLE * (n_chars_trimmed / n_words) + 0.5::DOUBLE * (n_words / n_sentences) - 21.43::DOUBLE ELSE 0 END AS ari,
 CASE WHEN n_words > 0 AND n_sentences > 0 THEN n_words / n_sentences + 100.0::DOUBLE * n_long / n_words ELSE 0 END AS lix FROM ss)"""


def indices(s, d):
    return rd.readability_indices(rd.syllable_stats(docs(s, d), "en"))


@query("c7_indices", f"WITH {INDEX} SELECT doc_id, smog, coleman_liau, flesch, flesch_kincaid, fog, ari, lix FROM ix")
def _(s, d):
    return indices(s, d).select("doc_id", "smog", "coleman_liau", "flesch", "flesch_kincaid", "fog", "ari", "lix")


@query("c8_difficulty", f"""WITH {INDEX} SELECT doc_id, CASE WHEN lix < 25 THEN 'very_easy' WHEN lix < 35 THEN 'easy' WHEN lix < 45 THEN 'medium' WHEN lix < 55 THEN 'difficult' ELSE 'very_difficult' END AS lix_level,
 CASE WHEN flesch > 90 THEN 'very_easy' WHEN flesch > 80 THEN 'easy' WHEN flesch > 70 THEN 'fairly_easy' WHEN flesch > 60 THEN 'medium' WHEN flesch > 50 THEN 'fairly_difficult' WHEN flesch > 30 THEN 'difficult' ELSE 'very_difficult' END AS flesch_level,
 CASE WHEN flesch_kincaid < 6 THEN 'elementary' WHEN flesch_kincaid < 10 THEN 'middle_school' WHEN flesch_kincaid < 13 THEN 'high_school' WHEN flesch_kincaid < 16 THEN 'college' ELSE 'graduate' END AS education_level,
 CASE WHEN flesch_kincaid < 6 THEN '6-11' WHEN flesch_kincaid < 10 THEN '11-14' WHEN flesch_kincaid < 13 THEN '14-18' WHEN flesch_kincaid < 16 THEN '18-22' ELSE '22+' END AS age_group,
 0.4::DOUBLE * (least(100, greatest(0, lix)) / 10) + 0.3::DOUBLE * ((100 - least(100, greatest(0, flesch))) / 10) + 0.3::DOUBLE * (least(20, greatest(0, flesch_kincaid)) / 2) AS complexity FROM ix""")
def _(s, d):
    return rd.difficulty(indices(s, d)).select("doc_id", "lix_level", "flesch_level", "education_level", "age_group", "complexity")


@query("c9_recommend", f"""WITH {STATS}, r AS ({tb.RECOMMENDATION_RULES.sql()}), m AS (SELECT doc_id, 'lix' AS metric, lix AS value FROM sc UNION ALL SELECT doc_id, 'rix', rix FROM sc
 UNION ALL SELECT doc_id, 'avg_sentence_length', avg_sentence_length FROM sc UNION ALL SELECT doc_id, 'long_words_percentage', long_words_percentage FROM sc),
h AS (SELECT doc_id, type, title, CASE WHEN value > high THEN 'high' ELSE impact END AS impact FROM m JOIN r ON m.metric = r.metric AND value > threshold AND (purpose IS NULL OR purpose = 'education'))
SELECT * FROM h UNION ALL SELECT doc_id, 'positive_feedback', CASE WHEN lix < 30 THEN 'Utmerket lesbarhet' ELSE 'God lesbarhet' END, 'low' FROM sc WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def _(s, d):
    return rd.recommend(scores(s, d), tb.RECOMMENDATION_RULES.df(s), "education")


SENT = f"""se AS (SELECT doc_id, sent_id, regexp_extract_all(sentence, '{W}') AS w FROM ({exploded(AFTER, 'sent_id', 'sentence')})),
sa AS (SELECT doc_id, sent_id, len(w)::INT AS n_words, {longer('w', 7)}::INT AS n_long, {longer('w', 10)}::INT AS n_very_long, array_to_string(list_filter(w, lambda x: length(x) >= 10)[1:3], ', ') AS first_very_long,
 CASE WHEN len(w) > 0 THEN {letters('w')} / len(w) ELSE 0 END AS avg_word_length, CASE WHEN len(w) > 0 THEN len(w) + 100.0::DOUBLE * {longer('w', 7)} / len(w) ELSE 0 END AS lix FROM se),
sl AS (SELECT *, CASE WHEN n_words = 0 THEN 'N/A' WHEN lix > 60 THEN 'svært kompleks' WHEN lix > 50 THEN 'kompleks' WHEN lix > 40 THEN 'moderat' ELSE 'enkel' END AS level, CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_long / n_words ELSE 0 END AS share FROM sa)"""


@query("c10_sentence_analysis", f"WITH {SENT} SELECT * EXCLUDE (share) FROM sl")
def _(s, d):
    return rd.sentence_analysis(docs(s, d))


@query("c11_sentence_issues", f"""WITH {SENT}, i AS (SELECT doc_id, sent_id, unnest([CASE WHEN n_words > 25 THEN 'long_sentence|high|split the sentence' WHEN n_words > 20 THEN 'medium_sentence|medium|split the sentence' END,
 CASE WHEN share > 30 THEN 'long_words|' || CASE WHEN share > 40 THEN 'high' ELSE 'medium' END || '|' || CASE WHEN n_very_long > 0 THEN 'replace: ' || first_very_long ELSE 'use shorter synonyms' END END]) AS x FROM sl)
SELECT doc_id, sent_id, split_part(x, '|', 1) AS type, split_part(x, '|', 2) AS severity, split_part(x, '|', 3) AS tip FROM i WHERE x IS NOT NULL""")
def _(s, d):
    return rd.sentence_issues(rd.sentence_analysis(docs(s, d)))


TOK = f"tk AS (SELECT *, lower(form) AS lower FROM ({exploded(WORDS, 'tok_id', 'form')}))"
FREQ = TOK + """, fq AS (SELECT doc_id, lower, count(*) AS frequency, min(tok_id) AS f FROM tk GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, f) AS rk, count(*) OVER (PARTITION BY doc_id) AS nd FROM fq)"""


@query("c12_word_analysis", f"""WITH {FREQ} SELECT doc_id, tok_id, form, frequency, rk::INT AS frequency_rank, frequency / nd AS freq_per_distinct,
 0.4::DOUBLE * (1 - rk / nd) + 0.3::DOUBLE * (length(form) / 12) + 0.3::DOUBLE * CASE WHEN length(form) >= 7 THEN 1 ELSE 0.5 END AS significance,
 CASE WHEN length(form) <= 3 THEN 'kort' WHEN length(form) >= 10 THEN 'svært lang' WHEN length(form) >= 7 THEN 'lang' ELSE 'vanlig' END AS style,
 CASE WHEN length(form) >= 10 AND frequency <= 1 THEN 'kompleks' WHEN length(form) >= 7 AND frequency <= 2 THEN 'moderat' ELSE 'enkel' END AS complexity
FROM tk JOIN fr USING (doc_id, lower) WHERE tok_id < 200""")
def _(s, d):
    return rd.word_analysis(by_document(docs(s, d)))


for _unit, _sql in (("word", f"SELECT doc_id, length(form)::INT AS length, count(*) AS n FROM tk GROUP BY ALL"), ("sentence", f"SELECT doc_id, len(regexp_extract_all(sentence, '{W}'))::INT AS length, count(*) AS n FROM ({exploded(ENDS, 'sent_id', 'sentence')}) GROUP BY ALL")):

    @query(f"c13_length_distribution_{_unit}", f"WITH {TOK} {_sql}")
    def _(s, d, unit=_unit):
        return rd.length_distribution(docs(s, d), unit)


@query("c14_most_common_words", f"WITH {FREQ} SELECT doc_id, lower AS word, frequency AS n, rk::INT AS rank FROM fr WHERE rk <= 15")
def _(s, d):
    return rd.most_common_words(docs(s, d))


@query("c15_corpus_diversity")
def _(s, d):
    """Words and distinct words of each language, by sketches of each source merged; no SQL, as estimates differ by engine."""
    from ..operators import sketches as sk

    t = docs(s, d).select("lang", "source", F.explode(tx.words(F.lower("text"))).alias("word"))
    merged = sk.estimate(sk.merge_sketches(sk.distinct_sketches(t, ["lang", "source"], "word"), ["lang"]))
    return merged.select("lang", F.col("n").alias("n_words"), "n_distinct", (F.col("n_distinct") / F.col("n")).alias("diversity"))


@query("c15_lexical_diversity", f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS w FROM documents)
SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END AS diversity FROM w""")
def _(s, d):
    return rd.lexical_diversity(docs(s, d))


@query("c16_word_batch_stats", f"""WITH t AS (SELECT lang, source, unnest({WORDS}) AS form FROM documents) SELECT lang, source, count(*) AS n_words, avg(length(form)) AS avg_length, min(length(form))::INT AS min_length, max(length(form))::INT AS max_length,
 100.0::DOUBLE * count_if(length(form) >= 7) / count(*) AS long_share FROM t GROUP BY ALL""")
def _(s, d):
    return rd.word_batch_stats(docs(s, d), ["lang", "source"])


@query("c17_progressive", f"""WITH p AS ({exploded(PARS, 'par_id', 'text')}), q AS (SELECT doc_id, par_id, len({WORDS}) AS w, greatest(1, len({ENDS})) AS s, {longer(WORDS, 7)} AS l FROM p),
r AS (SELECT doc_id, par_id, sum(w) OVER x AS w, sum(s) OVER x AS s, sum(l) OVER x AS l, count(*) OVER (PARTITION BY doc_id) AS n FROM q WINDOW x AS (PARTITION BY doc_id ORDER BY par_id ROWS UNBOUNDED PRECEDING))
SELECT doc_id, par_id, CASE WHEN w > 0 THEN w / s + 100.0::DOUBLE * l / w ELSE 0 END AS lix, l / s AS rix, 100.0::DOUBLE * (par_id + 1) / n AS progress, par_id + 1 = n AS is_final FROM r WHERE par_id + 1 = n OR (par_id + 1) % 2 = 0""")
def _(s, d):
    return rd.progressive_readability(docs(s, d), 2, r"\n")


COMPLEX = Literal("word string, complexity double", (("the", 0.1), ("thstble", 0.9), ("und", 0.8), ("tion", 0.75), ("que", 0.2)))


@query("c18_grammar_statistics", f"""WITH {PUNCT_TOKENS}, c AS ({COMPLEX.sql()}), t AS (SELECT doc_id, pt.lower, CASE WHEN complexity IS NOT NULL THEN complexity > 0.7 ELSE length(pt.lower) > 7 END AS hard FROM pt LEFT JOIN c ON pt.lower = lower(word) WHERE kind = 'word')
SELECT doc_id, count(*) AS n_words, count(DISTINCT lower) AS n_distinct, count_if(hard) AS n_complex, greatest(0, least(100, 100.0::DOUBLE - 100.0::DOUBLE * count_if(hard) / count(*))) AS score FROM t GROUP BY doc_id""")
def _(s, d):
    return rd.grammar_statistics(op.tokenize_punct(docs(s, d)), COMPLEX.df(s))


@query("c19_batch_summary", f"""WITH {BANDED}, r AS (SELECT *, regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> '' AS ok FROM bd)
SELECT lang, source, count(*) AS total, count_if(ok) AS completed, count_if(NOT ok) AS failed, count_if(lix_ord >= 3) AS difficult FROM r GROUP BY ROLLUP (lang, source)""")
def c19(s, d):
    status = F.when(tx.strip(F.coalesce("text", F.lit(""))) == "", "failed: Empty content").otherwise("ok")
    return rd.batch_summary(banded(s, d).withColumn("status", status), "lang", "source")


@query("c20_simpler_words", f"WITH {TOK}, a AS ({tb.ALTERNATIVES.sql()} UNION ALL SELECT 'the', 'a' UNION ALL SELECT 'und', 'u'), c AS (SELECT lower, count(*) AS n FROM tk GROUP BY 1) SELECT word, alternative, n FROM c JOIN a ON c.lower = a.word")
def _(s, d):
    more = s.createDataFrame([("the", "a"), ("und", "u")], "word string, alternative string")
    return rd.simpler_words(op.tokenize(docs(s, d)), tb.ALTERNATIVES.df(s).union(more))


@query("lix_by_doc", f"WITH {BANDED} SELECT doc_id, lang, lix, rix, lix_band, rix_band FROM bd")
def lix_by_doc(s, d):
    """LIX, RIX and bands of every document."""
    return banded(s, d).select("doc_id", "lang", "lix", "rix", "lix_band", "rix_band")
