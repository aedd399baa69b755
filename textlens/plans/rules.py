"""Rule tables of the pattern scan. Patterns, words and their replacements. A word that ends in å has no \\b behind it,
which is a boundary of ASCII words."""

from __future__ import annotations

from .literal import Literal

COLUMNS = (
    "checker string, type string, pattern string, suggestion string, severity string, confidence double, requires string, unless string, "
    "lead string, find string, lookup string, before string, not_before string, after string, not_after string"
)
_OPTIONAL = ("requires", "unless", "lead", "find", "lookup", "before", "not_before", "after", "not_after")

VERB_LIKE = r"(?i)\b(?:er|var|har|hadde|skal|skulle|vil|ville|kan|kunne)\b|\w(?:er|te|de|t|dd)\b"
#: Nouns with their definite form, and present or infinitive forms with their past: looked up by the word of a hit.
FORMS = Literal("lookup string, word string, form string", (
    ("definite", "butikk", "butikken"), ("definite", "dag", "dagen"), ("definite", "uke", "uken"), ("definite", "måned", "måneden"), ("definite", "år", "året"), ("definite", "bil", "bilen"), ("definite", "hus", "huset"), ("definite", "bok", "boken"),
    ("past", "kjøper", "kjøpte"), ("past", "kommer", "kom"), ("past", "er", "var"), ("past", "gjør", "gjorde"), ("past", "venter", "ventet"), ("past", "vente", "ventet"), ("past", "trenger", "trengte"), ("past", "hjelpe", "hjalp"), ("past", "hjelper", "hjalp"),
    ("article", "dag", "en dag"), ("article", "butikk", "en butikk"),
))


def rule(checker: str, kind: str, pattern: str, suggestion: str | None = None, severity: str = "medium", confidence: float = 0.7, **more: str) -> tuple:
    return (checker, kind, pattern, suggestion, severity, confidence, *[more.get(k) for k in _OPTIONAL])


_LETTER = "[a-zæøåA-ZÆØÅ]"
_LAST_WORD = r"(?s:.*)[^\p{L}]"  # what stands before the last word of a hit

RULES: dict[str, tuple] = {
    "f1a_spacing": (
        rule("spacing", "missing_space", rf"[.!?;:,]{_LETTER}", "$1 $2", "low", 0.8, find="^(.)(.)$"),
        rule("spacing", "space_before", r"\s+[.!?;:,]", "", "low", 0.8, find=r"^\s+"),
        rule("spacing", "space_before_mark", rf"{_LETTER}\s+[.!?;:,]", "", "low", 0.8, find=r"\s+"),
    ),
    "f1b_repeats": (
        rule("punctuation", "repeated_mark", r"!{2,}", "!", "low", 0.9), rule("punctuation", "repeated_mark", r"\?{2,}", "?", "low", 0.9), rule("punctuation", "many_dots", r"\.{4,}", "...", "low", 0.7),
        rule("punctuation", "doubled", r",,+|;;+|::+|\(\(+|\)\)+", "$1", "low", 0.7, find="^(.).*$"),
    ),
    "f1c_abbreviations": (
        *[rule("abbreviation", "abbreviation", rf"\b{a}\b", b, "low", 0.9) for a, b in (("feks", "f.eks."), ("dvs", "d.v.s."), ("osv", "o.s.v."), ("mfl", "m.fl."))],
        *[rule("time", "split_time", rf"(?i)\b{a}\b", b, "medium", 0.9) for a, b in (("igår", "i går"), ("idag", "i dag"), ("imorgen", "i morgen"), ("iforgårs", "i forgårs"))],
        rule("time", "capitalization", r"(?i)\bigår\b", "I går", "medium", 0.6),
    ),
    "f1d_blanks": (
        rule("spacing", "double_blank", r"[ \t\n\r\f]{2,}", " ", "low", 0.9),
        rule("comma", "comma_before_conjunction", r"(?i)\w+\s+(?:og|men|eller)\s+\w+", "$1, $2", "low", 0.4, find=r"^(\w+)\s+(\w+\s+\w+)$"),
    ),
    "f1e_comma_context": (rule("comma", "comma_conjunction", rf"[^,;:.!?]\s+(?:og|men|eller|for)\s+{_LETTER}", "$1, $2", "medium", 0.5, find=r"^(.)\s+(\w+)\s+.$", before=VERB_LIKE, after=VERB_LIKE),),
    "f1f_prepositions": (
        rule("preposition", "decade", r"(?i)på \d+-tallet", "i $1", "medium", 0.7, find=r"^.. (.*)$"),
        rule("preposition", "weekday", r"(?i)i (?:mandag|tirsdag|onsdag|torsdag|fredag|lørdag|søndag)", "på $1", "medium", 0.7, find=r"^. (.*)$"),
        rule("preposition", "season", r"(?i)i sommer", "til sommeren", "medium", 0.5),
    ),
    "f1h_grammar": (
        rule("negation", "negation_before_verb", r"(?i)\b(?:det|han|hun|de|vi|jeg|du)\s+ikke\s+(?:er|var|har|hadde)\b", "$1 $3 $2", find=r"^(\w+)\s+(\w+)\s+(\w+)$"),
        rule("negation", "question_order", r"(?i)\b(?:hvorfor|når|hvor|hva|hvem|hvilken|hvordan)\s+\w+\s+ikke\s+\w+", "$1 $4 $2 $3", find=r"^([^\s]+)\s+(\w+)\s+(\w+)\s+(\w+)$"),
        rule("infinitive", "present_after_marker", r"(?:^|\s)[åÅ]\s+\w+er\b", "e", lead=_LAST_WORD, find="er$"),
        rule("definite", "bare_noun_after_preposition", r"(?i)\b(?:til|i|på|med|for|om|av|fra)\s+(?:butikk|dag|uke|måned|år|bil|hus|bok)\b", lead=_LAST_WORD, lookup="definite"),
        rule("article", "missing_article", r"(?i)\b(?:dag|butikk)\b", lookup="article", not_before=r"(?:en|et|den|det|denne|dette|til|i|på|med|for|om|av|fra|min|din|sin|vår|deres|hans|hennes)\s+$"),
        rule("agreement", "masculine_adjective", r"(?i)\b(?:en|den)\s+\w+t\s+(?:bil|mann|gutt|stol|dag)\b", "$1", find=r"t(\s+\w+)$"),
        rule("agreement", "feminine_adjective", r"(?i)\b(?:ei|den)\s+\w+t\s+(?:bok|jente|dør|hylle)\b", "$1", find=r"t(\s+\w+)$"),
        rule("agreement", "neuter_adjective", r"(?i)\b(?:et|det)\s+\w*[a-su-z0-9_]\s+(?:hus|barn|bord|rom)\b", "t$1", find=r"(\s+\w+)$"),
        rule("tense", "present_after_past_time", r"(?i)\bi\s+går[^\n]{0,30}?\b(?:kjøper|kommer|er|gjør|venter?|trenger|hjelper?)\b", lead=_LAST_WORD, lookup="past"),
        rule("tense", "past_time_with_present", r"(?i)\b(?:i\s+forrige\s+uke|forrige|tidligere)\b[^\n]{0,30}?\b(?:kjøper|kommer|er|har|gjør|kan|vil|skal|hjelpe|vente|trenger)\b"),
        rule("tense", "present_time_with_past", r"(?i)\b(?:nå|i\s+dag|denne\s+uken|akkurat\s+nå)[^\p{L}\n][^\n]{0,30}?\b(?:gikk|kom|var|hadde|gjorde|kunne|ville|skulle|måtte|hjalp|ventet|trengte)\b"),
    ),
    "f1i_words": (
        rule("words", "grammar", r"grammatik\b", "grammatikk", requires="grammatik feil"), rule("words", "grammar", "skrivd", "skrevet"), rule("words", "style", "røde bil", "rød bil", confidence=0.5), rule("words", "spelling", "lovte", "lovet"),
        rule("words", "grammar", "blåse", "blåste", requires="i går|regnet"), rule("words", "grammar", "åpent", "åpen", requires="butikken"),
    ),
    "f1j_clauses": (
        rule("clause", "main_clause_v2", r"(?i)^[^,\n.!?]+?(?:,\s*)?[^\s,]+\s+(?:er|var|har|vil|kan|skal|må|blir|ble)\b", None, "low", 0.3, unless=r"(?i)^Glad\s+er"),
        rule("clause", "question_order", r"(?i)^(?:Er|Var|Har|Vil|Kan|Skal|Må|Blir|Ble)\s+\S+", None, "low", 0.3),
        rule("clause", "subclause_negation", r"(?i)\b(?:fordi|hvis|når|at|siden)\s+[^\s,]+\s+ikke\s+(?:er|var|har|vil|kan|skal|må|blir|ble)\b", None, "low", 0.5),
        rule("formality", "formal", r"(?i)\bDe\b", None, "low", 0.3, not_after=r"^\s+\w"),
        *[rule("formality", "formal", rf"(?i){p}", None, "low", 0.3) for p in (r"\bDeres\b", r"\b(?:Herr|Hr\.|Fru|Fr\.|Frøken)", r"ærbødigst\b", r"\bvennligst\b", r"\bMed\s+(?:vennlig|beste)\s+hilsen\b", r"\bHøytidelig\b")],
        *[rule("formality", "informal", rf"(?i){p}", None, "low", 0.3) for p in (r"\bdu\b", r"\bdeg\b", r"\b(?:din|ditt|dine)\b", r"\b(?:hei|hallo)\b", r"\bha\s+det\b", r"\b(?:kul|fett)\b", r"\btakk\b")],
    ),
}
