"""Band, rule and lexicon tables. Fixed values."""

from __future__ import annotations

from .literal import Literal

BANDS = Literal(
    "index string, lo double, hi double, ord int, band string, audience string",
    tuple(
        (index, float(lo), float(hi), ord_, band, audience)
        for index, edges in (("lix", (-1, 20, 30, 40, 50, 1000000)), ("rix", (-1, 1.5, 3.0, 4.5, 6.0, 1000000)), ("rix_alt", (-1, 1.8, 2.8, 3.7, 4.8, 1000000)))
        for ord_, (lo, hi, band, audience) in enumerate(
            zip(edges[:-1], edges[1:], ("svært lett", "lett", "middels", "vanskelig", "svært vanskelig"), ("children", "general", "newspaper", "professional", "academic"), strict=True)
        )
    ),
)

RECOMMENDATION_RULES = Literal(
    "metric string, threshold double, high double, purpose string, type string, title string, impact string",
    (
        ("avg_sentence_length", 18.0, 25.0, None, "sentence_structure", "Kortere setninger", "medium"),
        ("long_words_percentage", 25.0, 35.0, None, "word_complexity", "Enklere ordvalg", "medium"),
        ("lix", 40.0, None, None, "writing_style", "Aktivt språk", "medium"),
        ("lix", 40.0, None, None, "flow_improvement", "Bedre tekstflyt", "medium"),
        ("lix", 50.0, None, None, "technical_language", "Fagbegreper", "high"),
        ("lix", 50.0, None, None, "structure_improvement", "Forbedre tekststruktur", "high"),
        ("lix", 45.0, None, None, "visual_aids", "Visuelle hjelpemidler", "medium"),
        ("lix", 35.0, None, "education", "educational_content", "Tilpass for læring", "high"),
        ("lix", 45.0, None, "business", "business_communication", "Fokuser budskapet", "medium"),
        ("rix", 4.0, None, None, "rix_recommendation", "Balansere ordlengde", "medium"),
    ),
)

ALTERNATIVES = Literal(
    "word string, alternative string",
    (("implementere", "bruke"), ("signifikant", "viktig"), ("kommunisere", "si fra"), ("erunderth", "under"), ("thererin", "there"), ("inwhich", "which"), ("tiontion", "station")),
)

LEXICON = Literal(
    "category string, purpose string, word string",
    tuple((c, p, w) for c, p, ws in (
        ("article", "stopword", ("the", "a", "an", "die", "der", "la", "le", "el")),
        ("conjunction", "stopword", ("and", "or", "und", "et", "y", "que")),
        ("preposition", "stopword", ("of", "in", "to", "for", "on", "with", "de", "mit", "que", "zu")),
        ("verb", "stopword", ("is", "was", "are", "ist", "est", "es")),
    ) for w in ws),
)
