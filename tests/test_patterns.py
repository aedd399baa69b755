"""Boundaries of rule patterns: cheap where a word must follow, the same hits as RE2."""

import re

from pyspark.sql import functions as F

from textlens.functions.patterns import _BOUNDARY, java_pattern


def test_leading_boundaries_look_back_only(spark):
    patterns = (r"(?i)\b(?:dag|butikk)\b", r"\bfeks\b", r"(?i)\bi\s+går", r"(?i)\b(?:en|den)\s+\w+t\b", r"(?i)\b(?:kul|sur|fett)\b", r"(?i)\bærlig\b", r"(?i)\bd?u\b", r"\b(?:a|b)?c\b", r"\b[ab]c\b")
    assert [not java_pattern(p).removeprefix("(?iu)").startswith(_BOUNDARY) for p in patterns] == [True] * 5 + [False] * 4
    texts = ["Dag og BUTIKK, udag dag_ 9dag\nidag", "feks xfeks feks. åfeks", "i går xı går ı går åi går", "en fint den\tstort", "kul KUL Kul xKul fett sur ſur aſur xsur", "ærlig xærlig åærlig", "du u xu", "c ac xc bc", ""]
    rows = [(t, p, java_pattern(p), re.sub(r"(?<!\\)\\b", lambda _: _BOUNDARY, p).replace("(?i)", "(?iu)")) for t in texts for p in patterns]
    df = spark.createDataFrame(rows, "t string, p string, new string, full string")
    hits = lambda c: F.regexp_extract_all("t", F.col(c), F.lit(0))
    for r in df.select("t", "p", hits("new").alias("a"), hits("full").alias("b")).collect():
        # Java folds i and ı, RE2 doesn't: no word starts there any more
        assert r.a == [x for x in r.b if not x.startswith("ı")], (r.t, r.p)
