"""What a pattern can't match without: literals that every hit holds, for an index from text to patterns."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as parser

#: Letters from common to rare; the place in it weighs a string of three. Only decides which string of a rule is indexed.
COMMON = "etaoinsrhldukmgfcpbvywøåjæzxq"
SIZE = 3


_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: A boundary before a word: before letters that fold to ones beyond ASCII (k, s), and before others.
_WORD_START = (r"(?:(?<!\w)(?=\w)|(?<=\w)(?=(?-iu:[\u017F\u212A])))", r"(?<!\w)(?=\w)")


def _alternatives(group: str) -> tuple[list[str], str] | None:
    """The alternatives of the (?: group that opens the text and what follows it; None if classes make it hard to tell."""
    depth, at, parts = 0, 0, []
    i = 0
    while i < len(group):
        c = group[i]
        if c == "[":
            return None
        if c == "\\":
            i += 1
        elif c == "(":
            depth += 1
            at = 3 if depth == 1 else at
        elif c == "|" and depth == 1:
            parts.append(group[at:i])
            at = i + 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return [*parts, group[at:i]], group[i + 1 :]
        i += 1
    return None


def _first(rest: str) -> str | None:
    """The characters, all of ASCII words, that what follows can begin with; \\w counts as w; None if others may stand there."""
    if rest.startswith("(?:"):
        cut = _alternatives(rest)
        each = [_first(x) for x in cut[0]] if cut and not re.match(r"[?*{]", cut[1]) else [None]
        return "".join(each) if all(each) else None
    m = re.match(r"(\\w|[A-Za-z0-9_])(?![?*{|)]|$)", rest) or re.match(r"(\\w|[A-Za-z0-9_])$", rest)
    return m and m.group(1)[-1]


def java_pattern(pattern: str) -> str:
    """A pattern as RE2 reads it, for Java: boundaries of ASCII words (Java's see all letters), case folding beyond ASCII. A boundary
    that a word must follow looks back only, as it is tried at every place of a text."""

    def boundary(m: re.Match) -> str:
        first = _first(pattern[m.end() :])
        if first is None:
            return _BOUNDARY
        return _WORD_START["(?i" not in pattern or not set(first.lower()) & {"k", "s"}]

    return re.sub(r"(?<!\\)\\b", boundary, pattern).replace("(?i)", "(?iu)")


def _clauses(items) -> list[set[str]]:
    """For every hit and every set at least one string of the set stands in the hit. Case is folded."""
    found: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            found.append({run})
        run = ""

    for op, arg in items:
        if op is sre.LITERAL:
            run += chr(arg)
        elif op is sre.AT:
            continue  # no width: what is before and after it are neighbours
        elif op is sre.SUBPATTERN:
            inner = arg[-1]
            if all(o is sre.LITERAL for o, _ in inner):
                run += "".join(chr(a) for _, a in inner)
            else:
                close()
                found += _clauses(inner)
        elif op is sre.BRANCH:
            close()
            each = [_best(_clauses(branch)) for branch in arg[1]]
            if all(each):
                found.append(set().union(*each))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = arg[2]
            if len(inner) == 1 and inner[0][0] is sre.LITERAL:
                run += chr(inner[0][1]) * arg[0]
                close()
                run = ""
            else:
                close()
                found += _clauses(inner)
        else:
            close()
    close()
    return [{s.lower() for s in clause} for clause in found]


def _weight(gram: str) -> int:
    return sum(COMMON.find(c) if c in COMMON else len(COMMON) for c in gram)


def _gram(text: str) -> str | None:
    """The rarest three characters in a row without white space; letters whose case folds by context don't count."""
    grams = [g for i in range(len(text) - SIZE + 1) if not re.search(r"[\sσςΣİ]", g := text[i : i + SIZE])]
    return max(grams, key=_weight, default=None)


def _best(clauses: list[set[str]]) -> set[str] | None:
    """The clause whose strings all hold an indexable part, with the rarest such parts."""
    usable = [c for c in clauses if all(_gram(s) for s in c)]
    return max(usable, key=lambda c: min(_weight(_gram(s)) for s in c) - 8 * len(c), default=None)


def index_grams(pattern: str, requires: str | None = None) -> list[str]:
    """Strings of three lower-case characters of which every text that `pattern` (and `requires`) hits holds at least one.

    Empty if there are none, as for a pattern of classes only: then the pattern must be tried on every text. Groups, repeats,
    classes and alternatives of Java and RE2 are understood; a pattern that Python can't parse gives none.
    """
    clauses = []
    for p in (pattern, requires):
        if p is None:
            continue
        try:
            clauses += _clauses(parser.parse(re.sub(r"\\[pP]\{\w+\}", r"\\w", p.replace("(?iu)", "(?i)"))))
        except re.error:
            continue
    best = _best(clauses)
    return sorted({_gram(s) for s in best}) if best else []
