"""The term language of text filters, turned into a column expression.

`a|b` is any of its parts, `a&b` all of them; `|` binds first, so an `&` inside a part
of an `|` is an ordinary character. A part is taken literally, case and all, if it is
quoted, starts with `!` or has blanks inside; otherwise case and accents don't count.
`*` and `?` are wildcards within a line. `~part~` drops its marks. An empty pattern
or text matches nothing. Everything is settled on the driver; rows see only built-in
expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from folhario.functions.values import unaccent


class Term(NamedTuple):
    text: str
    exact: bool


class Query(NamedTuple):
    mode: str  # 'any', 'all' or 'none'
    terms: tuple[Term, ...]


def term(raw: str) -> Term:
    """One part of a pattern."""
    t = raw.strip()
    if len(t) > 1 and t[0] == t[-1] == "~":
        t = t[1:-1].strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return Term(t[1:-1], True)
    if t.startswith("!"):
        return Term(t[1:], True)
    return Term(t, bool(re.search(r"\s", t)))


def parse(pattern: str | None) -> Query:
    if not pattern:
        return Query("none", ())
    mark, mode = ("|", "any") if "|" in pattern else ("&", "all") if "&" in pattern else ("", "any")
    parts = [p.strip() for p in pattern.split(mark)] if mark else [pattern]
    return Query(mode, tuple(term(p) for p in parts if p.strip()))


def plain(text: str) -> str:
    """Lower case without accents, as the rows' text is folded."""
    t = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", t)


def wildcard(text: str) -> str:
    """A regular expression for a term with `*` and `?`, everything else literal."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text)


def term_matches(c: Column, t: Term) -> Column:
    body, wanted = (c, t.text) if t.exact else (unaccent(F.lower(c)), plain(t.text))
    if not wanted:
        return F.lit(False)
    return body.rlike(wildcard(wanted)) if re.search(r"[*?]", wanted) else body.contains(wanted)


def matches(c: Column, pattern: str | None) -> Column:
    """Whether the text matches the pattern; false, never null."""
    q = parse(pattern)
    if not q.terms:
        return F.lit(False)
    each = [term_matches(c, t) for t in q.terms]
    return F.coalesce((F.length(c) > 0) & reduce((lambda a, b: a | b) if q.mode == "any" else (lambda a, b: a & b), each), F.lit(False))


def model(text: str | None, pattern: str | None) -> bool:
    """The same decision in plain Python, for tests."""
    q = parse(pattern)
    if not text or not q.terms:
        return False

    def one(t: Term) -> bool:
        body, wanted = (text, t.text) if t.exact else (plain(text), plain(t.text))
        if not wanted:
            return False
        return bool(re.search(wildcard(wanted), body)) if re.search(r"[*?]", wanted) else wanted in body

    return (any if q.mode == "any" else all)(one(t) for t in q.terms)
