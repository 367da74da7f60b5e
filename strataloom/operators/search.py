"""Full-text search over templates: terms, phrases, prefixes, first words, NEAR, columns, AND, OR, NOT, parentheses."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = re.compile(r'"[^"]*"|[(){}:]|[^\s(){}:"]+')
#: Fixed value: words that may stand between the first and the last phrase of a NEAR group that names no number.
NEAR_WORDS = 10
_TERM = re.compile(r"[^\W_]+")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def inverted_index(templates: DataFrame, key: str, text: str) -> DataFrame:
    """``term, key``, each pair once."""
    return templates.select(F.col(key).alias("key"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def _phrase(words: list[str], have: Column, prefix: bool) -> Column:
    if not words:
        return F.lit(True)
    *firm, last = words

    def fits(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(firm):
            ok = ok & (F.get(have, i + k) == w)
        end = F.get(have, i + len(firm))
        return F.coalesce(ok & (end.startswith(last) if prefix else end == last), F.lit(False))

    if len(words) == 1:
        return F.exists(have, lambda x: x.startswith(last)) if prefix else F.array_contains(have, last)
    return (F.size(have) >= len(words)) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(have) - len(words), F.lit(0))), fits)


def _near(phrases: list[list[str]], have: Column, most: int) -> Column:
    """All phrases with at most ``most`` words from the end of the first to the start of the last of them."""

    def begins(words: list[str], at: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(words):
            ok = ok & F.coalesce(F.get(have, at + k) == w, F.lit(False))
        return ok

    def around(i: Column) -> Column:
        ok = F.lit(True)
        for words in phrases:
            starts = F.sequence(F.greatest(i - (len(words) - 1), F.lit(0)), i + most + 1)
            ok = ok & F.exists(starts, partial(begins, words))
        return ok

    return F.exists(F.sequence(F.lit(0), F.size(have)), around)


def parse_query(query: str, have: Column, column: str = "template") -> Column:
    """The condition of a query on an array of terms. Terms in a row mean AND; NOT binds tighter than AND, AND than OR.

    ``"a b"`` is a phrase, ``ab*`` a prefix, ``^ab`` the first word, ``NEAR(a "b c", 5)`` a group with at most 5 (10)
    words between its first and last phrase. ``column: x`` or ``{column}: x`` looks there, ``-column: x`` anywhere else,
    which is nowhere, as there is one column.
    """
    parts = _PARTS.findall(query)
    at = 0

    def group() -> Column:
        nonlocal at
        phrases, most, at = [], NEAR_WORDS, at + 1
        while at < len(parts) and parts[at] != ")":
            number = parts[at - 1].endswith(",") or parts[at].startswith(",")
            if number and (digits := parts[at].strip(",")).isdigit():
                most = int(digits)
            elif found := _TERM.findall(parts[at].lower()):
                phrases.append(found)
            at += 1
        if at >= len(parts):
            raise ValueError(f"missing ) in {query!r}")
        at += 1
        return _near(phrases, have, most)

    def filtered() -> Column | None:
        """What follows a column's name and a colon here, or None if there is no such name."""
        nonlocal at
        k = at
        against = parts[k].startswith("-") and (parts[k] == "-" or parts[k + 1 : k + 2] == [":"])
        names = [parts[k].lstrip("-")]
        if names[0] == "" or parts[k] == "{":
            k += parts[k] == "-"
            if parts[k : k + 1] != ["{"] or "}" not in parts[k:]:
                return None
            end = parts.index("}", k)
            names, k = parts[k + 1 : end], end
        if parts[k + 1 : k + 2] != [":"]:
            return None
        for name in names:
            if name != column:
                raise ValueError(f"no such column: {name}")
        at = k + 2
        inner = one()
        return F.lit(False) if against else inner

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(parts) and parts[at] == "OR":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = one()
        while at < len(parts) and parts[at] not in ("OR", ")"):
            if parts[at] == "AND":
                at += 1
            elif parts[at] == "NOT":
                at += 1
                left = left & ~one()
                continue
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"query ends too early: {query!r}")
        inner = filtered()
        if inner is not None:
            return inner
        part = parts[at]
        at += 1
        if part == "NEAR" and parts[at : at + 1] == ["("]:
            return group()
        if part == "NOT":
            return ~one()
        if part == "(":
            inner = either()
            if at >= len(parts) or parts[at] != ")":
                raise ValueError(f"missing ) in {query!r}")
            at += 1
            return inner
        if part in (")", "AND", "OR", "NEAR", ":", "{", "}"):
            raise ValueError(f"unexpected {part} in {query!r}")
        if part.startswith("^"):
            words = _TERM.findall(part.lower())
            return F.coalesce(F.get(have, F.lit(0)) == words[0], F.lit(False)) if words else F.lit(True)
        return _phrase(_TERM.findall(part.lower()), have, part.endswith("*"))

    out = either()
    if at < len(parts):
        raise ValueError(f"unexpected {parts[at]} in {query!r}")
    return out


def search(patterns: DataFrame, query: str, key: str = "id", text: str = "template") -> DataFrame:
    """``pattern_id, template`` of the templates that fit, by id."""
    return (
        patterns.withColumn("_terms", terms(F.col(text)))
        .where(parse_query(query, F.col("_terms"), text))
        .select(F.col(key).alias("pattern_id"), F.col(text).alias("template"))
        .orderBy("pattern_id")
    )
