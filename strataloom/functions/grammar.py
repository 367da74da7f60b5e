"""Weighted context-free grammar of log entry headers, parsed with Earley's algorithm.

A row is first cut into tokens of a few classes; the grammar is over classes, so rows of the same shape share one parse.
The chart is built left to right and its result kept in a trie at the length at which no rule can go on, so a shape is
parsed once per worker however many rows have it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Level names, synonyms, initials and numbers.
LEVELS = {
    "TRACE": "TRACE", "FINEST": "TRACE", "DEBUG": "DEBUG", "DBG": "DEBUG", "INFO": "INFO", "NOTICE": "INFO",
    "WARN": "WARN", "WARNING": "WARN", "ERROR": "ERROR", "ERR": "ERROR", "SEVERE": "ERROR", "FATAL": "FATAL",
    "CRIT": "FATAL", "CRITICAL": "FATAL", "T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR",
    "F": "FATAL", "10": "TRACE", "20": "DEBUG", "30": "INFO", "40": "WARN", "50": "ERROR", "60": "FATAL",
}

#: Field names that programs use for timestamp, level, component and message.
FIELD_NAMES = {
    "ts": "timestamp @timestamp @ts ts time t datetime",
    "lv": "level lvl severity loglevel",
    "co": "logger component module source_component",
    "ms": "message msg text",
}
FIELD_OF = {name: role for role, names in FIELD_NAMES.items() for name in names.split()}

_WORDS = "|".join(sorted((k for k in LEVELS if len(k) > 1 and k.isalpha()), key=len, reverse=True))
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = r"\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?"
_ZONE = rf"(?: ?(?:[+-]\d\d:?\d\d|Z\b)| (?!(?:{_WORDS})\b)[A-Z]{{3,5}}(?=[\]\)| ]|$))?(?:\[[A-Za-z_/+-]+\])?"

#: Token classes in order of preference. ``t`` timestamp, ``g`` initial, date and time, ``n`` number, ``l`` level word,
#: ``i`` level initial, ``w`` word or dotted, dashed name, ``s`` blanks; any other character is its own class.
PLAIN = re.compile(
    rf"(?P<t>\d{{4}}[-/]\d\d[-/]\d\d[T ]{_CLOCK}{_ZONE}|\d\d/\d\d/\d{{4}},? {_CLOCK}(?: ?[AP]M\b)?"
    rf"|\d\d\.\d\d\.\d{{4}} {_CLOCK}{_ZONE}|\d\d/{_MON}/\d{{4}}:{_CLOCK}(?: [+-]\d{{4}})?"
    rf"|(?:[A-Z][a-z]{{2}}, )?\d\d?[ -]{_MON}[ -]\d{{4}} {_CLOCK}{_ZONE}|{_MON} [ \d]\d {_CLOCK}|\d{{8}}T\d{{6}}Z?)"
    rf"|(?P<g>[TDIWEF](?=\d{{4}} \d\d:\d\d:\d\d))|(?P<m>(?<=^.)\d{{4}} \d\d:\d\d:\d\d(?:\.\d+)?)"
    rf"|(?P<e>(?:\d{{19}}|\d{{16}}|\d{{13}}|\d{{10}})(?:\.\d+)?(?![\w.:-]))"
    rf"|(?P<l>(?:{_WORDS})\b(?![.\w-]))|(?P<i>[TDIWEF](?![\w.-]))|(?P<n>\d+(?![\w.-]))"
    rf"|(?P<w>[^\W\d_](?:[\w$./@-]*\w)?|\w[\w$./@-]*)|(?P<s>[ \t]+)|(?P<a>>>)|(?P<x>.)",
    re.IGNORECASE | re.DOTALL,
)
_STRING = r'"(?:[^"\\]|\\.)*"'
JSON = re.compile(
    rf"(?P<k>{_STRING})\s*:|(?P<q>{_STRING})|(?P<n>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<b>true|false|null)|(?P<s>\s+)|(?P<x>.)",
    re.DOTALL,
)
PAIRS = re.compile(rf"(?P<k>[@\w.-]+)=|(?P<q>{_STRING})|(?P<s>\s+)|(?P<w>[^\s\"=]+)|(?P<x>.)", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    """``head`` -> ``body`` with a log weight; a part ``X:role`` names the field that X holds."""

    head: str
    body: tuple[str, ...]
    weight: float
    roles: tuple[str, ...]


def rule(head: str, body: str, weight: float = 0.0) -> Rule:
    parts = [p.partition("~") for p in body.split()]
    return Rule(head, tuple(p[0] for p in parts), weight, tuple(p[2] for p in parts))


#: Layouts and their parts. Capitals are nonterminals, ``s`` blanks; ``~role`` marks a field. A more specific layout has
#: the higher weight; a message word is never part of a header.
RULES = [
    rule("Entry", "Line"),
    rule("Entry", "Object"),
    rule("Entry", "Pairs"),
    rule("When", "t"),
    rule("When", "e", -1),
    rule("Level", "l"),
    rule("Level", "i", -1),
    rule("Level", "n", -3),
    rule("Part", "w"),
    rule("Part", "l", -2),
    rule("Part", "i", -3),
    rule("Host", "w"),
    rule("Host", "n", -1),
    rule("Pid", "n"),
    rule("Pid", "w", -1),
    rule("Words", "Word"),
    rule("Words", "Words Word"),
    *(rule("Word", c) for c in ("w", "l", "i", "n", "s", "-", ":", "#", "e")),
    rule("Pad", ""),
    rule("Pad", "s"),
    # 2025-12-25 13:45:18,617 *INFO* [Work Lane 6] component - message
    rule("Line", "When~ts s * Level~lv * s [ Words~th ] s Part~co s - s", 3),
    # [when] [component] [LEVEL] message, [when][level   ][component] message
    rule("Line", "[ When~ts ] Pad [ Part~co Pad ] Pad [ Level~lv Pad ] s", 2),
    rule("Line", "[ When~ts ] Pad [ Level~lv Pad ] Pad [ Part~co Pad ] s", 3),
    # [when] component LEVEL: message
    rule("Line", "[ When~ts ] s Part~co s Level~lv : s", 2),
    # component (when) level >> message
    rule("Line", "Part~co s ( When~ts ) s Level~lv s a s", 2),
    # level; when; component; message
    rule("Line", "Level~lv ; s When~ts ; s Part~co ; s", 2),
    # when host component[pid]: <level> message, [LEVEL] message, Level: message
    rule("Line", "When~ts s Host~ho s Part~co [ Pid~pi ] : s < Level~lv > s", 3),
    rule("Line", "When~ts s Host~ho s Part~co [ Pid~pi ] : s [ Level~lv ] s", 3),
    rule("Line", "When~ts s Host~ho s Part~co [ Pid~pi ] : s Level~lv : s", 2),
    # I0401 12:23:26.186008 25301 component:527] message
    rule("Line", "g~lv m~ts s n~pi s Part~co : n~ln ] s", 3),
    # when | level | component | message, when|level|component|message
    rule("Line", "When~ts Pad | Pad Level~lv Pad | Pad Part~co Pad | Pad", 2),
    # 1763397029.354 F component: message
    rule("Line", "When~ts s Level~lv s Part~co : s", 1),
    # any other line of such parts: when, level, thread and component in their usual orders, brackets and separators free
    *(rule("Stamp", b) for b in ("When~ts", "[ When~ts ]", "( When~ts )")),
    *(rule("Grade", b) for b in ("Level~lv", "[ Pad Level~lv Pad ]", "( Level~lv )", "< Level~lv >", "* Level~lv *")),
    *(rule("Lane", b) for b in ("[ Words~th ]", "( Words~th )")),
    *(rule("Origin", b) for b in ("Part~co", "[ Pad Part~co Pad ]", "Part~co [ Pid~pi ]", "Part~co : n~ln")),
    *(rule("Gap", b) for b in ("s", "s - s", "Pad | Pad")),
    *(rule("End", b) for b in ("s - s", ": s", "s : s", "Pad | Pad")),
    rule("Line", "Stamp Gap Grade Gap Origin End", -1),
    rule("Line", "Stamp Gap Grade Gap Lane Gap Origin End"),
    rule("Line", "Stamp Gap Lane Gap Grade Gap Origin End"),
    rule("Line", "Stamp Gap Lane Gap Origin Gap Grade End"),
    rule("Line", "Stamp Gap Origin Gap Grade End", -1),
    rule("Line", "Grade Gap Stamp Gap Origin End", -1),
    rule("Line", "Grade Gap Stamp Gap Lane Gap Origin End"),
    rule("Line", "Stamp Gap Grade Gap [ Pad Part~co Pad ] s", -3),
    # when LEVEL 12345 --- [thread] component : message
    rule("Line", "Stamp s Grade s n~pi s - - - s Lane s Part~co s : s", 1),
    # when host component: LEVEL message
    rule("Line", "Stamp s Host~ho s Part~co : s Grade s", -1),
    rule("Line", "Stamp s Host~ho s Part~co : s Grade : s"),
    # when [level] 12#34: message, for logs whose program names no component
    rule("Line", "Stamp s Grade s n~pi # n : s", -1),
    # {"time": ..., "level": ..., "component": ..., "message": ...} in any order
    rule("Object", "{ Members }", 1),
    rule("Members", "Member"),
    rule("Members", "Members , Member"),
    *(rule("Member", f"k{r} Value~{r}", 1) for r in FIELD_NAMES),
    rule("Member", "k Value"),
    *(rule("Value", c) for c in ("q", "n", "b")),
    rule("Value", "Nested"),
    rule("Nested", "{ Inner }"),
    rule("Nested", "{ }"),
    rule("Nested", "[ Items ]"),
    rule("Nested", "[ ]"),
    rule("Inner", "InnerMember"),
    rule("Inner", "Inner , InnerMember"),
    *(rule("InnerMember", f"k{r} Value") for r in ("", *FIELD_NAMES)),
    rule("Items", "Value"),
    rule("Items", "Items , Value"),
    # time="..." level=... component=... message="..." in any order
    rule("Pairs", "Pair", 1),
    rule("Pairs", "Pairs s Pair"),
    *(rule("Pair", f"k{r} Scalar~{r}", 1) for r in FIELD_NAMES),
    rule("Pair", "k Scalar"),
    rule("Scalar", "q"),
    rule("Scalar", "w"),
]

NEEDED = ("ts", "lv", "co")

#: Keys of a shape's result and of a row's end in the trie, which no token class can be.
RESULT, END = object(), object()

#: Nodes of the trie of known shapes at which it is begun anew; this costs time only.
MOST_NODES = 500_000


class Tokens:
    """Token classes of a row and their places, cut as far as they are asked for."""

    def __init__(self, found: Iterator[tuple[str, tuple[int, int]]]):
        self.found = found
        self.symbols: list[str] = []
        self.places: list[tuple[int, int]] = []

    def has(self, i: int) -> bool:
        while len(self.symbols) <= i:
            symbol, place = next(self.found, (None, None))
            if place is None:
                return False
            self.symbols.append(symbol)
            self.places.append(place)
        return True


@dataclass
class Grammar:
    """``needed``: roles that a header must have."""

    rules: list[Rule] = field(default_factory=lambda: RULES)
    needed: tuple[str, ...] = NEEDED

    def __post_init__(self) -> None:
        self.by_head: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by_head.setdefault(r.head, []).append(i)
        self.trie: dict = {}
        self.room = MOST_NODES

    def header(self, tokens: Tokens, whole: bool) -> tuple[float, int, dict[str, tuple[int, int]]] | None:
        """Score, length in tokens and fields (as token spans) of the best header that begins ``tokens``.

        ``whole``: it must take up all of them. Remembered by shape.
        """
        node, at, more = self.trie, 0, True
        while more:
            more = tokens.has(at)
            if not more and not whole:
                break
            node = node.get(tokens.symbols[at] if more else END)
            if node is None:
                break
            if RESULT in node:
                return node[RESULT]
            at += 1
        best, seen = self.parse(tokens, whole)
        self.room -= seen
        if self.room < 0:
            self.trie, self.room = {}, MOST_NODES
        node = self.trie
        for s in [*tokens.symbols, END] if whole else tokens.symbols[:seen]:
            node = node.setdefault(s, {})
        if whole or tokens.has(seen):
            node[RESULT] = best
        return best

    def parse(self, tokens: Tokens, whole: bool) -> tuple[tuple | None, int]:
        """Earley with best derivations. Returns the result and how many symbols it depends on."""
        # an item is (rule, dot, origin); kept are its best score and where that came from
        charts: list[dict[tuple[int, int, int], tuple[float, tuple]]] = [{}]
        best: tuple | None = None
        for i in self.by_head["Entry"]:
            charts[0][(i, 0, 0)] = (self.rules[i].weight, ())
        at = 0
        while at < len(charts):
            chart = charts[at]
            symbol = tokens.symbols[at] if tokens.has(at) else None
            work = list(chart)
            while work:
                item = work.pop()
                score, back = chart[item]
                r, dot, origin = item
                body = self.rules[r].body
                if dot == len(body):
                    head = self.rules[r].head
                    for (pr, pdot, porigin), (pscore, pback) in list(charts[origin].items()):
                        pbody = self.rules[pr].body
                        if pdot < len(pbody) and pbody[pdot] == head:
                            self._add(chart, work, (pr, pdot + 1, porigin), pscore + score, (*pback, (item, at)))
                    if head == "Entry" and origin == 0 and (not whole or symbol is None):
                        spans = self._fields(charts, item, at)
                        if all(k in spans for k in self.needed) and (best is None or (score, at) > best[:2]):
                            best = (score, at, spans)
                elif body[dot] in self.by_head:
                    for i in self.by_head[body[dot]]:
                        self._add(chart, work, (i, 0, at), self.rules[i].weight, ())
                        if not self.rules[i].body:
                            self._add(chart, work, (r, dot + 1, origin), score + self.rules[i].weight, (*back, None))
                elif symbol is not None and body[dot] == symbol:
                    if len(charts) == at + 1:
                        charts.append({})
                    self._add(charts[at + 1], None, (r, dot + 1, origin), score, (*back, at))
            at += 1
        return best, min(len(tokens.symbols), len(charts))

    def _add(self, chart: dict, work: list | None, item: tuple, score: float, back: tuple) -> None:
        old = chart.get(item)
        if old is None or score > old[0]:
            chart[item] = (score, back)
            if work is not None:
                work.append(item)

    def _fields(self, charts: list[dict], item: tuple, at: int) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        stack = [(item, at)]
        while stack:
            it, end = stack.pop()
            rule_, parts = self.rules[it[0]], charts[end][it][1]
            for role, part in zip(rule_.roles, parts, strict=False):
                if part is None:
                    continue
                span = (part, part + 1) if isinstance(part, int) else (part[0][2], part[1])
                if role:
                    out.setdefault(role, span)
                if not isinstance(part, int):
                    stack.append(part)
        return out


_SPACE = re.compile(r"\s*")


def _objects(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    for m in JSON.finditer(text):
        kind = m.lastgroup
        if kind == "k":
            yield "k" + FIELD_OF.get(m["k"][1:-1].lower(), ""), m.span("k")
        elif kind != "s":
            yield m[0] if kind == "x" else kind, m.span()


def _pairs(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    for m in PAIRS.finditer(text, 0, len(text.rstrip())):
        kind = m.lastgroup
        yield "k" + FIELD_OF.get(m["k"].lower(), "") if kind == "k" else m[0] if kind == "x" else kind, m.span()


def _line(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    stop = text.find("\n")
    for m in PLAIN.finditer(text, 0, stop if stop >= 0 else len(text)):
        yield m[0] if m.lastgroup == "x" else m.lastgroup, m.span()


def _cut(text: str) -> tuple[str, Tokens, bool]:
    """Kind of row, its tokens, and whether the header must take up the whole row.

    Rows that it must take up are cut to their end at once, others only as far as the grammar goes.
    """
    if text[:1] == "{":
        kind, tokens = "object", Tokens(_objects(text))
    elif re.match(r"[@\w.-]+=\S", text):
        kind, tokens = "pairs", Tokens(_pairs(text))
    else:
        return "line", Tokens(_line(text)), False
    while tokens.has(len(tokens.symbols)):
        pass
    return kind, tokens, True


def _plain(token: str) -> str:
    if token[:1] == '"':
        try:
            return json.loads(token, strict=False)
        except ValueError:
            return token[1:-1]
    return token


class HeaderParser:
    """Fields of the rows of a log. One per worker, as it remembers shapes."""

    def __init__(self, grammar: Grammar | None = None):
        self.grammar = grammar or Grammar()

    def __call__(self, text: str | None) -> dict | None:
        """``ts, level, component, message, unparsed`` of a row with a header of its own, else None.

        ``unparsed`` holds [start, end) of what no rule covers; a message counts as covered.
        """
        if not text:
            return None
        kind, tokens, whole = _cut(text)
        found = self.grammar.header(tokens, whole)
        places = tokens.places
        if found is None:
            return None
        _, length, spans = found
        got = {r: text[places[a][0] : places[b - 1][1]] for r, (a, b) in spans.items()}
        level = LEVELS.get(_plain(got.get("lv", "")).strip().upper())
        if level is None and "lv" in self.grammar.needed:
            return None
        if kind == "line":
            message = text[places[length - 1][1] :]
        else:
            message = _plain(got.get("ms", ""))
        tail = text[places[length - 1][1] :] if whole else ""
        unparsed = [(len(text) - len(tail), len(text))] if tail.strip() else []
        return {
            "ts": _plain(got["ts"]) if "ts" in got else None,
            "level": level,
            "component": _plain(got["co"]).strip() if "co" in got else None,
            "message": message,
            "unparsed": unparsed,
        }
