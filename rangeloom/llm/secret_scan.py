"""Secrets by assignment-aware lexing.

The lexer reads assignments in source and configuration syntax: ``name = ...``, ``name: ...`` (also quoted, subscripted
or typed names), ``name => ...``, XML elements, and XML ``name``/``key`` with ``value`` attributes. On the right it reads
string literals with escapes, also concatenated ones, names and references such as ``${NAME}``, and unquoted values as the
last word of their line. Literals given to sensitive names are secrets. A name given to a sensitive name is followed to
what it was last given before (or, if nothing, first behind), and so on: the literals at the end are secrets, dead ones
aren't. Access keys and long hexadecimal literals are read as literals wherever they stand.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BASE = ("assign", "access", "hex")
#: Beyond the base: other literals of sensitive names, and constants that end up in a sensitive name.
MORE = ("literal", "constant")
KINDS = BASE + MORE

SIGN = re.compile(r"[:=]")
WORDS = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: A name of any length, the rest of a quoted or subscripted or typed one, and the sign.
ASSIGN = re.compile(r"""(?<![\w.$-])([\w.$-]++)["']?\]?(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.\[\]]*+(?=[ \t]*+=))?[ \t]*+(?:=>|:=|[:=](?![:=]))[ \t]*+\(?""", re.ASCII)
ELEMENT = re.compile(r"<([A-Za-z][\w.:-]*+)(?:\s[^<>]*+)?>([^<>\n]++)</", re.ASCII)
TAG = re.compile(r"<[A-Za-z][\w.:-]*+\s([^<>]*+)>", re.ASCII)
ATTRIBUTE = re.compile(r"""([A-Za-z][\w.:-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.ASCII)
STRING = re.compile(r"""[rbfuRBFU]{0,2}+(?:"((?:[^"\\\n]|\\.)++)"|'((?:[^'\\\n]|\\.)++)'|`((?:[^`\\\n]|\\.)++)`)""")
JOINED = re.compile(r"[ \t]*+(?:(?:\+|\.(?=[ \t]*[\"'$])|\|\||\\)[ \t]*+(?:\r?\n[ \t]*+)?|(?=[\"']))")
#: Inside parentheses literals may also stand on lines of their own.
WITHIN = re.compile(r"\s*+(?:\+\s*+)?(?=[\"'])")
NAME = re.compile(r"\$?([A-Za-z_][A-Za-z0-9_]*+(?:(?:\.|->)[A-Za-z_][A-Za-z0-9_]*+)*+)(?![\w(\[])", re.ASCII)
REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)", re.ASCII)
#: An unquoted value: the last word of its line, but for a comment.
BARE = re.compile(r"""[^\s"'`(\[{=>~][^\s]*""")
BARE_END = re.compile(r"[ \t]*(?:[\r\n]|\Z)|[ \t]+(?:#|//|;)")
#: Unquoted values that are names, or begin with a call or subscript of one.
CODE = re.compile(r"[A-Za-z_.]+|[A-Za-z_][A-Za-z0-9_.]*[(\[].*", re.DOTALL)
#: What stands for a value given elsewhere.
PLACEHOLDER = re.compile(r"\$\{.*\}|\$\(.*\)|\$[A-Z_][A-Z0-9_]*|\{\{.*\}\}|\{[A-Za-z_][A-Za-z0-9_.]*\}|<.*>|%[A-Za-z_]+%")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Points for the parts of a name; a name with SENSITIVE points or more is a sensitive target.
POINTS = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 2, "secret": 3, "secrets": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "bearer": 2, "private": 1, "access": 1, "auth": 2, "api": 1, "signing": 1, "encryption": 1, "client": 1, "db": 1, "pass": 2, "key": 1, "salt": 1, "cookie": 1, "session": 1,
}
SENSITIVE = 3
#: A literal must be this long and this varied (bits a character) to count beyond the base.
LEAST_LENGTH, LEAST_BITS = 8, 2.5


def name_points(name: str) -> int:
    return sum(POINTS.get(p.lower(), 0) for p in PARTS.findall(name))


def varied(literal: str) -> bool:
    n = len(literal)
    if n < LEAST_LENGTH or " " in literal or "\t" in literal or PLACEHOLDER.fullmatch(literal):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) >= LEAST_BITS


@dataclass(slots=True)
class Given:
    """What a name is given at a place: spans of literals, their joined text, and names."""

    name: str
    spans: list[tuple[int, int]]
    value: str
    names: list[str]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base kinds, and under ``""`` the values of ``assign``."""
    out: dict[str, list[tuple[int, int]]] = {}
    behind, size = 0, len(text)
    for sign in SIGN.finditer(text):
        left, right = sign.start(), sign.end()
        while left and text[left - 1] == " ":
            left -= 1
        if left and text[left - 1] in "\"'":
            left -= 1
        target = WORDS.search(text, max(0, left - 8), left)
        if not target or target.start() < behind:
            continue
        while right < size and text[right] == " ":
            right += 1
        if value := VALUE.match(text, right + (right < size and text[right] in "\"'")):
            behind = value.end()
            if value.end() - value.start() >= 6:
                out.setdefault("assign", []).append((target.start(), value.end()))
                out.setdefault("", []).append(value.span())
    if found := [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]:
        out["access"] = found
    if found := [m.span() for m in HEX.finditer(text)]:
        out["hex"] = found
    return out


def expression(text: str, at: int, joining: re.Pattern) -> tuple[list[tuple[int, int]], str, list[str], int]:
    """Literals and names that are joined from ``at`` on: spans, text, names and where they end."""
    spans: list[tuple[int, int]] = []
    names: list[str] = []
    value = ""
    while True:
        if quoted := STRING.match(text, at):
            span = quoted.span(quoted.lastindex)
            held = quoted[quoted.lastindex]
            if reference := REFERENCE.fullmatch(held):
                names.append(reference[1] or reference[2])
            else:
                spans.append(span)
                value += held
            at = quoted.end()
        elif name := NAME.match(text, at):
            names.append(name[1].replace("->", "."))
            at = name.end()
        else:
            return spans, value, names, at
        if not (joined := joining.match(text, at)) or not (quoted or joined.end() > at):
            return spans, value, names, at
        at = joined.end()


def assignments(text: str) -> Iterator[Given]:
    """What names are given, in the order of the text; markup comes behind."""
    bare_behind = 0
    for m in ASSIGN.finditer(text):
        right = m.end()
        spans, value, names, _ = expression(text, right, WITHIN if text[right - 1] == "(" else JOINED)
        if not spans and right >= bare_behind and (bare := BARE.match(text, right)):
            # a value that was read already is no place of further ones
            bare_behind = bare.end()
            word = bare[0].rstrip(",;")
            reference = REFERENCE.fullmatch(word)
            if reference:
                names = [reference[1] or reference[2]]
            elif BARE_END.match(text, bare_behind) and not CODE.fullmatch(word):
                spans, value, names = [(right, right + len(word))], word, []
        yield Given(m[1].lstrip("$"), spans, value, names)
    if "<" in text and ">" in text:
        marked = [(m[1], m.start(2), m[2]) for m in ELEMENT.finditer(text)]
        for tag in TAG.finditer(text):
            held = {m[1].lower(): (tag.start(1) + m.start(m.lastindex), m[m.lastindex]) for m in ATTRIBUTE.finditer(tag[1])}
            name = held.get("key") or held.get("name")
            if name and "value" in held:
                marked.append((name[1], *held["value"]))
        for name, at, held_value in marked:
            word = held_value.strip()
            at += len(held_value) - len(held_value.lstrip())
            reference = REFERENCE.fullmatch(word)
            literal = word and not reference and not CODE.fullmatch(word)
            yield Given(name, [(at, at + len(word))] if literal else [], word if literal else "", [reference[1] or reference[2]] if reference else [])


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end; code points) of each kind, in order of their starts."""
    if not text:
        return {}
    out = base_spans(text)
    used = set(out.pop("", ()))
    given = list(assignments(text))
    by_name: dict[str, list[int]] = {}
    for i, g in enumerate(given):
        by_name.setdefault(g.name, []).append(i)
        if "." in g.name:
            by_name.setdefault(g.name.rsplit(".", 1)[1], []).append(i)

    def add(kind: str, g: Given) -> None:
        if varied(g.value):
            fresh = [x for x in g.spans if x not in used]
            used.update(fresh)
            out.setdefault(kind, []).extend(fresh)

    wanted = [i for i, g in enumerate(given) if name_points(g.name) >= SENSITIVE or WORDS.search(g.name)]
    for i in wanted:
        add("literal", given[i])
    # each place is followed once
    met = set(wanted)
    while wanted:
        i = wanted.pop()
        for name in given[i].names:
            places = by_name.get(name) or by_name.get(name.rsplit(".", 1)[-1])
            if not places:
                continue
            before = bisect.bisect_left(places, i)
            source = places[before - 1] if before else next((p for p in places if p != i), i)
            if source not in met:
                met.add(source)
                wanted.append(source)
                add("constant", given[source])
    return {k: sorted(v) for k, v in out.items() if v}


def written(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    flat = sorted((s, i, e) for i, k in enumerate(kinds) for s, e in spans.get(k, ()))
    return ",".join(f"{kinds[i]}:{s}:{e}" for s, i, e in flat)


def secrets(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_assign, n_access, n_hex, base_sha256, spans, n_more (spans of other kinds).

    Null and empty texts have no spans; repeated rows are read each; other columns are ignored. A text is read whole,
    in time and memory that grow in proportion to its length.
    """

    bounded_batches(docs)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_more long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for one in batch:
                spans = find(one)
                rows.append((*(len(spans.get(k, ())) for k in BASE), hashlib.sha256(written(spans, BASE).encode()).hexdigest(), written(spans, KINDS), sum(len(spans.get(k, ())) for k in MORE)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_more"])

    return docs.select(F.col(key), scan(F.col(text)).alias("__found")).select(key, "__found.*")
