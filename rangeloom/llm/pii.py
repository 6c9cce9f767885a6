"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, URL schemes, digits, plus signs and words that announce an
identifier. From each anchor a local parser expands to both sides as far as its kind of item can reach, and
validates what it found. Searching for a kind goes on behind its last item, valid or not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sole

BASE = ("email", "ip", "card", "phone")
#: Kinds beyond the base: URLs that carry a login, bank accounts (IBAN), announced account and social security numbers.
MORE = ("login", "iban", "account", "ssn")
KINDS = BASE + MORE

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9]+")
QUAD = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[A-Za-z0-9._%+-]+:[^\s/@:]+@[A-Za-z0-9.-]+[A-Za-z0-9]")
IBAN = re.compile(r"[:\x20#]{1,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr|num)\b\.?)?\x20?[:#=]\x20?([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])")
SSN = re.compile(r"(?:\x20?(?:number|no))?\.?\x20?[:#=]?\x20?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
CUES = {"iban": "iban", "account": "account", "acct": "account", "ssn": "ssn", "social security": "ssn"}


def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end; code points) of each kind, in order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {}
    if not text:
        return out
    behind = dict.fromkeys(KINDS, 0)
    run_end = 0

    def took(kind: str, start: int, end: int, valid: bool) -> None:
        behind[kind] = end
        if valid:
            out.setdefault(kind, []).append((start, end))

    for at, (what, size) in sole(anchors).iter(text):
        start = at - size + 1
        if what == "digit":
            if at >= run_end:  # the first digit of a run
                run_end = RUN.match(text, at).end()
                if at >= behind["ip"] and (m := QUAD.match(text, run_end)):
                    took("ip", at, m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text[at : m.end()].split(".")))
                if at >= behind["card"] and (m := CHAIN.match(text, at)):
                    digits = m[0].replace(" ", "").replace("-", "")
                    took("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        elif what == "at":
            left = at
            while left > behind["email"] and text[left - 1] in LOCAL:
                left -= 1
            if left < at and (m := DOMAIN.match(text, at + 1)):
                took("email", left, m.end(), True)
        elif what == "plus":
            if at >= behind["phone"] and (m := CALL.match(text, at)):
                took("phone", at, m.end(), 8 <= sum(map(str.isdigit, m[0])) <= 15)
        elif what == "scheme":
            if start >= behind["login"] and (m := LOGIN.match(text, start)):
                left = start
                while left > behind["login"] and start - left < 12 and text[left - 1].isascii() and text[left - 1].isalpha():
                    left -= 1
                took("login", left, m.end(), left < start)
        elif start == 0 or not text[start - 1].isalnum():
            m = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN}[what].match(text, at + 1)
            if m and m.start(1) >= behind[what]:
                took(what, m.start(1), m.end(1), what != "iban" or iban_valid(m[1]))
    return out


def written(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans.get(k, ()))


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    flat = sorted((s, -e, k) for k, each in spans.items() for s, e in each)
    if not flat:
        return text
    out, at = [], 0
    for s, e, k in flat:
        if s >= at:
            out += (text[at:s], f"<{k.upper()}>")
        at = max(at, -e)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more (spans of other kinds).

    Null and empty texts have no spans; repeated rows are read each; other columns are ignored.
    """

    bounded_batches(docs)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for one in batch:
                spans = find(one)
                base = written(spans, BASE)
                rows.append((*(len(spans.get(k, ())) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), written(spans, KINDS), sum(len(spans.get(k, ())) for k in MORE)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more"])

    return docs.select(F.col(key), scan(F.col(text)).alias("__found")).select(key, "__found.*")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null stays null, all other columns as they are."""

    bounded_batches(docs)

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = (x.as_py() for x in batch)
            yield pa.array([one if one is None else redacted(one, find(one)) for one in texts], pa.string())

    return docs.withColumn(text, clean(F.col(text)))
