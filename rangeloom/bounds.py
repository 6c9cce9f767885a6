"""Key ranges: what a read or a delete covers, as a Spark condition and as a test on a file's least and greatest key."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = tuple


def as_key(value: Any, width: int) -> Key | None:
    """A bound as a tuple of the key's columns; None stays (no bound). A composite bound may give leading columns only."""
    if value is None:
        return None
    key = tuple(value) if width > 1 and isinstance(value, (tuple, list)) else (value,)
    if not 0 < len(key) <= width:
        raise ValueError(f"a bound of {len(key)} columns for a key of {width}")
    if any(x is None for x in key):
        raise ValueError("a bound holds null")
    return tuple(bytes(x) if isinstance(x, bytearray) else x for x in key)


def is_default(value: Any) -> bool:
    """Values that the compatibility switch takes for "no bound"."""
    return value in (0, "", b"") or value == dt.datetime(1, 1, 1) or str(value) == "00000000-0000-0000-0000-000000000000"


@dataclass(frozen=True)
class KeyRange:
    """From ``start`` to ``end``, both included unless told otherwise; None: open."""

    start: Key | None = None
    end: Key | None = None
    start_included: bool = True
    end_included: bool = True

    @staticmethod
    def of(start: Any = None, end: Any = None, *, width: int = 1, start_included: bool = True, end_included: bool = True, default_is_unbounded: bool = False) -> KeyRange:
        if default_is_unbounded:
            start = None if start is not None and is_default(start) else start
            end = None if end is not None and is_default(end) else end
        return KeyRange(as_key(start, width), as_key(end, width), start_included, end_included)

    @property
    def empty(self) -> bool:
        """Whether no key can lie inside: known before any plan is built."""
        if self.start is None or self.end is None:
            return False
        n = min(len(self.start), len(self.end))
        a, b = self.start[:n], self.end[:n]
        return a > b or a == b and len(self.start) == len(self.end) and not (self.start_included and self.end_included)

    def condition(self, columns: Sequence[str]) -> Column:
        """Comparisons column by column, so that those on the leading one reach the scan."""
        if self.empty:
            return F.lit(False)
        parts = []
        if self.start is not None:
            parts += self._side(columns, self.start, True, self.start_included)
        if self.end is not None:
            parts += self._side(columns, self.end, False, self.end_included)
        out = F.lit(True)
        for i, p in enumerate(parts):
            out = p if i == 0 else out & p
        return out

    @staticmethod
    def _side(columns: Sequence[str], bound: Key, lower: bool, included: bool) -> list[Column]:
        cols = [F.col(c) for c in columns[: len(bound)]]
        beyond = lambda c, v: c > F.lit(v) if lower else c < F.lit(v)
        upto = lambda c, v: c >= F.lit(v) if lower else c <= F.lit(v)
        if len(bound) == 1:
            return [upto(cols[0], bound[0]) if included else beyond(cols[0], bound[0])]
        full = upto(cols[-1], bound[-1]) if included else beyond(cols[-1], bound[-1])
        for c, v in zip(cols[-2::-1], bound[-2::-1], strict=True):
            full = beyond(c, v) | ((c == F.lit(v)) & full)
        return [upto(cols[0], bound[0]), full]

    def meets(self, least: Key, greatest: Key) -> bool:
        """Whether a file with these extreme keys may hold keys of the range."""
        if self.empty:
            return False
        if self.start is not None:
            top = greatest[: len(self.start)]
            if top < self.start or top == self.start and not self.start_included and len(self.start) == len(greatest):
                return False
        if self.end is not None:
            low = least[: len(self.end)]
            if low > self.end or low == self.end and not self.end_included and len(self.end) == len(least):
                return False
        return True

    def covers(self, least: Key, greatest: Key) -> bool:
        """Whether all keys of such a file lie in the range."""
        if self.empty:
            return False
        inside = True
        if self.start is not None:
            low = least[: len(self.start)]
            inside &= low > self.start or low == self.start and self.start_included
        if self.end is not None:
            top = greatest[: len(self.end)]
            inside &= top < self.end or top == self.end and self.end_included
        return inside


def to_json(key: Key) -> list:
    """A key as JSON values; those without a JSON type carry a tag."""
    out = []
    for x in key:
        if isinstance(x, (bytes, bytearray)):
            out.append({"bytes": bytes(x).hex()})
        elif isinstance(x, dt.datetime):
            out.append({"datetime": x.isoformat()})
        elif isinstance(x, dt.date):
            out.append({"date": x.isoformat()})
        elif isinstance(x, decimal.Decimal):
            out.append({"decimal": str(x)})
        else:
            out.append(x)
    return out


def from_json(values: list) -> Key:
    read = {"bytes": bytes.fromhex, "datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "decimal": decimal.Decimal}
    return tuple(read[next(iter(x))](next(iter(x.values()))) if isinstance(x, dict) else x for x in values)
