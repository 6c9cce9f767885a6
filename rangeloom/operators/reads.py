"""Reads over an ordered keyed table. Methods give lazy DataFrames, but for those that give one value; reads by a batch
of keys count the batch when they are called."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..bounds import KeyRange

#: Up to so many probes, counted first, go to every task, so that only matching rows of the table are shuffled.
BROADCAST_PROBES = 100_000


def narrowed(rows: DataFrame, probes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows``, less rows that no probe can meet where the probes are few."""
    wanted = probes.select(*key)
    if wanted.limit(BROADCAST_PROBES + 1).count() > BROADCAST_PROBES:
        return rows
    return rows.join(F.broadcast(wanted), list(key), "left_semi")


class ReadView:
    """Reads of rows with unique, non-null keys.

    ``source`` gives the rows of a key range (it may give more: every method filters); tables prune files there.
    """

    def __init__(self, source: DataFrame | Callable[[KeyRange], DataFrame], key: str | Sequence[str], *, default_is_unbounded: bool = False):
        self.key = [key] if isinstance(key, str) else list(key)
        self._source = source if callable(source) and not isinstance(source, DataFrame) else (lambda _: source)
        self._default_is_unbounded = default_is_unbounded

    def _range(self, start: Any = None, end: Any = None, **more: bool) -> KeyRange:
        return KeyRange.of(start, end, width=len(self.key), default_is_unbounded=self._default_is_unbounded, **more)

    def _within(self, wanted: KeyRange) -> DataFrame:
        rows = self._source(wanted)
        return rows if wanted == KeyRange() else rows.where(wanted.condition(self.key))

    def _exactly(self, key: Any) -> KeyRange:
        return KeyRange.of(key, key, width=len(self.key))

    @property
    def rows(self) -> DataFrame:
        """All rows, in no order."""
        return self._source(KeyRange())

    def _ascending(self) -> list[Column]:
        return [F.col(c).asc() for c in self.key]

    def _descending(self) -> list[Column]:
        return [F.col(c).desc() for c in self.key]

    def _met_by(self, probes: DataFrame) -> DataFrame:
        """Rows that the keys of ``probes`` can meet, maybe more."""
        return narrowed(self.rows, probes, self.key)

    # lookups
    def get(self, key: Any) -> DataFrame:
        """The row with ``key``: one or none."""
        return self._within(self._exactly(key))

    def try_get(self, key: Any) -> Row | None:
        return self.get(key).first()

    def contains(self, key: Any) -> bool:
        return not self.get(key).select(*self.key).isEmpty()

    def __getitem__(self, key: Any) -> Row:
        row = self.try_get(key)
        if row is None:
            raise KeyError(key)
        return row

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """Each probe with the row of its key and ``found``; absent keys have nulls."""
        here = self._met_by(probes).withColumn("found", F.lit(True))
        return probes.join(here, self.key, "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def present(self, probes: DataFrame) -> DataFrame:
        """The probes whose key is in the table."""
        return probes.join(self._met_by(probes).select(*self.key), self.key, "left_semi")

    def absent(self, probes: DataFrame) -> DataFrame:
        """The probes whose key isn't in the table."""
        return probes.join(self._met_by(probes).select(*self.key), self.key, "left_anti")

    def keys_unordered(self) -> DataFrame:
        return self._source(KeyRange()).select(*self.key)

    def keys(self) -> DataFrame:
        return self.keys_unordered().orderBy(*self._ascending())

    def values(self) -> DataFrame:
        """The other columns, in the order of keys."""
        rows = self.rows
        return rows.orderBy(*self._ascending()).select(*[c for c in rows.columns if c not in self.key])

    def items(self) -> DataFrame:
        return self.scan()

    # scans
    def scan(self, start: Any = None, end: Any = None, **more: bool) -> DataFrame:
        """Rows from ``start`` to ``end``, both included, by ascending key. None: open; any value, 0 too, is a bound."""
        return self._within(self._range(start, end, **more)).orderBy(*self._ascending())

    def scan_reverse(self, start: Any = None, end: Any = None, **more: bool) -> DataFrame:
        return self._within(self._range(start, end, **more)).orderBy(*self._descending())

    def scan_unordered(self, start: Any = None, end: Any = None, **more: bool) -> DataFrame:
        """As scan, without the global sort, for what goes on to other operators."""
        return self._within(self._range(start, end, **more))

    def __iter__(self) -> Iterator[Row]:
        """All rows by ascending key, one after the other in this process; ``each`` goes through them where they are."""
        return self.scan().toLocalIterator()

    def each(self, visit: Callable[[Iterator[Row]], Iterable[tuple]], schema: T.StructType | str) -> DataFrame:
        """What ``visit`` yields going through all rows by ascending key: range after range of keys, each in its own
        task, with a call for each. The result is in that order; no row goes through the driver."""
        rows = self.scan()
        return rows.sparkSession.createDataFrame(rows.rdd.mapPartitions(visit), schema)

    def top(self, n: int) -> DataFrame:
        """The ``n`` rows with the smallest keys."""
        return self.scan().limit(n)

    def latest(self, n: int) -> DataFrame:
        """The ``n`` rows with the greatest keys."""
        return self.scan_reverse().limit(n)

    def page(self, size: int, *, after: Any = None, before: Any = None, reverse: bool = False) -> DataFrame:
        """One page by key: rows strictly behind ``after`` (strictly under ``before`` when going down)."""
        wanted = self._range(after, before, start_included=False, end_included=False)
        return self._within(wanted).orderBy(*(self._descending() if reverse else self._ascending())).limit(size)

    def top_by(self, value: str, n: int) -> DataFrame:
        """The ``n`` rows with the greatest ``value``; ties by key."""
        return self.rows.orderBy(F.col(value).desc_nulls_last(), *self._ascending()).limit(n)

    # ends and neighbours
    def first(self) -> DataFrame:
        return self.top(1)

    def last(self) -> DataFrame:
        return self.latest(1)

    def next_after(self, key: Any) -> DataFrame:
        """The row with the smallest key strictly greater than ``key``, which may be absent."""
        return self.page(1, after=key)

    def prev_before(self, key: Any) -> DataFrame:
        return self.page(1, before=key, reverse=True)

    # counts
    def count(self) -> int:
        return self.keys_unordered().count()

    def count_range(self, start: Any = None, end: Any = None, **more: bool) -> int:
        """Rows in the range; 0 if it is inverted. Reads the key columns only."""
        wanted = self._range(start, end, **more)
        return 0 if wanted.empty else self._within(wanted).select(*self.key).count()

    def __len__(self) -> int:
        return self.count()
