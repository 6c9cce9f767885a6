"""Errors that keyed tables raise."""

from __future__ import annotations


class KeyedTableError(Exception):
    """Base of all errors here."""


class ConflictError(KeyedTableError):
    """Another commit came first; ``winner`` is its version."""

    def __init__(self, read_version: int, winner: int, what: str = "the table"):
        super().__init__(f"{what} changed: read at version {read_version}, version {winner} came first")
        self.read_version, self.winner = read_version, winner


class ClosedError(KeyedTableError):
    """The table, snapshot or transaction is closed."""


class FinishedError(KeyedTableError):
    """The transaction has been committed or rolled back."""


class SchemaError(KeyedTableError):
    """Rows don't fit the table's schema."""


class NullKeyError(KeyedTableError):
    """A key is null."""


class KeyTooLongError(KeyedTableError):
    """A key has more bytes than the options allow."""

    def __init__(self, actual: int, limit: int):
        super().__init__(f"a key of {actual} bytes; at most {limit} are allowed")
        self.actual, self.limit = actual, limit


class MaintenanceError(KeyedTableError):
    """A maintenance operation can't run now."""


class DuplicateKeyError(KeyedTableError):
    """Rows of one write hold a key more than once where that has no defined result."""
