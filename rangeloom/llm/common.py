"""Helpers shared by the text operators: scratch tables in the cluster's shared folder, and byte-bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.scratch import Scratch, materialise, shared_folder

__all__ = ["Scratch", "bounded_batches", "by_size", "materialise", "shared_folder", "sole", "unused"]

#: Spark's limit of a batch that goes to Python, as it comes and as the text operators set it.
_LIMIT, _DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"

_held: dict[tuple, Any] = {}


def sole(build: Callable, *args) -> Any:
    """``build(*args)``, kept until another is asked for: a Python worker serves stage after stage, and needs the tables of one."""
    wanted = (build, *args)
    if wanted not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[wanted] = build(*args)
    return _held[wanted]


def bounded_batches(df: DataFrame) -> None:
    """Let a session send texts to Python in batches of 4 MB, unless it names a limit of its own: rows can be long."""
    if df.sparkSession.conf.get(_LIMIT) == _DEFAULT:
        df.sparkSession.conf.set(_LIMIT, BATCH)


def by_size(texts: Iterable[str | None], most: int) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) in lists of about ``most`` characters; a longer text stands alone."""
    held: list[str] = []
    n = 0
    for text in texts:
        text = text or ""
        if held and n + len(text) > most:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def unused(name: str, *taken: str) -> str:
    """``name``, with underscores behind it while a column is called so."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
