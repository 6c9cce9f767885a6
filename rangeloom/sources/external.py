"""Loading tables from files of other formats and writing their rows out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..operators.reads import ReadView
from ..table import KeyedTable, Options


def table_from_files(spark: SparkSession, path: str, files: str | list[str], *, key: str | Sequence[str], format: str = "parquet", schema: T.StructType | str | None = None, options: Options | None = None, **read: str) -> KeyedTable:
    """A new table at ``path`` with the rows of files; text formats need a ``schema`` (nothing is inferred)."""
    if schema is None and format in ("csv", "json", "text"):
        raise ValueError(f"{format} files need a schema")
    reader = spark.read.format(format).options(**read)
    rows = (reader.schema(schema) if schema is not None else reader).load(files)
    table = KeyedTable.create(spark, path, rows.schema, key, options)
    table.load(rows)
    return table


def export(view: ReadView, path: str, *, format: str = "parquet", ordered: bool = True, **write: str) -> None:
    """Write a view's rows; ``ordered``: files by ascending key ranges, sorted inside."""
    rows = view.rows
    if ordered:
        rows = rows.repartitionByRange(*view.key).sortWithinPartitions(*view.key)
    rows.write.format(format).options(**write).save(path)
