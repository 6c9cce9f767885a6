"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master, where nothing else shares it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="rangeloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Scopes that are open, the innermost last.
_open: list[Scratch] = []


class Scratch:
    """The tables that ``materialise`` writes inside a ``with`` block are deleted at its end, but for results.

    A table that a later one was computed from isn't needed once that one is written whole.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_: Any) -> None:
        _open.remove(self)
        for path in self._paths:
            where = self._spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, materialised for what lies around the block."""
        at = _open.index(self)
        return _written(df, name, _open[at - 1] if at else None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    return _written(df, name, _open[-1] if _open else None)


def _written(df: DataFrame, name: str, scope: Scratch | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if scope:
        scope._paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
