"""A keyed table as the sink of a stream: each micro-batch is one atomic upsert, applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.writes import last_wins
from ..table import KeyedTable


def upsert_stream(stream: DataFrame, table: KeyedTable, *, name: str, checkpoint: str, order: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Upsert a stream's rows into ``table``. ``order``: the column by which the last of several rows with one key wins.

    The table's versions record the last batch of each ``name``, so a batch that comes again after a failure has no
    effect.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = last_wins(batch, table.key, order) if order else batch
        table.put_range(rows.select(*table.schema.names), batch_id=(name, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
