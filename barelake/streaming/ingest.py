"""Adding tables to a lake as they arrive.

Each micro-batch of (table_id, block) is parsed and appended to the stored
cells, and its statistics beside them, so searches see new tables without the
old ones being read again. A batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import Lake
from ..sources.database import tables_from_blocks


def write_batch(path: str):
    """foreachBatch function: cells and table statistics below ``path``, in a folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        lake = tables_from_blocks(batch)
        lake.cells.write.mode("overwrite").parquet(f"{path}/cells/batch={number}")
        lake.tables.write.mode("overwrite").parquet(f"{path}/tables/batch={number}")

    return write


def ingest(blocks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends a stream of (table_id long, block string) to a lake at ``path``."""
    return blocks.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_lake(spark, path: str) -> Lake:
    return Lake(spark.read.parquet(f"{path}/cells").drop("batch"))
