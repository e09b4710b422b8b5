"""Incremental re-index as a stream: new listing files are taken up batch by batch and put into a partition store.

The state is the store itself, which keeps the time of each file's latest sighting; no watermark is needed, as a
sighting that comes late is older than the one that is stored and changes nothing. Each batch reads and replaces
only the partitions its rows fall into, and is idempotent: replayed after a failure it finds its rows there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.incremental import PartitionStore


def follow(spark: SparkSession, folder: str, schema: StructType, store: PartitionStore, checkpoint: str, by: str, name_filter: str | None = None) -> None:
    """Take up all listing files that have come since the last call, at most 100 a batch."""
    if by not in store.content:
        store.content.append(by)  # the time is part of the fingerprint: a newer sighting is stored even if nothing else is new

    def merge(batch: DataFrame, _: int) -> None:
        store.upsert(batch.select(store.key, *store.content).where(F.col(store.key).isNotNull()), by)

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    q = reader.parquet(folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
