"""Incremental ingest: new document files become upserted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..logs import Progress
from ..operators.store import Table


def upsert_stream(stream: DataFrame, table: Table, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces its keys; of rows that share a key in a batch the last by `order` wins. A batch that is
    replayed after a failure gives the same table, so writes are effectively once. Progress is logged batch by batch."""

    def apply(batch: DataFrame, _: int) -> None:
        table.upsert(batch, keys, order)  # reads the batch once

    progress = Progress("upserted")
    stream.sparkSession.streams.addListener(progress)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    progress.watch(query)
    return query


def document_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
