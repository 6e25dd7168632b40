"""Live graphs: documents of a stream are appended to a collection, and graphs over it follow.

A graph is derived from its collections, so an append needs no upkeep of its own. Each micro-batch becomes a Parquet
append; a batch that is run again after a failure is written under the same name and so counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docgraph.graph import model


def append_stream(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch to ``path/batch=<n>``; trigger as for ``writeStream``, all that is there by default."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def edge_counts(stream: DataFrame, mapping: model.EdgeMapping, time_column: str, window: str, late: str) -> DataFrame:
    """(window, type, edges) of a streaming edge collection: tumbling windows of event time, rows later than ``late`` are dropped."""
    from pyspark.sql import functions as F

    ends = stream.withWatermark(time_column, late).filter(F.col(mapping.source).isNotNull() & F.col(mapping.target).isNotNull())
    return ends.groupBy(F.window(time_column, window)).agg(F.count("*").alias("edges")).withColumn("type", F.lit(mapping.type))
