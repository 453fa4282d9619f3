"""A stream of positions snapped to roads, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from wayloom.operators import spatial


def snap_stream(points: DataFrame, edges: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that snaps each micro-batch (point_id, lat, lon) and writes it once to ``folder``/batch=N."""

    def write(batch: DataFrame, n: int) -> None:
        spatial.snap(batch, edges).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return points.writeStream.foreachBatch(write)
