"""A streaming front for decisions: each micro-batch is merged into the table of units (an addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glotmill.operators import decisions as D


def merge_stream(stream: DataFrame, units_path: str, checkpoint: str) -> StreamingQuery:
    """Merge decisions as they come; version n of the units is `units_path/v=n` for batch n, so a replayed batch overwrites its own."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        units = spark.read.parquet(f"{units_path}/v={n}")
        D.merge(units, D.judge(batch, units)).write.mode("overwrite").parquet(f"{units_path}/v={n + 1}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
