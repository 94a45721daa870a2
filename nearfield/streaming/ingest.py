"""Streams into a store. Each micro-batch is a batch put or a maintenance pass against the newest snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.centroids import Now
from nearfield.sources.store import Store


def put_stream(points: DataFrame, store: Store, checkpoint: str, route: str = "fast", now: Now = None, trigger: dict | None = None) -> StreamingQuery:
    """Put a stream of points. The store keeps the number of the last micro-batch of each stream (by checkpoint), so that
    one repeated after a failure adds nothing twice, and no batch is compared with what is stored."""

    def put(batch: DataFrame, number: int) -> None:
        store.put(batch, route, now, stream=checkpoint, number=number)

    return points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def maintain_stream(spark: SparkSession, store: Store, checkpoint: str, seconds: int = 5, now: Callable[[], Now] = lambda: None) -> StreamingQuery:
    """A maintenance pass every so many seconds; the micro-batch's number is the pass's."""

    def run(_: DataFrame, number: int) -> None:
        store.maintain(number % 1001, now())

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
