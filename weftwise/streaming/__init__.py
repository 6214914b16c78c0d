"""Requests as a stream: the same plans, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Answer a stream of requests with a plan that needs whole batches (clustering iterates).

    Each micro-batch's answers are written below ``path`` under its number, so a batch that is run again
    after a failure overwrites its own answers.
    """

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
