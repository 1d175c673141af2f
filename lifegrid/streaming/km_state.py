"""An addition: Kaplan-Meier state over a stream. The mergeable state is the time grid itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.timegrid import grid, survival


def stream_grid(rows: DataFrame, groups: list[str]) -> DataFrame:
    """The running grid of a stream of finished subjects (groups, time, event); its state is a row per group and time."""
    return grid(rows, groups)


def stream_curves(rows: DataFrame, groups: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls sink(curves, batch id) with the curves so far after each batch."""

    def each(batch: DataFrame, number: int) -> None:
        sink(survival(batch, groups).select(*groups, "time", "n", "d", "surv"), number)

    return stream_grid(rows, groups).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).start()
