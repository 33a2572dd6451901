"""Telemetry as Structured Streaming: the batch operators on streams, with watermarks, and a turn-by-turn stateful operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators import telemetry

FLUSH = "1500 milliseconds"


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """JSON files as they come, so many for a micro-batch; back-pressure takes the place of a queue that drops."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def windowed(points: DataFrame, length: str, slide: str | None = None, by: list[str] | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time windows; points later than the watermark no longer count."""
    return telemetry.windowed(points.withWatermark("ts", late), length, slide, by)


def sessions(points: DataFrame, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return telemetry.sessions(points.withWatermark("ts", late), gap, by)


def first_arrivals(points: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: what an at-least-once sender repeats goes."""
    return points.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def active_steps(lines: DataFrame) -> DataFrame:
    """(run_id, n, step) for streamed log lines (run_id, n, line): the last validation start, kept in state by run."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("n")
        found = rows["line"].str.extract(telemetry.STEP_MARK, expand=False).astype("Int64")
        steps = found.ffill().fillna(step) if step is not None else found.ffill()
        if len(steps) and not pd.isna(steps.iloc[-1]):
            state.update((int(steps.iloc[-1]),))
        yield pd.DataFrame({"run_id": key[0], "n": rows["n"].to_numpy(), "step": steps.astype("Int64").to_numpy()})

    return lines.groupBy("run_id").applyInPandasWithState(follow, "run_id string, n long, step long", "step long", "append", GroupStateTimeout.NoTimeout)


def latest_parameters(rows: DataFrame) -> DataFrame:
    """The latest parameters of each run."""
    return rows.groupBy("run_id").agg(F.max_by("params", "ts").alias("params"))


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs what is there to its end, batch by batch, and stops; started again it goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def follow(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs until stopped, a micro-batch every FLUSH."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=FLUSH).foreachBatch(each).start()
