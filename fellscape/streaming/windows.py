"""Count windows, running moments and event-time windows, as batch and as stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.functions.scalar import finite
from fellscape.operators.stats import with_ordinal_rank


def fnv1a(values: Sequence[float]) -> int:
    """32-bit FNV-1a over the texts of values rounded to 12 digits (fixed values of that hash)."""
    h = 0x811C9DC5
    for v in values:
        for byte in repr(round(float(v), 12)).encode():
            h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
    return h


def count_windows(events: DataFrame, source: str, value: str, order: Sequence[str], size: int) -> DataFrame:
    """(source, window, n, mean, p50, p95, complete): tumbling windows of ``size`` values per source, with the tail.

    ``order`` must tell all rows of a source apart; places come from range partitions, so a source
    that holds most events is not sorted in one task.
    """
    rows = events.where(finite(value)).select(source, value, *[c for c in order if c not in (source, value)])
    placed = with_ordinal_rank(rows, order, [source], "_at").withColumn("window", F.floor((F.col("_at") - 1) / size).cast("bigint"))
    return placed.groupBy(source, "window").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), (F.count("*") == size).alias("complete")
    )


def running_moments(events: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample variance and extremes; on a stream these are updated per micro-batch."""
    return events.where(finite(value)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"), F.min(value).alias("low"), F.max(value).alias("high"))


def event_windows(events: DataFrame, time: str, by: Sequence[str], value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Tumbling event-time windows; with ``late`` a watermark bounds the state of a stream."""
    rows = events.withWatermark(time, late) if late else events
    return rows.where(finite(value)).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: Sequence[str], gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions: events of a key less than ``gap`` apart."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def stream_count_windows(events: DataFrame, source: str, ordinal: str, value: str, size: int) -> DataFrame:
    """Count windows of a stream: state holds the values of the open window of each source only.

    Emits (source, window, n, mean, p50, p95, digest) as windows fill. Values arrive in the order
    of ``ordinal`` within a batch; the tail stays in the state until it is full.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, window = state.get if state.exists else ([], 0)
        held = list(held)
        fresh = pd.concat(list(frames)).sort_values(ordinal)[value].tolist()
        held += [x for x in fresh if x is not None and x == x and abs(x) != float("inf")]
        out = []
        while len(held) >= size:
            part, held = held[:size], held[size:]
            s = pd.Series(part)
            out.append((key[0], window, size, s.mean(), s.quantile(0.5), s.quantile(0.95), fnv1a(part)))
            window += 1
        state.update((held, window))
        if out:
            yield pd.DataFrame(out, columns=["source", "window", "n", "mean", "p50", "p95", "digest"])

    return events.select(F.col(source).alias("source"), ordinal, value).groupBy("source").applyInPandasWithState(
        step, "source STRING, window BIGINT, n BIGINT, mean DOUBLE, p50 DOUBLE, p95 DOUBLE, digest BIGINT", "held ARRAY<DOUBLE>, window BIGINT", "append", "NoTimeout"
    )


def write_checkpoints(stream: DataFrame, folder: str, checkpoint: str):
    """A streaming query that appends finished windows to Parquet, exactly once per batch."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class OnlineLandscape:
    """Cells that arrive in batches: rows are appended to a table, moments are read from all of them."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def update(self, cells: DataFrame) -> None:
        cells.write.mode("append").parquet(self.folder)

    def snapshot(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def diagnostics(self, value: str) -> DataFrame:
        return running_moments(self.snapshot(), [], value)
