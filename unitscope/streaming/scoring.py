"""Streams: units whose rows arrive as files, in any number of loads, are scored once with the frozen model; progress as results arrive."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from unitscope.operators.calibrate import rank_p_values
from unitscope.operators.energy import EnergyModel, energy
from unitscope.sources.tables import append_results, read_results

RESULTS = "unit_id long, n_sites long, mean_energy double, D double, null_size long, p_value double, status string"
_MOMENTS = "unit_id long, n long, mean double, m2 double, last boolean, event_time timestamp"
_STATE = "n long, mean double, m2 double, closed boolean"
#: What the stream makes of a unit: its moments when it is closed, or a number of rows that came after that.
_FOUND = "unit_id long, n_sites long, mean_energy double, D double, n_late long"


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row with the moments of each unit of each frame, so that few rows of a large unit are moved."""
    for frame in frames:
        units = frame.groupby("unit_id", sort=False)
        mean = units["energy"].transform("mean")
        m2 = ((frame["energy"] - mean) ** 2).groupby(frame["unit_id"], sort=False).sum()
        made = units.agg(n=("energy", "count"), mean=("energy", "mean"), last=("last", "max"), event_time=("event_time", "max"))
        made["m2"] = m2
        yield made.reset_index()[[c.split()[0] for c in _MOMENTS.split(", ")]]


def _gathered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, wait_ms: int) -> Iterator[pd.DataFrame]:
    """Adds moments to a unit's state; it is closed, and its result leaves, with its end marker or once event time has passed its last row by the timeout."""
    n, mean, m2, closed = state.get if state.exists else (0, 0.0, 0.0, False)
    names, before = [c.split()[0] for c in _FOUND.split(", ")], n
    close, newest = state.hasTimedOut, 0
    for frame in frames:
        for row in frame.itertuples():
            close |= bool(row.last)
            newest = max(newest, int(row.event_time.timestamp() * 1000))
            if row.n:
                away = row.mean - mean
                m2 += row.m2 + away * away * n * row.n / (n + row.n)
                mean += away * row.n / (n + row.n)
                n += row.n
    if closed:
        # Its result stands; the rows are counted and nothing else.
        if n > before:
            yield pd.DataFrame([(key[0], 0, 0.0, 0.0, n - before)], columns=names)
        return
    close = bool(close and n)
    state.update((n, mean, m2, close))
    if close:
        yield pd.DataFrame([(key[0], n, mean, m2 / n, 0)], columns=names)
    else:
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + wait_ms)


def scored(units: DataFrame, null: DataFrame) -> DataFrame:
    """Results of units (unit_id, n_sites, mean_energy, D) against a null table shared by all (a single D column)."""
    ranked = rank_p_values(units.withColumn("_all", F.lit(1)), null.select("D").withColumn("_all", F.lit(1)), "_all", split=True)
    return ranked.select(*(c.split(" ")[0] for c in RESULTS.split(", ")))


def score_files(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, model: EnergyModel, null: DataFrame, delay: str = "1 hour", wait_ms: int = 86_400_000) -> StreamingQuery:
    """Scores every unit of the Parquet files in source once and appends it to the store; a restart continues after the last finished batch.

    Files have unit_id, the model's features, event_time and last. A unit's rows may arrive in any number of files, batches and starts: its count, mean and
    squared deviations are kept as state, to which tasks send partial ones. A unit is closed by a row with `last`, whose features may be
    null, or once the watermark (the latest event_time less `delay`) has passed its last row by wait_ms. Rows that come after that
    change no result; `late_rows` counts them. (Those behind the watermark are dropped and counted by Spark's own
    progress.) A batch that is run again after a failure finds itself in the store by its number."""
    def append(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            append_results(scored(batch.filter("n_late = 0").drop("n_late"), null), f"{store}/results", number)
            append_results(batch.filter("n_late > 0").select("unit_id", "n_late"), f"{store}/late", number)
        finally:
            batch.unpersist()

    rows = spark.readStream.schema(schema).parquet(source).select("unit_id", energy(model).alias("energy"), F.coalesce("last", F.lit(False)).alias("last"), "event_time")
    moments = rows.filter("unit_id IS NOT NULL AND event_time IS NOT NULL").mapInPandas(_partial, _MOMENTS).withWatermark("event_time", delay)
    found = moments.groupBy("unit_id").applyInPandasWithState(partial(_gathered, wait_ms=wait_ms), _FOUND, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The results in a store."""
    return read_results(spark, f"{store}/results", RESULTS)


def late_rows(spark: SparkSession, store: str) -> DataFrame:
    """(unit_id, n_late) of the units of which rows came after their result."""
    return read_results(spark, f"{store}/late", "unit_id long, n_late long").groupBy("unit_id").agg(F.sum("n_late").alias("n_late"))


def progress(results: DataFrame) -> DataFrame:
    """Finished units and their running time by method and status; the same for a stream in complete mode."""
    return results.groupBy("method", "status").agg(F.count("*").alias("n"), F.sum("runtime_sec").alias("seconds"))


def progress_stream(spark: SparkSession, source: str, schema: str, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps an in-memory table of the progress of result files as they arrive."""
    stream = progress(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
