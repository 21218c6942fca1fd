"""Streams of usage events: windows with late data, duplicates within a watermark, rolling budgets, drift."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrymill.runtime import Workspace


def event_stream(spark: SparkSession, folder: str, file: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder whose names match ``file``, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("recursiveFileLookup", "false").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def folder_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream can give now, read back from an exactly-once file sink in the shared folder.

    Only ``append`` suits the sink; windows are then final once the watermark passes them. ``update`` and ``complete``
    results are written batch by batch, of which the last row of each key counts.
    """
    ws = Workspace(df.sparkSession, name)
    out, state = f"{ws.root}/out", f"{ws.root}/state"
    w = df.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).outputMode("append").start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda d, i: d.withColumn("batch_id", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return df.sparkSession.read.parquet(out)


def windowed_usage(events: DataFrame, ts: str, by: str, value: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Calls and sums by window; events later than ``late`` behind the newest are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once_within(events: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first event of each key as long as repeats come within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def rolling_sum(events: DataFrame, by: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Sum of the last ``seconds`` up to each event, events of the same second included (batch)."""
    w = Window.partitionBy(by).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(-seconds, 0)
    return events.withColumn("rolling", F.round(F.sum(value).over(w), 4))


def sessions_batch(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of each key by gaps between its events (batch)."""
    order = Window.partitionBy(by).orderBy(ts)
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    new = F.coalesce((sec - F.lag(sec).over(order) >= gap_seconds).cast("int"), F.lit(1))
    d = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(order))
    return d.groupBy(by, "_s").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_last"), F.count("*").alias("n")).drop("_s")


_BUDGET = "key string, admitted long, refused long, spent double"


def call_budget(events: DataFrame, key: str, cost: str, order: str, cap: float) -> DataFrame:
    """Running state of a persisted budget: an event is admitted while the spent costs stay within ``cap``.

    State is three numbers a key. Within a micro-batch events are taken in ``order``; over batches in their order of
    arrival, as a ledger does.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admitted, refused, spent = state.get if state.exists else (0, 0, 0.0)
        for pdf in batches:
            for c in pdf.sort_values(order, kind="stable")[cost]:
                if spent + c <= cap:
                    admitted, spent = admitted + 1, spent + float(c)
                else:
                    refused += 1
        state.update((admitted, refused, spent))
        yield pd.DataFrame({"key": [str(k[0])], "admitted": [admitted], "refused": [refused], "spent": [round(spent, 4)]})

    return events.groupBy(key).applyInPandasWithState(step, _BUDGET, "admitted long, refused long, spent double", "update", GroupStateTimeout.NoTimeout)


def drift(stream: DataFrame, frozen: DataFrame, key: str, digest: Column) -> DataFrame:
    """Rows of a stream whose digest differs from that of a frozen table, or that it lacks."""
    f = frozen.select(key, digest.alias("frozen_digest"))
    d = stream.withColumn("digest", digest).join(f, key, "left")
    return d.where(~F.col("digest").eqNullSafe(F.col("frozen_digest"))).select(key, F.when(F.col("frozen_digest").isNull(), "new").otherwise("changed").alias("status"))
