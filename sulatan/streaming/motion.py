"""Steadiness and held-steady events on a stream of motion readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sulatan.operators.motion import FRAME, HOLD_SECONDS, JITTER_AT_ZERO, STEADY_PERCENT, held_steady, magnitude, steadiness

OUTPUT = "device_id long, ts timestamp, event_id long, percent double, fired boolean"
STATE = "recent array<double>, since timestamp, fired boolean, last_ts timestamp, last_id long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold the new readings of one device into its last magnitudes and hold timer."""
    if state.exists:
        recent, since, fired, last_ts, last_id = state.get
        recent = list(recent)
    else:
        recent, since, fired, last_ts, last_id = [], None, False, None, -1
    since = None if since is None or pd.isna(since) else pd.Timestamp(since)
    last = None if last_ts is None or pd.isna(last_ts) else (pd.Timestamp(last_ts), last_id)
    # a micro-batch hands a device's readings over in any order
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], ignore_index=True)
    out = []
    for ts, event_id, value in zip(rows["ts"], rows["event_id"], rows["magnitude"]):
        if last is not None and (ts, event_id) <= last:
            continue  # older than what was already folded in
        last = (ts, int(event_id))
        recent = [*recent, float(value)][-FRAME:]
        if len(recent) < FRAME:
            continue
        percent = float(np.clip(100.0 * (1.0 - np.std(recent) / JITTER_AT_ZERO), 0.0, 100.0))
        fires = False
        if percent >= STEADY_PERCENT:
            since = ts if since is None else since
            fires = not fired and (ts - since).total_seconds() >= HOLD_SECONDS
            fired = fired or fires
        else:
            since, fired = None, False
        out.append((key[0], ts, int(event_id), percent, fires))
    if last is not None:
        state.update((recent, since, fired, last[0], last[1]))
    yield pd.DataFrame(out, columns=["device_id", "ts", "event_id", "percent", "fired"])


def steadiness_stream(readings: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Per reading: percent steady and whether it fires the held-steady event.

    For readings that come in time order: state per device is twenty numbers
    and a few scalars, and readings older than the watermark, or than the
    device's newest one, are dropped. `start_motion_log` takes any order.
    """
    df = (readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
          .select("device_id", "ts", "event_id", magnitude().alias("magnitude")))
    return df.groupBy("device_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def start_motion_log(readings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep every reading of a stream, late or not, below ``path``; a retried batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")

    columns = [F.col("ts").cast("timestamp").alias("ts") if c == "ts" else F.col(c) for c in ("device_id", "ts", "event_id", "x", "y", "z")]
    return (readings.select(*columns).writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start())


def current_steadiness(spark: SparkSession, path: str) -> DataFrame:
    """Percent steady and held-steady events of all kept readings, by the batch operators.

    Where a late reading falls between earlier ones, the frames around it come
    out as if it had been there from the start.
    """
    steady = steadiness(spark.read.option("basePath", path).parquet(path).drop("batch"))
    fired = held_steady(steady).select("device_id", "event_id", F.lit(True).alias("fired"))
    return steady.join(fired, ["device_id", "event_id"], "left").select("device_id", "ts", "event_id", "percent", F.coalesce("fired", F.lit(False)).alias("fired"))
