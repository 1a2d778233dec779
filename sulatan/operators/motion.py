"""Steadiness of a device from its motion readings (batch form).

The last twenty readings are an ordinary row frame. A device with very many
readings is cut into time slices; each slice borrows the nineteen readings
before it, so the frame never needs the whole device in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sulatan.operators.ordered import CHUNK, running, time_chunked, with_halo

# Frame length, jitter that counts as 0 %, threshold and hold time.
FRAME = 20
JITTER_AT_ZERO = 1.2
STEADY_PERCENT = 95.0
HOLD_SECONDS = 0.7
SLICE_SECONDS = 86400.0


def magnitude():
    return F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))


def steadiness(readings: DataFrame, keys: list[str] | None = None, frame: int = FRAME,
               slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """``percent`` steady after each reading that completes a frame."""
    keys, order = keys or ["device_id"], ["ts", "event_id"]
    df = time_chunked(readings.withColumn("magnitude", magnitude()), "ts", slice_seconds)
    rows = with_halo(df, keys, order, ["magnitude"], frame - 1)
    w = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(-(frame - 1), 0)
    out = rows.select(*keys, *order, "_halo", "magnitude", F.count(F.lit(1)).over(w).alias("_n"), F.stddev_pop("magnitude").over(w).alias("jitter"))
    percent = F.greatest(F.least(100.0 * (1.0 - F.col("jitter") / JITTER_AT_ZERO), F.lit(100.0)), F.lit(0.0))
    return out.filter(~F.col("_halo") & (F.col("_n") == frame)).select(*keys, *order, "magnitude", "jitter", percent.alias("percent"))


def held_steady(steady: DataFrame, keys: list[str] | None = None, percent: float = STEADY_PERCENT, hold: float = HOLD_SECONDS,
                slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """First moment of each steady stretch that has lasted ``hold`` seconds.

    A stretch starts after any unsteady reading; its start time is the newest
    time at which a stretch began, a running maximum.
    """
    keys, order = keys or ["device_id"], ["ts", "event_id"]
    df = time_chunked(steady.withColumn("_low", (F.col("percent") < percent).cast("long")), "ts", slice_seconds)
    # the number of unsteady readings so far names the stretch a steady reading belongs to
    numbered = running(df, keys, order, sums={"_stretch": "_low"}).filter("_low = 0")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    begun = numbered.groupBy(*keys, "_stretch", CHUNK).agg(F.min("ts").alias("_t0"), F.count(F.lit(1)).alias("_c"))
    start = begun.groupBy(*keys, "_stretch").agg(F.min("_t0").alias("started"))
    # one row per stretch and slice meets the start, then the rows of that slice do
    starts = begun.select(*keys, "_stretch", CHUNK).join(start, [*keys, "_stretch"])
    held = numbered.join(starts, [*keys, "_stretch", CHUNK])
    long_enough = micros - F.unix_micros(F.col("started").cast("timestamp")) >= F.lit(int(hold * 1_000_000))
    return (held.filter(long_enough).groupBy(*keys, "started")
            .agg(F.min_by("event_id", F.struct(*order)).alias("event_id"), F.min("ts").alias("fired_at")))
