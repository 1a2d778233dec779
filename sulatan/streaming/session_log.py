"""Running session status and detection counts from the append-only event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sulatan.operators.logs import OPENING
from pyspark.sql.streaming import StreamingQuery


def session_states(events: DataFrame) -> DataFrame:
    """Per session: newest status, first and last time, number of events.

    A partial state: the states of any parts of the log, in any order, merge
    to the state of the whole (`current_sessions`). A session with very many
    events is reduced inside each task before the shuffle.
    """
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("session_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("first_ts"),
        F.count(F.lit(1)).alias("n_events"), F.max(F.struct("ts", "event_id")).alias("newest"),
        F.max(F.when(F.col("status") != OPENING, F.col("ts"))).alias("last_update"),
    ).select("session_id", "status", "first_ts", F.col("newest.ts").alias("last_ts"), "n_events",
             F.col("newest.event_id").alias("last_event_id"), "last_update")


#: parts of one size that are merged into one of the next size
FANIN = 8


def _merged(parts: DataFrame) -> DataFrame:
    """States of the same sessions as one."""
    return parts.groupBy("session_id").agg(
        F.max_by("status", F.struct("last_ts", "last_event_id")).alias("status"), F.min("first_ts").alias("first_ts"),
        F.max(F.struct("last_ts", "last_event_id")).alias("newest"), F.sum("n_events").alias("n_events"), F.max("last_update").alias("last_update"),
    ).select("session_id", "status", "first_ts", F.col("newest.last_ts").alias("last_ts"), "n_events",
             F.col("newest.last_event_id").alias("last_event_id"), "last_update")


def _live(n: int, fanin: int) -> list[tuple[int, int]]:
    """``(first batch, batches)`` of the parts that hold ``n`` batches: fewer than ``fanin`` of each size."""
    size = 1
    while size * fanin <= n:
        size *= fanin
    out, at = [], 0
    while at < n:
        while at + size > n:
            size //= fanin
        out.append((at, size))
        at += size
    return out


def _part(path: str, at: int, size: int) -> str:
    return f"{path}/size={size}/first={at:010d}"


class _Manifest:
    """The number of batches that count, in one small file that is replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.gateway, self.jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("manifest").getFileSystem(self.conf)

    def read(self) -> int:
        at = self._at("manifest")
        if not self._fs().exists(at):
            return 0
        stream = self._fs().open(at)
        try:
            return stream.readInt()
        finally:
            stream.close()

    def write(self, n: int) -> None:
        stream = self._fs().create(self._at("manifest-next"), True)
        stream.writeInt(n)
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("manifest").toUri(), self.conf).rename(self._at("manifest-next"), self._at("manifest"), options)

    def drop(self, part: str) -> None:
        self._fs().delete(self.jvm.org.apache.hadoop.fs.Path(part), True)


def write_batch(batch: DataFrame, batch_id: int, path: str, fanin: int = FANIN) -> None:
    """The states of one micro-batch as a part, and the merges that are due with it."""
    spark, n = batch.sparkSession, batch_id + 1
    session_states(batch).write.mode("overwrite").parquet(_part(path, batch_id, 1))
    size = fanin
    while n % size == 0:
        parts = [_part(path, at, size // fanin) for at in range(n - size, n, size // fanin)]
        _merged(spark.read.parquet(*parts)).write.mode("overwrite").parquet(_part(path, n - size, size))
        size *= fanin
    manifest = _Manifest(spark, path)
    manifest.write(n)
    # a retry of this batch starts from what counted before it
    kept = {*_live(n, fanin), *_live(batch_id, fanin)}
    for at, held in {*_live(max(batch_id - 1, 0), fanin), *((batch_id - s, s) for s in _sizes(batch_id, fanin))} - kept:
        manifest.drop(_part(path, at, held))


def start_session_log(events: DataFrame, path: str, checkpoint: str, fanin: int = FANIN, **trigger) -> StreamingQuery:
    """Write each micro-batch's session states below ``path``; a retried batch replaces itself.

    There is no watermark: late and out-of-order events count like others.
    ``fanin`` parts of one size are merged into one part of the next, so after
    n batches there are fewer than ``fanin`` parts of each of log(n) sizes. A
    part's name follows from its batches and merging changes no state, so a
    batch can be written again at any point. The manifest counts a batch only
    once all its parts are complete; parts are dropped when neither the newest
    batch nor a retry of it needs them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, path, fanin)

    return (events.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start())


def _sizes(n: int, fanin: int) -> list[int]:
    """Sizes of the parts that end at batch ``n``."""
    out = []
    size = 1
    while n and n % size == 0:
        out.append(size)
        size *= fanin
    return out


def current_sessions(spark: SparkSession, path: str, fanin: int = FANIN) -> DataFrame:
    """State of every session from the parts that count."""
    schema = "session_id long, status string, first_ts timestamp, last_ts timestamp, n_events long, last_event_id long, last_update timestamp"
    parts = [_part(path, at, size) for at, size in _live(_Manifest(spark, path).read(), fanin)]
    states = spark.read.parquet(*parts) if parts else spark.createDataFrame([], schema)
    return _merged(states).select("session_id", "status", F.col("first_ts").alias("start_time"), F.col("last_update").alias("end_time"), "n_events")
