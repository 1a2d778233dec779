"""Session states, detection logs and the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sulatan.operators.ordered import skew_join


#: fixed value: the status a session opens with
OPENING = "Processing"


def session_latest_status(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Latest state of each session from an append-only log of status events.

    ``end_time`` is the time of the newest update; null while a session has only opened.
    """
    latest = F.max_by("status", F.struct("ts", "event_id"))
    return events.filter(F.col(session) != 0).groupBy(session).agg(
        latest.alias("status"), F.min("ts").alias("start_time"), F.max(F.when(F.col("status") != OPENING, F.col("ts"))).alias("end_time"), F.count(F.lit(1)).alias("n_events"))


def detection_log_rows(replies: DataFrame, detections: str = "detections", session: str = "session_id") -> DataFrame:
    """One log row per detection; nothing for session 0 or an empty list."""
    others = [c for c in replies.columns if c != detections]
    rows = replies.filter(F.col(session) != 0).select(*others, F.posexplode(detections).alias("pos", "_d"))
    return rows.select(*others, F.col("pos").cast("long").alias("pos"), "_d.char", "_d.confidence")


def safe_label(char) -> Column:
    """A label that is not an unresolved slot and cannot leave its folder."""
    c = F.col(char) if isinstance(char, str) else char
    return ~c.rlike("[{/]")


def archive_eligible(detections: DataFrame, manifest: DataFrame, root: str, path: str = "temp_path") -> DataFrame:
    """Detections that may be archived: complete, eligible, inside the root, and the file exists."""
    inside = F.col(path).startswith(root.rstrip("/") + "/") & ~F.col(path).rlike(r"(^|/)\.\.(/|$)")
    ok = detections.filter((F.coalesce("char", F.lit("")) != "") & (F.coalesce(path, F.lit("")) != "")
                           & F.coalesce("is_eligible", F.lit(False)) & inside & safe_label("char"))
    files = manifest.select(F.col(path).alias("_file"))
    return ok.join(files, F.col(path) == F.col("_file"), "left_semi")


def archive_entries(eligible: DataFrame) -> DataFrame:
    """Archive rows of eligible detections: the confirmed label, and the class the crop's name says was predicted.

    A detection becomes eligible only by its user's consent to the label, so every entry is ``verified``.
    """
    predicted = F.regexp_extract("crop_name", "^([^_]+)_", 1)
    return eligible.select("session_id", "crop_name", predicted.alias("predicted"), "confidence", F.lit(True).alias("verified"), F.col("char").alias("label"))


def session_detections(sessions: DataFrame, detections: DataFrame, archive: DataFrame) -> DataFrame:
    """Detections of known sessions with their archive entry, if any.

    One session may own a large share of the log, so the session key is spread.
    """
    logged = skew_join(detections, sessions.select("session_id", F.col("status").alias("session_status")), ["session_id"], ["log_id"])
    return logged.join(archive.select("log_id", F.col("label").alias("archive_label")), "log_id", "left")


def orphan_detections(detections: DataFrame, sessions: DataFrame) -> DataFrame:
    """Detections whose session is gone; a cascading delete would drop them."""
    return detections.join(sessions.select("session_id"), "session_id", "left_anti")
