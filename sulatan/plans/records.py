"""Queries on replies, sessions, detection logs, archives, pages and motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from sulatan.functions import replies as R
from sulatan.operators import logs as L
from sulatan.operators import metrics as M
from sulatan.operators import motion as MO
from sulatan.operators import pages as P
from sulatan.plans import views as V
from sulatan.plans.views import with_views
from sulatan.session import shared_folder
from sulatan.sources import sinks as S
from sulatan.sources.replies import parse_replies, reply_field
from sulatan.streaming import motion as SM
from sulatan.streaming import session_log as SL

ROOT = "/crops"


def _parsed(spark, sf):
    return parse_replies(V.v_replies(spark, sf))


def _parse(spark, sf):
    r = F.col("reply")
    return _parsed(spark, sf).select("event_id", r.isNotNull().alias("usable"), reply_field(r, "status").alias("status"),
                                     reply_field(r, "translated_text").alias("text"), reply_field(r, "confidence", "double").alias("confidence"))


def _detections(spark, sf):
    d = _parsed(spark, sf).select("event_id", F.col("user_id").alias("session_id"), R.sanitize_detections("reply").alias("detections"))
    return d


def _sanitized(spark, sf):
    d = _detections(spark, sf).select("event_id", F.posexplode("detections").alias("pos", "d"))
    return d.select("event_id", F.col("pos").cast("long").alias("pos"), "d.char", "d.confidence", F.col("d.bbox.x1").alias("x1"))


def _log_append(spark, sf):
    path = shared_folder(spark, "detection-log")
    S.append_detection_log(L.detection_log_rows(_detections(spark, sf)), path)
    return spark.read.parquet(path)


def _candidates(spark, sf):
    d = V.v_detections(spark, sf)
    name = F.concat(F.col("char"), F.lit("_"), F.col("event_id"), F.lit(".png"))
    folder = F.when(F.col("char") == "e", "/crops/../etc/").otherwise("/crops/")
    return d.select("session_id", "event_id", F.when(F.col("k") < 10, "{d/r}a").otherwise(F.col("char")).alias("char"), "confidence",
                    F.concat(folder, F.lit("session_"), F.col("session_id"), F.lit("/"), name).alias("temp_path"), name.alias("crop_name"),
                    (F.col("confidence") > 10).alias("is_eligible"), "k", "ts")


def _eligible(spark, sf):
    c = _candidates(spark, sf)
    return L.archive_eligible(c, c.filter("k >= 20").select("temp_path"), ROOT)


def _archive(spark, sf):
    path = shared_folder(spark, "archive")
    entries = L.archive_entries(_eligible(spark, sf))
    S.write_archive(entries, path)
    S.write_archive(entries, path)  # a repeated run adds nothing
    return S.read_archive(spark, path)


def _listing(spark, sf):
    path = shared_folder(spark, "labelled")
    entries = _eligible(spark, sf).select("session_id", "crop_name", F.col("char").alias("label"))
    S.write_archive(entries, path)
    return S.labelled_files(spark, path, "*.parquet").select("label").distinct()


def _accepted(spark, sf):
    c = _candidates(spark, sf)
    ok = _eligible(spark, sf).select("event_id").withColumn("accepted", F.lit(True))
    return M.acceptance_rate(c.join(ok, "event_id", "left").select(F.coalesce("accepted", F.lit(False)).alias("accepted")))


def _eval_csv(spark, sf):
    path = shared_folder(spark, "eval-log")
    r = F.col("reply")
    rows = _parsed(spark, sf).select(
        F.concat(F.lit("scan_"), F.col("event_id"), F.lit(".jpg")).alias("file"), R.normalize_input_type("event_type").alias("input_type"),
        reply_field(r, "status").alias("status"), reply_field(r, "confidence", "double").alias("confidence"), F.col("json").alias("text"))
    S.write_eval_csv(rows, path)
    return S.read_eval_csv(spark, path)


def _report(language):
    def run(spark, sf):
        # a report is some forty times its text: tasks get even parts of the text, whatever the files are
        pages = V.in_parts(V.v_pages(spark, sf).select("scan_id", "page_no", "text", "confidence"), "scan_id", "page_no")
        lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda line: F.transform(
            F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)),
            lambda c: F.struct(c.alias("char"), (F.lit(50.0) + F.ascii(c) % 50).alias("confidence"))))
        at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_no as int))")
        return pages.select("scan_id", "page_no", P.report_text(
            "text", F.lit("HOG"), lines, at, "confidence", F.length("text"), language=language).alias("report"))
    return run


def _raw_type():
    e = F.col("event_type")
    return F.when(e == "view", "pen").when(e == "click", "pentel_pen").when(e == "purchase", "marker").otherwise(e)


def _status(spark, sf):
    e, k = F.col("event_type"), F.col("k")
    mode = F.when(e == "error", "other").when(e == "view", "text").when(e == "signup", F.when(k >= 50, "image")).otherwise("image")
    request = R.request_status(mode, k >= 10, F.when(k < 50, "").otherwise("x"), k == 99)
    return V.v_events(spark, sf).select("event_id", R.classify_status(k % 5 == 0, (k % 4).cast("int"), F.col("value"), request).alias("status"))


def _outcome(spark, sf):
    r = _parsed(spark, sf)
    o = R.recognition_outcome(reply_field(F.col("reply"), "status"), is_missing=F.col("reply").isNull())
    return r.select("event_id", o.alias("outcome"), R.has_text(o).alias("has_text"))


def _settings(spark, sf):
    e, k = F.col("event_type"), F.col("k").cast("long").cast("string")
    return V.v_events(spark, sf).select(
        "event_id", R.setting("cameraInputType", _raw_type()).alias("camera"),
        R.setting("resultFilter", F.when(e == "view", "Raw").otherwise(e)).alias("result_filter"),
        R.setting("language", F.when(e == "click", "fil").otherwise("jp")).alias("language"),
        R.setting("hapticsEnabled", F.when(e == "error", "false").otherwise("yes")).alias("haptics"),
        R.setting("cameraGridByDefault", F.when(e == "view", "true").otherwise(k)).alias("grid"),
        R.setting("minConfidence", F.when(e == "signup", "high").otherwise(k)).alias("min_confidence"))


def _quality(spark, sf):
    return V.v_events(spark, sf).select("event_id", R.page_quality(F.col("k"), F.col("value") * 2).alias("quality"))


def _problem(script):
    def run(spark, sf):
        r = _parsed(spark, sf)
        text, status = reply_field(F.col("reply"), "translated_text"), reply_field(F.col("reply"), "status")
        if script == "latin":  # its recogniser says ok and blurry
            status = F.when(status.isin("Success", "Low_Confidence"), "ok").when(status == "Blurry_Image", "blurry").otherwise(status)
        return r.select("event_id", R.page_problem(F.col("reply").isNull(), status, text, script).alias("problem"),
                        R.page_is_read(status, text, script=script).alias("is_read"))
    return run


def _filtered(spark, sf):
    d = V.v_detections(spark, sf)
    return d.filter(R.passes_confidence("confidence", "k") & R.above_noise(F.col("confidence") / 100, F.lit("pen"))).select("event_id", "confidence")


def _averages(spark, sf):
    a = M.average_confidence(V.v_detections(spark, sf), ["session_id"])
    return a.withColumn("average_confidence", F.round("average_confidence", 6))


def _combined(by):
    def run(spark, sf):
        out = P.combined_pages(V.v_pages(spark, sf), ["scan_id"], by=by)
        return out.withColumn("combined_confidence", F.round("combined_confidence", 6))
    return run


def _sessions(spark, sf):
    return L.session_latest_status(V.v_session_events(spark, sf)).drop("n_events")


def _session_archive(spark, sf):
    ev = V.v_events(spark, sf)
    sessions = ev.filter("event_type = 'signup'").select(F.col("user_id").alias("session_id"), "ts", "event_id", "status")
    sessions = L.session_latest_status(sessions)
    logs = V.v_detections(spark, sf).withColumnRenamed("event_id", "log_id")
    archive = _eligible(spark, sf).select(F.col("event_id").alias("log_id"), F.col("char").alias("label"))
    rows = L.session_detections(sessions, logs, archive)
    known = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_detections"), F.count("archive_label").alias("n_archived"), F.lit(False).alias("orphan"))
    orphans = L.orphan_detections(logs, sessions).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_detections"), F.lit(0).cast("long").alias("n_archived"), F.lit(True).alias("orphan"))
    return known.unionByName(orphans)


def _flat(spark, sf):
    p = V.v_pages(spark, sf).select("scan_id", "page_no", "is_read")
    return P.flatten_pages(p.filter("is_read"), p.filter("not is_read"))


def _steady(spark, sf):
    s = MO.steadiness(V.v_motion(spark, sf))
    return s.select("device_id", "event_id", F.round("percent", 6).alias("percent"))


def _held(spark, sf):
    return MO.held_steady(MO.steadiness(V.v_motion(spark, sf))).select("device_id", "started", "event_id", "fired_at")


def stream_events(spark, sf):
    """The stored events as a streaming source."""
    schema, path = V.table(spark, sf, "events").schema, f"{sf}/events.parquet"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one_file = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    stream = spark.readStream.schema(schema)
    # a file source takes folders, so a table in one file is picked out of its folder
    return stream.option("pathGlobFilter", "events.parquet").parquet(sf) if one_file else stream.parquet(path)


def _session_stream(spark, sf):
    path, check = shared_folder(spark, "sessions"), shared_folder(spark, "sessions-check")
    status = (F.when(F.col("event_type") == "purchase", "Success").when(F.col("event_type") == "view", "Low_Confidence")
              .when(F.col("event_type") == "click", "No_Characters").when(F.col("event_type") == "signup", "Blurry_Image").otherwise("Error"))
    status = F.when(F.col("event_id") % 3 == 0, "Processing").otherwise(status)
    events = stream_events(spark, sf).select(F.col("user_id").alias("session_id"), "ts", "event_id", status.alias("status"))
    SL.start_session_log(events, path, check).awaitTermination()
    out = SL.current_sessions(spark, path)
    return out.select("session_id", "status", F.col("start_time").cast("timestamp_ntz").alias("start_time"),
                      F.col("end_time").cast("timestamp_ntz").alias("end_time"), "n_events")


def _motion_stream(spark, sf):
    path, check = shared_folder(spark, "motion"), shared_folder(spark, "motion-check")
    k = F.get_json_object("props", "$.k").cast("double")
    readings = stream_events(spark, sf).select(F.col("user_id").alias("device_id"), "ts", "event_id", (F.col("value") / 500).alias("x"),
                                               (k / 500).alias("y"), F.lit(0.0).alias("z"))
    SM.start_motion_log(readings, path, check).awaitTermination()
    return SM.current_steadiness(spark, path).select("device_id", "event_id", F.round("percent", 6).alias("percent"), "fired")


QUERIES = {
    "parse_replies": _parse,
    "sanitize_detections": _sanitized,
    "detection_log_append": _log_append,
    "session_latest_status": _sessions,
    "archive_eligible": lambda s, d: _eligible(s, d).select("session_id", "event_id", "char", "temp_path"),
    "archive_write": _archive,
    "labelled_file_listing": _listing,
    "acceptance_rate": _accepted,
    "eval_log_csv": _eval_csv,
    "result_report_text": _report("en"),
    "result_report_text_fil": _report("fil"),
    "normalize_input_type": lambda s, d: V.v_events(s, d).select("event_id", _raw_type().alias("raw"), R.normalize_input_type(_raw_type()).alias("input_type")),
    "classify_status": _status,
    "recognition_outcome": _outcome,
    "validate_settings": _settings,
    "page_quality_gate": _quality,
    "page_problem": _problem("baybayin"),
    "page_problem_latin": _problem("latin"),
    "min_confidence_filter": _filtered,
    "average_confidence": _averages,
    "combined_pages": _combined("page"),
    "combined_pages_by_character": _combined("character"),
    "session_detection_archive": _session_archive,
    "flatten_pages": _flat,
    "new_pieces": lambda s, d: P.new_pieces(V.v_dict(s, d), V.v_vocab(s, d), ["word"]),
    "steadiness": _steady,
    "held_steady": _held,
    "session_log_stream": _session_stream,
    "steadiness_stream": _motion_stream,
}

# --- SQL -----------------------------------------------------------------------------

_STATUS = """CASE event_type WHEN 'purchase' THEN 'Success' WHEN 'view' THEN 'Low_Confidence' WHEN 'click' THEN 'No_Characters'
    WHEN 'signup' THEN 'Blurry_Image' ELSE 'Error' END"""
_RAW = "CASE event_type WHEN 'view' THEN 'pen' WHEN 'click' THEN 'pentel_pen' WHEN 'purchase' THEN 'marker' ELSE event_type END"
_JSON = """CASE event_id % 7 WHEN 0 THEN '{not json' WHEN 1 THEN '[1, 2, 3]' WHEN 2 THEN '{"error": "boom", "status": "' || status || '"}' WHEN 3 THEN ''
    ELSE '{"status": "' || status || '", "translated_text": "' || event_type || '", "confidence": ' || k || ', "individual_detections": ["junk", 7, {"char": "ba", "confidence": '
      || k || ', "bbox": {"x0": 0, "y0": 1, "x1": ' || (k - 20) || ', "y1": 9}}, {"char": "ka", "confidence": "high", "bbox": {"x0": "5", "y0": 5, "x1": 8, "y1": 9}}]}' END"""
_DETS = """dt AS (SELECT event_id, user_id, 0::BIGINT AS pos, 'ba' AS char, k AS confidence, CASE WHEN k > 20 THEN k - 20 END AS x1 FROM v_events WHERE event_id % 7 >= 4
    UNION ALL SELECT event_id, user_id, 1, 'ka', 0.0, NULL FROM v_events WHERE event_id % 7 >= 4)"""
_CAND = """cd AS (SELECT *, CASE WHEN k < 10 THEN '{d/r}a' ELSE char END AS label, char || '_' || event_id || '.png' AS crop_name,
      (CASE WHEN char = 'e' THEN '/crops/../etc/' ELSE '/crops/' END) || 'session_' || session_id || '/' || char || '_' || event_id || '.png' AS temp_path FROM v_detections),
    el AS (SELECT * FROM cd WHERE k >= 20 AND confidence > 10 AND char <> 'e' AND label = char)"""
_STEADY = """mg AS (SELECT *, sqrt(x * x + y * y + z * z) AS m FROM v_motion),
    fr AS (SELECT *, count(*) OVER w AS n, stddev_pop(m) OVER w AS j FROM mg WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    st AS (SELECT device_id, ts, event_id, greatest(least(100 * (1 - j / 1.2), 100.0), 0.0) AS percent FROM fr WHERE n = 20),
    isl AS (SELECT *, sum(CASE WHEN percent < 95 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS g FROM st),
    hd AS (SELECT *, min(ts) OVER (PARTITION BY device_id, g) AS started FROM isl WHERE percent >= 95),
    hf AS (SELECT *, row_number() OVER (PARTITION BY device_id, g ORDER BY ts, event_id) AS rn FROM hd WHERE ts - started >= INTERVAL 700 MILLISECONDS)"""


def _sql_report(language: str) -> str:
    w = P.WORDING[language]
    lines = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"
    nl = "chr(10)"
    char_line = (f"'  ' || j || '. ' || rpad(substr(ln, j, 1), 4, ' ') || ' ' || printf('%.1f', 50.0::DOUBLE + ord(substr(ln, j, 1)) % 50) || '%' || {nl}")
    block = (f"{nl} || '{w['line']} ' || i || ': ' || array_to_string(regexp_extract_all(ls[i], '(?s).'), ' ') || {nl} || "
             f"array_to_string(list_transform(range(1, length(ls[i]) + 1), lambda j: {char_line.replace('ln', 'ls[i]')}), '')")
    return with_views(f"""
        WITH p AS (SELECT *, {lines} AS ls FROM v_pages)
        SELECT scan_id, page_no, '{w['title']}' || {nl} || '{w['exported']}: ' || strftime(TIMESTAMP '2024-01-01' + to_hours(page_no), '%Y-%m-%d %H:%M') || {nl} || {nl} ||
          '{w['result']}' || {nl} || CASE WHEN text = '' THEN '{w['none']}' ELSE text END || {nl} || {nl} || 'Filter: HOG' || {nl} || '{w['characters']}: ' || length(text) || {nl} ||
          '{w['words']}: ' || len(regexp_extract_all(text, '\\S+')) || {nl} || '{w['lines']}: ' || len(ls) || {nl} ||
          CASE WHEN confidence > 0 THEN '{w['average']}: ' || confidence::BIGINT || '%' || {nl} ELSE '' END || {nl} || '{w['breakdown']}' || {nl} ||
          CASE WHEN len(ls) = 0 THEN '{w['empty']}' || {nl} ELSE array_to_string(list_transform(range(1, len(ls) + 1), lambda i: {block}), '') END AS report FROM p""", "v_pages")


_COMBINED = """
    SELECT scan_id, count(*) FILTER (WHERE is_read) AS n_read, count(*) FILTER (WHERE NOT is_read) AS n_unread,
           coalesce(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE is_read), '') AS combined_text,
           round(coalesce(avg(confidence) FILTER (WHERE is_read{cond}), 0), 6) AS combined_confidence FROM v_pages GROUP BY ALL"""

ORACLES = {
    "parse_replies": with_views("""SELECT event_id, event_id % 7 >= 4 AS usable, CASE WHEN event_id % 7 >= 4 THEN status END AS status,
        CASE WHEN event_id % 7 >= 4 THEN event_type END AS text, CASE WHEN event_id % 7 >= 4 THEN k END AS confidence FROM v_events""", "v_events"),
    "sanitize_detections": with_views(f"WITH {_DETS} SELECT event_id, pos, char, confidence, x1 FROM dt", "v_events"),
    "detection_log_append": with_views(f"WITH {_DETS} SELECT event_id, user_id AS session_id, pos, char, confidence FROM dt WHERE user_id <> 0", "v_events"),
    "session_latest_status": with_views("""SELECT session_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS start_time, max(ts) FILTER (WHERE status <> 'Processing') AS end_time
        FROM v_session_events WHERE session_id <> 0 GROUP BY ALL""", "v_session_events"),
    "archive_eligible": with_views(f"WITH {_CAND} SELECT session_id, event_id, char, temp_path FROM el", "v_detections"),
    "archive_write": with_views(f"WITH {_CAND} SELECT session_id, crop_name, char AS predicted, confidence, true AS verified, label FROM el", "v_detections"),
    "labelled_file_listing": with_views(f"WITH {_CAND} SELECT DISTINCT label FROM el", "v_detections"),
    "acceptance_rate": with_views(f"""WITH {_CAND}, c AS (SELECT (SELECT count(*) FROM cd) AS t, (SELECT count(*) FROM el) AS a)
        SELECT t AS total_submissions, a AS archived, t - a AS rejected, a / t::DOUBLE AS acceptance_rate, 0.6::DOUBLE AS target_rate, a / t::DOUBLE >= 0.6 AS target_met FROM c""", "v_detections"),
    "eval_log_csv": with_views(f"""SELECT 'scan_' || event_id || '.jpg' AS file, 'marker' AS input_type, CASE WHEN event_id % 7 >= 4 THEN status ELSE 'Failed' END AS status,
        CASE WHEN event_id % 7 >= 4 THEN k::VARCHAR ELSE '' END AS confidence, {_JSON} AS text FROM v_events""", "v_events"),
    "result_report_text": _sql_report("en"),
    "result_report_text_fil": _sql_report("fil"),
    "normalize_input_type": f"SELECT event_id, {_RAW} AS raw, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN {_RAW} ELSE 'marker' END AS input_type FROM events",
    "classify_status": with_views("""SELECT event_id, CASE WHEN k = 99 THEN 'Error' WHEN event_type IN ('click', 'purchase') AND k < 10 THEN 'No_File'
        WHEN event_type = 'view' THEN CASE WHEN k < 50 THEN 'No_Text' ELSE 'Success' END WHEN event_type = 'error' OR (event_type = 'signup' AND k < 50) THEN 'Invalid_Mode'
        WHEN k % 5 = 0 THEN 'Blurry_Image' WHEN k % 4 = 0 THEN 'No_Characters' WHEN value > 60 THEN 'Success' ELSE 'Low_Confidence' END AS status FROM v_events""", "v_events"),
    "recognition_outcome": with_views("""WITH o AS (SELECT event_id, CASE WHEN event_id % 7 < 4 THEN 'failed' ELSE CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'lowConfidence'
        WHEN 'click' THEN 'noCharacters' WHEN 'signup' THEN 'blurry' ELSE 'failed' END END AS outcome FROM v_events) SELECT *, outcome IN ('success', 'lowConfidence') AS has_text FROM o""", "v_events"),
    "validate_settings": with_views("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'pen' ELSE 'marker' END AS camera, CASE WHEN event_type = 'view' THEN 'Raw' ELSE 'HOG' END AS result_filter,
        CASE WHEN event_type = 'click' THEN 'fil' ELSE 'en' END AS language, event_type <> 'error' AS haptics, event_type = 'view' AS grid,
        CASE WHEN event_type = 'signup' THEN 23.0 ELSE least(k, 90.0) END AS min_confidence FROM v_events""", "v_events"),
    "page_quality_gate": with_views("SELECT event_id, CASE WHEN k < 40 THEN 'dark' WHEN value * 2 < 60 THEN 'blurry' ELSE 'ok' END AS quality FROM v_events", "v_events"),
    "page_problem": with_views("""SELECT event_id, CASE WHEN event_id % 7 < 4 THEN 'not_processed' WHEN event_type = 'signup' THEN 'too_blurry' ELSE 'no_letters' END AS problem,
        event_id % 7 >= 4 AND event_type IN ('purchase', 'view') AS is_read FROM v_events""", "v_events"),
    "page_problem_latin": with_views("""SELECT event_id, CASE WHEN event_id % 7 < 4 THEN 'not_processed' WHEN event_type = 'signup' THEN 'too_blurry' ELSE 'no_letters' END AS problem,
        event_id % 7 >= 4 AND event_type IN ('purchase', 'view') AS is_read FROM v_events""", "v_events"),
    "min_confidence_filter": with_views("SELECT event_id, confidence FROM v_detections WHERE confidence >= least(k, 90.0) AND confidence / 100 >= 0.3", "v_detections"),
    "average_confidence": with_views("SELECT session_id, round(avg(confidence), 6) AS average_confidence, count(*) AS n FROM v_detections GROUP BY ALL", "v_detections"),
    "combined_pages": with_views(_COMBINED.replace("{cond}", " AND confidence > 0"), "v_pages"),
    "combined_pages_by_character": with_views(_COMBINED.replace("{cond}", ""), "v_pages"),
    "session_detection_archive": with_views(f"""WITH {_CAND}, s AS (SELECT DISTINCT user_id AS session_id FROM events WHERE event_type = 'signup' AND user_id <> 0),
        j AS (SELECT c.session_id, c.event_id, e.event_id IS NOT NULL AS archived, s.session_id IS NULL AS orphan FROM cd c LEFT JOIN el e ON e.event_id = c.event_id LEFT JOIN s ON s.session_id = c.session_id)
        SELECT session_id, count(*) AS n_detections, CASE WHEN orphan THEN 0 ELSE count(*) FILTER (WHERE archived) END AS n_archived, orphan FROM j GROUP BY session_id, orphan""", "v_detections"),
    "flatten_pages": with_views("SELECT scan_id, page_no, is_read FROM v_pages", "v_pages"),
    "new_pieces": with_views("SELECT word FROM v_dict WHERE word NOT IN (SELECT word FROM v_vocab)", "v_dict", "v_vocab"),
    "steadiness": with_views(f"WITH {_STEADY} SELECT device_id, event_id, round(percent, 6) AS percent FROM st", "v_motion"),
    "held_steady": with_views(f"WITH {_STEADY} SELECT device_id, started, event_id, ts AS fired_at FROM hf WHERE rn = 1", "v_motion"),
    "session_log_stream": with_views("""SELECT session_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS start_time, max(ts) FILTER (WHERE status <> 'Processing') AS end_time, count(*) AS n_events
        FROM v_session_events GROUP BY ALL""", "v_session_events"),
    "steadiness_stream": with_views(f"""WITH {_STEADY} SELECT st.device_id, st.event_id, round(st.percent, 6) AS percent, hf.event_id IS NOT NULL AS fired
        FROM st LEFT JOIN hf ON hf.event_id = st.event_id AND hf.rn = 1""", "v_motion"),
}
