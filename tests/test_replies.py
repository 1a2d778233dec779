import json

from pyspark.sql import functions as F

from sulatan.plans import views as V
from sulatan.functions import replies as R
from sulatan.operators import logs, pages
from sulatan.sources import sinks
from sulatan.sources.replies import parse_replies, reply_field


def replies(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    return parse_replies(df)


def test_parse(spark):
    texts = ['{"status": "Success", "translated_text": "bata"}', None, "", "{not json", "[1, 2, 3]", "7", '{"error": "boom", "status": "Error"}', '{"error": null}']
    got = [r["u"] for r in replies(spark, texts).select("i", F.col("reply").isNotNull().alias("u")).orderBy("i").collect()]
    assert got == [True, False, False, False, False, False, False, True]


def test_outcomes(spark):
    cases = {'{"status": "Success"}': "success", '{"status": "success"}': "success", '{"status": "Low_Confidence"}': "lowConfidence",
             '{"status": "No_Characters"}': "noCharacters", '{"status": "Blurry_Image"}': "blurry", '{"status": "Invalid_Image"}': "invalidImage",
             '{"status": "New"}': "failed", "{}": "failed", '{"status": 42}': "failed", '{"error": "x", "status": "Success"}': "failed", "": "failed"}
    o = R.recognition_outcome(reply_field(F.col("reply"), "status"), is_missing=F.col("reply").isNull())
    got = [r["o"] for r in replies(spark, list(cases)).select("i", o.alias("o")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_sanitize(spark):
    dets = ["junk", 7, {"char": "ba", "confidence": 91.5, "bbox": {"x0": 1, "y0": 2, "x1": 10, "y1": 20}},
            {"char": "ka", "confidence": "high", "bbox": {"x0": 5, "y0": 5, "x1": "x", "y1": 9}},
            {"char": "ta", "confidence": "7.25", "bbox": {"x0": "0", "y0": 0, "x1": 1, "y1": 1}}, {"confidence": True, "bbox": [1]}]
    texts = [json.dumps({"individual_detections": dets}), json.dumps({"individual_detections": "nope"}), "{}", ""]
    rows = replies(spark, texts).select("i", R.sanitize_detections("reply").alias("d")).orderBy("i").collect()
    first = rows[0]["d"]
    assert [(d["char"], d["confidence"]) for d in first] == [("ba", 91.5), ("ka", 0.0), ("ta", 7.25), (None, 0.0)]
    assert first[0]["bbox"]["y1"] == 20.0 and [d["bbox"] for d in first[1:]] == [None] * 3
    assert [list(r["d"]) for r in rows[1:]] == [[], [], []]


def test_settings_and_status(spark):
    df = spark.createDataFrame([("crayon", "500", "yes"), ("pen", "-3", "false"), (None, "high", None)], "a string, b string, c string")
    got = [tuple(r) for r in df.select(R.setting("cameraInputType", "a"), R.setting("minConfidence", "b"), R.setting("hapticsEnabled", "c")).collect()]
    assert got == [("marker", 90.0, True), ("pen", 0.0, False), ("marker", 23.0, True)]
    st = spark.createDataFrame([(True, 0, 99.0), (False, 0, 99.0), (False, 2, 60.0), (False, 2, 60.1)], "b boolean, n int, c double")
    assert [r[0] for r in st.select(R.classify_status("b", "n", "c")).collect()] == ["Blurry_Image", "No_Characters", "Low_Confidence", "Success"]


def test_archive_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([(1, "A_1.png", "A"), (1, "A_1.png", "A"), (2, "Ba_Cross_2_ab.png", "Ba")], "session_id long, crop_name string, label string")
    sinks.write_archive(rows, path)
    sinks.write_archive(rows, path)
    assert sinks.read_archive(spark, path).count() == 2


def test_archive_keeps_colliding_names_and_text_labels(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([(1, "c0", "007", 90.0), (1, "c0", "7", 90.0), (1, "c0", "7", 80.0), (1, "c0", "7", 80.0)],
                                 "session_id int, crop_name string, label string, confidence double")
    for _ in range(2):
        sinks.write_archive(rows, path)
    got = sorted((r["label"], r["confidence"]) for r in sinks.read_archive(spark, path).collect())
    assert got == [("007", 90.0), ("7", 80.0), ("7", 90.0)]


def test_append_reads_only_its_buckets(spark, tmp_path):
    """Unreadable files in all other buckets do not disturb an append."""
    path = tmp_path / "archive"
    rows = spark.range(300).selectExpr("id as session_id", "concat('c', id) as crop_name", "'A' as label")
    sinks.write_archive(rows, str(path), buckets=16)
    few = rows.filter("session_id < 2")
    mine = {r[0] for r in few.selectExpr("pmod(xxhash64(session_id, crop_name), 16)").collect()}
    others = [f for f in path.rglob("*.parquet") if int(f.parent.parent.name.split("=")[1]) not in mine]
    assert others
    good = {f: f.read_bytes() for f in others}
    for f in others:
        f.write_bytes(b"not parquet")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    sinks.write_archive(few, str(path), buckets=16)
    for f, data in good.items():
        f.write_bytes(data)
    assert sinks.read_archive(spark, str(path)).count() == 300


def test_end_time_needs_an_update(spark):
    rows = [(1, 1, 1, "Processing"), (1, 5, 2, "Success"), (2, 3, 3, "Processing")]
    df = spark.createDataFrame(rows, "session_id int, ts int, event_id int, status string")
    got = {r["session_id"]: (r["status"], r["start_time"], r["end_time"]) for r in logs.session_latest_status(df).collect()}
    assert got == {1: ("Success", 1, 5), 2: ("Processing", 3, None)}


def test_archive_filter(spark):
    rows = [("a", "/crops/s/1", True), ("{d/r}a", "/crops/s/2", True), ("b", "/other/3", True), ("c", "/crops/../4", True), ("d", "/crops/5", False), ("e", "/crops/gone", True), ("", "/crops/6", True)]
    d = spark.createDataFrame(rows, "char string, temp_path string, is_eligible boolean")
    files = d.filter("temp_path <> '/crops/gone'").select("temp_path")
    assert [r["char"] for r in logs.archive_eligible(d, files, "/crops").collect()] == ["a"]


def test_labelled_files(spark, tmp_path):
    for name in ("Ba/Ba_Dot_Above_12_efba0c.png", "Ka/Ga_3_aa.jpg", "Ka/notes.txt"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x")
    got = {(r["label"], r["predicted"]) for r in sinks.labelled_files(spark, str(tmp_path)).collect()}
    assert got == {("Ba", "Ba_Dot_Above"), ("Ka", "Ga")}


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = [("a.jpg", "pen", None, 9.5, 'say "hi",\nthere'), ("b.jpg", "pen", "Success", None, None)]
    sinks.write_eval_csv(spark.createDataFrame(rows, "file string, input_type string, status string, confidence double, text string"), path)
    got = {tuple(r) for r in sinks.read_eval_csv(spark, path).collect()}
    assert got == {("a.jpg", "pen", "Failed", "9.5", 'say "hi",\nthere'), ("b.jpg", "pen", "Success", "", "")}


def test_csv_files_are_bounded(spark, tmp_path):
    rows = spark.range(25).coalesce(1).selectExpr("concat(id, '.jpg') AS file", "'pen' AS input_type", "'ok' AS status", "1D AS confidence", "'a\n\"b' AS text")
    sinks.write_eval_csv(rows, str(tmp_path / "csv"), file_rows=10)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 3
    got = sinks.read_eval_csv(spark, str(tmp_path / "csv")).collect()
    assert sorted(r["file"] for r in got) == sorted(f"{i}.jpg" for i in range(25)) and {r["text"] for r in got} == {'a\n"b'}


def test_report_figures_and_parts(spark, tmp_path):
    figures = [0.0, -0.0, 0.05, 0.25, 8.05, 99.95, 1e6, 1000000.1, -0.04, float("nan"), float("inf"), None]
    df = spark.createDataFrame([([[("a", x)]], x) for x in figures], "l array<array<struct<char:string,confidence:double>>>, x double")
    report = pages.report_text(F.lit("t"), F.lit("HOG"), "l", F.lit("2026-01-02 03:04:00").cast("timestamp"), F.lit(1.0), F.lit(1))
    for text, want in df.select(report, F.format_string("%.1f%%", "x")).collect():
        assert f"  1. a    {want}\n" in text
    text = "x" * 1000
    spark.range(3000).selectExpr("id AS conv_id", "0L AS turn", f"'{text}' AS text", "'user' AS role").coalesce(1) \
        .write.option("parquet.block.size", 1 << 28).parquet(str(tmp_path / "conversations.parquet"))
    sizes = V.in_parts(V.v_pages(spark, str(tmp_path)), "scan_id", "page_no").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 1000


def test_report_and_pages(spark):
    df = spark.createDataFrame([("mahal kita", [[("ma", 90.0), ("ha", 88.25)], [("ki", 70.0)]], 88.4), ("", [], 0.0)],
                               "t string, lines array<array<struct<char:string,confidence:double>>>, c double")
    for lang, words in (("en", ["RESULT (IN LATIN)\nmahal kita\n", "Words: 2", "Average confidence: 88%", "Line 1: ma ha\n  1. ma   90.0%"]),
                        ("fil", ["RESULTA (SA LATIN)", "Linya 1: ma ha"])):
        full, empty = [r[0] for r in df.select(pages.report_text("t", F.lit("HOG"), "lines", F.lit("2026-01-02 03:04:00").cast("timestamp"), "c", F.lit(3), lang)).collect()]
        assert all(w in full for w in words)
        assert pages.WORDING[lang]["empty"] in empty and pages.WORDING[lang]["average"] not in empty
    scans = spark.createDataFrame([(1, 2, "kita ", True, 60.0), (1, 1, " mahal", True, 95.0), (1, 3, "", False, 0.0), (2, 1, "", False, 0.0)],
                                  "scan_id int, page_no int, text string, is_read boolean, confidence double")
    got = {r["scan_id"]: (r["combined_text"], r["combined_confidence"], r["n_unread"]) for r in pages.combined_pages(scans, ["scan_id"]).collect()}
    assert got == {1: ("mahal\n\nkita", 77.5, 1), 2: ("", 0.0, 1)}
