"""Inputs derived from the stored tables, in Spark and as SQL for checking.

The stored tables hold no boxes, readings or sessions, so each view states by
plain arithmetic how such rows follow from a stored row. No view drops rows to
save time: every document, line, character and event takes part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTER_WIDTH, LETTER_STEP, LINE_STEP = 8, 10, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table read by fewer tasks than there are cores.

    Text is exploded right after reading, so a table in one small file would be
    exploded by one task. A table with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, *keys)


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


#: bytes of text whose letters one task holds as boxes
TASK_TEXT = 1 << 19


def pages(spark, sf_dir) -> DataFrame:
    """``(doc_id, text)`` dealt by id, in parts of about ``TASK_TEXT``.

    A page weighs a hundredth of its boxes: dealt as text, its lines, boxes and
    all that is grouped by page or line stay in one task without a shuffle of
    boxes (see `co_partitioned`). Parts are small so that a task sorts its boxes in memory.
    """
    return in_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def in_parts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key in parts of about ``TASK_TEXT`` of ``text``."""
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_TEXT)), *keys)


def conversations(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")


# --- text and vocabulary -------------------------------------------------

def v_text(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text")
    bench = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("src"), F.col("item_id").alias("id"), "text")
    return docs.unionByName(bench)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("long"))


def v_lines(spark, sf_dir) -> DataFrame:
    return _lines(documents(spark, sf_dir))


def v_page_lines(spark, sf_dir) -> DataFrame:
    """`v_lines` with the lines of a page in one task."""
    return _lines(pages(spark, sf_dir))


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    from sulatan.sources.wordlist import token_words

    return token_words(df, text)


def v_vocab(spark, sf_dir) -> DataFrame:
    return tokens(documents(spark, sf_dir))


def v_dict(spark, sf_dir) -> DataFrame:
    return tokens(conversations(spark, sf_dir))


def as_slots(word):
    out = F.regexp_replace(word, "[ei]", "{e/i}")
    out = F.regexp_replace(out, "[ou]", "{o/u}")
    # a slot keeps its own letters: only bare d and r are left at this point
    return F.regexp_replace(out, "[dr]", "{d/r}")


def v_slot_words(spark, sf_dir) -> DataFrame:
    return v_vocab(spark, sf_dir).select("word", as_slots(F.col("word")).alias("slot_word"))


def _letter_p(c):
    return F.lit(0.5) + (F.ascii(c) % 50) / F.lit(100.0)


def _next_letter(c):
    return F.when(c == "z", F.lit("a")).otherwise(F.char(F.ascii(c) + 1))


def letter_pair(c):
    """Best and second-best letter of one position with their probabilities."""
    best = _letter_p(c)
    return F.array(
        F.struct(c.alias("char"), best.alias("p")),
        F.struct(_next_letter(c).alias("char"), ((F.lit(1.0) - best) * F.lit(0.9)).alias("p")),
    )


def v_letter_cands(spark, sf_dir) -> DataFrame:
    letters = F.transform(F.regexp_extract_all("word", F.lit("."), F.lit(0)), letter_pair)
    return v_vocab(spark, sf_dir).select("word", letters.alias("letters"))


def v_readings(spark, sf_dir) -> DataFrame:
    """Readings of every word as letter arrays: three of longer words, two of single letters.

    ``sure``: the word is one letter read with 0.9 or more.
    """
    words = v_vocab(spark, sf_dir)
    long = F.length("word") >= 2
    swapped = F.concat(F.substring("word", 2, 1), F.substring("word", 1, 1), F.expr("substring(word, 3)"))
    cut = F.concat(_next_letter(F.col("word")), F.lit("i"))
    shorter = F.expr("substring(word, 1, length(word) - 1)")
    readings = F.array(
        F.struct(F.lit(0).alias("reading"), F.col("word").alias("text"), F.lit(0.0).alias("penalty")),
        F.struct(F.lit(1).alias("reading"), F.when(long, swapped).otherwise(cut).alias("text"), F.lit(0.15).alias("penalty")),
        F.struct(F.lit(2).alias("reading"), F.when(long, shorter).alias("text"), F.lit(0.15).alias("penalty")),
    )
    exploded = words.select("word", F.explode(readings).alias("r")).select("word", "r.*").filter("text is not null")
    letters = F.transform(F.regexp_extract_all("text", F.lit("."), F.lit(0)),
                          lambda c: F.struct(c.alias("char"), _letter_p(c).alias("p")))
    return exploded.select("word", "reading", "penalty", letters.alias("letters"), (~F.col("text").isNull() & (F.length("word") == 1) & (_letter_p(F.col("word")) >= 0.9)).alias("sure"))


def v_word_edges(spark, sf_dir) -> DataFrame:
    """Edges of every word's letters: each kept, some split in two, some joined with the next."""
    chars = F.regexp_extract_all("word", F.lit("."), F.lit(0))
    rows = v_vocab(spark, sf_dir).select("word", chars.alias("chars"), F.posexplode(chars).alias("at", "c"))
    after = F.get("chars", F.col("at") + 1)
    code, pair = F.ascii("c"), F.ascii("c") + F.ascii(after)

    def edge(span: int, place: int, text, penalty: float):
        return F.struct((F.col("at") + span).alias("to"), F.lit(place).alias("ord"), text.alias("t"), F.lit(penalty).alias("penalty"))

    before = F.when(F.col("c") == "a", F.lit("z")).otherwise(F.char(code - 1))
    found = F.array_compact(F.array(
        edge(1, 0, F.col("c"), 0.0),
        F.when(code % 7 == 0, edge(1, 1, F.concat(before, _next_letter(F.col("c"))), 0.15)),
        F.when(pair % 7 == 0, edge(2, 2, F.char(pair % 26 + 97), 0.15))))
    edges = rows.select("word", "at", F.explode(found).alias("e")).select("word", "at", "e.*")
    return edges.select("word", "at", "to", "ord", "penalty", F.transform(F.regexp_extract_all("t", F.lit("."), F.lit(0)), letter_pair).alias("letters"))


# --- boxes ---------------------------------------------------------------

def v_char_boxes(spark, sf_dir) -> DataFrame:
    chars = v_page_lines(spark, sf_dir).select(
        "page_id", "line_no",
        F.posexplode(F.split("line", "")).alias("pos", "char"))
    chars = chars.filter(~F.contains(F.lit(" \t\n\r\f\v"), F.col("char")))
    top = F.col("line_no") * LINE_STEP + 10
    tall = F.contains(F.lit("bdfhklt"), F.col("char")) | F.col("char").between("A", "Z")
    deep = F.contains(F.lit("gjpqy"), F.col("char"))
    return chars.select(
        "page_id", "line_no", F.col("pos").cast("long").alias("pos"), "char",
        (F.lit(50.0) + F.ascii("char") % 50).alias("confidence"),
        (F.col("pos") * LETTER_STEP).cast("double").alias("x0"),
        F.when(tall, top - 10).otherwise(top).cast("double").alias("y0"),
        (F.col("pos") * LETTER_STEP + LETTER_WIDTH).cast("double").alias("x1"),
        F.when(deep, top + 28).otherwise(top + 20).cast("double").alias("y1"),
    )


def v_marks(spark, sf_dir) -> DataFrame:
    """Letter boxes plus one dot above every ``i`` and ``j``."""
    boxes = v_char_boxes(spark, sf_dir)
    parts = F.when(F.col("char").isin("i", "j"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = boxes.withColumn("part", F.explode(parts))
    dot = F.col("part") == 1
    line_top = F.col("line_no") * LINE_STEP
    out = rows.select(
        "page_id", "line_no", (F.col("pos") * 2 + F.col("part")).alias("comp_id"), "char", dot.alias("is_mark"),
        "confidence",
        F.when(dot, F.col("x0") + 2).otherwise(F.col("x0")).alias("x0"),
        F.when(dot, line_top + 2.0).otherwise(F.col("y0")).alias("y0"),
        F.when(dot, F.col("x1") - 2).otherwise(F.col("x1")).alias("x1"),
        F.when(dot, line_top + 6.0).otherwise(F.col("y1")).alias("y1"),
    )
    return out.withColumns({"area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), "stroke": F.lit(2.0)})


def v_broken(spark, sf_dir) -> DataFrame:
    """Letter boxes of which some are broken: in two or three stacked parts, or found twice.

    A part's height and gap follow from its letter and place, so that some
    parts belong together and some are too small or too far apart.
    """
    b = v_char_boxes(spark, sf_dir)
    code, odd = F.ascii("char"), F.col("pos") % 3
    h, gap = F.col("y1") - F.col("y0"), (1 + odd * 3).cast("double")

    def part(top, bottom, dx):
        return F.struct((F.col("x0") + dx).alias("x0"), top.alias("y0"), (F.col("x1") + dx / 2).alias("x1"), bottom.alias("y1"))

    y0, y1, third = F.col("y0"), F.col("y1"), h / 4
    whole = F.array(part(y0, y1, F.lit(0.0)))
    two = F.array(part(y0, y0 + third * 2 - gap, F.lit(0.0)), part(y0 + third * 2, y1, F.lit(1.0)))
    three = F.array(part(y0, y0 + third, F.lit(0.0)), part(y0 + third + gap, y0 + third * 3, F.lit(1.0)), part(y0 + third * 3 + gap / 2, y1 + 2, F.lit(-0.5)))
    twice = F.array(part(y0, y1, F.lit(0.0)), part(y0 + odd, y1, F.lit(0.0)))
    parts = F.when(code % 5 == 0, two).when(code % 5 == 1, three).when(code % 5 == 2, twice).otherwise(whole)
    return b.select("page_id", "line_no", "pos", F.explode(parts).alias("b")).select("page_id", "line_no", "pos", "b.*")


def v_written(spark, sf_dir) -> DataFrame:
    """Letter boxes on a rising line, some raised, cut or stretched, with a dot flag."""
    b = v_char_boxes(spark, sf_dir)
    code, third = F.ascii("char"), F.col("pos") % 3
    shift = F.floor(F.col("x0") / 200) + F.when(code % 7 == 0, 10).otherwise(0)
    return b.withColumns({
        "y0": F.col("y0") + shift + F.when((F.col("char") == "l") & (third == 1), 12).when((F.col("char") == "i") & (third == 2), -10).otherwise(0),
        "y1": F.col("y1") + shift + F.when((F.col("char") == "g") & (third == 0), -10).otherwise(0),
        "has_dot": F.col("char").isin("i", "j") & (F.col("pos") % 2 == 0),
        "first_in_word": F.col("pos") == 0,
    })


def v_bands(spark, sf_dir) -> DataFrame:
    """One text band per non-empty line (dots fall into the gap above it)."""
    top = F.col("line_no") * LINE_STEP
    lines = v_page_lines(spark, sf_dir).filter(F.col("line").rlike(r"\S"))
    return lines.select("page_id", F.col("line_no").alias("band"),
                        (top + 10.0).alias("b0"), (top + 30.0).alias("b1"))


def v_profile(spark, sf_dir) -> DataFrame:
    """Boxes covering each pixel row of a page, counted from distinct extents."""
    extents = v_char_boxes(spark, sf_dir).groupBy("page_id", "y0", "y1").agg(F.count(F.lit(1)).alias("n"))
    rows = extents.select("page_id", "n", F.explode(F.sequence(
        F.col("y0").cast("long"), F.col("y1").cast("long") - 1)).alias("row"))
    return rows.groupBy("page_id", "row").agg(F.sum("n").alias("value"))


def v_glyph_pred(spark, sf_dir) -> DataFrame:
    """Made-up classifier answers for every character box, from its code point."""
    names = F.array(*[F.lit(n) for n in GLYPH_CLASSES])
    marks = F.array(*[F.lit(n) for n in MARK_CLASSES])
    code = F.ascii("char")

    def number(prime):
        return ((code * prime + F.col("pos")) % 100) / F.lit(100.0)

    return v_char_boxes(spark, sf_dir).select(
        "page_id", "line_no", "pos",
        F.get(names, (code * 5 % 17).cast("int")).alias("whole_base"), number(7).alias("whole_conf"),
        F.get(names, (code % 17).cast("int")).alias("base"), number(11).alias("base_conf"),
        F.get(marks, (code % 3).cast("int")).alias("mark"), number(13).alias("mark_conf"),
        F.when(code % 2 == 0, F.lit("Above")).otherwise(F.lit("Below")).alias("position"),
        number(17).alias("solidity"), (code * 3 % 100).cast("double").alias("mark_area"),
    )


# Class names of the glyph and mark classifiers.
GLYPH_CLASSES = ("A", "Ba", "Da", "EI", "Ga", "Ha", "Ka", "La", "Ma", "Na", "Nga", "OU", "Pa", "Sa", "Ta", "Wa", "Ya")
MARK_CLASSES = ("Dot", "None", "X")


# --- replies, sessions, motion, pages ------------------------------------

def v_events(spark, sf_dir) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"), "event_id")
    status = (F.when(F.col("event_type") == "purchase", "Success").when(F.col("event_type") == "view", "Low_Confidence")
              .when(F.col("event_type") == "click", "No_Characters").when(F.col("event_type") == "signup", "Blurry_Image")
              .otherwise("Error"))
    k = F.get_json_object("props", "$.k").cast("double")
    return events.withColumns({"status": status, "k": k})


def v_replies(spark, sf_dir) -> DataFrame:
    """Reply texts: well-formed, malformed, non-object, failed and empty ones."""
    kind = F.col("event_id") % 7
    boxes = F.concat(
        F.lit('{"status": "'), F.col("status"), F.lit('", "translated_text": "'), F.col("event_type"),
        F.lit('", "confidence": '), F.col("k"), F.lit(', "individual_detections": ["junk", 7, {"char": "ba", "confidence": '),
        F.col("k"), F.lit(', "bbox": {"x0": 0, "y0": 1, "x1": '), F.col("k") - F.lit(20), F.lit(', "y1": 9}}, '),
        F.lit('{"char": "ka", "confidence": "high", "bbox": {"x0": "5", "y0": 5, "x1": 8, "y1": 9}}]}'))
    json = (F.when(kind == 0, "{not json").when(kind == 1, "[1, 2, 3]")
            .when(kind == 2, F.concat(F.lit('{"error": "boom", "status": "'), F.col("status"), F.lit('"}')))
            .when(kind == 3, "").otherwise(boxes))
    return v_events(spark, sf_dir).select("event_id", "user_id", "event_type", "status", "k", "value", json.alias("json"))


def v_session_events(spark, sf_dir) -> DataFrame:
    """Status events; every third one opens its session, so that some sessions only have opened."""
    status = F.when(F.col("event_id") % 3 == 0, "Processing").otherwise(F.col("status"))
    return v_events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts", "event_id", status.alias("status"))


def v_detections(spark, sf_dir) -> DataFrame:
    return v_events(spark, sf_dir).select(
        F.col("user_id").alias("session_id"), "event_id", F.substring("event_type", 1, 1).alias("char"),
        F.least("value", F.lit(100.0)).alias("confidence"), "ts", "k")


def v_motion(spark, sf_dir) -> DataFrame:
    return v_events(spark, sf_dir).select(
        F.col("user_id").alias("device_id"), "ts", "event_id", (F.col("value") / 500).alias("x"),
        (F.col("k") / 500).alias("y"), F.lit(0.0).alias("z"))


def v_pages(spark, sf_dir) -> DataFrame:
    talk = conversations(spark, sf_dir)
    return talk.select(F.col("conv_id").alias("scan_id"), F.col("turn").alias("page_no"), "text",
                       (F.col("role") == "assistant").alias("is_read"),
                       (F.length("text") % 100).cast("double").alias("confidence"))


def v_eval(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(truth, prediction) tables of the labelled documents."""
    truth = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), F.col("quality").cast("int").alias("actual"),
        F.when(F.col("toxic") == 1, "Printed").otherwise("Handwritten").alias("script_type"))
    pred = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("predicted"))
    return truth, pred


def v_sv(spark, sf_dir) -> DataFrame:
    """Model vectors: the five lowest ids of every label, stored as doubles."""
    from pyspark.sql import Window as W

    emb = table(spark, sf_dir, "embeddings")
    w = W.partitionBy("label").orderBy("vec_id")
    return (emb.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 5)
            .select(F.col("vec_id").alias("sv_id"), F.col("label").alias("class"),
                    F.col("embedding").cast("array<double>").alias("vec")))


def v_query_vec(spark, sf_dir) -> DataFrame:
    """Every stored vector that is not part of the model."""
    emb = table(spark, sf_dir, "embeddings")
    return (emb.join(v_sv(spark, sf_dir).select("sv_id"), F.col("vec_id") == F.col("sv_id"), "left_anti")
            .select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")))


# --- the same views as SQL ------------------------------------------------

_CLASS_LIST = "[" + ", ".join(f"'{n}'" for n in GLYPH_CLASSES) + "]"
_MARK_LIST = "[" + ", ".join(f"'{n}'" for n in MARK_CLASSES) + "]"

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_text": ((), "SELECT 'documents' AS src, doc_id AS id, text FROM documents UNION ALL "
                   "SELECT 'benchmark', item_id, text FROM benchmark"),
    "v_lines": ((), """
        SELECT page_id, i - 1 AS line_no, parts[i] AS line
        FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id AS page_id, string_split(text, chr(10)) AS parts FROM documents))"""),
    "v_vocab": ((), "SELECT DISTINCT lower(w) AS word FROM "
                    "(SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)"),
    "v_dict": ((), "SELECT DISTINCT lower(w) AS word FROM "
                   "(SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations)"),
    "v_slot_words": (("v_vocab",), """
        SELECT word, regexp_replace(regexp_replace(regexp_replace(word, '[ei]', '{e/i}', 'g'),
               '[ou]', '{o/u}', 'g'), '[dr]', '{d/r}', 'g') AS slot_word FROM v_vocab"""),
    "v_letters": (("v_vocab",), """
        SELECT word, pos, ch, 0.5 + (ord(ch) % 50) / 100.0::DOUBLE AS p,
               CASE WHEN ch = 'z' THEN 'a' ELSE chr(ord(ch) + 1) END AS ch2,
               (1.0::DOUBLE - (0.5::DOUBLE + (ord(ch) % 50) / 100.0::DOUBLE)) * 0.9::DOUBLE AS p2
        FROM (SELECT word, i AS pos, substr(word, i, 1) AS ch
              FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v_vocab))"""),
    "v_word_edges": (("v_vocab",), """
        SELECT word, src, e.dst, e.ord, e.t, e.penalty FROM (
          SELECT word, src, unnest(list_filter([
            {'dst': src + 1, 'ord': 0, 't': c, 'penalty': 0.0::DOUBLE, 'ok': true},
            {'dst': src + 1, 'ord': 1, 't': CASE WHEN c = 'a' THEN 'z' ELSE chr(ord(c) - 1) END || CASE WHEN c = 'z' THEN 'a' ELSE chr(ord(c) + 1) END, 'penalty': 0.15::DOUBLE, 'ok': ord(c) % 7 = 0},
            {'dst': src + 2, 'ord': 2, 't': chr(97 + (ord(c) + ord(d)) % 26), 'penalty': 0.15::DOUBLE, 'ok': d <> '' AND (ord(c) + ord(d)) % 7 = 0}], lambda x: x.ok)) AS e
          FROM (SELECT word, i - 1 AS src, substr(word, i, 1) AS c, substr(word, i + 1, 1) AS d
                FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v_vocab)))"""),
    "v_char_boxes": (("v_lines",), """
        SELECT page_id, line_no, pos, ch AS char, 50.0::DOUBLE + ord(ch) % 50 AS confidence,
               (pos * 10)::DOUBLE AS x0,
               (line_no * 40 + CASE WHEN regexp_full_match(ch, '[bdfhkltA-Z]') THEN 0 ELSE 10 END)::DOUBLE AS y0,
               (pos * 10 + 8)::DOUBLE AS x1,
               (line_no * 40 + CASE WHEN regexp_full_match(ch, '[gjpqy]') THEN 38 ELSE 30 END)::DOUBLE AS y1
        FROM (SELECT page_id, line_no, i - 1 AS pos, chars[i] AS ch
              FROM (SELECT page_id, line_no, chars, unnest(range(1, len(chars) + 1)) AS i
                    FROM (SELECT page_id, line_no, regexp_extract_all(line, '(?s).') AS chars FROM v_lines)))
        WHERE NOT regexp_full_match(ch, '\\s')"""),
    "v_marks": (("v_char_boxes",), """
        SELECT *, (x1 - x0) * (y1 - y0) AS area, 2.0::DOUBLE AS stroke FROM (
          SELECT page_id, line_no, pos * 2 AS comp_id, char, false AS is_mark, confidence, x0, y0, x1, y1 FROM v_char_boxes
          UNION ALL
          SELECT page_id, line_no, pos * 2 + 1, char, true, confidence, x0 + 2, line_no * 40 + 2.0::DOUBLE, x1 - 2,
                 line_no * 40 + 6.0::DOUBLE FROM v_char_boxes WHERE char IN ('i', 'j'))"""),
    "v_broken": (("v_char_boxes",), """
        SELECT page_id, line_no, pos, b.x0, b.y0, b.x1, b.y1 FROM (
          SELECT page_id, line_no, pos, unnest(CASE ord(char) % 5
            WHEN 0 THEN [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y0 + t * 2 - g}, {'x0': x0 + 1, 'y0': y0 + t * 2, 'x1': x1 + 0.5, 'y1': y1}]
            WHEN 1 THEN [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y0 + t}, {'x0': x0 + 1, 'y0': y0 + t + g, 'x1': x1 + 0.5, 'y1': y0 + t * 3}, {'x0': x0 - 0.5, 'y0': y0 + t * 3 + g / 2, 'x1': x1 - 0.25, 'y1': y1 + 2}]
            WHEN 2 THEN [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}, {'x0': x0, 'y0': y0 + pos % 3, 'x1': x1, 'y1': y1}]
            ELSE [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] END) AS b
          FROM (SELECT *, (y1 - y0) / 4 AS t, (1 + pos % 3 * 3)::DOUBLE AS g FROM v_char_boxes))"""),
    "v_written": (("v_char_boxes",), """
        SELECT page_id, line_no, pos, char, confidence, x0, x1,
               y0 + s + CASE WHEN char = 'l' AND pos % 3 = 1 THEN 12 WHEN char = 'i' AND pos % 3 = 2 THEN -10 ELSE 0 END AS y0,
               y1 + s + CASE WHEN char = 'g' AND pos % 3 = 0 THEN -10 ELSE 0 END AS y1,
               char IN ('i', 'j') AND pos % 2 = 0 AS has_dot, pos = 0 AS first_in_word
        FROM (SELECT *, floor(x0 / 200) + CASE WHEN ord(char) % 7 = 0 THEN 10 ELSE 0 END AS s FROM v_char_boxes)"""),
    "v_bands": (("v_lines",), """
        SELECT page_id, line_no AS band, line_no * 40 + 10.0::DOUBLE AS b0, line_no * 40 + 30.0::DOUBLE AS b1
        FROM v_lines WHERE regexp_matches(line, '\\S')"""),
    "v_profile": (("v_char_boxes",), """
        SELECT page_id, r AS row, sum(n)::BIGINT AS value
        FROM (SELECT page_id, n, unnest(range(y0::BIGINT, y1::BIGINT)) AS r
              FROM (SELECT page_id, y0, y1, count(*) AS n FROM v_char_boxes GROUP BY ALL))
        GROUP BY ALL"""),
    "v_glyph_pred": (("v_char_boxes",), f"""
        SELECT page_id, line_no, pos,
               {_CLASS_LIST}[ord(char) * 5 % 17 + 1] AS whole_base, (ord(char) * 7 + pos) % 100 / 100.0::DOUBLE AS whole_conf,
               {_CLASS_LIST}[ord(char) % 17 + 1] AS base, (ord(char) * 11 + pos) % 100 / 100.0::DOUBLE AS base_conf,
               {_MARK_LIST}[ord(char) % 3 + 1] AS mark, (ord(char) * 13 + pos) % 100 / 100.0::DOUBLE AS mark_conf,
               CASE WHEN ord(char) % 2 = 0 THEN 'Above' ELSE 'Below' END AS position,
               (ord(char) * 17 + pos) % 100 / 100.0::DOUBLE AS solidity, (ord(char) * 3 % 100)::DOUBLE AS mark_area
        FROM v_char_boxes"""),
    "v_events": ((), """
        SELECT *, CASE event_type WHEN 'purchase' THEN 'Success' WHEN 'view' THEN 'Low_Confidence'
                  WHEN 'click' THEN 'No_Characters' WHEN 'signup' THEN 'Blurry_Image' ELSE 'Error' END AS status,
               (props::JSON ->> '$.k')::DOUBLE AS k FROM events"""),
    "v_session_events": (("v_events",), "SELECT user_id AS session_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'Processing' ELSE status END AS status FROM v_events"),
    "v_detections": (("v_events",), """
        SELECT user_id AS session_id, event_id, substr(event_type, 1, 1) AS char, least(value, 100.0::DOUBLE) AS confidence,
               ts, k FROM v_events"""),
    "v_motion": (("v_events",), """
        SELECT user_id AS device_id, ts, event_id, value / 500 AS x, k / 500 AS y, 0.0::DOUBLE AS z FROM v_events"""),
    "v_pages": ((), """
        SELECT conv_id AS scan_id, turn AS page_no, text, role = 'assistant' AS is_read,
               (length(text) % 100)::DOUBLE AS confidence FROM conversations"""),
    "v_sv": ((), """
        SELECT vec_id AS sv_id, label AS class, embedding::DOUBLE[] AS vec
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 5"""),
    "v_query_vec": (("v_sv",), """
        SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings
        WHERE vec_id NOT IN (SELECT sv_id FROM v_sv)"""),
    "v_kernel": (("v_query_vec",), """
        SELECT vec_id, label, sv_id, class,
               exp(-0.5::DOUBLE * list_sum(list_transform(list_zip(q.vec, s.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS k
        FROM v_query_vec q, v_sv s"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix a SQL body with the named views and everything they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in SQL_VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1].strip()})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def recursive(sql: str) -> str:
    """``sql`` of `with_views` whose body begins ``WITH RECURSIVE``: the keyword belongs to the first of all CTEs."""
    head, keyword, rest = sql.partition(",\nRECURSIVE ")
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + rest if keyword else sql
