"""Queries on box tables. Results are per-line or per-page totals over every box."""

from __future__ import annotations

from pyspark.sql import functions as F

from sulatan.functions import geometry as G
from sulatan.functions import replies as R
from sulatan.operators import boxes as B
from sulatan.operators import grouping as W
from sulatan.operators.ranking import spaced_top_k
from sulatan.plans import views as V
from sulatan.plans.views import recursive, with_views
from sulatan.session import co_partitioned

KEYS = ["page_id", "line_no"]
SPACED_MOST = 14
ROTATION = ((0.5, -0.25, 3.0), (0.25, 0.5, 7.0))


def _n(alias: str = "n"):
    return F.count(F.lit(1)).alias(alias)


def _long(expr, alias: str):
    return F.sum(expr).cast("long").alias(alias)


def _geometry(spark, sf):
    g = B.box_geometry(V.v_marks(spark, sf))
    return g.groupBy(*KEYS).agg(_n(), *[F.sum(c).alias(c) for c in ("cx", "cy", "width", "height", "area")],
                                F.coalesce(F.sum("h_overlap"), F.lit(0.0)).alias("h_overlap"), F.coalesce(F.sum("v_gap"), F.lit(0.0)).alias("v_gap"))


def _words(strategy):
    def run(spark, sf):
        out = W.words_by_gap(V.v_char_boxes(spark, sf).select(*KEYS, "pos", *B.EDGES), strategy)
        cut = F.max("threshold")
        return out.groupBy(*KEYS).agg(
            _n("n_boxes"), (F.max("word_no") + 1).cast("long").alias("n_words"),
            _long(F.col("word_no") * (F.col("pos") + 1), "word_sum"),
            F.when(cut == float("inf"), F.lit(-1.0)).otherwise(cut).alias("threshold"))
    return run


def _otsu(spark, sf):
    gaps = W.gap_counts(V.v_char_boxes(spark, sf), KEYS, ["x0", "x1", "y0", "y1"])
    return W.otsu_split(gaps.groupBy(*KEYS, "gap").agg(F.sum("n").alias("n")), KEYS)


def _rows(spark, sf):
    out = W.row_clusters(V.v_char_boxes(spark, sf))
    return out.groupBy("page_id").agg(_n(), (F.max("row_no") + 1).cast("long").alias("n_rows"), _long("row_no", "row_sum"),
                                      _long(F.col("row_no") * F.col("row_pos"), "place_sum"))


def _reading_order(spark, sf):
    out = W.reading_order_lines(V.v_char_boxes(spark, sf))
    return out.groupBy("page_id").agg(_n(), (F.max("text_line") + 1).cast("long").alias("n_lines"), _long("text_line", "line_sum"),
                                      _long(F.col("text_line") * F.col("line_pos"), "place_sum"))


def _pieces(spark, sf):
    words = W.words_by_gap(V.v_char_boxes(spark, sf).select(*KEYS, *B.EDGES), "fixed")
    words = words.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    out = W.side_by_side_pieces(words, [*KEYS, "word_no"])
    return out.groupBy("page_id").agg(_n("n_words"), _long("side_by_side", "pieces"), _long(F.col("is_word").cast("long"), "n_word_like"))


def _lines(spark, sf):
    text = V.pages(spark, sf)
    words = text.select(F.col("doc_id").alias("page_id"), F.posexplode(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("word_idx", "word"))
    words = words.withColumn("word_idx", F.col("word_idx").cast("long"))
    # the last line is left out of the counts, so its words are the leftovers
    counts = V.v_page_lines(spark, sf).withColumn("n_words", F.size(F.filter(F.split("line", r"[ \t\n\r]+"), lambda w: w != "")).cast("long"))
    last = text.select(F.col("doc_id").alias("page_id"), (F.size(F.split("text", "\n")) - 1).alias("_last"))
    counts = counts.join(last, "page_id").filter(F.col("line_no") < F.col("_last")).select("page_id", "line_no", "n_words")
    out = W.words_to_lines(words, counts, ["page_id"])
    return out.groupBy("page_id", "text_line").agg(_n(), F.min("word_idx").alias("first_idx"), F.max("word_idx").alias("last_idx"))


def _bands(full):
    return lambda s, d: W.detect_bands(V.v_profile(s, d), ["page_id"], keep_full_lines=full)


def _to_band(spark, sf):
    out = B.component_to_band(V.v_marks(spark, sf), V.v_bands(spark, sf))
    return out.groupBy("page_id", "line_no", "band").agg(_n(), _long("comp_id", "comp_sum"))


def _owners(spark, sf):
    out = B.dot_owner(V.v_marks(spark, sf))
    own = F.when(F.col("owner") != F.col("comp_id"), 1).otherwise(0)
    return out.groupBy(*KEYS).agg(_n(), _long(own, "n_owned"), _long("owner", "owner_sum"))


def _joined_dots(spark, sf):
    out = B.join_dots(V.v_marks(spark, sf))
    return out.groupBy(*KEYS).agg(_n("n_letters"), F.sum("x0").alias("x0"), F.sum("y0").alias("y0"), F.sum("x1").alias("x1"), F.sum("y1").alias("y1"))


def _near(spark, sf):
    marks = V.v_marks(spark, sf).withColumn("L", F.lit(20.0)).select("page_id", "line_no", "comp_id", "is_mark", "x0", "y0", "x1", "y1", "L")
    kept = B.near_letter(marks.filter("is_mark"), marks.filter("not is_mark"), "page_id", "L")
    return kept.groupBy("page_id").agg(_n("kept"), _long("comp_id", "comp_sum"))


def _page_sizes(spark, sf):
    boxes = V.v_char_boxes(spark, sf)
    return boxes.groupBy("page_id").agg((F.max("x1") + 10).alias("img_w"), (F.max("y1") + 10).alias("img_h")).withColumn("stroke", F.lit(2.0))


def _noise(spark, sf):
    out = B.noise_components(V.v_marks(spark, sf), _page_sizes(spark, sf))
    return out.groupBy("page_id", "tag").agg(_n())


def _outliers(spark, sf):
    return B.outlier_boxes(V.v_marks(spark, sf)).groupBy(*KEYS, "tag").agg(_n())


def _slivers(spark, sf):
    out = B.edge_slivers(V.v_marks(spark, sf).select(*KEYS, "comp_id", *B.EDGES), _page_sizes(spark, sf))
    return out.groupBy("page_id").agg(_n(), _long(F.col("dropped").cast("long"), "n_dropped"))


def _reject(spark, sf):
    code = F.ascii("char")
    cands = V.v_marks(spark, sf).select(
        "page_id", (F.col("y1") - F.col("y0")).alias("height"), ((code * 7 + F.col("comp_id")) % 100 < 25).alias("textured"),
        ((code * 3 + F.col("comp_id")) % 100 < 10).alias("is_word"), (~F.col("is_mark") & ((code + F.col("page_id")) % 3 != 0)).alias("kept"),
        (~F.col("is_mark")).alias("letter"), ((code + F.col("page_id")) % 7 < F.col("page_id") % 8).alias("rejected"))
    return B.page_reject(cands)


def _baseline(spark, sf):
    out = B.fit_baseline(V.v_written(spark, sf))
    return out.select(*KEYS, (F.round("slope", 6) + F.lit(0.0)).alias("slope"), (F.round("intercept", 4) + F.lit(0.0)).alias("intercept"),
                      "x_height", "tall_height", "n_small", "mixed_case")


def _position(spark, sf):
    boxes = V.v_written(spark, sf)
    out = B.position_fix(boxes, B.fit_baseline(boxes))
    return out.filter("char <> fixed").groupBy("page_id", "char", "fixed").agg(_n(), _long("pos", "pos_sum"))


def _merge(rule, view=V.v_marks):
    def run(spark, sf):
        out = B.merge_boxes(view(spark, sf), rule)
        return out.groupBy(*KEYS).agg(_n(), F.sum("x0").alias("x0"), F.sum("y0").alias("y0"), F.sum("x1").alias("x1"), F.sum("y1").alias("y1"))
    return run


def _fused(pen):
    def run(spark, sf):
        p = V.v_glyph_pred(spark, sf).withColumn("mark", F.when(F.col("mark") != "None", F.col("mark")))
        r = p.select(R.fuse_glyph_reading("whole_base", "whole_conf", "base", "base_conf", "mark", "mark_conf", "position",
                                          "solidity", "mark_area", pen=pen).alias("r")).select("r.*")
        return r.groupBy("base", "mark", "text", "position").agg(_n(), F.round(F.sum("confidence"), 4).alias("confidence"))
    return run


def _crop_names(spark, sf):
    crops = V.v_glyph_pred(spark, sf).groupBy("base", "mark", "position").agg(F.count(F.lit(1)).alias("n"))
    return crops.groupBy(R.crop_label_prefix("base", "mark", "position").alias("prefix")).agg(_long("n", "n"))


def _mapped(spark, sf):
    m = V.v_char_boxes(spark, sf).select(*KEYS, G.map_box(ROTATION, scale_x=2.0, scale_y=2.0).alias("m"))
    return m.groupBy(*KEYS).agg(_n(), *[_long(f"m.{k}", k) for k in ("x0", "y0", "x1", "y1")])


def _band_of(spark, sf):
    c = V.v_char_boxes(spark, sf).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(R.confidence_band("confidence").alias("band"), R.confidence_band("confidence", (90.0, 75.0)).alias("page_band")).agg(_long("n", "n"))


QUERIES = {
    "box_geometry": _geometry,
    "box_union": lambda s, d: B.box_union(V.v_char_boxes(s, d), KEYS),
    "words_by_gap": _words("max_jump"),
    **{f"words_by_gap_{k}": _words(k) for k in W.STRATEGIES if k != "max_jump"},
    "otsu_split": _otsu,
    "row_clusters": _rows,
    "reading_order_lines": _reading_order,
    "side_by_side_pieces": _pieces,
    "words_to_lines": _lines,
    "detect_bands": _bands(False),
    "detect_bands_full_lines": _bands(True),
    "component_to_band": _to_band,
    "dot_owner": _owners,
    "join_dots": _joined_dots,
    "small_mark_has_letter": _near,
    "noise_components": _noise,
    "outlier_boxes": _outliers,
    "edge_slivers": _slivers,
    "page_reject": _reject,
    "fit_baseline": _baseline,
    "position_fix": _position,
    "merge_boxes": _merge("marks"),
    "merge_boxes_stacked": _merge("stacked", V.v_broken),
    "merge_boxes_strokes": _merge("strokes", V.v_broken),
    "merge_boxes_duplicates": _merge("duplicates", V.v_broken),
    "fuse_glyph_reading": _fused(False),
    "fuse_glyph_reading_pen": _fused(True),
    "crop_label_prefix": _crop_names,
    "box_to_original": _mapped,
    "confidence_band": _band_of,
    "spaced_top_k": lambda s, d: spaced_top_k(V.v_profile(s, d), ["page_id"], "row", "value", 40.0, SPACED_MOST),
}

# pages are dealt once, as text
QUERIES = {name: lambda s, d, run=run: run(co_partitioned(s), d) for name, run in QUERIES.items()}

# --- SQL -------------------------------------------------------------------------

_GAPS = """g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page_id, line_no ORDER BY x0) AS gap FROM v_char_boxes),
    sz AS (SELECT page_id, line_no, count(*) AS n_boxes, median(x1 - x0) AS mw, median(y1 - y0) AS mh FROM v_char_boxes GROUP BY ALL)"""


def _sql_otsu(name: str, source: str) -> str:
    return f"""{name}_d AS (SELECT page_id, line_no, gap, count(*) AS n FROM {source} WHERE gap IS NOT NULL GROUP BY ALL),
    {name}_st AS (SELECT page_id, line_no, sum(n)::BIGINT AS cnt, sum(gap * n) AS tot, min(gap) AS lo, max(gap) AS hi FROM {name}_d GROUP BY ALL),
    {name}_t AS (SELECT page_id, line_no, cnt, tot, k, CASE WHEN k = 49 THEN hi ELSE lo + k * ((hi - lo) / 49) END AS t
        FROM {name}_st, range(50) r(k) WHERE cnt >= 2 AND hi - lo >= 5),
    {name}_v AS (SELECT page_id, line_no, k, t, cnt, tot, sum(CASE WHEN gap <= t THEN n ELSE 0 END)::BIGINT AS c0,
        sum(CASE WHEN gap <= t THEN gap * n ELSE 0 END) AS s0 FROM {name}_t JOIN {name}_d USING (page_id, line_no) GROUP BY ALL),
    {name}_w AS (SELECT *, (c0 / cnt::DOUBLE) * ((cnt - c0) / cnt::DOUBLE) * ((s0 / c0 - (tot - s0) / (cnt - c0)) * (s0 / c0 - (tot - s0) / (cnt - c0))) AS v
        FROM {name}_v WHERE c0 > 0 AND c0 < cnt),
    {name}_b AS (SELECT page_id, line_no, t, row_number() OVER (PARTITION BY page_id, line_no ORDER BY v DESC, k) AS rn FROM {name}_w),
    {name} AS (SELECT s.page_id, s.line_no, CASE WHEN cnt < 2 THEN 10.0::DOUBLE WHEN hi - lo < 5 THEN hi + 1.0 ELSE coalesce(t, lo) END AS threshold
        FROM {name}_st s LEFT JOIN {name}_b b ON b.page_id = s.page_id AND b.line_no = s.line_no AND b.rn = 1)"""


_JUMP = """sg AS (SELECT page_id, line_no, gap, row_number() OVER (PARTITION BY page_id, line_no ORDER BY gap) AS i,
        lead(gap) OVER (PARTITION BY page_id, line_no ORDER BY gap) AS nxt, count(*) OVER (PARTITION BY page_id, line_no) AS m
        FROM g WHERE gap IS NOT NULL),
    sj AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY nxt - gap DESC NULLS LAST, i) AS rn FROM sg),
    mj AS (SELECT page_id, line_no, CASE WHEN m > 1 THEN (gap + nxt) / 2 ELSE greatest(10.0, gap * 2.0) END AS threshold FROM sj WHERE rn = 1)"""

_REFINED = """lo AS (SELECT g.page_id, g.line_no, gap, threshold FROM g JOIN mj USING (page_id, line_no) WHERE gap <= threshold),
    ov AS (SELECT page_id, line_no, count(*) AS m, count(*) FILTER (WHERE gap > threshold) AS over FROM g JOIN mj USING (page_id, line_no)
           WHERE gap IS NOT NULL GROUP BY ALL),
    lg AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY gap) AS i,
        lead(gap) OVER (PARTITION BY page_id, line_no ORDER BY gap) AS nxt, count(*) OVER (PARTITION BY page_id, line_no) AS m FROM lo),
    lj AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY nxt - gap DESC NULLS LAST, i) AS rn FROM lg),
    lk AS (SELECT page_id, line_no, i AS k, gap AS a, nxt AS b FROM lj WHERE rn = 1 AND m >= 2),
    un AS (SELECT l.page_id, l.line_no, median(l.gap) AS med, max(l.gap) AS mx FROM lg l JOIN lk USING (page_id, line_no) WHERE l.i <= lk.k GROUP BY ALL),
    rf AS (SELECT mj.page_id, mj.line_no, CASE WHEN ov.m >= 3 AND ov.over <= 1 AND mw > 0 AND b - a >= 0.15 * mw AND (a + b) / 2 >= 0.45 * mw
             AND b >= 1.35 * med AND b >= 1.3 * mx THEN (a + b) / 2 ELSE mj.threshold END AS threshold
        FROM mj JOIN ov USING (page_id, line_no) JOIN sz USING (page_id, line_no) LEFT JOIN lk USING (page_id, line_no) LEFT JOIN un USING (page_id, line_no))"""

_CLIPPED = "gc AS (SELECT page_id, line_no, CASE WHEN mw > 0 THEN least(gap, 2.0 * mw) ELSE gap END AS gap FROM g JOIN sz USING (page_id, line_no) WHERE gap IS NOT NULL)"
_LATIN = """la AS (SELECT o.page_id, o.line_no, CASE WHEN m >= 2 AND lo > 0.45 * mh AND hi <= 1.6 * lo AND hi <= 1.0 * mh THEN 'infinity'::DOUBLE
        ELSE least(greatest(threshold, 0.45 * mh), 1.0 * mh) END AS threshold
        FROM ot o JOIN sz USING (page_id, line_no) JOIN (SELECT page_id, line_no, count(gap) AS m, min(gap) AS lo, max(gap) AS hi FROM g GROUP BY ALL)
        USING (page_id, line_no))"""
_PEN = """pg AS (SELECT page_id, line_no, greatest(gap, 0.0) AS gap FROM g WHERE gap IS NOT NULL),
    pc AS (SELECT page_id, line_no, quantile_cont(gap, 0.6) AS p FROM pg GROUP BY ALL),
    pu AS (SELECT page_id, line_no, median(gap) AS usual FROM pg JOIN pc USING (page_id, line_no) WHERE gap <= p GROUP BY ALL),
    pe AS (SELECT la.page_id, la.line_no, CASE WHEN n_boxes <= 2 THEN la.threshold ELSE least(greatest(0.48 * greatest(mh, 1.0), usual * 2.2), 1.05 * greatest(mh, 1.0)) END AS threshold
        FROM la JOIN sz USING (page_id, line_no) JOIN pu USING (page_id, line_no))"""


def _sql_words(cuts: str, *ctes: str) -> str:
    body = f"""WITH {', '.join([_GAPS, *ctes])},
    wn AS (SELECT g.page_id, g.line_no, pos, t.threshold, sum(CASE WHEN gap > t.threshold THEN 1 ELSE 0 END)
             OVER (PARTITION BY g.page_id, g.line_no ORDER BY x0) AS word_no
           FROM g LEFT JOIN {cuts} t ON t.page_id = g.page_id AND t.line_no = g.line_no)
    SELECT page_id, line_no, count(*) AS n_boxes, (max(word_no) + 1)::BIGINT AS n_words, sum(word_no * (pos + 1))::BIGINT AS word_sum,
           CASE WHEN max(threshold) = 'infinity'::DOUBLE THEN -1.0 ELSE max(threshold) END AS threshold FROM wn GROUP BY ALL"""
    return with_views(body, "v_char_boxes")


_OTSU = _sql_otsu("ot", "g")
_FIXED = "fx AS (SELECT page_id, line_no, greatest(10.0, 0.9 * mw) AS threshold FROM sz)"
_SUMS = "count(*) AS n, sum(x0) AS x0, sum(y0) AS y0, sum(x1) AS x1, sum(y1) AS y1"
_SIZES = """sz AS (SELECT page_id, line_no, count(*) AS n_boxes, median(x1 - x0) AS mw, median(y1 - y0) AS mh FROM v_marks GROUP BY ALL)"""
_PAGES = "pg AS (SELECT page_id, max(x1) + 10 AS img_w, max(y1) + 10 AS img_h FROM v_char_boxes GROUP BY ALL)"
_OWN = f"""{_SIZES},
    m AS (SELECT v.*, mh, n_boxes >= 2 AND y1 - y0 < 0.45 * mh AND x1 - x0 < 0.8 * mh AS dot FROM v_marks v JOIN sz USING (page_id, line_no)),
    c AS (SELECT d.page_id, d.line_no, d.comp_id, b.comp_id AS stem,
            row_number() OVER (PARTITION BY d.page_id, d.line_no, d.comp_id
              ORDER BY least(d.x1, b.x1) - greatest(d.x0, b.x0) DESC, abs((b.x0 + b.x1) - (d.x0 + d.x1)), b.comp_id) AS rn
          FROM m d JOIN m b ON b.page_id = d.page_id AND b.line_no = d.line_no AND d.dot AND NOT b.dot AND b.x1 - b.x0 <= 0.6 * b.mh
            AND least(d.x1 + 0.25 * d.mh, b.x1) - greatest(d.x0 - 0.25 * d.mh, b.x0) > 0 AND (b.y0 + b.y1) / 2 > (d.y0 + d.y1) / 2
            AND b.y0 - d.y1 <= 0.8 * d.mh),
    o AS (SELECT m.*, coalesce(c.stem, m.comp_id) AS owner FROM m LEFT JOIN c ON c.page_id = m.page_id AND c.line_no = m.line_no
            AND c.comp_id = m.comp_id AND c.rn = 1)"""


def _sql_bands(full: bool = False) -> str:
    # one run after another: each step sees the band that its page has built so far
    walk = """n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY st) AS rn FROM runs JOIN md USING (page_id)),
        walk AS (SELECT page_id, rn, st, en, 0 AS grp FROM n WHERE rn = 1
          UNION ALL SELECT page_id, rn, CASE WHEN joins THEN st ELSE s2 END, e2, CASE WHEN joins THEN grp ELSE grp + 1 END
          FROM (SELECT w.page_id, n.rn, w.st, w.grp, n.st AS s2, n.en AS e2,
                       n.st - w.en <= greatest(5.0, med * 0.6) AND least(n.en - n.st, w.en - w.st) < 0.6 * med AS joins
                FROM walk w JOIN n ON n.page_id = w.page_id AND n.rn = w.rn + 1)),
        gr AS (SELECT n.*, grp + 1 AS grp FROM walk w JOIN n USING (page_id, rn)),"""
    plain = """f AS (SELECT *, CASE WHEN st - lag(en) OVER (PARTITION BY page_id ORDER BY st) <= greatest(5.0, med * 0.6) THEN 0 ELSE 1 END AS fresh
              FROM runs JOIN md USING (page_id)),
        gr AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY st) AS grp FROM f),"""
    sql = with_views("""
        WITH RECURSIVE h AS (SELECT page_id, max(row) + 1 AS hh FROM v_profile GROUP BY ALL),
        s AS (SELECT page_id, hh, greatest(3, CASE WHEN round_even(hh * 0.02, 0)::BIGINT % 2 = 0 THEN round_even(hh * 0.02, 0)::BIGINT + 1
                     ELSE round_even(hh * 0.02, 0)::BIGINT END) AS size FROM h),
        d AS (SELECT s.page_id, hh, size, r, coalesce(value, 0)::DOUBLE AS v FROM (SELECT *, unnest(range(hh)) AS r FROM s) s
              LEFT JOIN v_profile p ON p.page_id = s.page_id AND p.row = s.r),
        c AS (SELECT *, sum(v) OVER (PARTITION BY page_id ORDER BY r) AS cum FROM d),
        sm AS (SELECT a.*, (b.cum - coalesce(e.cum, 0)) / a.size AS sv FROM c a
               JOIN c b ON b.page_id = a.page_id AND b.r = least(a.r + a.size // 2, a.hh - 1)
               LEFT JOIN c e ON e.page_id = a.page_id AND e.r = a.r - a.size // 2 - 1),
        k AS (SELECT *, sv > 0.3 * max(sv) OVER (PARTITION BY page_id) AS core FROM sm),
        i AS (SELECT *, sum(CASE WHEN core THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY r) AS isl FROM k),
        runs AS (SELECT page_id, hh, isl, min(r) AS st, max(r) + 1 AS en FROM i WHERE core GROUP BY ALL),
        md AS (SELECT page_id, median(en - st) AS med FROM runs GROUP BY ALL),
        @merge@
        b AS (SELECT page_id, hh, med, grp - 1 AS band, min(st) AS st, max(en) AS en FROM gr GROUP BY ALL),
        l AS (SELECT *, coalesce((lag(en) OVER w + st) // 2, 0) AS l0, coalesce((en + lead(st) OVER w) // 2, hh) AS l1,
                     greatest(5.0, round_even(med * 0.5, 0))::BIGINT AS x FROM b WINDOW w AS (PARTITION BY page_id ORDER BY band)),
        q AS (SELECT *, greatest(l0, st - x) AS c0, least(l1, en + x) AS c1 FROM l)
        SELECT page_id, band::BIGINT AS band,
               coalesce((SELECT max(r) FROM d WHERE d.page_id = q.page_id AND v = 0 AND r <= c0 AND r > l0), l0)::BIGINT AS y0,
               coalesce((SELECT min(r) FROM d WHERE d.page_id = q.page_id AND v = 0 AND r >= c1 AND r < l1), l1)::BIGINT AS y1
        FROM q""", "v_profile")
    return recursive(sql.replace("@merge@", walk if full else plain))


def _sql_fused(pen: bool) -> str:
    shape = "CASE WHEN mark_area < 16 THEN 'Dot' WHEN solidity < 0.8 THEN 'X' ELSE 'Dot' END"
    if pen:
        shape = f"CASE WHEN position = 'Above' THEN 'Dot' ELSE {shape} END"
    return with_views(f"""
        WITH u AS (SELECT *, mark = 'None' OR (whole_conf >= base_conf AND (whole_base IN ('A', 'EI', 'OU') OR mark_area < 16)) AS whole,
                   {shape} AS shape FROM v_glyph_pred),
        r AS (SELECT CASE WHEN whole THEN whole_base ELSE base END AS base, CASE WHEN whole THEN 'None' ELSE shape END AS mark,
                     CASE WHEN whole THEN 'None' ELSE position END AS position,
                     CASE WHEN whole THEN whole_conf ELSE least(base_conf, mark_conf) END AS confidence FROM u),
        t AS (SELECT *, CASE WHEN base = 'Da' THEN '{{d/r}}' ELSE substr(base, 1, length(base) - 1) END AS stem FROM r)
        SELECT base, mark, CASE WHEN base = 'EI' THEN '{{e/i}}' WHEN base = 'OU' THEN '{{o/u}}' WHEN base = 'A' THEN 'A' WHEN mark = 'X' THEN stem
               WHEN mark = 'Dot' AND position = 'Above' THEN stem || '{{e/i}}' WHEN mark = 'Dot' THEN stem || '{{o/u}}'
               WHEN base = 'Da' THEN '{{d/r}}a' ELSE base END AS text, position, count(*) AS n, round(sum(confidence), 4) AS confidence
        FROM t GROUP BY ALL""", "v_glyph_pred")


def _sql_merge() -> str:
    return with_views(f"""WITH {_SIZES},
        d AS (SELECT v.*, mh, char IN ('i', 'j') AND NOT is_mark AS owns FROM v_marks v JOIN sz USING (page_id, line_no)),
        o AS (SELECT page_id, line_no, x0, x1, y1, CASE WHEN owns THEN line_no * 40 + 2.0::DOUBLE ELSE y0 END AS y0 FROM d WHERE NOT is_mark)
        SELECT page_id, line_no, {_SUMS} FROM o GROUP BY ALL""", "v_marks")


def _sql_pieces(fits: str, rank: str, once: bool) -> str:
    """The pieces of each letter as a list; each step unites the best pair that fits, until none does.

    Letters of `v_broken` do not overlap each other, so only pieces of one letter can.
    """
    over = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))"
    gap = "greatest(0.0, greatest(a.y0, b.y0) - least(a.y1, b.y1))"
    narrow = "least(a.x1 - a.x0, b.x1 - b.x0)"
    put = lambda x: x.format(over=over, gap=gap, narrow=narrow)
    source = "SELECT DISTINCT page_id, line_no, pos, x0, y0, x1, y1 FROM v_broken" if once else "SELECT * FROM v_broken"
    return recursive(with_views(f"""WITH RECURSIVE sz AS (SELECT page_id, line_no, {'greatest(1.0, median(y1 - y0))' if once else 'median(y1 - y0)'} AS mh FROM v_broken GROUP BY ALL),
        cols AS (SELECT page_id, line_no, pos, mh, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY x0, y0, x1, y1) AS bs FROM ({source}) JOIN sz USING (page_id, line_no) GROUP BY ALL),
        steps AS (SELECT *, 0 AS step FROM cols
          UNION ALL SELECT page_id, line_no, pos, mh,
            {'list_sort' if once else ''}(list_transform(list_filter(range(1, len(bs) + 1), lambda k: k <> best.j), lambda k: CASE WHEN k <> best.i THEN bs[k] ELSE
              {{'x0': least(bs[best.i].x0, bs[best.j].x0), 'y0': least(bs[best.i].y0, bs[best.j].y0), 'x1': greatest(bs[best.i].x1, bs[best.j].x1), 'y1': greatest(bs[best.i].y1, bs[best.j].y1)}} END)), step + 1
          FROM (SELECT s.page_id, s.line_no, s.pos, s.mh, any_value(bs) AS bs, any_value(step) AS step, min({{{put(rank)}'i': i, 'j': j}}) AS best
                FROM (SELECT *, bs[i] AS a, bs[j] AS b FROM (SELECT *, unnest(range(i + 1, len(bs) + 1)) AS j FROM (SELECT *, unnest(range(1, len(bs))) AS i FROM steps))) s
                WHERE {put(fits)} GROUP BY ALL)),
        ended AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY page_id, line_no, pos ORDER BY step DESC) = 1),
        flat AS (SELECT page_id, line_no, unnest(bs) AS b FROM ended)
        SELECT page_id, line_no, count(*) AS n, sum(b.x0) AS x0, sum(b.y0) AS y0, sum(b.x1) AS x1, sum(b.y1) AS y1 FROM flat GROUP BY ALL""", "v_broken"))


_STACKED = "least(greatest(a.x1 - a.x0, a.y1 - a.y0), greatest(b.x1 - b.x0, b.y1 - b.y0)) >= 0.35 * mh AND {narrow} > 0 AND {over} >= 0.5 * {narrow} AND {gap} <= 0.3 * mh"
_STROKES = ("least(a.y1 - a.y0, b.y1 - b.y0) <= 0.55 * mh AND {over} >= 0.38 * greatest({narrow}, 1.0) AND {gap} <= 0.18 * mh "
            "AND greatest(a.x1, b.x1) - least(a.x0, b.x0) <= 1.25 * mh")
# of boxes that cover each other the first stays: at most two boxes of a letter do
_COPIES = with_views(f"""WITH d AS (SELECT DISTINCT page_id, line_no, pos, x0, y0, x1, y1 FROM v_broken),
        gone AS (SELECT DISTINCT b.* FROM d a JOIN d b USING (page_id, line_no, pos) WHERE (a.x0, a.y0, a.x1, a.y1) < (b.x0, b.y0, b.x1, b.y1)
          AND greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))
              > 0.92 * greatest(1.0, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))))
        SELECT page_id, line_no, {_SUMS} FROM (SELECT * FROM d EXCEPT SELECT * FROM gone) GROUP BY ALL""", "v_broken")


_BASE = """
    xl AS (SELECT page_id, line_no, (x0 + x1) / 2 AS x, y1 AS y, y1 - y0 AS h FROM v_written WHERE char IN ('a','c','e','m','n','o','r','s','u','w')),
    f1 AS (SELECT page_id, line_no, regr_slope(y, x) AS a, regr_intercept(y, x) AS c, count(*) AS n, max(x) - min(x) AS rg, median(h) AS xh, median(y) AS flat
           FROM xl GROUP BY ALL),
    f2 AS (SELECT xl.page_id, xl.line_no, regr_slope(y, x) AS a2, regr_intercept(y, x) AS c2, count(*) AS n2, max(x) - min(x) AS rg2
           FROM xl JOIN f1 USING (page_id, line_no) WHERE n >= 3 AND rg > 0 AND abs(y - (a * x + c)) <= 0.35 * xh GROUP BY ALL),
    tl AS (SELECT page_id, line_no, median(y1 - y0) AS th FROM v_written WHERE char IN ('b','d','h','k','l','t') GROUP BY ALL),
    ft AS (SELECT page_id, line_no, xh, th, n, CASE WHEN n < 3 OR rg <= 0 THEN 0.0 WHEN n2 >= 3 AND rg2 > 0 THEN a2 ELSE a END AS slope,
             CASE WHEN n < 3 OR rg <= 0 THEN flat WHEN n2 >= 3 AND rg2 > 0 THEN c2 ELSE c END AS intercept
           FROM f1 LEFT JOIN f2 USING (page_id, line_no) LEFT JOIN tl USING (page_id, line_no) WHERE n >= 2 AND xh > 0),
    sn AS (SELECT DISTINCT v.page_id, v.line_no FROM v_written v JOIN ft USING (page_id, line_no) WHERE char IN ('g', 'p', 'y')
             AND y1 >= slope * (x0 + x1) / 2 + intercept + 0.4 * xh),
    bl AS (SELECT ft.*, coalesce(th >= 1.25 * xh, false) OR sn.page_id IS NOT NULL AS mixed_case,
             CASE WHEN th IS NULL THEN 1.45 ELSE least(1.45, 0.95 * th / xh) END AS a_max FROM ft LEFT JOIN sn USING (page_id, line_no))"""

ORACLES = {
    "box_geometry": with_views("""
        WITH p AS (SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM v_marks
                   WINDOW w AS (PARTITION BY page_id, line_no ORDER BY x0, x1, y0, y1))
        SELECT page_id, line_no, count(*) AS n, sum((x0 + x1) / 2) AS cx, sum((y0 + y1) / 2) AS cy, sum(x1 - x0) AS width, sum(y1 - y0) AS height,
               sum(area) AS area, coalesce(sum(CASE WHEN px0 IS NOT NULL THEN greatest(0.0, least(x1, px1) - greatest(x0, px0)) / least(x1 - x0, px1 - px0) END), 0.0) AS h_overlap,
               coalesce(sum(CASE WHEN px0 IS NULL THEN NULL WHEN y1 <= py0 THEN py0 - y1 WHEN py1 <= y0 THEN y0 - py1 ELSE 0.0 END), 0.0) AS v_gap
        FROM p GROUP BY ALL""", "v_marks"),
    "box_union": with_views("""
        SELECT page_id, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes, (min(x0) + max(x1)) / 2 AS cx,
               (min(y0) + max(y1)) / 2 AS cy, max(x1) - min(x0) AS width, max(y1) - min(y0) AS height FROM v_char_boxes GROUP BY page_id, line_no""", "v_char_boxes"),
    "words_by_gap": _sql_words("mj", _JUMP),
    "words_by_gap_refined": _sql_words("rf", _JUMP, _REFINED),
    "words_by_gap_otsu": _sql_words("ot", _OTSU),
    "words_by_gap_otsu_clipped": _sql_words("ot", _CLIPPED, _sql_otsu("ot", "gc")),
    "words_by_gap_latin": _sql_words("la", _OTSU, _LATIN),
    "words_by_gap_pen": _sql_words("pe", _OTSU, _LATIN, _PEN),
    "words_by_gap_fixed": _sql_words("fx", _FIXED),
    "otsu_split": with_views(f"WITH {_GAPS}, {_OTSU} SELECT page_id, line_no, threshold FROM ot", "v_char_boxes"),
    "row_clusters": with_views("""
        WITH l AS (SELECT *, (y0 + y1) / 2 AS c, lag((y0 + y1) / 2) OVER w AS pc, lag(y1 - y0) OVER w AS ph FROM v_char_boxes
                   WINDOW w AS (PARTITION BY page_id ORDER BY y0, x0, y1, x1)),
        r AS (SELECT *, sum(CASE WHEN abs(c - pc) >= ph * 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y0, x0, y1, x1) AS row_no FROM l),
        q AS (SELECT page_id, row_no, row_number() OVER (PARTITION BY page_id, row_no ORDER BY x0, y0) - 1 AS row_pos FROM r)
        SELECT page_id, count(*) AS n, (max(row_no) + 1)::BIGINT AS n_rows, sum(row_no)::BIGINT AS row_sum, sum(row_no * row_pos)::BIGINT AS place_sum
        FROM q GROUP BY ALL""", "v_char_boxes"),
    "reading_order_lines": with_views("""
        WITH l AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY line_no) - 1 AS tl,
                          row_number() OVER (PARTITION BY page_id, line_no ORDER BY x0) - 1 AS lp FROM v_char_boxes)
        SELECT page_id, count(*) AS n, max(tl) + 1 AS n_lines, sum(tl)::BIGINT AS line_sum, sum(tl * lp)::BIGINT AS place_sum FROM l GROUP BY ALL""", "v_char_boxes"),
    "side_by_side_pieces": with_views(f"""
        WITH {_GAPS}, {_FIXED},
        w AS (SELECT g.*, (x1 - x0) * (y1 - y0) AS area, sum(CASE WHEN gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY g.page_id, g.line_no ORDER BY x0) AS wn
              FROM g JOIN fx ON fx.page_id = g.page_id AND fx.line_no = g.line_no),
        b AS (SELECT page_id, line_no, wn, sum(area) AS ink, max(x1) - min(x0) AS bw, max(y1) - min(y0) AS bh FROM w GROUP BY ALL),
        s AS (SELECT w.page_id, w.line_no, w.wn, x0, max(x1) OVER (PARTITION BY w.page_id, w.line_no, w.wn ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rt
              FROM w JOIN b ON b.page_id = w.page_id AND b.line_no = w.line_no AND b.wn = w.wn WHERE area >= greatest(3.0, 0.01 * ink)),
        c AS (SELECT page_id, line_no, wn, count(*) FILTER (WHERE rt IS NULL OR x0 > rt) AS sbs FROM s GROUP BY ALL)
        SELECT page_id, count(*) AS n_words, sum(sbs)::BIGINT AS pieces, sum(CASE WHEN bh > 0 AND bw >= 1.6 * bh AND sbs >= 3 THEN 1 ELSE 0 END)::BIGINT AS n_word_like
        FROM b JOIN c USING (page_id, line_no, wn) GROUP BY ALL""", "v_char_boxes"),
    "words_to_lines": with_views(r"""
        WITH w AS (SELECT page_id, unnest(range(0, n)) AS idx FROM (SELECT doc_id AS page_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM documents)),
        c AS (SELECT page_id, line_no, len(list_filter(regexp_split_to_array(line, '[ \t\n\r]+'), lambda x: x <> '')) AS n, max(line_no) OVER (PARTITION BY page_id) AS last FROM v_lines),
        f AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line_no) - 1 AS tl, sum(n) OVER (PARTITION BY page_id ORDER BY line_no) AS en, n FROM c WHERE line_no < last AND n > 0),
        p AS (SELECT w.page_id, idx, coalesce((SELECT tl FROM f WHERE f.page_id = w.page_id AND idx >= en - n AND idx < en), (SELECT count(*) FROM f WHERE f.page_id = w.page_id)) AS text_line FROM w)
        SELECT page_id, text_line::BIGINT AS text_line, count(*) AS n, min(idx)::BIGINT AS first_idx, max(idx)::BIGINT AS last_idx FROM p GROUP BY ALL""", "v_lines"),
    "detect_bands": _sql_bands(),
    "detect_bands_full_lines": _sql_bands(True),
    "spaced_top_k": recursive(with_views(f"""WITH RECURSIVE picks AS (SELECT page_id, 0 AS n, []::BIGINT[] AS rows FROM v_profile GROUP BY ALL
          UNION ALL SELECT page_id, n + 1, list_append(rows, row) FROM (
            SELECT p.page_id, n, rows, v.row, row_number() OVER (PARTITION BY p.page_id ORDER BY value, v.row) AS rn FROM picks p JOIN v_profile v ON v.page_id = p.page_id
            WHERE n < {SPACED_MOST} AND list_bool_and([true] || list_transform(rows, lambda c: abs(c - v.row) >= 40))) WHERE rn = 1)
        SELECT page_id, unnest(rows)::DOUBLE AS row FROM (SELECT *, max(n) OVER (PARTITION BY page_id) AS last FROM picks) WHERE n = last""", "v_profile")),
    "component_to_band": with_views("""
        WITH e AS (SELECT DISTINCT page_id, y0, y1 FROM v_marks),
        c AS (SELECT e.*, band, least(y1, b1) - greatest(y0, b0) AS ov, abs((y0 + y1) / 2 - (b0 + b1) / 2) AS away FROM e JOIN v_bands USING (page_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY page_id, y0, y1 ORDER BY CASE WHEN ov > 0 THEN 0 ELSE 1 END, CASE WHEN ov > 0 THEN -ov ELSE away END, band) AS rn FROM c)
        SELECT m.page_id, m.line_no, band, count(*) AS n, sum(comp_id)::BIGINT AS comp_sum
        FROM v_marks m JOIN r ON r.page_id = m.page_id AND r.y0 = m.y0 AND r.y1 = m.y1 AND rn = 1 GROUP BY ALL""", "v_marks", "v_bands"),
    "dot_owner": with_views(f"""WITH {_OWN}
        SELECT page_id, line_no, count(*) AS n, sum(CASE WHEN owner <> comp_id THEN 1 ELSE 0 END)::BIGINT AS n_owned, sum(owner)::BIGINT AS owner_sum
        FROM o GROUP BY ALL""", "v_marks"),
    "join_dots": with_views(f"""WITH {_OWN},
        u AS (SELECT page_id, line_no, owner, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM o GROUP BY ALL)
        SELECT page_id, line_no, count(*) AS n_letters, sum(x0) AS x0, sum(y0) AS y0, sum(x1) AS x1, sum(y1) AS y1 FROM u GROUP BY ALL""", "v_marks"),
    "small_mark_has_letter": with_views("""
        SELECT page_id, count(*) AS kept, sum(comp_id)::BIGINT AS comp_sum FROM v_marks d WHERE is_mark AND EXISTS (
          SELECT 1 FROM v_marks b WHERE b.page_id = d.page_id AND NOT b.is_mark AND b.line_no BETWEEN d.line_no - 1 AND d.line_no + 1
            AND (d.x0 + d.x1) / 2 BETWEEN b.x0 - 2 AND b.x1 + 2 AND greatest(b.y0 - d.y1, d.y0 - b.y1, 0.0) <= 12) GROUP BY ALL""", "v_marks"),
    "noise_components": with_views(f"""
        WITH {_PAGES}, c AS (SELECT m.*, img_w, img_h, x1 - x0 AS w, y1 - y0 AS h FROM v_marks m JOIN pg USING (page_id)),
        s AS (SELECT page_id, median(h) AS L, count(*) AS n FROM c WHERE greatest(w, h) >= 8 AND greatest(w, h) < 0.5 * greatest(img_w, img_h) GROUP BY ALL
              HAVING count(*) >= 3 AND median(h) >= 3),
        t AS (SELECT c.*, L, CASE WHEN L IS NULL THEN 'keep'
                WHEN w < 0.35 * L AND h < 0.35 * L THEN CASE WHEN area < 2 THEN 'speck' ELSE 'small' END
                WHEN (w > 3 * L AND h < 0.5 * L) OR (h > 3 * L AND w < 0.5 * L) THEN 'line'
                WHEN (x0 <= 0 OR y0 <= 0 OR x1 >= img_w OR y1 >= img_h) AND greatest(w, h) > 2 * L THEN 'border junk'
                WHEN w > 2.5 * L AND h > 2.5 * L AND area > 1.5 * L * L THEN 'blob' ELSE 'keep' END AS tag0 FROM c LEFT JOIN s USING (page_id)),
        o AS (SELECT DISTINCT d.page_id, d.line_no, d.comp_id FROM t d JOIN t b ON b.page_id = d.page_id AND b.line_no = d.line_no AND d.tag0 = 'small' AND b.tag0 = 'keep'
                AND b.L IS NOT NULL AND greatest(b.w, b.h) <= 3 * b.L AND (d.x0 + d.x1) / 2 BETWEEN b.x0 - 0.1 * d.L AND b.x1 + 0.1 * d.L
                AND greatest(b.y0 - d.y1, d.y0 - b.y1, 0.0) <= 0.6 * d.L)
        SELECT t.page_id, CASE WHEN tag0 <> 'small' THEN tag0 WHEN o.comp_id IS NOT NULL THEN 'keep' ELSE 'speck' END AS tag, count(*) AS n
        FROM t LEFT JOIN o USING (page_id, line_no, comp_id) GROUP BY ALL""", "v_marks"),
    "outlier_boxes": with_views(f"""
        WITH {_SIZES} SELECT page_id, line_no, CASE WHEN n_boxes < 3 THEN 'keep' WHEN y1 - y0 < 0.35 * mh AND x1 - x0 < 0.35 * mw THEN 'orphan'
               WHEN y1 - y0 > 3 * mh THEN 'too_tall' ELSE 'keep' END AS tag, count(*) AS n FROM v_marks JOIN sz USING (page_id, line_no) GROUP BY ALL""", "v_marks"),
    "edge_slivers": with_views(f"""
        WITH {_SIZES}, {_PAGES}, c AS (SELECT m.*, mh, img_w, (x0 <= greatest(4, round_even(0.015 * img_w, 0)) OR x1 >= img_w - greatest(4, round_even(0.015 * img_w, 0)))
                AND x1 - x0 <= 0.35 * mh AS cand FROM v_marks m JOIN sz USING (page_id, line_no) JOIN pg USING (page_id)),
        k AS (SELECT page_id, line_no, comp_id, x0, x1, mh, img_w FROM c WHERE cand),
        a AS (SELECT k.page_id, k.line_no, k.comp_id, min(greatest(b.x0 - k.x1, k.x0 - b.x1)) AS gap FROM k LEFT JOIN c b
              ON b.page_id = k.page_id AND b.line_no = k.line_no AND NOT b.cand GROUP BY ALL),
        d AS (SELECT k.page_id, count(*) AS nd FROM k JOIN a USING (page_id, line_no, comp_id) WHERE x0 <= 2 OR x1 >= img_w - 2 OR gap IS NULL OR gap >= 0.6 * mh GROUP BY ALL)
        SELECT page_id, count(*) AS n, coalesce(any_value(nd), 0)::BIGINT AS n_dropped FROM c LEFT JOIN d USING (page_id) GROUP BY ALL""", "v_marks"),
    "page_reject": with_views("""
        WITH c AS (SELECT page_id, y1 - y0 AS h, (ord(char) * 7 + comp_id) % 100 < 25 AS tx, (ord(char) * 3 + comp_id) % 100 < 10 AS wd, NOT is_mark AND (ord(char) + page_id) % 3 <> 0 AS kept, NOT is_mark AS letter, (ord(char) + page_id) % 7 < page_id % 8 AS rej FROM v_marks),
        a AS (SELECT page_id, count(*) AS candidates, count(*) FILTER (WHERE tx) AS n_textured, count(*) FILTER (WHERE wd) AS n_words, count(*) FILTER (WHERE kept) AS n_kept,
                count(*) FILTER (WHERE letter) AS n_letters, count(*) FILTER (WHERE letter AND rej) AS n_rejected, quantile_cont(h, 0.25) FILTER (WHERE kept) AS q1, median(h) FILTER (WHERE kept) AS q2, quantile_cont(h, 0.75) FILTER (WHERE kept) AS q3 FROM c GROUP BY ALL),
        s AS (SELECT *, n_textured / candidates::DOUBLE AS texture_share, n_words / candidates::DOUBLE AS word_share, CASE WHEN n_kept >= 3 THEN (q3 - q1) / greatest(1.0, q2) ELSE 0.0 END AS height_spread, CASE WHEN n_kept > 0 THEN (q3 - q1) / greatest(1.0, q2) ELSE 0.0 END AS latin_spread FROM a),
        t AS (SELECT *, texture_share >= 0.35 OR (texture_share >= 0.2 AND height_spread > 0.75) AS tex, texture_share >= 0.35 OR (texture_share >= 0.2 AND latin_spread > 0.75) AS latin_tex FROM s)
        SELECT page_id, candidates, n_textured, n_words, n_kept, n_letters, n_rejected, texture_share, word_share, height_spread, latin_spread,
               CASE WHEN n_kept = 0 THEN 'empty' WHEN n_words >= 3 AND word_share >= 0.15 THEN 'words' WHEN tex THEN 'texture' WHEN candidates >= 8 AND n_kept < 0.5 * candidates THEN 'few_kept' ELSE 'ok' END AS verdict,
               CASE WHEN n_kept = 0 THEN 'empty' WHEN latin_tex THEN 'texture' WHEN n_letters > 0 AND n_rejected / n_letters::DOUBLE >= 0.5 THEN 'unknown_letters' ELSE 'ok' END AS latin_verdict FROM t""", "v_marks"),
    "fit_baseline": with_views(f"""WITH {_BASE}
        SELECT page_id, line_no, round(slope, 6) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, xh AS x_height, th AS tall_height, n AS n_small, mixed_case FROM bl""", "v_written"),
    "position_fix": with_views(f"""WITH {_BASE},
        x AS (SELECT v.*, xh, mixed_case, slope * ((x0 + x1) / 2) + intercept AS base, CASE WHEN first_in_word THEN least(a_max, 1.2) ELSE a_max END AS lim
              FROM v_written v JOIN bl USING (page_id, line_no)),
        f AS (SELECT *, CASE WHEN char = 'g' AND mixed_case AND y1 - y0 <= lim * xh AND y1 <= base + 0.35 * xh THEN 'a'
                WHEN char = 'l' AND (has_dot OR (mixed_case AND y1 - y0 <= 1.15 * xh)) THEN 'i'
                WHEN char = 'i' AND mixed_case AND NOT has_dot AND NOT first_in_word AND y1 - y0 >= 1.35 * xh THEN 'l' ELSE char END AS fixed FROM x)
        SELECT page_id, char, fixed, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM f WHERE char <> fixed GROUP BY ALL""", "v_written"),
    "merge_boxes": _sql_merge(),
    "merge_boxes_stacked": _sql_pieces(_STACKED, "", False),
    "merge_boxes_strokes": _sql_pieces(_STROKES, "'s': -{over} / greatest({narrow}, 1.0), 'g': {gap}, ", True),
    "merge_boxes_duplicates": _COPIES,
    "fuse_glyph_reading": _sql_fused(False),
    "fuse_glyph_reading_pen": _sql_fused(True),
    "crop_label_prefix": with_views("""
        SELECT base || CASE mark WHEN 'None' THEN '' WHEN 'X' THEN '_Cross' ELSE '_Dot_' || position END AS prefix, count(*) AS n FROM v_glyph_pred GROUP BY ALL""", "v_glyph_pred"),
    "box_to_original": with_views("""
        WITH c AS (SELECT page_id, line_no, [0.5 * x0 - 0.25 * y0 + 3, 0.5 * x1 - 0.25 * y0 + 3, 0.5 * x0 - 0.25 * y1 + 3, 0.5 * x1 - 0.25 * y1 + 3] AS xs,
                          [0.25 * x0 + 0.5 * y0 + 7, 0.25 * x1 + 0.5 * y0 + 7, 0.25 * x0 + 0.5 * y1 + 7, 0.25 * x1 + 0.5 * y1 + 7] AS ys FROM v_char_boxes)
        SELECT page_id, line_no, count(*) AS n, sum(round_even(2 * list_min(xs), 0))::BIGINT AS x0, sum(round_even(2 * list_min(ys), 0))::BIGINT AS y0,
               sum(round_even(2 * list_max(xs), 0))::BIGINT AS x1, sum(round_even(2 * list_max(ys), 0))::BIGINT AS y1 FROM c GROUP BY ALL""", "v_char_boxes"),
    "confidence_band": with_views("""
        SELECT CASE WHEN confidence >= 90 THEN 0 WHEN confidence >= 80 THEN 1 WHEN confidence >= 70 THEN 2 ELSE 3 END AS band,
               CASE WHEN confidence >= 90 THEN 0 WHEN confidence >= 75 THEN 1 ELSE 2 END AS page_band, count(*) AS n FROM v_char_boxes GROUP BY ALL""", "v_char_boxes"),
}
