import random
import statistics as st

import numpy as np
import pytest
from pyspark.sql import functions as F

from sulatan.functions import geometry as G
from sulatan.operators import boxes as B
from sulatan.operators import grouping as W
from sulatan.operators import packed as P
from sulatan.plans import views as V
from sulatan.session import co_partitioned

BOX = "page_id int, line_no int, x0 double, y0 double, x1 double, y1 double"


def make_lines(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for line in range(n):
        x = 0
        for _ in range(rng.randint(1, 25)):
            w, h = rng.randint(4, 14), rng.randint(10, 30)
            rows.append((0, line, float(x), 0.0, float(x + w), float(h)))
            x += w + rng.choice([-1, 1, 2, 3, 3, 4, 12, 15, 40])
    return rows


def otsu(g):
    if len(g) < 2:
        return 10.0
    g, lo, hi = np.array(g), min(g), max(g)
    if hi - lo < 5:
        return hi + 1.0
    best, thr = -1, lo
    for t in np.linspace(lo, hi, 50):
        a, b = g[g <= t], g[g > t]
        if len(a) and len(b):
            v = len(a) / len(g) * (len(b) / len(g)) * (a.mean() - b.mean()) ** 2
            if v > best + 1e-9:
                best, thr = v, t
    return thr


def split_jump(vals):
    s = sorted(vals)
    jumps = [b - a for a, b in zip(s, s[1:])]
    k = jumps.index(max(jumps))
    return s, k, jumps[k], (s[k] + s[k + 1]) / 2


def threshold(row, strategy):
    gaps = [b[2] - a[4] for a, b in zip(row, row[1:])]
    mw, mh = st.median(b[4] - b[2] for b in row), st.median(b[5] - b[3] for b in row)
    if strategy == "fixed":
        return max(10.0, .9 * mw)
    if strategy in ("max_jump", "refined"):
        t = split_jump(gaps)[3] if len(gaps) > 1 else max(10.0, 2 * gaps[0])
        if strategy == "refined" and len(gaps) >= 3 and sum(g > t for g in gaps) <= 1:
            low = [g for g in gaps if g <= t]
            if len(low) >= 2:
                s, k, jump, mid = split_jump(low)
                under = s[:k + 1]
                if jump >= .15 * mw and mid >= .45 * mw and s[k + 1] >= 1.35 * st.median(under) and s[k + 1] >= 1.3 * max(under):
                    return mid
        return t
    if strategy == "otsu":
        return otsu(gaps)
    if strategy == "otsu_clipped":
        return otsu([min(g, 2 * mw) for g in gaps])
    if strategy == "pen" and len(row) > 2:
        g = np.maximum(gaps, 0)
        usual = np.median(g[g <= np.percentile(g, 60)])
        return min(max(.48 * max(1, mh), usual * 2.2), 1.05 * max(1, mh))
    if len(gaps) >= 2 and min(gaps) > .45 * mh and max(gaps) <= 1.6 * min(gaps) and max(gaps) <= mh:
        return float("inf")
    return min(max(otsu(gaps), .45 * mh), mh)


@pytest.mark.parametrize("strategy", W.STRATEGIES)
def test_words_by_gap(spark, strategy):
    rows = make_lines(1)
    want = {}
    for line in range(60):
        row = sorted(r for r in rows if r[1] == line)
        word = 0
        t = threshold(row, strategy) if len(row) > 1 else 0
        for a, b in zip([None, *row], row):
            word += a is not None and b[2] - a[4] > t
            want[b[1], b[2]] = word
    out = W.words_by_gap(spark.createDataFrame(rows, BOX), strategy, chunk_px=40.0).collect()
    assert {(r["line_no"], r["x0"]): r["word_no"] for r in out} == want


def test_row_clusters_and_reading_order(spark):
    rng = random.Random(4)
    rows = [(p, 0, float(rng.randint(0, 400)), float(y := rng.randint(0, 300)), 0.0, float(y + rng.randint(5, 40))) for p in range(3) for _ in range(80)]
    rows = [(*r[:4], r[2] + 8, r[5]) for r in rows]
    df = spark.createDataFrame(rows, BOX)
    got = {tuple(r[c] for c in ("page_id", "x0", "y0", "x1", "y1")): (r["row_no"], r["row_pos"]) for r in W.row_clusters(df, chunk_px=30.0).collect()}
    lines = {tuple(r[c] for c in ("page_id", "x0", "y0", "x1", "y1")): r["text_line"] for r in W.reading_order_lines(df, chunk_px=30.0).collect()}
    for page in range(3):
        boxes = sorted({(r[3], r[2], r[5], r[4]) for r in rows if r[0] == page})
        row, prev = 0, None
        for y0, x0, y1, x1 in boxes:
            if prev is not None and abs((y0 + y1) / 2 - sum(prev) / 2) >= (prev[1] - prev[0]) * .5:
                row += 1
            prev = (y0, y1)
            assert got[page, x0, y0, x1, y1][0] == row
        members, tall, line = [], 0, -1
        for cy, h, x0, y0, x1, y1 in sorted(((y0 + y1) / 2, y1 - y0, x0, y0, x1, y1) for y0, x0, y1, x1 in boxes):
            if not members or abs(cy - sum(members) / len(members)) > max(tall, h) * .7:
                members, tall, line = [], 0, line + 1
            members.append(cy)
            tall = max(tall, h)
            assert lines[page, x0, y0, x1, y1] == line


@pytest.mark.parametrize("full, inked, want", [
    (False, [(20, 40), (60, 80)], [(8, 50), (50, 80)]),  # far apart: two bands that meet half way
    (False, [(20, 40), (44, 64)], [(8, 64)]),  # a thin gap is bridged
    (True, [(20, 40), (44, 64)], [(8, 42), (42, 64)]),  # unless both sides are whole lines
])
def test_bands(spark, full, inked, want):
    data = [(page, row, 6 + page) for page in range(3) for a, b in inked for row in range(a, b)]
    out = W.detect_bands(spark.createDataFrame(data, "page_id int, row int, value int"), ["page_id"], keep_full_lines=full)
    got = {}
    for r in out.orderBy("page_id", "band").collect():
        got.setdefault(r["page_id"], []).append((r["y0"], r["y1"]))
    assert got == {page: want for page in range(3)}


def _bands_by_rows(profile, height, full):
    """Row by row and run by run, as a page is read."""
    v = [profile.get(r, 0) for r in range(height)]
    size = max(3, round(height * .02) | 1)
    half = size // 2
    smooth = [sum(v[max(0, r - half):r + half + 1]) / size for r in range(height)]
    core = [s > max(smooth) * .3 for s in smooth] + [False]
    runs, start = [], None
    for r, c in enumerate(core):
        if c and start is None:
            start = r
        elif not c and start is not None:
            runs.append((start, r))
            start = None
    sizes = sorted(b - a for a, b in runs)
    median = (sizes[len(sizes) // 2] + sizes[(len(sizes) - 1) // 2]) / 2
    merged = []
    for a, b in runs:
        if merged and a - merged[-1][1] <= max(5, median * .6) and not (full and min(b - a, merged[-1][1] - merged[-1][0]) >= .6 * median):
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out = []
    for i, (a, b) in enumerate(merged):
        low = (merged[i - 1][1] + a) // 2 if i else 0
        high = (b + merged[i + 1][0]) // 2 if i + 1 < len(merged) else height
        grow = max(5, round(median * .5))
        y0, y1 = max(low, a - grow), min(high, b + grow)
        while y0 > low and v[y0]:
            y0 -= 1
        while y1 < high and v[y1]:
            y1 += 1
        out.append((max(y0, low), min(y1, high)))
    return out


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("chunk", [37.0, 4096.0])
def test_bands_against_rows(spark, full, chunk, monkeypatch):
    """Random pages, cut into chunks far smaller than a page, and a lookup grid of few rows."""
    monkeypatch.setattr(W, "BAND_CELL", 16 if chunk < 100 else 4096)
    rng = random.Random(9)
    pages = {}
    for page in range(12):
        profile, row = {}, rng.randint(0, 30)
        while row < 900:
            tall, ink = rng.choice([3, 6, 12, 14, 20, 40]), rng.randint(1, 9)
            profile |= {r: max(1, ink + rng.randint(-1, 1)) for r in range(row, row + tall) if rng.random() < .97}
            row += tall + rng.choice([1, 2, 4, 8, 15, 40])
        pages[page] = profile
    df = spark.createDataFrame([(k, r, v) for k, p in pages.items() for r, v in p.items()], "page_id int, row int, value int").repartition(5)
    tall = spark.createDataFrame([(k, 1000) for k in pages], "page_id int, height int")
    got = {}
    for r in W.detect_bands(df, ["page_id"], height=tall, keep_full_lines=full, chunk=chunk).orderBy("page_id", "band").collect():
        got.setdefault(r["page_id"], []).append((r["y0"], r["y1"]))
    assert got == {k: _bands_by_rows(p, 1000, full) for k, p in pages.items()}
    assert W.detect_bands(df.limit(0), ["page_id"]).collect() == []


#: letters of height 20 that set the line's median height and never meet another box
LETTERS = [(1000.0 + 50 * i, 0.0, 1010.0 + 50 * i, 20.0) for i in range(9)]


@pytest.mark.parametrize("rule, pieces, want", [
    # a dot above and one below one letter; a dot between two letters goes to the left one only
    ("marks", [(0, 20, 10, 40), (3, 12, 6, 15), (4, 44, 7, 47)], [(0, 12, 10, 47)]),
    ("marks", [(0, 20, 12, 40), (8, 12, 18, 15), (14, 20, 26, 40)], [(0, 12, 18, 40), (14, 20, 26, 40)]),
    ("marks", [(0, 100, 10, 120), (3, 40, 6, 43)], [(0, 100, 10, 120), (3, 40, 6, 43)]),
    ("stacked", [(0, 0, 10, 9), (1, 12, 9, 20), (2, 25, 10, 34)], [(0, 0, 10, 34)]),
    ("stacked", [(0, 0, 10, 9), (1, 16, 9, 24)], [(0, 0, 10, 9), (1, 16, 9, 24)]),
    # the middle piece prefers the one it shares more width with
    ("strokes", [(0, 0, 8, 10), (4, 11, 16, 20), (5, 21, 16, 30)], [(0, 0, 16, 30)]),
    ("strokes", [(0, 0, 20, 10), (10, 11, 30, 20)], [(0, 0, 20, 10), (10, 11, 30, 20)]),
    ("duplicates", [(0, 0, 10, 20), (0, 0, 10, 20), (0, 1, 10, 20), (5, 0, 15, 20)], [(0, 0, 10, 20), (5, 0, 15, 20)]),
])
def test_merge_by_hand(spark, rule, pieces, want):
    rows = [(0, line, *map(float, b)) for line in range(2) for b in pieces + LETTERS]
    out = B.merge_boxes(spark.createDataFrame(rows, BOX), rule, chunk_px=25.0, cell=8.0)
    assert sorted(tuple(r) for r in out.collect()) == sorted((0, line, *map(float, b)) for line in range(2) for b in want + LETTERS)


def _merged_by_hand(boxes, rule):
    """Written out for plain tuples: look at all pairs, take the best, start again."""
    med = st.median(b[3] - b[1] for b in boxes)
    med = max(med, 1) if rule == "strokes" else med
    live = sorted(set(boxes) if rule == "strokes" else boxes)

    def rank(i, j):
        a, b = live[i], live[j]
        wide, tall = sorted((a[2] - a[0], b[2] - b[0])), sorted((a[3] - a[1], b[3] - b[1]))
        both, gap = min(a[2], b[2]) - max(a[0], b[0]), max(0, max(a[1], b[1]) - min(a[3], b[3]))
        size = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
        if rule == "marks":
            owner = a if size[0] >= size[1] else b
            ok = wide[0] > 0 and min(size) <= .45 * max(size) and both >= .3 * wide[0] and gap <= min(3 * (owner[3] - owner[1]), 2.5 * med)
        elif rule == "stacked":
            ok = wide[0] > 0 and min(max(x[2] - x[0], x[3] - x[1]) for x in (a, b)) >= .35 * med and both >= .5 * wide[0] and gap <= .3 * med
        else:
            ok = tall[0] <= .55 * med and both >= .38 * max(1, wide[0]) and gap <= .18 * med and max(a[2], b[2]) - min(a[0], b[0]) <= 1.25 * med
        return None if not ok else (-both / max(1, wide[0]), gap, i, j) if rule == "strokes" else (i, j)

    while found := [r for i in range(len(live)) for j in range(i + 1, len(live)) if (r := rank(i, j))]:
        *_, i, j = min(found)
        a, b = live[i], live[j]
        u = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        live[i] = u
        del live[j]
        if rule == "strokes":
            live.sort()
    return sorted(live)


@pytest.mark.parametrize("rule", ["marks", "stacked", "strokes"])
def test_merge_in_sequence(spark, rule):
    """Random crowded lines: growing boxes change what fits next."""
    rng = random.Random(6)
    lines = {}
    for line in range(60):
        n = rng.randint(2, 14)
        lines[line] = [(float(x := rng.randint(0, 60)), float(y := rng.randint(0, 60)), float(x + rng.randint(1, 25)), float(y + rng.choice([2, 4, 9, 20, 30]))) for _ in range(n)]
        lines[line] += lines[line][:1]
    df = spark.createDataFrame([(0, k, *b) for k, bs in lines.items() for b in bs], BOX).repartition(7)
    got = {}
    for r in B.merge_boxes(df, rule, chunk_px=25.0).collect():
        got.setdefault(r["line_no"], []).append(tuple(r)[2:])
    want = {k: _merged_by_hand(bs, rule) for k, bs in lines.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sum(map(len, want.values())) < sum(len(set(b)) for b in lines.values())


def test_huge_columns_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(B, "COLUMN_BOXES", 3)
    test_merge_under_a_ruled_line(spark, 50)


def test_merge_under_a_ruled_line(spark, n=5000):
    rows = [(0, 0, 20.0 * i, 30.0, 20.0 * i + 10, 50.0) for i in range(n)] + [(0, 0, 0.0, 50.0, 20.0 * n, 52.0)]
    out = B.merge_boxes(spark.createDataFrame(rows, BOX), "marks").collect()
    assert [tuple(r) for r in out] == [(0, 0, 0.0, 30.0, 20.0 * n, 52.0)]


def test_noise_tags(spark):
    letters = [(i, 40.0 * i + 100, 100.0, 40.0 * i + 120, 130.0, 200.0) for i in range(6)]
    odd = [(10, 0.0, 300.0, 400.0, 304.0, 900.0), (11, 0.0, 400.0, 70.0, 470.0, 300.0), (12, 200.0, 400.0, 300.0, 500.0, 9000.0),
           (13, 105.0, 90.0, 110.0, 95.0, 20.0), (14, 105.0, 60.0, 110.0, 65.0, 20.0), (15, 145.0, 135.0, 146.0, 136.0, 1.0), (16, 330.0, 100.0, 335.0, 105.0, 20.0)]
    df = spark.createDataFrame([(1, *r) for r in letters + odd], "page_id int, comp_id int, x0 double, y0 double, x1 double, y1 double, area double")
    page = spark.createDataFrame([(1, 1000.0, 1000.0, 3.0)], "page_id int, img_w double, img_h double, stroke double")
    got = {r["comp_id"]: r["tag"] for r in B.noise_components(df, page, piece=["comp_id"]).collect()}
    assert {k: v for k, v in got.items() if k >= 10} == {10: "line", 11: "border junk", 12: "blob", 13: "keep", 14: "speck", 15: "speck", 16: "speck"}
    assert all(got[i] == "keep" for i in range(6))


def test_bands_overlap_and_nearest(spark):
    rng = random.Random(8)
    bands = [(0, i, 50.0 * i + rng.randint(0, 5), 50.0 * i + rng.randint(20, 40)) for i in range(8)]
    pieces = [(0, i, float(y := rng.randint(0, 450)), float(y + rng.choice([2, 5, 30, 200]))) for i in range(150)]
    want = {}
    for _, i, a, b in pieces:
        ov = [min(b, q) - max(a, p) for _, _, p, q in bands]
        want[i] = ov.index(max(ov)) if max(ov) > 0 else min(range(8), key=lambda k: (abs((a + b) / 2 - (bands[k][2] + bands[k][3]) / 2), k))
    out = B.component_to_band(spark.createDataFrame(pieces, "page_id int, comp_id int, y0 double, y1 double"),
                              spark.createDataFrame(bands, "page_id int, band int, b0 double, b1 double"), piece=["comp_id"])
    assert {r["comp_id"]: r["band"] for r in out.collect()} == want


def test_map_box(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 4.0)], "x0 double, y0 double, x1 double, y1 double")
    r = df.select(G.map_box(((0.0, -1.0, 0.5), (1.0, 0.0, 0.0))).alias("b")).first()["b"]
    assert tuple(r) == (-4, 0, 0, 10)  # halves go to the even neighbour
    assert df.select(G.horizontal_overlap_fraction("x0", "x1", F.lit(5.0), F.lit(25.0))).first()[0] == 0.5


@pytest.mark.parametrize("rule", B.MERGE_RULES)
def test_dealt_columns_merge_without_storing(spark, rule, monkeypatch):
    def never(df, name):
        raise AssertionError(f"{name} stored")

    rng = random.Random(4)
    rows = [(0, line, float(x := rng.randint(0, 60)), float(y := rng.randint(0, 9)), float(x + rng.choice([9, 10])), float(y + rng.choice([19, 20])))
            for line in range(9) for _ in range(40)]
    want = sorted(tuple(r) for r in B.merge_boxes(spark.createDataFrame(rows, BOX), rule, chunk_px=25.0).collect())
    monkeypatch.setattr(B, "stored", never)
    own = co_partitioned(spark)
    assert sorted(tuple(r) for r in B.merge_boxes(own.createDataFrame(rows, BOX), rule, chunk_px=25.0).collect()) == want
    if rule != "duplicates":
        test_merge_in_sequence(own, rule)


def test_only_large_columns_are_stored(spark, monkeypatch):
    """A long line of small columns is merged in place, beside a line with one large column."""
    rows = [(0, 0, 20.0 * i, float(y), 20.0 * i + 9, y + 10.0) for i in range(40) for y in (0, 11)] + [(0, 1, 0.0, 50.0, 10.0, 60.0)] * 8
    want = [(0, 0, 20.0 * i, 0.0, 20.0 * i + 9, 21.0) for i in range(40)] + [(0, 1, 0.0, 50.0, 10.0, 60.0)]
    kept, stored = {}, B.stored

    def noted(df, name):
        out = stored(df, name)
        kept.setdefault(name, out.count())
        return out

    monkeypatch.setattr(B, "COLUMN_BOXES", 5)
    monkeypatch.setattr(B, "stored", noted)
    out = B.merge_boxes(co_partitioned(spark).createDataFrame(rows, BOX), "stacked", chunk_px=25.0).collect()
    assert sorted(tuple(r) for r in out) == want
    assert "merge-cut" not in kept and kept["merge-large"] == 8


def test_pages_are_dealt_in_small_parts(spark):
    rows = spark.range(60).select("id", F.repeat(F.lit("x"), 500_000).alias("text"))
    assert V.in_parts(rows, "id").rdd.getNumPartitions() >= 57  # half a megabyte each


def test_equal_boxes_share_a_word(spark):
    rows = [(0, 0, 10.0 * i, 0.0, 10.0 * i + 8, 20.0) for i in range(30) for _ in range(2)]
    out = W.words_by_gap(co_partitioned(spark).createDataFrame(rows, BOX).repartition(5), "refined").collect()
    assert sorted((r["x0"], r["word_no"]) for r in out) == sorted((10.0 * i, i) for i in range(30) for _ in range(2))


def test_crop_names_are_made_once_a_class(spark, tmp_path):
    from sulatan.plans.boxes import QUERIES

    spark.createDataFrame([(1, "ABA ka\n\nbij"), (2, "xyz"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["crop_label_prefix"](spark, str(tmp_path))
    # boxes are counted before any pattern is tried
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[-1].split("+- ", 1)[1]
    counts = {r["prefix"]: r["n"] for r in df.collect()}
    want = {}
    for c in map(ord, "ABAkabijxyz"):
        base = ("A", "Ba", "Da", "EI", "Ga", "Ha", "Ka", "La", "Ma", "Na", "Nga", "OU", "Pa", "Sa", "Ta", "Wa", "Ya")[c % 17]
        name = base + ("_Dot_" + ("Below" if c % 2 else "Above"), "", "_Cross")[c % 3]
        want[name] = want.get(name, 0) + 1
    assert counts == want


def _random_lines(seed: int) -> list[tuple]:
    """Distinct boxes of uneven lines, among them lines of one box, of even gaps and without a key."""
    rng = random.Random(seed)
    rows = set()
    for line in range(40):
        x = 0.0
        for _ in range(rng.choice([1, 2, 3, 9, 30])):
            w, y = rng.choice([4.0, 8.0, 9.5]), rng.choice([0.0, 3.0, 8.0])
            rows.add((line % 3, None if line == 7 else line, x, y, x + w, y + rng.choice([6.0, 20.0, 31.0])))
            x += w + (5.0 if line % 5 == 0 else rng.choice([-3.0, 0.5, 2.0, 2.0, 11.0, 30.0]))
    return sorted(rows, key=str)


@pytest.mark.parametrize("strategy", W.STRATEGIES)
def test_words_of_dealt_lines(spark, strategy, monkeypatch):
    """Lines that lie in one task are cut there, without windows and joins, as elsewhere."""
    rows = _random_lines(3)
    want = sorted(map(tuple, W.words_by_gap(spark.createDataFrame(rows, BOX), strategy, chunk_px=40.0).collect()), key=str)
    for most in (1 << 22, 25):
        monkeypatch.setattr(P, "TASK_ROWS", most, raising=False)
        out = W.words_by_gap(co_partitioned(spark).createDataFrame(rows, BOX).repartition(5), strategy, chunk_px=40.0)
        assert sorted(map(tuple, out.collect()), key=str) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_dealt_pieces(spark):
    rows = [(0, k % 4, float(x), float(y), x + w, y + 9.0, w * h) for k, (x, y, w, h) in enumerate((r.randint(0, 90), r.randint(0, 30), float(r.choice([1, 6, 20])), float(r.choice([0.1, 9]))) for r in [random.Random(2)] for _ in range(60))]
    schema = BOX + ", area double"
    out = W.side_by_side_pieces(co_partitioned(spark).createDataFrame(rows, schema), ["page_id", "line_no"], chunk_px=25.0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, W.side_by_side_pieces(spark.createDataFrame(rows, schema), ["page_id", "line_no"], chunk_px=25.0).collect()))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rule", B.MERGE_RULES)
def test_dealt_lines_merge_on_arrays(spark, rule, monkeypatch):
    """Small columns of many lines are merged together, without windows and joins, as one by one."""
    rng = random.Random(5)
    rows = [(line % 3, line, float(x := 30 * rng.randint(0, 8) + rng.randint(0, 9)), float(y := rng.randint(0, 40)), x + rng.choice([3.0, 9.0, 9.5, 20.0]), y + rng.choice([2.0, 5.0, 20.0]))
            for line in range(50) for _ in range(rng.randint(1, 30))]
    want = sorted(map(tuple, B.merge_boxes(spark.createDataFrame(rows, BOX), rule, chunk_px=25.0).collect()))
    for most in (1 << 22, 25):
        monkeypatch.setattr(P, "TASK_ROWS", most, raising=False)
        out = B.merge_boxes(co_partitioned(spark).createDataFrame(rows, BOX).repartition(5), rule)
        assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_dealt_rows_stay_in_their_task(spark):
    """Pieces of words are counted where the words were cut, and a new key deals rows anew."""
    rows = [(k % 9, k % 2, 3.0 * k, 0.0, 3.0 * k + 2, 5.0) for k in range(90)]
    boxes = co_partitioned(spark).createDataFrame(rows, BOX).repartition(6, "page_id")
    words = W.words_by_gap(boxes, "fixed").withColumn("area", F.lit(9.0))
    for df, exchanges in ((words, 1), (words.withColumn("page_id", F.col("page_id") % 2), 2)):
        out = W.side_by_side_pieces(df, ["page_id", "line_no", "word_no"])
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == exchanges
        assert out.count() == df.select("page_id", "line_no", "word_no").distinct().count()


def _plain_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Window" not in plan and "Generate" not in plan and "percentile" not in plan


def _some_marks(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        x, y, small = rng.randint(0, 250), rng.randint(0, 60), rng.random() < 0.4
        w, h = (rng.randint(1, 4), rng.randint(1, 4)) if small else (rng.randint(3, 9), rng.randint(14, 26))
        rows.append((k % 3, k % 7, k if k % 50 else 0, float(x), float(y), float(x + w), float(y + h), float(w * h)))
    return rows


MARK = "page_id int, line_no int, comp_id int, x0 double, y0 double, x1 double, y1 double, area double"


def test_dealt_dots(spark):
    rows = [r for r in _some_marks(1) if r[2]]
    for run in (B.dot_owner, B.join_dots):
        out = run(co_partitioned(spark).createDataFrame(rows, MARK))
        assert _plain_plan(out) and out.columns == run(spark.createDataFrame(rows, MARK)).columns
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, run(spark.createDataFrame(rows, MARK)).collect()))
    assert any(r["owner"] != r["comp_id"] for r in B.dot_owner(co_partitioned(spark).createDataFrame(rows, MARK)).collect())


def test_dealt_slivers(spark):
    rows = _some_marks(2)

    def run(session):
        widths = session.createDataFrame([(p, 255.0 + 3 * p) for p in range(3)], "page_id int, img_w double")
        return B.edge_slivers(session.createDataFrame(rows, MARK), widths, thin=0.9, margin_frac=0.1, apart=0.2)

    got, want = run(co_partitioned(spark)), run(spark)
    assert _plain_plan(got)
    names = want.columns
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.collect()))
    assert {r["dropped"] for r in want.collect()} == {True, False}


def test_dealt_noise(spark):
    rows = [r for r in _some_marks(3) if r[2]] + [(1, 0, 999, 20.0, 9.0, 210.0, 12.0, 500.0), (2, 0, 998, 0.0, 9.0, 90.0, 99.0, 900.0)]

    def run(session):
        pages = session.createDataFrame([(p, 260.0, 100.0, 2.0) for p in range(3)], "page_id int, img_w double, img_h double, stroke double")
        return B.noise_components(session.createDataFrame(rows, MARK), pages)

    got, want = run(co_partitioned(spark)), sorted(map(tuple, run(spark).collect()))
    assert _plain_plan(got)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[-1] for r in want} >= {"keep", "speck", "line"}


def test_dealt_baselines(spark):
    rng = random.Random(4)
    rows = [(k % 3, k % 11, rng.choice("acemnorsuwbdhkltgpyIX?"), float(x := rng.randint(0, 300)), float(y := rng.randint(0, 9)), x + 8.0, y + rng.choice([18.0, 20.0, 31.0])) for k in range(300)]
    rows += [(5, 0, "a", 0.0, 0.0, 8.0, 20.0), (5, 1, "a", 0.0, 0.0, 8.0, 20.0), (5, 1, "c", 0.0, 1.0, 8.0, 22.0), (5, 1, "t", 9.0, 0.0, 12.0, 30.0), (5, 2, "b", 0.0, 0.0, 8.0, 20.0)]
    schema = "page_id int, line_no int, char string, x0 double, y0 double, x1 double, y1 double"
    out = B.fit_baseline(co_partitioned(spark).createDataFrame(rows, schema))
    want = B.fit_baseline(spark.createDataFrame(rows, schema))
    assert _plain_plan(out) and out.columns == want.columns
    got, want = ({tuple(r)[:2]: tuple(r)[2:] for r in df.collect()} for df in (out, want))
    assert got.keys() == want.keys() and len(got) > 30
    assert all(g[4:6] == want[k][4:6] and g[:4] == pytest.approx(want[k][:4]) and g[6] == pytest.approx(want[k][6]) for k, g in got.items())


def test_dealt_keys_need_not_be_asked_for(spark):
    """What follows may leave out any key; Spark then drops it on the way."""
    rows = [(k % 3, k % 7, 3.0 * k, 0.0, 3.0 * k + 2, 5.0) for k in range(60)]
    boxes = co_partitioned(spark).createDataFrame(rows, BOX).repartition(4, "page_id")
    words = W.words_by_gap(boxes, "fixed")
    assert words.count() == 60
    assert {r["page_id"]: r["n"] for r in words.groupBy("page_id").agg(F.count("*").alias("n")).collect()} == {0: 20, 1: 20, 2: 20}
    assert len({r["line_no"] for r in words.select("line_no").distinct().collect()}) == 7
