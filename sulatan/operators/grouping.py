"""Grouping boxes into words, rows, lines and bands.

Boxes of a line are ordered by their left edge; every ordered step goes through
``ordered`` so that one line or page may hold a large share of all boxes.
Thresholds come from the distinct gaps of a line with their counts, which are
combined before the shuffle and stay few however many boxes a line has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from sulatan.operators import packed as P
from sulatan.operators.ordered import CHUNK, chunked, dealt, previous_row, running, segments, skew_join, whole
from sulatan.session import stored

LINE = ["page_id", "line_no"]
CHUNK_PIXELS = 16384.0
STRATEGIES = ("max_jump", "refined", "otsu", "otsu_clipped", "latin", "pen", "fixed")

# Thresholds of the word-gap rules, in letter widths or heights.
DEFAULT_GAP = 10.0
REFINE_MIN_WIDTHS, REFINE_MIN_JUMP, REFINE_OVER_MEDIAN, REFINE_OVER_MAX = 0.45, 0.15, 1.35, 1.3
OTSU_STEPS, OTSU_MIN_RANGE, CLIP_WIDTHS = 50, 5.0, 2.0
LATIN_MIN, LATIN_MAX, EVEN_RATIO, EVEN_MAX = 0.45, 1.0, 1.6, 1.0
PEN_MIN, PEN_MAX, PEN_RATIO, PEN_PERCENT = 0.48, 1.05, 2.2, 0.60
FIXED_WIDTHS = 0.9


def otsu_split(values: DataFrame, keys: list[str], value: str = "gap", count: str = "n") -> DataFrame:
    """Best two-class threshold per key over counted distinct values.

    Of 50 evenly spaced thresholds the first with the largest between-class
    variance wins. Fewer than two values give 10, a range below 5 gives
    ``max + 1``. Values are binned to the first threshold not below them, so a
    key needs at most 51 running sums whatever its number of values.
    """
    v, n = F.col(value), F.col(count)
    stats = values.groupBy(*keys).agg(F.sum(n).alias("_n"), F.sum(v * n).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    # values are counted already, so a key has one row per distinct value at most
    wide = values.join(stats.filter((F.col("_n") >= 2) & (F.col("_hi") - F.col("_lo") >= OTSU_MIN_RANGE)), keys)
    step = (F.col("_hi") - F.col("_lo")) / (OTSU_STEPS - 1)

    def threshold(k: Column) -> Column:
        return F.when(k == OTSU_STEPS - 1, F.col("_hi")).otherwise(F.col("_lo") + k * step)

    # the arithmetic guess can be off by one in floating point; settle it exactly
    guess = F.greatest(F.ceil((v - F.col("_lo")) / step) - 1, F.lit(0)).cast("int")
    binned = (wide.withColumn("_k", guess)
              .withColumn("_k", F.when(threshold(F.col("_k")) >= v, F.col("_k"))
                          .when(threshold(F.col("_k") + 1) >= v, F.col("_k") + 1).otherwise(F.col("_k") + 2))
              .groupBy(*keys, "_k").agg(F.sum(n).alias("_bn"), F.sum(v * n).alias("_bs")))
    # empty bins repeat the variance of the bin before, and the first one wins
    w = W.partitionBy(*keys).orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = binned.select(*keys, "_k", F.sum("_bn").over(w).alias("_cn"), F.sum("_bs").over(w).alias("_cs"))
    scored = cum.join(stats, keys)
    below, above = F.col("_cn"), F.col("_n") - F.col("_cn")
    means = F.col("_cs") / below - (F.col("_s") - F.col("_cs")) / F.when(above > 0, above)
    variance = (below / F.col("_n")) * (above / F.col("_n")) * (means * means)
    best = (scored.filter(above > 0)
            .groupBy(*keys).agg(F.min_by(threshold(F.col("_k")), F.struct((-variance).alias("v"), F.col("_k"))).alias("_t")))
    out = stats.join(best, keys, "left")
    return out.select(*keys, F.when(F.col("_n") < 2, F.lit(DEFAULT_GAP))
                      .when(F.col("_hi") - F.col("_lo") < OTSU_MIN_RANGE, F.col("_hi") + 1.0)
                      .otherwise(F.coalesce("_t", "_lo")).alias("threshold"))


def _largest_jump(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Midpoint, both sides and size of the first largest jump between sorted gaps."""
    w = W.partitionBy(*keys).orderBy("gap")
    rows = gaps.withColumn("_next", F.lead("gap").over(w)).withColumn("_jump", F.coalesce(F.col("_next") - F.col("gap"), F.lit(0.0)))
    side = F.struct(F.col("gap").alias("low"), F.coalesce("_next", "gap").alias("high"), F.col("_jump").alias("jump"))
    # a gap that occurs twice is followed by a zero jump, so only a lone single gap has none
    return rows.groupBy(*keys).agg(
        F.min_by(side, F.struct((-F.col("_jump")).alias("j"), F.col("gap"))).alias("_best"), F.sum("n").alias("_total"),
        F.min("gap").alias("_min"))


def _max_jump(gaps: DataFrame, keys: list[str]) -> DataFrame:
    best = _largest_jump(gaps, keys)
    middle = (F.col("_best.low") + F.col("_best.high")) / 2.0
    return best.select(*keys, F.when(F.col("_total") > 1, middle)
                       .otherwise(F.greatest(F.lit(DEFAULT_GAP), F.col("_min") * 2.0)).alias("threshold"))


def _refined(gaps: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    first = _max_jump(gaps, keys)
    marked = gaps.join(first, keys)
    totals = marked.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("gap") > F.col("threshold"), F.col("n")).otherwise(0)).alias("_over"))
    low = marked.filter(F.col("gap") <= F.col("threshold")).drop("threshold")
    best = _largest_jump(low, keys).withColumnRenamed("_total", "_low_n")
    under = (low.join(best.select(*keys, "_best"), keys).filter(F.col("gap") <= F.col("_best.low"))
             .groupBy(*keys).agg(F.percentile("gap", 0.5, F.col("n")).alias("_median"), F.max("gap").alias("_max")))
    df = first.join(totals, keys).join(best.drop("_min"), keys, "left").join(under, keys, "left").join(sizes, keys)
    candidate = (F.col("_best.low") + F.col("_best.high")) / 2.0
    width, high = F.col("median_w"), F.col("_best.high")
    accept = ((F.col("_n") >= 3) & (F.col("_over") <= 1) & (F.col("_low_n") >= 2) & (width > 0)
              & (F.col("_best.jump") >= REFINE_MIN_JUMP * width) & (candidate >= REFINE_MIN_WIDTHS * width)
              & (high >= REFINE_OVER_MEDIAN * F.col("_median")) & (high >= REFINE_OVER_MAX * F.col("_max")))
    return df.select(*keys, F.when(accept, candidate).otherwise(F.col("threshold")).alias("threshold"))


def _latin(gaps: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    stats = gaps.groupBy(*keys).agg(F.sum("n").alias("_n"), F.min("gap").alias("_lo"), F.max("gap").alias("_hi"))
    df = otsu_split(gaps, keys).join(stats, keys).join(sizes, keys)
    h = F.col("median_h")
    even = ((F.col("_n") >= 2) & (F.col("_lo") > LATIN_MIN * h) & (F.col("_hi") <= EVEN_RATIO * F.col("_lo"))
            & (F.col("_hi") <= EVEN_MAX * h))
    cut = F.least(F.greatest(F.col("threshold"), LATIN_MIN * h), LATIN_MAX * h)
    return df.select(*keys, F.when(even, F.lit(float("inf"))).otherwise(cut).alias("threshold"))


def _pen(gaps: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    short = _latin(gaps, sizes, keys).withColumnRenamed("threshold", "_short")
    flat = gaps.withColumn("gap", F.greatest("gap", F.lit(0.0))).groupBy(*keys, "gap").agg(F.sum("n").alias("n"))
    cut = flat.groupBy(*keys).agg(F.percentile("gap", PEN_PERCENT, F.col("n")).alias("_p"))
    usual = (flat.join(cut, keys).filter(F.col("gap") <= F.col("_p"))
             .groupBy(*keys).agg(F.percentile("gap", 0.5, F.col("n")).alias("_usual")))
    h = F.greatest(F.col("median_h"), F.lit(1.0))
    wide = F.least(F.greatest(PEN_MIN * h, F.col("_usual") * PEN_RATIO), PEN_MAX * h)
    df = short.join(usual, keys).join(sizes, keys)
    return df.select(*keys, F.when(F.col("n_boxes") <= 2, F.col("_short")).otherwise(wide).alias("threshold"))


def word_gap_thresholds(gaps: DataFrame, sizes: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """Threshold per line from counted gaps ``(keys, gap, n)`` and line sizes."""
    if strategy == "max_jump":
        return _max_jump(gaps, keys)
    if strategy == "refined":
        return _refined(gaps, sizes, keys)
    if strategy == "otsu":
        return otsu_split(gaps, keys)
    if strategy == "otsu_clipped":
        clipped = (gaps.join(sizes, keys)
                   .withColumn("gap", F.when(F.col("median_w") > 0, F.least("gap", CLIP_WIDTHS * F.col("median_w"))).otherwise(F.col("gap")))
                   .groupBy(*keys, "gap").agg(F.sum("n").alias("n")))
        return otsu_split(clipped, keys)
    if strategy == "latin":
        return _latin(gaps, sizes, keys)
    if strategy == "pen":
        return _pen(gaps, sizes, keys)
    if strategy == "fixed":
        return sizes.select(*keys, F.greatest(F.lit(DEFAULT_GAP), FIXED_WIDTHS * F.col("median_w")).alias("threshold"))
    raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")


def line_sizes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Median width and height per key, from distinct sizes with their counts."""
    sizes = boxes.groupBy(*keys, (F.col("x1") - F.col("x0")).alias("_w"), (F.col("y1") - F.col("y0")).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(*keys).agg(F.percentile("_w", 0.5, F.col("_n")).alias("median_w"),
                                    F.percentile("_h", 0.5, F.col("_n")).alias("median_h"), F.sum("_n").alias("n_boxes"))


def _gaps_inside(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Chunked boxes with the gap to the box before them in the same chunk."""
    return df.withColumn("gap", F.col("x0") - F.lag("x1").over(W.partitionBy(*keys, CHUNK).orderBy(*order)))


def _gaps_between(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per chunk with the gap across its left edge (null for the first chunk)."""
    place = F.struct(*[F.col(c) for c in order])
    ends = df.groupBy(*keys, CHUNK).agg(F.min_by("x0", place).alias("_first"), F.max_by("x1", place).alias("_last"))
    before = F.lag("_last").over(W.partitionBy(*keys).orderBy(CHUNK))
    return ends.select(*keys, CHUNK, (F.col("_first") - before).alias("edge"))


def gap_counts(boxes: DataFrame, keys: list[str], order: list[str], chunk_px: float = CHUNK_PIXELS) -> DataFrame:
    """Counted distinct gaps per key and chunk between neighbouring boxes."""
    df = chunked(boxes, "x0", chunk_px)
    if dealt(df):
        return (df.withColumn("gap", F.col("x0") - F.lag("x1").over(whole(keys, order))).filter(F.col("gap").isNotNull())
                .groupBy(*keys, CHUNK, "gap").agg(F.count(F.lit(1)).alias("n")))
    inner = (_gaps_inside(df, keys, order).filter(F.col("gap").isNotNull())
             .groupBy(*keys, CHUNK, "gap").agg(F.count(F.lit(1)).alias("n")))
    edges = _gaps_between(df, keys, order).filter(F.col("edge").isNotNull())
    return inner.unionByName(edges.select(*keys, CHUNK, F.col("edge").alias("gap"), F.lit(1).cast("long").alias("n")))


# --- the same thresholds over arrays, for lines that lie in one task ---------------


def _counted(gap: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct gaps of sorted ones, their lines and counts."""
    new = np.ones(len(gap), bool)
    new[1:] = (gap[1:] != gap[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(new)
    return gap[at], line[at], np.diff(np.append(at, len(gap)))


def _jumps(gap: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`_largest_jump` of sorted distinct gaps: low, high and jump per line, and the least gap; NaN without gaps."""
    out = np.full((4, n), np.nan)
    if len(gap):
        start, number = P.starts_of(line)
        high = np.append(gap[1:], np.nan)
        high[np.append(start[1:], len(gap)) - 1] = np.nan
        jump = np.where(np.isnan(high), 0.0, high - gap)
        best = np.flatnonzero(jump == np.maximum.reduceat(jump, start)[number])
        best = best[P.starts_of(number[best])[0]]
        high = np.where(np.isnan(high), gap, high)
        out[:, line[start]] = gap[best], high[best], jump[best], gap[start]
    return tuple(out)


def _max_jump_cuts(gap, line, n):
    low, high, _, least = _jumps(*_counted(gap, line)[:2], n)
    return np.where(np.bincount(line, minlength=n) > 1, (low + high) / 2.0, np.where(np.isnan(least), np.nan, np.maximum(DEFAULT_GAP, least * 2.0)))


def _otsu_cuts(gap, line, n):
    v, at, c = _counted(gap, line)
    count, total = np.bincount(at, c, n), np.bincount(at, v * c, n)
    lo, hi = np.full(n, np.nan), np.full(n, np.nan)
    lo[at[::-1]], hi[at] = v[::-1], v
    wide = (count >= 2) & (hi - lo >= OTSU_MIN_RANGE)
    best = np.where(count < 2, DEFAULT_GAP, hi + 1.0)
    rows = wide[at]
    if rows.any():
        number = np.cumsum(wide) - 1
        v, c, k = v[rows], c[rows], number[at[rows]]
        low, high, all_, sum_ = lo[wide], hi[wide], count[wide], total[wide]
        step = (high - low) / (OTSU_STEPS - 1)
        steps = np.where(np.arange(OTSU_STEPS) == OTSU_STEPS - 1, high[:, None], low[:, None] + np.arange(OTSU_STEPS) * step[:, None])
        # the arithmetic guess can be off by one in floating point; settle it exactly
        guess = np.minimum(np.maximum(np.ceil((v - low[k]) / step[k]) - 1, 0).astype(np.int64), OTSU_STEPS - 1)
        after = steps[k, np.minimum(guess + 1, OTSU_STEPS - 1)]
        bin_ = k * OTSU_STEPS + np.minimum(np.where(steps[k, guess] >= v, guess, np.where(after >= v, guess + 1, guess + 2)), OTSU_STEPS - 1)
        shape = (len(low), OTSU_STEPS)
        below = np.cumsum(np.bincount(bin_, c, shape[0] * shape[1]).reshape(shape), axis=1)
        part = np.cumsum(np.bincount(bin_, v * c, shape[0] * shape[1]).reshape(shape), axis=1)
        above = all_[:, None] - below
        with np.errstate(divide="ignore", invalid="ignore"):
            means = part / below - (sum_[:, None] - part) / above
            variance = (below / all_[:, None]) * (above / all_[:, None]) * (means * means)
        variance[above <= 0] = -np.inf
        pick = np.argmax(variance, axis=1)
        best[wide] = np.where(np.isneginf(variance.max(axis=1)), low, steps[np.arange(len(low)), pick])
    best[count == 0] = np.nan
    return best


def _refined_cuts(gap, line, n, sizes):
    first = _max_jump_cuts(gap, line, n)
    low = gap <= first[line]
    over = np.bincount(line[~low], minlength=n)
    g, at = gap[low], line[low]
    low_n = np.bincount(at, minlength=n)
    left, high, jump, _ = _jumps(*_counted(g, at)[:2], n)
    under = g <= left[at]
    middle = P.percentile(g[under], at[under], n, 0.5)
    most = np.full(n, np.nan)
    most[at[under]] = g[under]
    width, candidate = sizes["median_w"], (left + high) / 2.0
    accept = ((np.bincount(line, minlength=n) >= 3) & (over <= 1) & (low_n >= 2) & (width > 0) & (jump >= REFINE_MIN_JUMP * width)
              & (candidate >= REFINE_MIN_WIDTHS * width) & (high >= REFINE_OVER_MEDIAN * middle) & (high >= REFINE_OVER_MAX * most))
    return np.where(accept, candidate, first)


def _latin_cuts(gap, line, n, sizes):
    lo, hi = np.full(n, np.nan), np.full(n, np.nan)
    lo[line[::-1]], hi[line] = gap[::-1], gap
    h, cut = sizes["median_h"], _otsu_cuts(gap, line, n)
    even = (np.bincount(line, minlength=n) >= 2) & (lo > LATIN_MIN * h) & (hi <= EVEN_RATIO * lo) & (hi <= EVEN_MAX * h)
    return np.where(even, np.inf, np.where(np.isnan(cut), np.nan, np.fmin(np.fmax(cut, LATIN_MIN * h), LATIN_MAX * h)))


def _pen_cuts(gap, line, n, sizes):
    flat = np.maximum(gap, 0.0)
    some = flat <= P.percentile(flat, line, n, PEN_PERCENT)[line]
    usual, h = P.percentile(flat[some], line[some], n, 0.5), np.fmax(sizes["median_h"], 1.0)
    wide = np.where(np.isnan(usual), np.nan, np.fmin(np.fmax(PEN_MIN * h, usual * PEN_RATIO), PEN_MAX * h))
    return np.where(sizes["n_boxes"] <= 2, _latin_cuts(gap, line, n, sizes), wide)


def _line_cuts(gap: np.ndarray, line: np.ndarray, n: int, sizes: dict[str, np.ndarray], strategy: str) -> np.ndarray:
    """`word_gap_thresholds` of sorted gaps; NaN for lines without one."""
    if strategy == "max_jump":
        return _max_jump_cuts(gap, line, n)
    if strategy == "refined":
        return _refined_cuts(gap, line, n, sizes)
    if strategy == "otsu":
        return _otsu_cuts(gap, line, n)
    if strategy == "otsu_clipped":
        width = sizes["median_w"][line]
        return _otsu_cuts(np.where(width > 0, np.minimum(gap, CLIP_WIDTHS * width), gap), line, n)
    if strategy == "latin":
        return _latin_cuts(gap, line, n, sizes)
    if strategy == "pen":
        return _pen_cuts(gap, line, n, sizes)
    return np.fmax(DEFAULT_GAP, FIXED_WIDTHS * sizes["median_w"])


def _words_in_task(keys: list[str], order: list[str], strategy: str):
    def run(t: pa.Table) -> pa.Table:
        g = P.Groups(t, keys, order, "x0")
        x0, x1 = g["x0"], g["x1"]
        gap = np.append(np.nan, x0[1:] - x1[:-1])[: len(x0)]
        gap[g.start] = np.nan
        sizes = {"median_w": P.median(x1 - x0, g.group, g.n), "median_h": P.median(g["y1"] - g["y0"], g.group, g.n), "n_boxes": g.size}
        cut = _line_cuts(*P.by_group(gap, g.group), g.n, sizes, strategy)
        opens = gap > cut[g.group]
        rows, equal = g.table, np.zeros(len(x0), bool)
        equal[1:] = g.group[1:] == g.group[:-1]
        for c in order:
            v = g[c]
            equal[1:] &= (v[1:] == v[:-1]) | np.isnan(v[1:]) & np.isnan(v[:-1])
        if equal.any():
            # of equal boxes the one that may open a word comes first
            place = np.lexsort((~opens, np.cumsum(~equal)))
            opens, rows = opens[place], rows.take(pa.array(place))
        words = np.cumsum(opens)
        words -= (words - opens)[g.start][g.group] if len(words) else 0
        threshold = pa.array(cut[g.group], from_pandas=True)
        return rows.append_column("threshold", threshold).append_column("word_no", pa.array(words.astype(np.int64)))

    return run


def words_by_gap(boxes: DataFrame, strategy: str = "max_jump", keys: list[str] | None = None,
                 tie: list[str] | None = None, chunk_px: float = CHUNK_PIXELS) -> DataFrame:
    """Add ``threshold`` and ``word_no`` (from 0) to the boxes of every line.

    Boxes are shuffled by line and chunk and stay there: thresholds and the
    number of words before each chunk come from the counted gaps and are joined
    per chunk. Where lines lie in one task, all of it is done there on arrays.
    """
    keys, order = keys or LINE, ["x0", *(tie or ["x1", "y0", "y1"])]
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    if dealt(boxes):
        schema = StructType([*boxes.schema.fields, StructField("threshold", DoubleType()), StructField("word_no", LongType())])
        return P.in_task(boxes, keys, _words_in_task(keys, order, strategy), schema)
    df = chunked(boxes, "x0", chunk_px)
    inside = _gaps_inside(df, keys, order)
    counted = inside.filter(F.col("gap").isNotNull()).groupBy(*keys, CHUNK, "gap").agg(F.count(F.lit(1)).alias("n"))
    edges = _gaps_between(df, keys, order)
    crossing = edges.filter(F.col("edge").isNotNull()).select(*keys, F.col("edge").alias("gap"), F.lit(1).cast("long").alias("n"))
    gaps = counted.drop(CHUNK).unionByName(crossing).groupBy(*keys, "gap").agg(F.sum("n").alias("n"))
    cuts = word_gap_thresholds(gaps, line_sizes(boxes, keys), keys, strategy)
    # a line with one box has no gaps and therefore no row in most strategies
    chunks = edges.join(cuts, keys, "left")
    breaks = (counted.join(chunks.select(*keys, CHUNK, "threshold"), [*keys, CHUNK])
              .groupBy(*keys, CHUNK).agg(F.sum(F.when(F.col("gap") > F.col("threshold"), F.col("n")).otherwise(0)).alias("_n")))
    opens = F.when(F.col("edge") > F.col("threshold"), 1).otherwise(0)
    past = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    placed = chunks.join(breaks, [*keys, CHUNK], "left").withColumn("_open", opens)
    base = F.coalesce(F.sum(F.coalesce("_n", F.lit(0)) + F.col("_open")).over(past), F.lit(0)) + F.col("_open")
    placed = placed.select(*keys, CHUNK, "threshold", base.alias("_base"))
    run = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    word = F.sum(F.when(F.col("gap") > F.col("threshold"), 1).otherwise(0)).over(run) + F.col("_base")
    return inside.join(placed, [*keys, CHUNK]).withColumn("word_no", word.cast("long")).drop(CHUNK, "gap", "_base")


def row_clusters(boxes: DataFrame, keys: list[str] | None = None, chunk_px: float = CHUNK_PIXELS) -> DataFrame:
    """Number text rows: a box joins while its centre is near that of the box before it.

    Adds ``row_no`` and ``row_pos`` (left-to-right place in the row), both from 0.
    """
    keys = keys or ["page_id"]
    order = ["y0", "x0", "y1", "x1"]
    mid = {"_mid": (F.col("y0") + F.col("y1")) / 2, "_high": F.col("y1") - F.col("y0")}
    df = chunked(boxes.withColumns(mid), "y0", chunk_px)
    rows = segments(df, keys, order, ["_mid", "_high"],
                    lambda p, c: F.abs(c.getField("_mid") - p.getField("_mid")) >= p.getField("_high") * 0.5, "row_no")
    placed = running(chunked(rows.drop(CHUNK), "x0", chunk_px), [*keys, "row_no"], ["x0", "y0", "y1", "x1"], index="row_pos")
    return placed.drop("_mid", "_high", CHUNK)


def reading_order_lines(boxes: DataFrame, keys: list[str] | None = None, tolerance: float = 0.7,
                        chunk_px: float = CHUNK_PIXELS) -> DataFrame:
    """Assign boxes to text lines by a running mean of their centres.

    The mean makes each step depend on all before it, but not across a jump
    larger than ``tolerance`` times the tallest box of the page: no line can
    survive that. Pages are cut there, equal ``(centre, height)`` pairs are
    counted once, and only those few pairs of one stretch are folded.
    Adds ``text_line`` (from 0) and ``line_pos``.
    """
    keys = keys or ["page_id"]
    df = boxes.withColumns({"_cy": (F.col("y0") + F.col("y1")) / 2, "_h": F.col("y1") - F.col("y0")})
    pairs = df.groupBy(*keys, "_cy", "_h").agg(F.count(F.lit(1)).alias("_n"))
    tallest = pairs.groupBy(*keys).agg(F.max("_h").alias("_tall"))
    pairs = chunked(pairs.join(tallest, keys), "_cy", chunk_px)
    cut = segments(pairs, keys, ["_cy", "_h"], ["_cy", "_tall"],
                   lambda p, c: c.getField("_cy") - p.getField("_cy") > tolerance * c.getField("_tall"), "_part").drop(CHUNK)

    first = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"), F.lit(0.0).alias("tall"))
    out_t = "array<struct<cy:double,h:double,line:int>>"
    start = F.struct(first.alias("cur"), F.array().cast(out_t).alias("out"))

    def step(acc: Column, b: Column) -> Column:
        cur = acc["cur"]
        mean = cur["sum"] / F.greatest(cur["n"], F.lit(1.0))
        new = (cur["n"] == 0) | (F.abs(b["_cy"] - mean) > F.greatest(cur["tall"], b["_h"]) * tolerance)
        n = b["_n"].cast("double")
        nxt = F.struct(
            F.when(new, cur["line"] + 1).otherwise(cur["line"]).alias("line"),
            F.when(new, b["_cy"] * n).otherwise(cur["sum"] + b["_cy"] * n).alias("sum"),
            F.when(new, n).otherwise(cur["n"] + n).alias("n"),
            F.when(new, b["_h"]).otherwise(F.greatest(cur["tall"], b["_h"])).alias("tall"))
        item = F.struct(b["_cy"].alias("cy"), b["_h"].alias("h"), nxt["line"].alias("line"))
        return F.struct(nxt.alias("cur"), F.concat(acc["out"], F.array(item)).alias("out"))

    stretches = cut.groupBy(*keys, "_part").agg(F.sort_array(F.collect_list(F.struct("_cy", "_h", "_n"))).alias("_b"))
    folded = stretches.withColumn("_b", F.aggregate("_b", start, step)["out"]).withColumn("_lines", F.array_max("_b.line") + 1)
    offset = F.coalesce(F.sum("_lines").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = (folded.withColumn("_off", offset).select(*keys, "_off", F.explode("_b").alias("_x"))
             .select(*keys, F.col("_x.cy").alias("_cy"), F.col("_x.h").alias("_h"),
                     (F.col("_off") + F.col("_x.line")).cast("long").alias("text_line")))
    joined = chunked(df.join(lines, [*keys, "_cy", "_h"]).withColumn("_cx", (F.col("x0") + F.col("x1")) / 2), "_cx", chunk_px)
    out = running(joined, [*keys, "text_line"], ["_cx", "x0", "y0", "y1"], index="line_pos")
    return out.drop("_cy", "_h", "_cx", CHUNK)


def _pieces_in_task(keys: list[str], min_pieces: int, min_aspect: float):
    def run(t: pa.Table) -> pa.Table:
        g = P.Groups(t, keys, ["x0", "x1", "y0", "y1"])
        x0, x1, y0, y1, area = (g[c] for c in ("x0", "x1", "y0", "y1", "area"))
        if not g.n:
            return g.key_table(np.arange(0)).append_column("side_by_side", pa.array([], pa.int64())).append_column("is_word", pa.array([], pa.bool_()))
        width, height = (np.fmax.reduceat(b, g.start) - np.fmin.reduceat(a, g.start) for a, b in ((x0, x1), (y0, y1)))
        real = (area >= np.fmax(3.0, 0.01 * g.total(np.nan_to_num(area))[g.group])) & ~np.isnan(x0)
        x0, x1, group = x0[real], x1[real], g.group[real]
        start, _ = P.starts_of(group)
        apart = np.bincount(group, x0 > P.reach_before(x1, start, group), g.n).astype(np.int64)
        is_word = (height > 0) & (width >= min_aspect * height) & (apart >= min_pieces)
        return g.key_table(np.arange(g.n)).append_column("side_by_side", pa.array(apart)).append_column("is_word", pa.array(is_word))

    return run


def side_by_side_pieces(pieces: DataFrame, keys: list[str], min_pieces: int = 3, min_aspect: float = 1.6,
                        chunk_px: float = CHUNK_PIXELS) -> DataFrame:
    """Per group: pieces that start right of everything before them; a wide row of them is a word.

    Pieces below ``max(3, 1 %)`` of the group's ink do not count.
    """
    if dealt(pieces):
        schema = StructType([*pieces.select(*keys).schema.fields, StructField("side_by_side", LongType()), StructField("is_word", BooleanType())])
        return P.in_task(pieces.select(*keys, "x0", "x1", "y0", "y1", "area"), keys, _pieces_in_task(keys, min_pieces, min_aspect), schema)
    whole = pieces.groupBy(*keys).agg(F.sum("area").alias("_ink"), F.count(F.lit(1)).alias("n"), (F.max("x1") - F.min("x0")).alias("_w"),
                                      (F.max("y1") - F.min("y0")).alias("_h"))
    real = (skew_join(pieces, whole.drop("n"), keys, ["x0", "y0"], counts=whole)
            .filter(F.col("area") >= F.greatest(F.lit(3.0), 0.01 * F.col("_ink"))))
    swept = running(chunked(real, "x0", chunk_px), keys, ["x0", "x1", "y0", "y1"], peaks_before={"_right": "x1"})
    starts = F.sum(F.when(F.col("_right").isNull() | (F.col("x0") > F.col("_right")), 1).otherwise(0))
    counted = swept.groupBy(*keys).agg(starts.cast("long").alias("side_by_side"))
    out = whole.join(counted, keys, "left").fillna(0, ["side_by_side"])
    wide = (F.col("_h") > 0) & (F.col("_w") >= min_aspect * F.col("_h"))
    return out.select(*keys, "side_by_side", (wide & (F.col("side_by_side") >= min_pieces)).alias("is_word"))


def words_to_lines(words: DataFrame, counts: DataFrame, keys: list[str], word_index: str = "word_idx",
                   line: str = "line_no", n: str = "n_words", chunk_lines: float = 4096) -> DataFrame:
    """Give each word of a flat list its line, using words-per-line counts in order.

    Lines without words take no place; words beyond all counts form one more line.
    """
    filled = counts.filter(F.col(n) > 0).select(*keys, line, n)
    ends = running(chunked(filled, line, chunk_lines), keys, [line], sums={"_end": n}, index="_line").drop(CHUNK)
    spans = ends.select(*keys, F.col("_line").alias("text_line"), F.explode(F.sequence(
        (F.col("_end") - F.col(n)).cast("long"), (F.col("_end") - 1).cast("long"))).alias(word_index))
    total = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_lines"))
    placed = words.join(spans, [*keys, word_index], "left")
    placed = skew_join(placed, total, keys, [word_index], "left")
    return placed.withColumn("text_line", F.coalesce("text_line", "_n_lines", F.lit(0)).cast("long")).drop("_n_lines")


# --- text bands of a page -----------------------------------------------------

# Shares used to find text bands in a row profile.
BAND_SMOOTH, BAND_RUN, BAND_MERGE, BAND_MIN_GAP, BAND_EXPAND, BAND_FULL = 0.02, 0.3, 0.6, 5.0, 0.5, 0.6


#: rows of a page that one task sorts, and rows of a grid cell for looking up a row
BAND_CHUNK, BAND_CELL = 4096.0, 4096


def _islands(df: DataFrame, keys: list[str], fields: list[str], starts, chunk: float) -> DataFrame:
    """Numbered runs of rows ``r`` (``_run``), a new one where ``starts(previous, current)`` holds."""
    return segments(chunked(df, "r", chunk), keys, ["r"], fields, starts, "_run").drop(CHUNK)


def _core_runs(p: DataFrame, height: DataFrame, keys: list[str], chunk: float) -> DataFrame:
    """``(keys, H, start, end)``: stretches whose moving average exceeds a share of the page's greatest.

    The average changes only where a covered row enters or leaves its window,
    so it is summed over those changes, and each value holds until the next.
    """
    half = F.floor(F.col("size") / 2).cast("long")
    moves = F.array(F.struct(F.greatest(F.col("r") - half, F.lit(0).cast("long")).alias("r"), F.col("v").alias("d")),
                    F.struct((F.col("r") + half + 1).alias("r"), (-F.col("v")).alias("d")))
    events = p.join(height, keys).select(*keys, "H", "size", F.explode(moves).alias("e")).select(*keys, "H", "size", "e.*")
    deltas = events.groupBy(*keys, "H", "size", "r").agg(F.sum("d").alias("d")).filter("d <> 0")
    summed = running(chunked(deltas, "r", chunk), keys, ["r"], sums={"s": "d"}).drop(CHUNK).withColumn("s", F.col("s") / F.col("size"))
    summed = stored(summed, "profile")
    most = summed.groupBy(*keys).agg(F.max("s").alias("_most"))
    flagged = summed.join(most, keys).select(*keys, "H", "r", (F.col("s") > F.col("_most") * BAND_RUN).alias("core"))
    runs = _islands(flagged, keys, ["core"], lambda a, b: a.getField("core") != b.getField("core"), chunk)
    runs = runs.groupBy(*keys, "H", "core", "_run").agg(F.min("r").alias("start"))
    # the last change is the last row leaving, so every core run has one after it
    ends = runs.select(*keys, (F.col("_run") - 1).alias("_run"), F.col("start").alias("end"))
    out = runs.filter("core").join(ends, [*keys, "_run"])
    return out.select(*keys, "H", "start", F.least("end", "H").alias("end"))


def _merged_runs(runs: DataFrame, keys: list[str], keep_full_lines: bool, chunk: float) -> DataFrame:
    """Runs joined over thin gaps: ``(keys, H, median, band, start, end)``.

    A stretch of runs with thin gaps is one band, unless full lines are kept
    apart. Then a run of a line's height starts a band of its own if what the
    band holds already has that height: always after another such run, and
    before the first one if the smaller runs from the stretch's start reach it.
    """
    page = runs.groupBy(*keys).agg(F.percentile(F.col("end") - F.col("start"), 0.5).alias("median"))
    sized = runs.join(page, keys).withColumns({"r": F.col("start"), "_gap": F.greatest(F.lit(BAND_MIN_GAP), F.col("median") * BAND_MERGE),
                                               "_full": (F.col("end") - F.col("start")) >= BAND_FULL * F.col("median")})
    cut = _islands(sized, keys, ["start", "end", "_gap"], lambda a, b: b.getField("start") - a.getField("end") > b.getField("_gap"), chunk)
    if not keep_full_lines:
        bands = cut.withColumnRenamed("_run", "band")
    else:
        whole = cut.groupBy(*keys, "_run").agg(F.min("start").alias("_s0"), F.min(F.when(F.col("_full"), F.col("start"))).alias("_f0"))
        placed = previous_row(chunked(cut.join(whole, [*keys, "_run"]), "r", chunk), keys, ["r"], ["end"])
        held = F.col("prev").getField("end") - F.col("_s0")
        fresh = (F.col("start") == F.col("_s0")) | (F.col("_full") & ((F.col("start") > F.col("_f0")) | (held >= BAND_FULL * F.col("median"))))
        numbered = running(placed.withColumn("_fresh", fresh.cast("int")), keys, ["r"], sums={"band": "_fresh"})
        bands = numbered.withColumn("band", F.col("band") - 1)
    return bands.groupBy(*keys, "H", "median", F.col("band").cast("long").alias("band")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def detect_bands(profile: DataFrame, keys: list[str], row: str = "row", value: str = "value",
                 height: DataFrame | None = None, keep_full_lines: bool = False, chunk: float = BAND_CHUNK) -> DataFrame:
    """Text bands ``(keys, band, y0, y1)`` of a row profile.

    ``height`` gives page heights; without it a page ends at its last covered
    row. With ``keep_full_lines`` two runs that are both full lines are never
    merged. Rows are swept in chunks that hand their last state on, so a task
    never sorts more than ``chunk`` rows of a page, however long it is.
    """
    p = stored(profile.filter(F.col(value) > 0).groupBy(*keys, F.col(row).cast("long").alias("r")).agg(F.sum(value).cast("double").alias("v")), "rows")
    if height is None:
        height = p.groupBy(*keys).agg((F.max("r") + 1).alias("height"))
    height = height.select(*keys, F.col("height").cast("long").alias("H"))
    height = height.withColumn("size", F.greatest(F.lit(3), F.bround(F.col("H") * BAND_SMOOTH).cast("int").bitwiseOR(F.lit(1))).cast("long"))
    bands = stored(_merged_runs(_core_runs(p, height, keys, chunk), keys, keep_full_lines, chunk), "bands")

    before = bands.select(*keys, (F.col("band") + 1).alias("band"), F.col("end").alias("_end"))
    after = bands.select(*keys, (F.col("band") - 1).alias("band"), F.col("start").alias("_start"))
    expand = F.greatest(F.lit(BAND_MIN_GAP), F.bround(F.col("median") * BAND_EXPAND)).cast("long")
    bands = bands.join(before, [*keys, "band"], "left").join(after, [*keys, "band"], "left").withColumns({
        "lim0": F.coalesce(F.floor((F.col("_end") + F.col("start")) / 2), F.lit(0)).cast("long"),
        "lim1": F.coalesce(F.floor((F.col("end") + F.col("_start")) / 2), F.col("H")).cast("long")})
    bands = bands.withColumns({"c0": F.greatest("lim0", F.col("start") - expand), "c1": F.least("lim1", F.col("end") + expand)})
    # inked rows as stretches; an edge inside one moves to its blank neighbour
    inked = _islands(p, keys, ["r"], lambda a, b: b.getField("r") - a.getField("r") > 1, chunk).groupBy(*keys, "_run").agg(F.min("r").alias("i0"), (F.max("r") + 1).alias("i1"))
    cells = inked.select(*keys, "i0", "i1", F.explode(F.sequence(F.floor(F.col("i0") / BAND_CELL), F.floor((F.col("i1") - 1) / BAND_CELL))).alias("_cell"))
    edges = bands.select(*keys, "band", F.explode(F.array(F.col("c0"), F.col("c1"))).alias("c")).withColumn("_cell", F.floor(F.col("c") / BAND_CELL))
    hit = edges.join(cells, [*keys, "_cell"]).filter("i0 <= c and c < i1").select(*keys, "band", "c", "i0", "i1").distinct()
    up, down = hit.select(*keys, "band", F.col("c").alias("c0"), (F.col("i0") - 1).alias("_up")), hit.select(*keys, "band", F.col("c").alias("c1"), F.col("i1").alias("_down"))
    out = bands.join(up, [*keys, "band", "c0"], "left").join(down, [*keys, "band", "c1"], "left")
    blank0, blank1 = F.coalesce("_up", "c0"), F.coalesce("_down", "c1")
    return out.select(*keys, "band", F.when(blank0 > F.col("lim0"), blank0).otherwise(F.col("lim0")).alias("y0"),
                      F.when(blank1 < F.col("lim1"), blank1).otherwise(F.col("lim1")).alias("y1"))
