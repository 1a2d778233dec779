"""Box arithmetic. A box is four columns ``x0, y0, x1, y1`` in page pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def box_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])


def width(x0="x0", x1="x1") -> Column:
    return _c(x1) - _c(x0)


def height(y0="y0", y1="y1") -> Column:
    return _c(y1) - _c(y0)


def center(lo, hi) -> Column:
    return (_c(lo) + _c(hi)) / 2


def overlap(a0, a1, b0, b1) -> Column:
    """Signed overlap of two intervals (negative: the distance between them)."""
    return F.least(_c(a1), _c(b1)) - F.greatest(_c(a0), _c(b0))


def horizontal_overlap_fraction(ax0, ax1, bx0, bx1) -> Column:
    """Shared width over the narrower width; 0 for boxes without width."""
    narrow = F.least(_c(ax1) - _c(ax0), _c(bx1) - _c(bx0))
    shared = F.greatest(overlap(ax0, ax1, bx0, bx1), F.lit(0.0))
    return F.when(narrow <= 0, F.lit(0.0)).otherwise(shared / F.when(narrow > 0, narrow))


def vertical_gap(ay0, ay1, by0, by1) -> Column:
    """Distance between two boxes stacked above each other, 0 if they touch."""
    return F.greatest(-overlap(ay0, ay1, by0, by1), F.lit(0.0))


def map_box(matrix: Sequence[Sequence[float]] | Sequence[Sequence[Column]], x0="x0", y0="y0", x1="x1", y1="y1",
            scale_x=1.0, scale_y=1.0) -> Column:
    """Bounding box of the four corners under a 2x3 matrix, scaled and rounded.

    Matrix entries may be numbers or columns, so each page can bring its own.
    """
    m = [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in matrix]
    corners = [(_c(x), _c(y)) for x in (x0, x1) for y in (y0, y1)]
    xs = [(m[0][0] * x + m[0][1] * y + m[0][2]) * scale_x for x, y in corners]
    ys = [(m[1][0] * x + m[1][1] * y + m[1][2]) * scale_y for x, y in corners]
    parts = {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
    return F.struct(*[F.bround(v).cast("long").alias(k) for k, v in parts.items()])
