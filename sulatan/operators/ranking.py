"""Top-k per key and greedy picks with a minimum distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sulatan.operators.ordered import dealt
from sulatan.session import stored


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key by ``order``; Spark limits each task to ``k`` before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.filter(F.col(rank) <= k)


def top_candidates(letters, k: int = 3):
    """The ``k`` most probable candidates of an array, best first, then by class."""
    ordered = F.array_sort(F.transform(letters, lambda c: F.struct((-c["p"]).alias("np"), c["char"].alias("char"))))
    return F.transform(F.slice(ordered, 1, k), lambda c: F.struct(c["char"].alias("char"), (-c["np"]).alias("p")))


def spaced_top_k(df: DataFrame, keys: list[str], position: str, score: str, min_gap: float, k: int) -> DataFrame:
    """The ``k`` lowest scores that lie at least ``min_gap`` from every lower one kept.

    As if positions were taken one after another, best score first, then
    smallest position; null positions or scores do not take part. In each
    round every position that beats all others nearer than the gap is taken at
    once and those around it fall, which leaves the same picks: nothing better
    can still forbid them. Each round takes the best position left, so there
    are at most ``k``. Positions meet through cells of one gap's width, so a
    position is compared with three rows, and no key is gathered.

    Where a key's rows lie in one task already (`co_partitioned`), the picks are
    taken one after another by windows over them, and nothing is stored.
    """
    if not min_gap > 0 or k < 1:
        raise ValueError("min_gap and k must be positive")
    cell = F.floor(F.col("_x") / F.lit(float(min_gap))).cast("long")
    left = df.groupBy(*keys, F.col(position).cast("double").alias("_x")).agg(F.min(score).alias("_s")).filter("_x is not null and _s is not null")
    if dealt(df):
        return _picked_in_place(left.dropna(subset=keys), keys, position, min_gap, k)
    left = stored(left.withColumns({"_cell": cell, "_at": F.struct("_s", "_x")}), "spaced")
    taken = None
    for _ in range(k):
        best = left.groupBy(*keys, "_cell").agg(F.min("_at").alias("_best"))
        # around: every row and every pick beside the cells where it could matter
        around = left.select(*keys, "_at", F.explode(F.array(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell"))
        near = F.abs(F.col("_at._x") - F.col("_best._x")) < min_gap
        beaten = around.join(best, [*keys, "_cell"]).filter(near & (F.col("_at") < F.col("_best"))).select(*keys, "_cell").distinct()
        picks = stored(best.join(beaten, [*keys, "_cell"], "left_anti"), "picks")
        taken = picks if taken is None else taken.unionByName(picks)
        reach = picks.select(*keys, "_best", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell"))
        fallen = left.join(reach, [*keys, "_cell"]).filter(near).select(*keys, "_x").distinct()
        left = stored(left.join(fallen, [*keys, "_x"], "left_anti"), "spaced")
        if left.isEmpty():
            break
    first = top_k(taken.select(*keys, F.col("_best._x").alias(position), "_best"), keys, [F.col("_best")], k)
    return first.select(*keys, position)


def _picked_in_place(left: DataFrame, keys: list[str], position: str, min_gap: float, k: int) -> DataFrame:
    """The picks of `spaced_top_k`, best first, without a shuffle of the rows ``(keys, _x, _s)``."""
    rows = left.select(*keys, F.struct("_s", "_x").alias("_at"), F.lit(False).alias("_taken"))
    w = W.partitionBy(*keys)
    for _ in range(k):
        # a fallen row has no place left and is gone from the next round
        rows = rows.withColumn("_best", F.min(F.when(~F.col("_taken"), F.col("_at"))).over(w))
        near = F.abs(F.col("_at._x") - F.col("_best._x")) < min_gap
        rows = rows.withColumn("_taken", F.col("_taken") | F.coalesce(F.col("_at") == F.col("_best"), F.lit(False)))
        rows = rows.filter(F.col("_taken") | ~F.coalesce(near, F.lit(False))).drop("_best")
    return rows.filter("_taken").select(*keys, F.col("_at._x").alias(position))
