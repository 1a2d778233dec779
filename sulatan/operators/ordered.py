"""Ordered work over keys that may hold a large share of all rows.

A plain window partitioned by a hot key sorts that key inside one task. Here
each key is cut into chunks along its order column, windows run per
``(key, chunk)``, and a summary of one row per chunk carries state across the
cut. Only the summary is windowed by the bare key. All functions are exact for
any chunk width; the width only decides how much one task sorts.

In a session that keeps tables as they are dealt (`co_partitioned`) all chunks
of a key lie in one task already. There the state is carried by a window over
the same sorted rows, instead of joining a summary for which the rows would be
made and sorted a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sulatan.session import CO_PARTITION

CHUNK = "_chunk"


def chunked(df: DataFrame, by, width: float) -> DataFrame:
    """Add the chunk number of every row; it must not decrease along the order."""
    col = F.col(by) if isinstance(by, str) else by
    return df.withColumn(CHUNK, F.floor(col / F.lit(float(width))).cast("long"))


def time_chunked(df: DataFrame, ts: str, seconds: float) -> DataFrame:
    """Chunk number from a timestamp column of either timestamp type."""
    return chunked(df, F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6), seconds)


def _order(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _inside(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys, CHUNK).orderBy(*order)


def dealt(df: DataFrame) -> bool:
    """Whether the chunks of a key share a task (see `co_partitioned`)."""
    return df.sparkSession.conf.get(CO_PARTITION, "true") == "false"


def whole(keys: Sequence[str], order: Sequence[str]):
    """Window over all chunks of a key. Rows without a key or chunk count in it and are dropped after it, as by the join."""
    return W.partitionBy(*keys).orderBy(CHUNK, *order)


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
                 out: str = "prev") -> DataFrame:
    """Add the fields of the preceding row of the key as a struct (null on the first)."""
    row = F.struct(*[F.col(f) for f in fields])
    if dealt(df):
        return df.withColumn(out, F.lag(row).over(whole(keys, order))).dropna(subset=[*keys, CHUNK])
    last = (
        df.groupBy(*keys, CHUNK)
        .agg(F.max_by(row, _order(order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy(CHUNK)))
        .select(*keys, CHUNK, "_carry")
    )
    inside = df.withColumn("_lag", F.lag(row).over(_inside(keys, order)))
    joined = inside.join(last, [*keys, CHUNK])
    return joined.withColumn(out, F.coalesce("_lag", "_carry")).drop("_lag", "_carry")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
            sums: dict[str, str] | None = None, peaks: dict[str, str] | None = None,
            peaks_before: dict[str, str] | None = None, index: str | None = None) -> DataFrame:
    """Running totals and maxima of a key.

    ``sums`` and ``peaks`` include the current row, ``peaks_before`` does not,
    ``index`` numbers the rows of a key from 0.
    """
    sums, peaks, before = sums or {}, peaks or {}, peaks_before or {}
    if dealt(df):
        w = whole(keys, order)
        incl, excl = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(incl), F.lit(0)).alias(o) for o, c in sums.items()],
                         *[F.max(c).over(incl).alias(o) for o, c in peaks.items()],
                         *[F.max(c).over(excl).alias(o) for o, c in before.items()],
                         *([(F.row_number().over(w) - 1).cast("long").alias(index)] if index else [])).dropna(subset=[*keys, CHUNK])
    incl = _inside(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    excl = _inside(keys, order).rowsBetween(W.unboundedPreceding, -1)
    past = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)

    aggs, carries = [F.count(F.lit(1)).alias("_n")], []
    for out, col in sums.items():
        aggs.append(F.sum(col).alias(f"_s_{out}"))
        carries.append((f"_c_{out}", F.sum(f"_s_{out}")))
    for out, col in {**peaks, **before}.items():
        aggs.append(F.max(col).alias(f"_s_{out}"))
        carries.append((f"_c_{out}", F.max(f"_s_{out}")))
    if index:
        carries.append((f"_c_{index}", F.sum("_n")))
    summary = df.groupBy(*keys, CHUNK).agg(*aggs)
    summary = summary.select(*keys, CHUNK, *[c.over(past).alias(name) for name, c in carries])

    out_df = df.select("*", *[F.sum(c).over(incl).alias(o) for o, c in sums.items()],
                       *[F.max(c).over(incl).alias(o) for o, c in peaks.items()],
                       *[F.max(c).over(excl).alias(o) for o, c in before.items()],
                       *([F.row_number().over(_inside(keys, order)).cast("long").alias(index)] if index else []))
    out_df = out_df.join(summary, [*keys, CHUNK])
    fixed = {o: F.coalesce(F.col(o), F.lit(0)) + F.coalesce(F.col(f"_c_{o}"), F.lit(0)) for o in sums}
    fixed |= {o: F.greatest(F.col(o), F.col(f"_c_{o}")) for o in [*peaks, *before]}
    if index:
        fixed[index] = F.col(index) - 1 + F.coalesce(F.col(f"_c_{index}"), F.lit(0))
    return out_df.withColumns(fixed).drop(*[name for name, _ in carries])


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
             starts, out: str) -> DataFrame:
    """Number the runs of a key: a run starts where ``starts(prev, cur)`` holds.

    ``prev`` and ``cur`` give access to the named fields of neighbouring rows
    (``prev.getField(name)``). The first row of a key belongs to run 0.
    """
    row = F.struct(*[F.col(f) for f in fields])
    w = _inside(keys, order)

    def flag(prev: Column, cur: Column) -> Column:
        return F.when(prev.isNull(), 0).otherwise(F.when(starts(prev, cur), 1).otherwise(0))

    if dealt(df):
        w = whole(keys, order)
        marked = df.withColumn("_lag", F.lag(row).over(w)).withColumn("_break", flag(F.col("_lag"), row))
        number = F.sum("_break").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        return marked.withColumn(out, number.cast("long")).dropna(subset=[*keys, CHUNK]).drop("_lag", "_break")
    marked = df.withColumn("_lag", F.lag(row).over(w)).withColumn("_break", flag(F.col("_lag"), row))
    by_key = W.partitionBy(*keys).orderBy(CHUNK)
    summary = (
        marked.groupBy(*keys, CHUNK)
        .agg(F.min_by(row, _order(order)).alias("_first"), F.max_by(row, _order(order)).alias("_last"),
             F.sum("_break").alias("_n"))
        .withColumn("_edge", flag(F.lag("_last").over(by_key), F.col("_first")))
        .withColumn("_base", F.coalesce(F.sum(F.col("_n") + F.col("_edge")).over(
            by_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_edge"))
        .select(*keys, CHUNK, "_base")
    )
    numbered = marked.withColumn(out, F.sum("_break").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return (numbered.join(summary, [*keys, CHUNK])
            .withColumn(out, (F.col(out) + F.col("_base")).cast("long"))
            .drop("_lag", "_break", "_base"))


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
              n: int, flag: str = "_halo") -> DataFrame:
    """Prepend to every chunk the last ``n`` earlier rows of its key, flagged.

    A frame of up to ``n`` preceding rows can then be evaluated per
    ``(key, chunk)``; flagged rows are dropped afterwards. Each chunk passes on
    at most ``n`` rows, so the arrays gathered here hold at most ``n * n`` items.
    """
    row = F.struct(*[F.col(f) for f in [*order, *fields]])
    newest = W.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    tail = (
        df.select(*keys, CHUNK, *order, *fields)
        .withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
        .groupBy(*keys, CHUNK).agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    )
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-n, -1)
    halo = (
        tail.withColumn("_prior", F.flatten(F.collect_list("_tail").over(earlier)))
        .filter(F.size("_prior") > 0)
        .withColumn("_row", F.explode(F.slice("_prior", F.greatest(F.size("_prior") - n + 1, F.lit(1)), n)))
        .select(*keys, CHUNK, "_row.*").withColumn(flag, F.lit(True))
    )
    return df.select(*keys, CHUNK, *order, *fields).withColumn(flag, F.lit(False)).unionByName(halo)


BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a narrow lookup table for broadcast after adding up its bytes.

    Each task sends one number. Beyond the bound the table is returned unmarked
    and the join shuffles.
    """
    row = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8) for f in df.schema), F.lit(16))
    size = df.agg(F.sum(row.cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


HOT_SHARE = 1024


def hot_keys(counts: DataFrame, on: Sequence[str], n: str = "n") -> DataFrame:
    """Keys with more than one task's fair share of all rows, and in how many such shares to cut them.

    There are fewer such keys than shares, and at most twice as many cuts. The
    number of shares is the session's shuffle partitions, 1024 at least.
    """
    shares = max(HOT_SHARE, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = counts.agg(F.sum(n).alias("t")).scalar()
    cuts = F.least(F.ceil(F.col(n) * shares / total), F.col(n)).cast("int")
    return counts.filter(F.col(n) * shares > total).select(*on, cuts.alias("_cuts"))


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner",
              counts: DataFrame | None = None) -> DataFrame:
    """Equi-join that spreads the hot keys of ``left`` over many tasks.

    Keys above one task's share of the rows are found first (from ``counts`` with
    columns ``on`` and ``n``, or by counting ``left``). That list is short by
    construction, so broadcasting it is safe whatever the data size. Rows of hot
    keys get a salt from ``spread``, as many as they hold shares; only their
    partners in ``right`` are repeated. A ``right`` side small enough is broadcast on its measured size.
    """
    on = list(on)
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, on))
    salt = F.pmod(F.xxhash64(*spread), F.col("_cuts")).cast("int")
    salted = left.join(hot, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_cuts")
    salts = F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1)
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_cuts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
