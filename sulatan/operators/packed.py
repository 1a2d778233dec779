"""Whole keys as arrays inside a task.

Where all rows of a key lie in one task (see `co_partitioned`), a rule over
the boxes of a line needs no window, join or aggregate of its own: the rows of
a task are taken as arrays, sorted once if they are not in order yet, and
every step is a few array operations over all lines of the task at once.
A task takes keys together up to ``TASK_ROWS`` rows; beyond that its rows go to
files by key first and are read back part by part.
"""

from __future__ import annotations

import os
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a task that are taken together; files that more rows go to
TASK_ROWS, PARTS = 1 << 22, 16
_COPY = "_first_key"

def _columns_of(df: DataFrame, keys: Sequence[str]) -> list:
    """The key columns as Spark's plan has them."""
    output = df._jdf.queryExecution().analyzed().output()
    named = {a.name(): a for a in (output.apply(i) for i in range(output.size()))}
    return [named[k] for k in keys]


def _together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the rows of a key in one task; as it is, if it has been dealt by some of ``keys``."""
    found = df._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    own = {a.toString() for a in _columns_of(df, keys)}
    # an inner join has the partitionings of both its sides
    dealt = re.findall(r"hashpartitioning\(([^()]+), \d+\)", found)
    return df if any(set(by.split(", ")) <= own for by in dealt) else df.repartition(*keys)


def _same_key(out: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """``out``, made of ``df`` task by task, with the very column ``key`` of ``df``: Spark then knows where its rows are.

    Without it, what follows would deal all rows anew by a key that has not changed.
    """
    spark, plan = df.sparkSession, out._jdf.queryExecution().analyzed()
    own = _columns_of(df, [key])[0]
    columns = [own if a.name() == key else a for a in (plan.output().apply(i) for i in range(plan.output().size()))]
    plan = plan.copy(plan.productElement(0), spark._jvm.PythonUtils.toSeq(columns), *[plan.productElement(i) for i in range(2, plan.productArity())])
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _parts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """A part number for each row, from its key alone."""
    part = np.zeros(batch.num_rows, np.uint32)
    for k in keys:
        d = batch.column(k).dictionary_encode()
        own = np.array([zlib.crc32(repr(v).encode()) for v in d.dictionary.to_pylist()], np.uint32)
        part = part * np.uint32(2654435761) + own[d.indices.to_numpy()]
    return part >> 7 & (PARTS - 1)


def _split(batches: Iterator[pa.RecordBatch], first: list[pa.RecordBatch], keys: Sequence[str], folder: str) -> Iterator[pa.Table]:
    """The rows by their part number, through one file a part."""
    schema, files = first[0].schema, [os.path.join(folder, str(k)) for k in range(PARTS)]
    out = [pa.ipc.new_file(f, schema) for f in files]

    def put(batch: pa.RecordBatch) -> None:
        part = _parts(batch, keys)
        for k in np.unique(part).tolist():
            out[k].write_batch(batch.filter(pa.array(part == k)))

    while first:
        put(first.pop())
    for batch in batches:
        put(batch)
    for f in out:
        f.close()
    for f in files:
        with pa.memory_map(f) as source:
            yield pa.ipc.open_file(source).read_all()


def in_task(df: DataFrame, keys: Sequence[str], run: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """``run`` on tables that hold whole keys; rows with a null key are dropped."""
    most, names = TASK_ROWS, df.columns
    df = _together(df.dropna(subset=list(keys)), keys)
    # the first key is given back as it is, so Spark may leave it out on the way in: a copy is worked on
    df = df.withColumn(_COPY, F.col(keys[0]))
    sent = [_COPY if c == keys[0] else c for c in names]

    def batches_of(batches):
        held, rows = [], 0
        batches = (b.select(sent).rename_columns(names) for b in batches)
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > most:
                break
        if not rows:
            return
        if rows <= most:
            yield from run(pa.Table.from_batches(held).combine_chunks()).to_batches()
            return
        with tempfile.TemporaryDirectory() as folder:
            for t in _split(batches, held, keys, folder):
                if t.num_rows:
                    yield from run(t.combine_chunks()).to_batches()

    return _same_key(df.mapInArrow(batches_of, schema), df, keys[0])


# --- arrays -----------------------------------------------------------------------


def numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return t[name].cast(pa.float64()).to_numpy()


def ranks(values) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them."""
    d = pa.chunked_array([values]).combine_chunks() if not isinstance(values, np.ndarray) else pa.array(values)
    d = d.dictionary_encode()
    order = pc.array_sort_indices(d.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return d.dictionary.take(pa.array(order)).to_numpy(zero_copy_only=False), place[d.indices.to_numpy()]


def codes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for each key, by order of first appearance of its parts."""
    code = None
    for k in keys:
        d = t[k].combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        part = d.indices.to_numpy().astype(np.int64)
        if code is not None:
            part += code * max(len(d.dictionary), 1)
            if len(part) and part.max() > 1 << 40:
                part = np.unique(part, return_inverse=True)[1]
        code = part
    return code


def in_order(columns: Sequence[np.ndarray]) -> np.ndarray | None:
    """The order that sorts rows by the columns, nulls first; None if they are sorted."""
    columns = [np.where(np.isnan(c), -np.inf, c) if c.dtype.kind == "f" and np.isnan(c).any() else c for c in columns]
    less, same = np.zeros(max(len(columns[0]) - 1, 0), bool), np.ones(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        less |= same & (c[1:] > c[:-1])
        same &= c[1:] == c[:-1]
    return None if (less | same).all() else np.lexsort(columns[::-1])


def starts_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the runs of equal codes, and the run's number of each row."""
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Groups:
    """Rows of a table in the order of their keys and of ``order``."""

    def __init__(self, t: pa.Table, keys: Sequence[str], order: Sequence[str], present: str | None = None):
        if present is not None and t[present].null_count:
            t = t.filter(pc.is_valid(t[present]))
        code = codes(t, keys)
        place = in_order([code, *[numbers(t, c) for c in order]])
        if place is not None:
            t, code = t.take(pa.array(place)), code[place]
        self.table, self.keys = t, list(keys)
        self.start, self.group = starts_of(code)
        self.n = len(self.start)
        self.size = np.diff(np.append(self.start, len(code)))

    def __getitem__(self, name: str) -> np.ndarray:
        return numbers(self.table, name)

    def key_table(self, groups: np.ndarray) -> pa.Table:
        """The keys of the given groups."""
        return self.table.select(self.keys).take(pa.array(self.start[groups]))

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.group, values, self.n)


def by_group(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (without NaN) sorted within their group, and the groups."""
    ok = ~np.isnan(values)
    if not ok.all():
        values, group = values[ok], group[ok]
    found, place = ranks(values)
    if not len(found):
        return values, group
    both = np.sort(group * len(found) + place)
    return found[both % len(found)], both // len(found)


def percentile(values: np.ndarray, group: np.ndarray, n: int, p: float) -> np.ndarray:
    """Per group the exact percentile of sorted values, as `F.percentile` interpolates it; NaN without values."""
    count = np.bincount(group, minlength=n)
    at = np.cumsum(count) - count
    out = np.full(n, np.nan)
    some = np.flatnonzero(count)
    place = (count[some] - 1) * p
    low, high = np.floor(place), np.ceil(place)
    a, b = values[at[some] + low.astype(np.int64)], values[at[some] + high.astype(np.int64)]
    out[some] = np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)
    return out


def median(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return percentile(*by_group(values, group), n, 0.5)


def reach_before(x1: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Greatest ``x1`` of the earlier rows of the group; minus infinity on the first."""
    found, place = ranks(np.where(np.isnan(x1), -np.inf, x1))
    before = found[np.maximum.accumulate(group * len(found) + place) % max(len(found), 1)]
    before = np.concatenate([[-np.inf], before[:-1]]) if len(before) else before
    before[start] = -np.inf
    return before


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers ``i`` and all numbers from ``lo[i]`` up to ``hi[i]``, without it."""
    count = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(lo)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)


def search(line: np.ndarray, x: np.ndarray, at_line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many rows, sorted by ``(line, x)``, come before ``(at_line, at)``."""
    _, place = ranks(np.concatenate([x, at]))
    width = place.max(initial=0) + 1
    return np.searchsorted(line * width + place[: len(x)], at_line * width + place[len(x) :])
