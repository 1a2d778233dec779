"""Scoring feature vectors against a reference set with a Gaussian kernel.

A model is three tables: ``sv(sv_id, class, vec)``, ``coef(sv_id, pair_id, coef)``
and ``pair(pair_id, i, j, intercept, prob_a, prob_b)``. Both sides are packed
into blocks, a block of vectors meets a block of the model as one matrix
product, and the products are summed up inside the task: no row ever stands
for one vector and one model vector.

Sums over the whole model need every block to meet every block; `_meet` deals
both sides out so that model blocks are repeated no more than the vectors weigh.
Nearest vectors need few: `nearest_vectors` leaves out the parts of the model
that the triangle inequality rules out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sulatan.operators.ordered import BROADCAST_BYTES, broadcast_if_small
from sulatan.operators.ranking import top_k
from sulatan.session import stored

#: model vectors and scored vectors of a block
BLOCK, BATCH = 512, 1024
NEAREST = 5
#: bytes of reference points that every task holds for the nearest search
PIVOT_BYTES = 16 << 20


# --- blocks ---------------------------------------------------------------------

def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0)
    return values, (offsets - offsets[0]).astype(np.int64)


def _pack(df: DataFrame, fields: Sequence[str], most: int, count: str, key: str | None = None) -> DataFrame:
    """Rows packed into blocks of at most ``most`` (``count`` says of how many): every field as the bytes of an array.

    ``vec`` becomes a matrix; other list fields also get their offsets
    (``<field>_at``). With a ``key``, rows lie sorted by it in their partition
    and a block holds rows of one key.
    """
    names = ([key] if key else []) + list(fields)
    lists = {f for f, kind in df.select(*fields).dtypes if kind.startswith("array") and f != "vec"}
    out = [*([f"{key} long"] if key else []), f"{count} int", *[f"{f} binary" for f in fields], *[f"{f}_at binary" for f in sorted(lists)]]
    schema = ", ".join(out)
    columns = [c.split(" ")[0] for c in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy() if key else np.zeros(batch.num_rows, np.int64)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            rows: dict[str, list] = {c: [] for c in columns}
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows)):
                for at in range(int(lo), int(hi), most):
                    part = batch.slice(at, min(most, int(hi) - at))
                    if key:
                        rows[key].append(int(keys[at]))
                    rows[count].append(part.num_rows)
                    for f in fields:
                        cell = part.column(names.index(f))
                        if f == "vec" or f in lists:
                            values, offsets = _list_parts(cell)
                            if f in lists:
                                rows[f"{f}_at"].append(offsets.tobytes())
                        else:
                            values = cell.to_numpy()
                        rows[f].append(np.ascontiguousarray(values).tobytes())
            kinds = {count: pa.int32(), key: pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.binary())) for c in columns], columns)

    return df.select(*names).mapInArrow(run, schema)


def _vectors(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Named fields with ids and classes as long and the vector as doubles; null vectors have no part."""
    kinds = {"vec": "array<double>", "vec_id": "long", "sv_id": "long", "class": "long"}
    return df.filter("vec is not null").select(*[F.col(f).cast(kinds[f]).alias(f) if f in kinds else F.col(f) for f in fields])


def _array(cell: pa.Scalar, kind=np.float64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _matrix(cell: pa.Scalar, n: int) -> np.ndarray:
    return _array(cell).reshape(n, -1)


def _squared(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (s * s).sum(axis=1)[None, :] - 2.0 * (x @ s.T), 0.0)


def _small(blocks: DataFrame, max_bytes: int) -> tuple[bool, int]:
    """Whether packed blocks may be broadcast, from their counted bytes, and how many rows they hold."""
    size, rows = blocks.agg(F.sum(sum(F.octet_length(f) for f, kind in blocks.dtypes if kind == "binary").cast("long")), F.sum("m")).first()
    return (size or 0) <= max_bytes, rows or 0


def _meet(batches: DataFrame, blocks: DataFrame, max_bytes: int) -> DataFrame:
    """Every batch of vectors beside every model block, the blocks of a batch one after another.

    Batches are dealt into groups and each group gets all blocks once. A
    group holds as many vectors as the model, so repeated blocks weigh no more
    than the vectors; a model within the bound is broadcast to one group.
    """
    small, n_model = _small(blocks, max_bytes)
    n_vectors = batches.agg(F.sum("n")).first()[0] or 0
    groups = 1 if small else max(1, math.ceil(n_vectors / max(n_model, 16 * BATCH)))
    dealt = batches.withColumn("_group", F.pmod(F.xxhash64("batch"), F.lit(groups)).cast("int"))
    copies = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return dealt.join(F.broadcast(copies) if small else copies, "_group").drop("_group")


def _batches(vectors: DataFrame, most: int) -> DataFrame:
    packed = _pack(_vectors(vectors, ["vec_id", "vec"]), ["vec_id", "vec"], most, "n")
    return stored(packed.select(F.monotonically_increasing_id().alias("batch"), F.col("n").alias("n"), F.col("vec_id").alias("ids"), F.col("vec").alias("x")), "batches")


def _summed(met: DataFrame, fields: Sequence[str], schema: str, add: Callable, out: Callable) -> DataFrame:
    """One pass over batches met by blocks: ``add(state, x, block)`` for each, ``out(ids, state)`` once per batch and task."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, x, state = None, None, None, {}
        for rows in arrow:
            for i in range(rows.num_rows):
                batch, n, m = (rows.column(k)[i].as_py() for k in range(3))
                if batch != now:
                    if now is not None:
                        yield out(ids, state)
                    now, ids, x, state = batch, _array(rows.column(3)[i], np.int64), _matrix(rows.column(4)[i], n), {}
                add(state, x, {"m": m} | {f: rows.column(5 + k)[i] for k, f in enumerate(fields)})
        if now is not None:
            yield out(ids, state)

    return met.select("batch", "n", "m", "ids", "x", *fields).mapInArrow(run, schema)


# --- sums over the model -------------------------------------------------------------

def kernel_similarity(vectors: DataFrame, sv: DataFrame, gamma: float, max_bytes: int = BROADCAST_BYTES, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """``exp(-gamma |x - s|^2)`` of every vector with every model vector: ``(vec_id, sv_id, class, k)``.

    Null vectors have no rows. A task holds the values of one batch and one block at a time.
    """
    fields = ["sv_id", "class", "vec"]
    blocks = stored(_pack(_vectors(sv, fields), fields, block, "m"), "model")

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            for i in range(rows.num_rows):
                n, m = rows.column(0)[i].as_py(), rows.column(1)[i].as_py()
                ids, x, svs, classes, s = (rows.column(c)[i] for c in range(2, 7))
                k = np.exp(-gamma * _squared(_matrix(x, n), _matrix(s, m)))
                columns = [np.repeat(_array(ids, np.int64), m), np.tile(_array(svs, np.int64), n), np.tile(_array(classes, np.int64), n), k.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "sv_id", "class", "k"])

    met = _meet(_batches(vectors, batch), blocks, max_bytes).select("n", "m", "ids", "x", *fields)
    rows = met.mapInArrow(run, "vec_id long, sv_id long, class long, k double")
    kinds = dict(sv.dtypes)
    return rows.select("vec_id", *[F.col(c).cast(kinds[c]).alias(c) for c in ("sv_id", "class")], "k")


def class_similarity(vectors: DataFrame, sv: DataFrame, gamma: float, max_bytes: int = BROADCAST_BYTES, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """``exp(-gamma |x - s|^2)`` summed up per class: ``(vec_id, class, n, k_sum, k_max)``.

    ``vec_id`` names a vector; null vectors have no rows, and without a model
    there are none.
    """
    blocks = stored(_pack(_vectors(sv, ["class", "vec"]), ["class", "vec"], block, "m"), "model")

    def add(state: dict, x: np.ndarray, b: dict) -> None:
        k = np.exp(-gamma * _squared(x, _matrix(b["vec"], b["m"])))
        classes = _array(b["class"], np.int64)
        for c in np.unique(classes).tolist():
            own = k[:, classes == c]
            n, total, most = state.get(c, (0, 0.0, 0.0))
            state[c] = n + own.shape[1], total + own.sum(axis=1), np.maximum(most, own.max(axis=1))

    def out(ids: np.ndarray, state: dict) -> pa.RecordBatch:
        cs = sorted(state)
        columns = [np.tile(ids, len(cs)), np.repeat(np.array(cs, np.int64), len(ids)), np.repeat(np.array([state[c][0] for c in cs], np.int64), len(ids))]
        columns += [np.concatenate([state[c][k] for c in cs]) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "class", "n", "k_sum", "k_max"])

    met = _meet(_batches(vectors, batch), blocks, max_bytes)
    rows = _summed(met, ["class", "vec"], "vec_id long, class long, n long, k_sum double, k_max double", add, out)
    # a batch whose blocks were dealt to several tasks has several partial rows
    total = rows.groupBy("vec_id", "class").agg(F.sum("n").alias("n"), F.sum("k_sum").alias("k_sum"), F.max("k_max").alias("k_max"))
    return total.select("vec_id", F.col("class").cast(dict(sv.dtypes)["class"]).alias("class"), "n", "k_sum", "k_max")


def pair_decisions(vectors: DataFrame, sv: DataFrame, coef: DataFrame, pair: DataFrame, gamma: float,
                   max_bytes: int = BROADCAST_BYTES, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """Decision value of every class pair for every vector, with the columns of ``pair``.

    Each model block knows the pairs its vectors have coefficients for; kernel
    values times coefficients are added up per pair inside the task.
    """
    own = coef.groupBy(F.col("sv_id").cast("long").alias("sv_id")).agg(F.collect_list(F.struct(F.col("pair_id").cast("long").alias("p"), F.col("coef").cast("double").alias("c"))).alias("_c"))
    weighted = _vectors(sv, ["sv_id", "vec"]).join(own, "sv_id").select("vec", F.col("_c.p").alias("pairs"), F.col("_c.c").alias("coefs"))
    blocks = stored(_pack(weighted, ["vec", "pairs", "coefs"], block, "m"), "model")

    def add(state: dict, x: np.ndarray, b: dict) -> None:
        k = np.exp(-gamma * _squared(x, _matrix(b["vec"], b["m"])))
        pairs, column = np.unique(_array(b["pairs"], np.int64), return_inverse=True)
        weights = np.zeros((b["m"], len(pairs)))
        np.add.at(weights, (np.repeat(np.arange(b["m"]), np.diff(_array(b["pairs_at"], np.int64))), column), _array(b["coefs"]))
        for p, v in zip(pairs.tolist(), (k @ weights).T):
            state[p] = state.get(p, 0.0) + v

    def out(ids: np.ndarray, state: dict) -> pa.RecordBatch:
        ps = sorted(state)
        return pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(ps))), pa.array(np.repeat(np.array(ps, np.int64), len(ids))), pa.array(np.concatenate([state[p] for p in ps]) if ps else np.zeros(0))], ["vec_id", "pair_id", "v"])

    met = _meet(_batches(vectors, batch), blocks, max_bytes)
    rows = _summed(met, ["vec", "pairs", "pairs_at", "coefs"], "vec_id long, pair_id long, v double", add, out)
    sums = rows.groupBy("vec_id", "pair_id").agg(F.sum("v").alias("_v")).withColumn("pair_id", F.col("pair_id").cast(dict(pair.dtypes)["pair_id"]))
    return sums.join(pair, "pair_id").withColumn("decision", F.col("_v") + F.col("intercept")).drop("_v")


# --- nearest vectors -------------------------------------------------------------------

def _pivots(model: DataFrame, k: int) -> np.ndarray:
    """Some model vectors as reference points: about the root of their number, within ``PIVOT_BYTES``."""
    n, width = model.agg(F.count("*"), F.max(F.size("vec"))).first()
    most = max(k, min(math.isqrt(n) + 1, PIVOT_BYTES // (8 * max(width or 1, 1))))
    rows = model.select("vec").orderBy(F.xxhash64("sv_id"), "sv_id").limit(most).toArrow().column("vec")
    return np.array(rows.to_pylist(), np.float64).reshape(len(rows), width or 0)


def _slack(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """What a distance may be off by rounding, generously: nothing may be ruled out by it."""
    return 1e-6 * (1.0 + np.sqrt((x * x).sum(axis=1)) + math.sqrt(float((points * points).sum(axis=1).max())))


def _cells(model: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Model vectors with their nearest pivot (``cell``) and the distance ``d`` to it."""
    held = model.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _squared(_list_parts(batch.column(2))[0].reshape(batch.num_rows, -1), held.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1)), pa.array(np.sqrt(d.min(axis=1)))], ["sv_id", "class", "vec", "cell", "d"])

    return model.mapInArrow(run, "sv_id long, class long, vec array<double>, cell long, d double")


def _needs(vectors: DataFrame, pivots: np.ndarray, radius: np.ndarray, members: np.ndarray, k: int, counter) -> DataFrame:
    """``(vec_id, vec, cell, reach, wanted)``: the nearest pivot, a bound on the k-th distance, and the cells within it.

    Two bounds: pivots are model vectors themselves, so the k-th nearest pivot
    is one; and the cells whose far sides are nearest hold k vectors together.
    A cell is needed if its ball comes that close.
    """
    held = vectors.sparkSession.sparkContext.broadcast((pivots, radius, members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, radii, sizes = held.value
        most = float(sizes.sum())
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _list_parts(batch.column(1))[0].reshape(batch.num_rows, -1)
            d = np.sqrt(_squared(x, points))
            if counter is not None:
                counter.add(d.size)
            reach = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
            far = np.where(sizes > 0, d + radii[None, :], np.inf)
            order = np.argsort(far, axis=1)
            enough = np.argmax(np.cumsum(sizes[order], axis=1) >= min(k, most), axis=1)
            reach = np.minimum(reach, far[np.arange(len(d)), order[np.arange(len(d)), enough]]) if most >= k else reach
            near = d - radii[None, :] <= (reach + _slack(x, points))[:, None]
            row, cell = np.nonzero(near)
            wanted = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(d)))), pa.int32()), pa.array(cell.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1)), pa.array(reach), wanted], ["vec_id", "vec", "cell", "reach", "wanted"])

    return vectors.mapInArrow(run, "vec_id long, vec array<double>, cell long, reach double, wanted array<long>")


def nearest_vectors(vectors: DataFrame, sv: DataFrame, gamma: float, k: int = NEAREST, max_bytes: int = BROADCAST_BYTES, block: int = BLOCK, batch: int = BATCH, counter=None) -> DataFrame:
    """The ``k`` most similar model vectors of each vector: ``(vec_id, sv_id, class, k, rank)``.

    Model vectors lie in cells around pivots. A vector needs a cell only if
    the cell's ball is no farther than the vector's k-th nearest pivot, and in
    a cell only blocks whose range of distances to the pivot can hold anything
    closer than its k-th best so far. Vectors with the same nearest pivot
    travel in one batch and ask for cells together, so model blocks are
    repeated per batch group, not per vector. The result is exact for any
    pivots; equal similarities go to the smaller ``sv_id``.

    ``counter`` is an accumulator for the number of distances taken. Null
    vectors have no rows; a model with fewer than ``k`` vectors gives all.
    """
    model = stored(_vectors(sv, ["sv_id", "class", "vec"]), "model")
    pivots = _pivots(model, k)
    names, kinds = ["vec_id", "sv_id", "class", "k"], "vec_id long, sv_id long, class long, k double"
    if not len(pivots):
        return top_k(vectors.sparkSession.createDataFrame([], kinds), ["vec_id"], [F.col("k").desc(), F.col("sv_id")], k)
    placed = stored(_cells(model, pivots), "cells")
    sizes = placed.groupBy("cell").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect()  # one row per pivot
    radius, members = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in sizes:
        radius[r["cell"]], members[r["cell"]] = r["r"], r["n"]
    blocks = stored(_pack(placed.repartitionByRange("cell", "d").sortWithinPartitions("cell", "d"), ["sv_id", "class", "vec", "d"], block, "m", "cell"), "blocks")
    small, n_model = _small(blocks, max_bytes)

    asked = stored(_needs(_vectors(vectors, ["vec_id", "vec"]), pivots, radius, members, k, counter), "asked")
    # a group: vectors of one cell, no more than the model has, so repeated blocks weigh no more than vectors
    per_cell = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / max(n_model, 16 * batch)).cast("long").alias("_parts")))
    grouped = asked.join(per_cell, "cell").withColumn("group", F.col("cell") * F.lit(1 << 40) + F.pmod(F.xxhash64("vec_id"), F.col("_parts")))
    wanted = grouped.select("group", F.explode("wanted").alias("cell")).distinct()
    packed = _pack(grouped.select("group", "vec_id", "vec", "reach").repartition("group").sortWithinPartitions("group"), ["vec_id", "vec", "reach"], batch, "n", "group")
    batches = stored(packed.select("group", F.monotonically_increasing_id().alias("batch"), "n", F.col("vec_id").alias("ids"), F.col("vec").alias("x"), "reach"), "batches")
    dealt = wanted.join(F.broadcast(blocks) if small else blocks, "cell")
    met = batches.join(dealt, "group").select("batch", "n", "m", "ids", "x", "reach", "cell", "sv_id", "class", "vec", "d")
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def best(state: dict, sims: np.ndarray, ids: np.ndarray, classes: np.ndarray, rows: np.ndarray) -> None:
        """Keeps the k best of what a vector had and what came; far is similarity 0."""
        have = [a[rows] for a in (state["k"], state["ids"], state["class"])]
        both = [np.concatenate([have[0], sims], axis=1), np.concatenate([have[1], np.tile(ids, (len(rows), 1))], axis=1), np.concatenate([have[2], np.tile(classes, (len(rows), 1))], axis=1)]
        order = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
        for name, a in zip(("k", "ids", "class"), both):
            state[name][rows] = np.take_along_axis(a, order, axis=1)

    def out(ids: np.ndarray, state: dict) -> pa.RecordBatch:
        found = state["k"] >= 0
        row = np.nonzero(found)[0]
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), *[pa.array(state[c][found]) for c in ("ids", "class", "k")]], names)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = held.value
        now, ids, x, state = None, None, None, {}
        for rows in arrow:
            for i in range(rows.num_rows):
                number, n, m = (rows.column(j)[i].as_py() for j in range(3))
                if number != now:
                    if now is not None:
                        yield out(ids, state)
                    now, ids, x = number, _array(rows.column(3)[i], np.int64), _matrix(rows.column(4)[i], n)
                    state = {"k": np.full((n, k), -1.0), "ids": np.full((n, k), np.iinfo(np.int64).max), "class": np.zeros((n, k), np.int64), "reach": _array(rows.column(5)[i]).copy()}
                    slack = _slack(x, points)
                near = _array(rows.column(10)[i])
                mine = np.sqrt(_squared(x, points[rows.column(6)[i].as_py()][None, :]))[:, 0]
                # in this block, distances to the pivot run from near[0] to near[-1]
                live = np.flatnonzero(np.maximum(mine - near[-1], near[0] - mine) <= state["reach"] + slack)
                if counter is not None:
                    counter.add(n + len(live) * m)
                if not len(live):
                    continue
                sims = np.exp(-gamma * _squared(x[live], _matrix(rows.column(9)[i], m)))
                best(state, sims, _array(rows.column(7)[i], np.int64), _array(rows.column(8)[i], np.int64), live)
                kth = state["k"][live, k - 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    bound = np.where(kth > 0, np.sqrt(np.maximum(-np.log(kth) / gamma, 0.0)), np.inf) if gamma > 0 else np.full(len(live), np.inf)
                state["reach"][live] = np.minimum(state["reach"][live], bound)
        if now is not None:
            yield out(ids, state)

    best_rows = top_k(met.mapInArrow(run, kinds), ["vec_id"], [F.col("k").desc(), F.col("sv_id")], k)
    return best_rows.withColumn("class", F.col("class").cast(dict(sv.dtypes)["class"]))


# --- letters the model does not know -------------------------------------------------------

def familiarity(vectors: DataFrame, sv: DataFrame | None, gamma: float, score: str = "sim5", **sizes) -> DataFrame:
    """How well the model knows each vector: ``prob``, ``sim1`` or ``sim5``."""
    if score == "prob":
        return vectors.select("vec_id", F.col("p").alias("familiarity"))
    near = nearest_vectors(vectors.select("vec_id", "vec"), sv, gamma, 1 if score == "sim1" else NEAREST, **sizes)
    return near.groupBy("vec_id").agg(F.avg("k").alias("familiarity"))


def reject_unknown_letters(scores: DataFrame, threshold: float | None, exempt: str | None = None) -> DataFrame:
    """Flag letters below the threshold; without one nothing is rejected.

    ``exempt`` names a flag of letters that belong to a real word of two letters or more.
    """
    flag = F.lit(False) if threshold is None else F.col("familiarity") < float(threshold)
    if exempt:
        flag = flag & ~F.coalesce(F.col(exempt), F.lit(False))
    return scores.withColumn("rejected", flag)


def apply_rejection(letters: Column, mode: str = "drop") -> Column:
    """Word of ``array<struct<char, rejected>>``: rejected letters vanish or become ``?``."""
    if mode == "drop":
        return F.array_join(F.transform(F.filter(letters, lambda c: ~c["rejected"]), lambda c: c["char"]), "")
    return F.array_join(F.transform(letters, lambda c: F.when(c["rejected"], "?").otherwise(c["char"])), "")


def reject_in_words(letters: DataFrame, keys: list[str], dictionary: DataFrame | None, threshold: float | None, mode: str = "drop") -> DataFrame:
    """Words without the letters the model does not know: ``(keys, word, word_out, n_rejected, status)``.

    ``letters`` holds the keys of a word, ``pos``, ``char`` and ``familiarity``.
    A letter below the threshold is rejected, but in a dictionary word of two
    letters or more none is. ``drop`` leaves rejected letters out, and the
    word if none is left; ``mark`` writes ``?`` and sets the status
    ``unknown_letters``. Status is else ``known``.
    """
    if mode not in ("drop", "mark"):
        raise ValueError("mode must be drop or mark")
    # a word's letters are as few as its boxes
    words = letters.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "char", "familiarity"))).alias("_l"))
    words = words.withColumn("word", F.array_join(F.transform("_l", lambda c: c["char"]), ""))
    if dictionary is not None:
        known = broadcast_if_small(dictionary.select(F.col("word").alias("_known")))
        words = words.join(known, (F.col("word") == F.col("_known")) & (F.length("word") > 1), "left")
        real = F.col("_known").isNotNull()
    else:
        real = F.lit(False)
    low = (lambda c: F.lit(False)) if threshold is None else (lambda c: ~real & F.coalesce(c["familiarity"] < float(threshold), F.lit(False)))
    flagged = words.withColumn("_f", F.transform("_l", lambda c: F.struct(c["char"].alias("char"), low(c).alias("rejected"))))
    n = F.size(F.filter("_f", lambda c: c["rejected"]))
    status = F.when((n > 0) & F.lit(mode == "mark"), "unknown_letters").otherwise("known")
    out = flagged.select(*keys, "word", apply_rejection(F.col("_f"), mode).alias("word_out"), n.cast("long").alias("n_rejected"), status.alias("status"))
    return out if mode == "mark" else out.filter("word_out <> ''")


# --- votes -----------------------------------------------------------------------------------

def platt_probability(decision: Column, a: Column, b: Column) -> Column:
    """Sigmoid of a decision value, written so that neither side overflows."""
    f = decision * a + b
    small = F.exp(-F.abs(f))
    return F.when(f >= 0, small / (1.0 + small)).otherwise(1.0 / (1.0 + small))


def ovo_vote(decisions: DataFrame) -> DataFrame:
    """Class with the most pair wins per vector; a tie goes to the lowest class."""
    winner = F.when(F.col("decision") > 0, F.col("i")).otherwise(F.col("j"))
    votes = decisions.groupBy("vec_id", winner.alias("class")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("vec_id").agg(F.min_by(F.struct("class", "votes"), F.struct((-F.col("votes")).alias("v"), F.col("class"))).alias("_b"))
    return best.select("vec_id", F.col("_b.class").alias("predicted"), F.col("_b.votes").alias("votes"))
