"""Quality classifier: random-indexing word vectors and a two-layer network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.llm.learn import TwoLayers
from sulatan.llm.store import docs_of, held_out, labelled, save
from sulatan.llm.words import SHAPES, Words, words

#: word vectors: hashed rows, width, and non-zero places of an index vector
ROWS, WIDTH, PLACES = 1 << 14, 64, 4
#: vectors travel in blocks of so many rows; so many tasks are summed at once
BLOCK_ROWS, FAN_IN = 1 << 10, 256
#: labelled texts, at most, that train the network
TRAIN_TEXTS = 20_000
#: tokens pooled at once
STEP = 1 << 16


def tokens(column: pa.Array):
    """Runs of lower-case letters, capitals, digits, or one sign."""
    return words(column, lower=False, classes=SHAPES)


def _index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse index vector of each token: ``PLACES`` places and signs, from its hash."""
    bits = hashes[None] >> (np.arange(PLACES, dtype=np.uint64)[:, None] * np.uint64(7))
    return (bits & np.uint64(WIDTH - 1)).astype(np.int64), ((bits >> np.uint64(6)) & np.uint64(1)).astype(np.int64) * 2 - 1


def _row_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 14)).astype(np.int64)


def _contexts(batches):
    """Per task: each row's sum of its neighbours' index vectors, left ones turned by half the width."""
    total = np.zeros(ROWS * WIDTH)
    for batch in batches:
        for w in tokens(batch.column(0)):
            place, sign = _index(w.hashes)
            row, text = _row_of(w.hashes) * WIDTH, w.rows()
            same = np.flatnonzero(text[1:] == text[:-1])
            cells = np.concatenate([(row[same] + place[:, same + 1]).ravel(), (row[same + 1] + (place[:, same] + WIDTH // 2) % WIDTH).ravel()])
            total += np.bincount(cells, np.concatenate([sign[:, same + 1].ravel(), sign[:, same].ravel()]), ROWS * WIDTH)
    parts = total.astype(np.float32).reshape(-1, BLOCK_ROWS * WIDTH)
    rows = len(parts)
    group = TaskContext.get().partitionId() // FAN_IN
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array(np.full(rows, group, np.int32)), pa.array([p.tobytes() for p in parts])], ["block", "part", "cells"])


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK_ROWS * WIDTH)
    for cells in table.column("cells"):
        total += np.frombuffer(cells.as_py(), np.float32)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "cells": pa.array([total.astype(np.float32).tobytes()])})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors by hashed word, from the neighbours of every word of all texts.

    A fixed number of rows, whatever the vocabulary. Tasks send blocks of
    their sums, which are added in two steps.
    """
    kind = "block int, part int, cells binary"
    parts = docs.select("text").mapInArrow(_contexts, kind).groupBy("block", "part").applyInArrow(_added, kind).groupBy("block").applyInArrow(_added, kind)
    out = np.zeros((ROWS // BLOCK_ROWS, BLOCK_ROWS * WIDTH), np.float32)
    for block, cells in parts.select("block", "cells").collect():  # ROWS x WIDTH numbers
        out[block] = np.frombuffer(cells, np.float32)
    out = out.reshape(ROWS, WIDTH)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pooled(w: Words, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean word vector, mean index vector, share of distinct tokens, their spread, and the length."""
    n, text = np.diff(w.at), w.rows()
    rows = len(n)
    place, sign = _index(w.hashes)
    own = np.bincount((text * WIDTH + place).ravel(), sign.ravel(), rows * WIDTH).reshape(rows, WIDTH)
    mean = np.zeros((rows, WIDTH))
    where = _row_of(w.hashes)
    for lo in range(0, len(where), STEP):
        part = text[lo : lo + STEP]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        mean[part[first]] += np.add.reduceat(vectors[where[lo : lo + STEP]], first, axis=0)
    keys = np.sort(text.astype(np.uint64) << np.uint64(40) | w.hashes >> np.uint64(24))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=rows)
    size = np.maximum(n, 1)[:, None]
    spread = (own**2).sum(axis=1, keepdims=True) / size**2
    return np.column_stack([mean / size, own / size, (distinct[:, None] / size), np.log(distinct[:, None] + 1) / np.log(size + 1.5), np.sqrt(spread), np.log1p(size)])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Word vectors come from all texts; at most `TRAIN_TEXTS` labelled rows
    outside the held-out fold train the network on their pooled vectors, and
    every fifth of these only sets the temperature. Only the text enters a
    score.

    Null and empty texts get the score of an empty pool; a null id counts as
    not held out; repeated rows score alike; without labels of both kinds the
    score is 0.5; extra columns are ignored; an empty table gives no rows.
    """
    docs = docs_of(docs, id_col, text_col)
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    keep = TRAIN_TEXTS / max(rows.count(), 1)
    if keep < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(keep * 1_000_003 * 0.95))

    def pool(batches):
        for batch in batches:
            for w in tokens(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(pooled(w, vectors.value))), batch.column(1).slice(w.lo, w.hi - w.lo)], ["x", "label"])

    train = save(labelled(docs, rows, "quality").select("text", "label").mapInArrow(pool, "x array<double>, label int"), "quality_train").toArrow()
    model = None
    if train.num_rows:
        x, y = np.array(train.column("x").to_pylist()), train.column("label").to_numpy().astype(float)
        order = np.lexsort(np.round(x.T, 9))  # the same rows in any order give the same network
        model = TwoLayers(x[order], y[order]) if 0 < y.mean() < 1 else None
    fitted = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for w in tokens(batch.column(1)):
                s = fitted.value.score(pooled(w, vectors.value)) if fitted.value is not None else np.full(w.hi - w.lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(s)], ["doc_id", "score"])

    out = docs.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
