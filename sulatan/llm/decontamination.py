"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.llm.store import bounded, docs_of
from sulatan.llm.words import NON_WORD, Words, runs, words

#: test items are held by every task, this many words at a time
BLOCK_WORDS = 1 << 20
#: alignments done at once
LANES = 256
FILTER_BITS = 18
#: an n-gram this many times as common as its item's median one is no seed
COMMONER = 16


class Items:
    """Test items of one block: word hashes, n-grams and where they stand."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, size: int) -> None:
        self.ids, self.words, grams, item, at = ids, [], [], [], []
        for w in words(texts, NON_WORD):
            got, start = runs(w, size)
            for r in range(w.hi - w.lo):
                self.words.append(w.hashes[w.at[r] : w.at[r + 1]])
                mine = got[start[r] : start[r + 1]]
                grams.append(mine)
                item.append(np.full(len(mine), w.lo + r))
                at.append(np.arange(len(mine)))
        self.grams, self.item, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, item, at))
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.item, self.at = self.grams[order].astype(np.uint64), self.item[order], self.at[order]

    def only(self, keep: np.ndarray) -> None:
        self.grams, self.item, self.at = self.grams[keep], self.item[keep], self.at[keep]

    def filter(self) -> np.ndarray:
        flags = np.zeros(1 << FILTER_BITS, bool)
        flags[self.grams & np.uint64((1 << FILTER_BITS) - 1)] = True
        return flags


def _hits(grams: np.ndarray, known: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Positions in ``grams`` of values in the sorted ``known``."""
    maybe = np.flatnonzero(flags[grams & np.uint64((1 << FILTER_BITS) - 1)])
    if not len(maybe) or not len(known):
        return maybe[:0]
    spot = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
    return maybe[known[spot] == grams[maybe]]


def align(windows: np.ndarray, items: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman scores of many word windows against their items.

    Match 1, mismatch -1, gap -1. ``windows``: lanes x width, 0 for no word;
    ``items``: lanes x longest. One pass over the item words; a row's gaps
    along the window come from a running maximum.
    """
    lanes, width = windows.shape
    step = np.arange(width + 1, dtype=np.int32)
    row, best = np.zeros((lanes, width + 1), np.int32), np.zeros(lanes, np.int32)
    for k in range(items.shape[1]):
        score = np.where((windows == items[:, k : k + 1]) & (windows != 0), 1, -1)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + score, row[:, 1:] - 1)
        new = np.maximum(new, 0)
        new = np.maximum.accumulate(new + step, axis=1) - step
        row = np.where((k < lengths)[:, None], new, row)
        best = np.maximum(best, row.max(axis=1))
    return best


def _candidates(w: Words, items: Items, flags: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, items and window starts where a seed of an item occurs."""
    grams, at = runs(w, size)
    pos = _hits(grams, items.grams, flags)
    lo = np.searchsorted(items.grams, grams[pos], "left")
    n = np.searchsorted(items.grams, grams[pos], "right") - lo
    row = np.searchsorted(at, pos, "right") - 1
    seed = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
    row, pos = np.repeat(row, n), np.repeat(pos - at[row], n)
    item = items.item[seed]
    length = np.array([len(items.words[i]) for i in item], np.int64) if len(item) else np.zeros(0, np.int64)
    slack = length // 4 + 4
    start = (pos - items.at[seed]) // np.maximum(slack, 1) * slack - slack
    return np.unique(np.stack([row, item, start]), axis=1) if len(item) else np.zeros((3, 0), np.int64)


def _leaks(batch: pa.RecordBatch, items: Items, flags: np.ndarray, size: int, least: float) -> Iterator[pa.RecordBatch]:
    for w in words(batch.column(1), NON_WORD):
        row, item, start = _candidates(w, items, flags, size)
        best: dict[tuple[int, int], int] = {}
        # lanes of like length together, so padding stays small
        order = np.argsort([len(items.words[i]) for i in item], kind="stable") if len(item) else []
        for lo in range(0, len(order), LANES):
            pick = order[lo : lo + LANES]
            lengths = np.array([len(items.words[i]) for i in item[pick]])
            width = int((lengths + 3 * (lengths // 4 + 4)).max())
            from_, to = w.at[row[pick]], w.at[row[pick] + 1]
            at = (from_ + start[pick])[:, None] + np.arange(width)
            inside = (at >= from_[:, None]) & (at < to[:, None])
            windows = np.where(inside, w.hashes[np.clip(at, 0, len(w.hashes) - 1)], np.uint64(0))
            padded = np.zeros((len(pick), lengths.max()), np.uint64)
            for k, i in enumerate(item[pick]):
                padded[k, : lengths[k]] = items.words[i]
            for r, i, s in zip(row[pick], item[pick], align(windows, padded, lengths)):
                best[r, i] = max(best.get((r, i), 0), int(s))
        kept = [(r, i, s) for (r, i), s in best.items() if s >= least * len(items.words[i])]
        if kept:
            r, i, s = (np.array(x) for x in zip(*kept))
            lengths = np.array([len(items.words[k]) for k in i])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.lo + r)), pa.array(items.ids[i]), pa.array(s.astype(np.int64)), pa.array(s / lengths)], ["doc_id", "item_id", "score", "similarity"])


def _rare(items: Items, counts: dict[str, np.ndarray]) -> np.ndarray:
    """Of each item, its n-grams that are not far commoner than its median one.

    A leak that was copied often raises its item's counts alike; an edited
    copy lowers some. Neither loses seeds, while common phrases do.
    """
    order = np.argsort(counts["gram"].astype(np.int64).view(np.uint64))
    known, n = counts["gram"].astype(np.int64).view(np.uint64)[order], counts["n"].astype(np.int64)[order]
    seen = np.zeros(len(items.grams), np.int64)
    if len(known) and len(items.grams):
        spot = np.minimum(np.searchsorted(known, items.grams), len(known) - 1)
        seen = np.where(known[spot] == items.grams, n[spot], 0)
    keep = np.zeros(len(seen), bool)
    by = np.argsort(items.item, kind="stable")
    for own in np.split(by, np.flatnonzero(np.diff(items.item[by])) + 1) if len(by) else []:
        keep[own] = seen[own] <= COMMONER * (np.median(seen[own]) + 1)
    return keep


def _blocks(benchmark: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """Test items in blocks of bounded size, dealt by a hash of the id."""
    size = benchmark.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    parts = int(size // (4 * BLOCK_WORDS)) + 1
    for k in range(parts):
        part = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        table = part.orderBy("item_id", "text").toArrow().combine_chunks()
        if table.num_rows:
            yield {"ids": table.column("item_id").to_numpy(), "texts": table.column("text").combine_chunks()}


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 3, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs ``(doc_id, item_id, score, similarity)`` of texts that hold a test item.

    Words are lower-cased runs of letters and digits. First every n-gram of
    the items is counted over all texts. An item's seeds are those not far
    commoner than its median one, so common phrases start no alignment, while
    a leak that was copied often, or edited, keeps its seeds. Where a seed occurs, the words around it
    are aligned with the whole item (`align`); a pair is reported when the
    best score reaches ``least`` of the item's word count. Items are a query
    set: they are held in blocks of bounded size, against all texts.

    An item shorter than ``size`` words is found only as a text's whole
    wording. Null or empty texts and items, and items without an id, give no
    pair; repeated ids give one row each per text row; extra columns are
    ignored; empty tables give no rows.
    """
    docs = docs_of(docs, id_col, text_col)
    bench = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text].cast("string").alias("text")).where("item_id is not null and text is not null")
    spark, found = docs.sparkSession, None
    for block in _blocks(bench):
        items = Items(block["ids"], block["texts"], size)
        known = spark.sparkContext.broadcast((np.unique(items.grams), items.filter()))

        def count(batches, known=known):
            grams, flags = known.value
            n = np.zeros(len(grams), np.int64)
            for batch in batches:
                for w in words(batch.column(0), NON_WORD):
                    got, _ = runs(w, size)
                    n += np.bincount(np.searchsorted(grams, got[_hits(got, grams, flags)]), minlength=len(grams))
            yield pa.RecordBatch.from_arrays([pa.array(grams[n > 0].view(np.int64)), pa.array(n[n > 0])], ["gram", "n"])

        counts = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        items.only(_rare(items, bounded(counts, len(items.grams) + 1)))
        seeds = spark.sparkContext.broadcast((items, items.filter()))

        def find(batches, seeds=seeds):
            for batch in batches:
                yield from _leaks(batch, *seeds.value, size, least)

        part = docs.mapInArrow(find, "doc_id long, item_id long, score long, similarity double")
        found = part if found is None else found.union(part)
    return found if found is not None else docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("score"), F.lit(0.0).alias("similarity")).where("false")
