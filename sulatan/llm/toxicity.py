"""Toxicity by two class-conditional Kneser-Ney models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.llm.learn import logistic, logistic_score
from sulatan.llm.store import bounded, docs_of, held_out, labelled, save
from sulatan.llm.words import NON_WORD, Words, mix, words

#: absolute discount; words of a passage
DISCOUNT, PASSAGE = 0.75, 4
#: a class keeps at least this share for what it has not seen
LEAST_REST = 1e-3
#: bytes of the texts that look up their counts together
BLOCK_BYTES = 8 << 20
#: keys of a block that are asked for at once
AT_ONCE = 1 << 21
#: bits of the table that tells which keys the model may have
MODEL_BITS = 1 << 26
#: of a word: lower-order probability, share left to it as a context, and its pairs' count, in the toxic and the other class
VALUES = ("v_1", "v_0", "left_1", "left_0", "size_1", "size_0")
#: what a block gets back from a part of the model: its pairs and their counts, its words and their values
ANSWER = {"block": "long", "pair": "binary", "n": "binary", "word": "binary", "x": "binary"}
#: labelled texts, at most, that fit the final scale
CALIBRATION_TEXTS = 20_000


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the one before it (0 at a text's start), and that word's hash."""
    before = np.concatenate([np.zeros(1, np.uint64), w.hashes[:-1]]) if len(w.hashes) else w.hashes
    before[w.at[:-1][np.diff(w.at) > 0]] = 0
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + w.hashes), before


def _per_text(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once per text."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[first], row[first]


def _find(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted ``known``, or its length."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    spot = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[spot] == values, spot, len(known))


def _text_counts(batches):
    """Texts per pair and class, summed per batch, with the pair's first word."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        keys, sides, before = [], [], []
        for w in words(batch.column(0), NON_WORD):
            values, first = _pairs(w)
            got, row = _per_text(values, w.rows())
            known, at = np.unique(values, return_index=True)
            keys.append(got)
            sides.append(label[w.lo + row])
            before.append(first[at[_find(known, got)]])
        if not keys:
            continue
        key, side, first = np.concatenate(keys), np.concatenate(sides), np.concatenate(before)
        uniq, at, which = np.unique(key, return_index=True, return_inverse=True)
        toxic = np.bincount(which, weights=side, minlength=len(uniq)).astype(np.int64)
        every = np.bincount(which, minlength=len(uniq)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(first[at].view(np.int64)), pa.array(toxic), pa.array(every - toxic)], ["key", "before", "toxic", "other"])


def _continuations(batches):
    """Distinct words before each word, in both classes together and in each, summed per batch."""
    for batch in batches:
        key, before, n_1, n_0 = (c.to_numpy() for c in batch.columns)
        word, which = np.unique(_second(key.view(np.uint64), before.view(np.uint64)), return_inverse=True)
        sums = (np.bincount(which, weights=x, minlength=len(word)).astype(np.int64) for x in (np.ones(len(key)), n_1 > 0, n_0 > 0))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *map(pa.array, sums)], ["key", "n", "n_1", "n_0"])


def _features(ratio: np.ndarray, w: Words) -> np.ndarray:
    """Per text: mean ratio, the best passage's, how many passages stand out, and the length."""
    n = np.diff(w.at)
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    rows = w.rows()
    end = np.minimum(np.arange(len(ratio)) + PASSAGE, np.repeat(w.at[1:], n))
    passage = (total[end] - total[np.arange(len(ratio))]) / PASSAGE
    best = np.full(len(n), -20.0)
    np.maximum.at(best, rows, passage)
    mean = (total[w.at[1:]] - total[w.at[:-1]]) / np.maximum(n, 1)
    strong = np.bincount(rows, weights=ratio > 3, minlength=len(n))
    return np.column_stack([mean, np.where(n > 0, best, 0.0), np.log1p(strong), strong / np.maximum(n, 1), np.log1p(n)])


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte: high bytes are mostly zero and vanish in a compressed shuffle."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _wanted(bits, part_bits: int):
    """Every word and pair of the texts that the model may have, about once per block, packed per block and part of the model: rows come by block."""

    def once(found: list[np.ndarray]) -> pa.RecordBatch:
        of, key = np.concatenate(found, axis=1)
        order = np.lexsort((key, of))
        of, key = of[order], key[order]
        first = np.ones(len(key), bool)
        first[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        of, key = of[first], key[first]
        part = key >> np.uint64(64 - part_bits)
        cut = np.flatnonzero((of[1:] != of[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate([[0], cut])
        packed = [_packed(k) for k in np.split(key, cut)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(of[starts].view(np.int64)), pa.array(packed, pa.binary())], ["part", "block", "keys"])

    def run(batches):
        found, n = [], 0
        for batch in batches:
            block = batch.column(0).to_numpy()
            for w in words(batch.column(2), NON_WORD):
                every = block[w.lo : w.hi]
                found.append(np.stack([every.view(np.uint64), np.zeros(len(every), np.uint64)]))  # 0: a text's start
                of = every[w.rows()]
                for key in (w.hashes, _pairs(w)[0]):
                    spot = _spots(key)
                    hit = bits.value[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1 > 0
                    found.append(np.stack([of[hit].view(np.uint64), key[hit]]))
                    n += len(found[-1][0])
                if n > AT_ONCE:
                    yield once(found)
                    found, n = [], 0
        if found:
            yield once(found)

    return run


def _answers(wanted: pa.Table, model: pa.Table) -> pa.Table:
    """What a part of the model holds of the keys asked for, one row per question."""
    key = _column(model, "key").to_numpy().view(np.uint64)
    of_word = _column(model, "x").is_valid().to_numpy(zero_copy_only=False)
    word, pair = np.flatnonzero(of_word), np.flatnonzero(~of_word)
    word, pair = word[np.argsort(key[word])], pair[np.argsort(key[pair])]
    values = _column(model, "x").take(pa.array(word)).flatten().to_numpy().reshape(-1, len(VALUES))
    counts = _column(model, "n").to_numpy()[pair]
    out = {name: [] for name in ANSWER}
    for block, asked in zip(wanted.column("block").to_pylist(), wanted.column("keys").to_pylist()):
        asked = _unpacked(asked)
        of_words, of_pairs = (s[s < len(known)] for known in (key[word], key[pair]) for s in [_find(known, asked)])
        numbers = (counts[of_pairs].view(np.uint8).reshape(-1, 8).T.tobytes(), values[of_words].T.tobytes())
        for name, value in zip(ANSWER, (block, _packed(key[pair][of_pairs]), numbers[0], _packed(key[word][of_words]), numbers[1])):
            out[name].append(value)
    return pa.table({name: pa.array(column, pa.int64() if name == "block" else pa.binary()) for name, column in out.items()})


def _spots(key: np.ndarray) -> np.ndarray:
    """Bit of each key, the same as `_bit_table` takes."""
    return (key & np.uint64(MODEL_BITS - 1)).astype(np.int64)


def _bit_table(model: DataFrame) -> np.ndarray:
    """Which keys the model may have, in a fixed number of bits: a fuller table only lets more through."""
    spot = F.col("key").bitwiseAND(F.lit(MODEL_BITS - 1))
    rows = model.select(F.shiftright(spot, 6).alias("w"), F.expr(f"shiftleft(1L, cast((key & {MODEL_BITS - 1}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = bounded(rows, MODEL_BITS // 64)
    table = np.zeros(MODEL_BITS // 64, np.int64)
    table[got["w"].astype(np.int64)] = got["b"].astype(np.int64)
    return np.packbits(np.unpackbits(table.view(np.uint8), bitorder="little"))


def _column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name).combine_chunks()
    return got if isinstance(got, pa.Array) else got.chunk(0)


def _scorer(rest: tuple[float, float]):
    """Features of a block's texts from the counts of its words and pairs; ``rest``: what a class keeps for unseen words."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64()))})
        def all_of(name: str, read, none) -> np.ndarray:
            return np.concatenate([none, *map(read, found.column(name).to_pylist())])

        no_key, no_value = np.empty(0, np.uint64), np.empty((0, len(VALUES)))
        pair, word = all_of("pair", _unpacked, no_key), all_of("word", _unpacked, no_key)
        by_pair, by_word = np.argsort(pair), np.argsort(word)
        counted = all_of("n", lambda n: np.frombuffer(n, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel(), np.empty(0, np.int64))[by_pair]
        pairs_of = (counted & 0xFFFFFFFF, counted >> 32)
        x = dict(zip(VALUES, all_of("x", lambda x: np.frombuffer(x).reshape(len(VALUES), -1).T, no_value)[by_word].T))
        word, pair = word[by_word], pair[by_pair]
        out = []
        for w in words(_column(texts, "text"), NON_WORD):
            two, before = _pairs(w)
            own, context, both = _find(word, w.hashes), _find(word, before), _find(pair, two)
            ratio = np.zeros(len(two))
            for k, sign in ((1, 1), (0, -1)):
                # a word of no labelled text has the share ``q`` of both classes, which cancels
                p = np.append(x[f"v_{k}"], rest[k])[own]
                left, size = np.append(x[f"left_{k}"], 1.0)[context], np.append(x[f"size_{k}"], 1.0)[context]
                n = np.append(pairs_of[k], 0)[both]
                ratio += sign * np.log(np.maximum(n - DISCOUNT, 0) / size + left * p)
            out += list(_features(ratio, w))
        return pa.table({"doc_id": texts.column("doc_id"), "x": pa.array(out, pa.list_(pa.float64()))})

    return run


def fit_counts(train: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """Kneser-Ney models of both classes from ``train(text, label)``, as a table; and what each class keeps for unseen words.

    ``p(w|u) = max(c(u,w) - D, 0) / c(u) + rest(u) p(w)`` in each class, with
    the class's continuation counts as the lower order: ``p(w) = max(N(w) -
    D, 0) / N + rest q(w)``, ``N(w)`` being the distinct words before w and N
    the distinct pairs. ``q`` is the share of continuations in both classes
    together, so what a class has not seen says nothing. ``c`` counts texts:
    a repeated line or phrase counts once per text.

    Every pair of a labelled text is a row with its counts packed in ``n``
    (toxic in the upper half), every word (and 0, a text's start) one with
    `VALUES` in ``x``.
    """
    pair = save(train.select("text", "label").mapInArrow(_text_counts, "key long, before long, toxic long, other long").groupBy("key").agg(F.min("before").alias("before"), F.sum("toxic").alias("n_1"), F.sum("other").alias("n_0")), "toxic_pairs")
    word = pair.mapInArrow(_continuations, "key long, n long, n_1 long, n_0 long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "n_1", "n_0")))
    word = save(word, "toxic_words")
    sums = word.agg(F.sum("n").alias("n"), *(f(k).alias(f"{name}_{k}") for k in (0, 1) for name, f in (("all", lambda k: F.sum(f"n_{k}")), ("kinds", lambda k: F.count_if(F.col(f"n_{k}") > 0))))).first()
    total = sums["n"] or 1
    size = [max(sums[f"all_{k}"] or 0, 1) for k in (0, 1)]
    rest = tuple(max(DISCOUNT * sums[f"kinds_{k}"] / size[k], LEAST_REST) for k in (0, 1))

    over = lambda k: F.greatest(F.col(f"n_{k}") - DISCOUNT, F.lit(0.0))
    context = pair.groupBy(F.col("before").alias("key")).agg(*(f for k in (0, 1) for f in (F.sum(f"n_{k}").alias(f"sum_{k}"), F.sum(over(k)).alias(f"over_{k}"))))
    both = word.join(context, "key", "full").na.fill(0)
    for k in (0, 1):
        seen = F.col(f"sum_{k}") > 0
        both = both.withColumn(f"size_{k}", F.greatest(F.col(f"sum_{k}"), F.lit(1)))
        both = both.withColumn(f"left_{k}", F.when(seen, F.greatest(1 - F.col(f"over_{k}") / F.col(f"size_{k}"), F.lit(LEAST_REST))).otherwise(1.0))
        both = both.withColumn(f"v_{k}", over(k) / size[k] + rest[k] * F.col("n") / total)
    of_words = save(both.select("key", F.lit(0).cast("long").alias("n"), F.array(*(F.col(c).cast("double") for c in VALUES)).alias("x")), "toxic_values")
    of_pairs = pair.select("key", (F.shiftleft("n_1", 32) + F.col("n_0")).alias("n"), F.lit(None).cast("array<double>").alias("x"))
    return of_words.union(of_pairs), rest


def text_features(docs: DataFrame, model: DataFrame, rest: tuple[float, float]) -> DataFrame:
    """``(doc_id, x)`` of every row.

    Texts are dealt to blocks by id and text; a block asks for those of its
    words and pairs that the model may have, packed per part of the model. The
    model is cut by key into parts whose number grows with the texts, and is
    never in one place.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(size // BLOCK_BYTES, tasks)
    part_bits = max(int(max(blocks // 4, tasks) - 1).bit_length(), 1)
    # dealt once, for the questions and for the scores
    placed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text").repartition("block").sortWithinPartitions("block")
    bits = spark.sparkContext.broadcast(_bit_table(model))
    wanted = placed.mapInArrow(_wanted(bits, part_bits), "part int, block long, keys binary")
    parts = model.withColumn("part", F.shiftrightunsigned("key", 64 - part_bits).cast("int"))
    found = wanted.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(_answers, ", ".join(f"{k} {v}" for k, v in ANSWER.items()))
    return placed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scorer(rest), "doc_id long, x array<double>")


def _second(pair: np.ndarray, before: np.ndarray) -> np.ndarray:
    """`mix` is a bijection; its inverse gives back the second word's hash."""
    h = pair ^ (pair >> np.uint64(32))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    h = h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))
    h = h * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    return h - before * np.uint64(0x9E3779B97F4A7C15)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted, log_ratio)`` of every row.

    The two models are learned from the labelled rows outside the held-out
    fold, four fifths of them; the last fifth (at most `CALIBRATION_TEXTS`)
    fits a logistic scale over the length-normalised log-likelihood ratio of
    the text, of its best passage, and the length. ``log_ratio`` is the
    text's ratio per word. Only words enter a score. All counts are kept, in
    tables that grow with the texts.

    Null and empty texts get the score of a text without evidence; a null id
    counts as not held out; repeated rows score alike (and count again when
    labelled); unlabelled input scores 0.5; extra columns are ignored; an
    empty table gives no rows.
    """
    docs = docs_of(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = save(labelled(docs, labels, "toxic"), "toxic_train").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))
    rated = save(text_features(docs, *fit_counts(rows.where("part > 0"))), "toxic_features")

    part = rows.where("part = 0").select("doc_id", "label").distinct()
    keep = CALIBRATION_TEXTS / max(part.count(), 1)
    if keep < 1:
        part = part.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(keep * 1_000_003 * 0.95))
    sample = rated.join(part.hint("merge"), "doc_id").select("x", "label").toArrow()
    model = None
    if sample.num_rows:
        x, y = np.array(sample.column("x").to_pylist()), sample.column("label").to_numpy().astype(float)
        model = logistic(x, y)
    fitted = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, -1)
            s = logistic_score(fitted.value, x) if fitted.value is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(x[:, 0] if len(x) else s)], ["doc_id", "score", "log_ratio"])

    out = rated.mapInArrow(score, "doc_id long, score double, log_ratio double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "log_ratio")
