"""Importance resampling towards a target distribution of hashed n-grams.

Separators collapse to single spaces; an overlapped regex then yields the span
of every run of n words, which goes straight into a CRC.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.llm.store import bounded, save

BUCKETS = 10_000
_SEPARATORS = regex.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())
#: bytes of collapsed text whose spans are held at a time
PIECE = 1 << 20


def run_pattern(longest: int):
    """A word between single spaces, and in groups of their own up to ``longest - 1`` words after it.

    Matched at every word's start, its spans are all runs of 1 to ``longest``
    words: a run ends where one of the groups does.
    """
    more = b""
    for _ in range(longest - 1):
        more = rb"(?:( [^ ]++)" + more + rb")?+"
    return regex.compile(rb"(?<![^ ])([^ ]++)" + more + rb"(?![^ ])")


def collapsed(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case and words between single spaces."""
    return _SEPARATORS.sub(b" ", (text or "").encode().translate(_LOWERED)).strip(b" ")


def _stretches(line: bytes, longest: int):
    """``(stretch, limit)``: the line cut at spaces; matches that start before ``limit`` belong to the stretch.

    A stretch reaches over its limit by the words that its last runs need.
    """
    begin = 0
    while len(line) - begin > PIECE:
        cut = line.find(b" ", begin + PIECE)
        if cut < 0:
            break
        end = cut
        for _ in range(longest - 1):
            end = line.find(b" ", end + 1)
            if end < 0:
                end = len(line)
                break
        yield line[begin:end], cut - begin
        begin = cut + 1
    yield line[begin:], len(line) - begin


def feature_buckets(line: bytes, pattern, longest: int, buckets: int) -> np.ndarray:
    """Bucket of every run of words of a collapsed text, repeats included.

    The CRC of a longer run goes on from that of the shorter one.
    """
    found: list[np.ndarray] = []
    for part, limit in _stretches(line, longest):
        crcs: list[int] = []
        for match in pattern.finditer(part, overlapped=True):
            if match.start() >= limit:
                break
            crc = 0
            for span in match.groups():
                if span is None:
                    break
                crc = crc32(span, crc)
                crcs.append(crc)
        found.append((np.array(crcs, np.int64) % buckets).astype(np.int32))
    return np.concatenate(found)


def _buckets_of(longest: int, buckets: int):
    width = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        pattern = run_pattern(longest)
        for batch in batches:
            words, sizes, packed = [], [], []
            for text in batch.column(1):
                line = collapsed(text.as_py())
                found = feature_buckets(line, pattern, longest, buckets)
                words.append(line.count(b" ") + 1 if line else 0)
                sizes.append(len(found))
                packed.append(found.astype(width).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return run, width


def bucket_rows(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)`` of ``texts(doc_id, text)``; buckets are packed integers."""
    run, _ = _buckets_of(longest, buckets)
    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows; every task sends one row per bucket at most."""
    width = _buckets_of(longest, buckets)[1]

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(np.frombuffer(cell.as_buffer(), width), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "n"])

    got = bounded(rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), buckets)
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].astype(np.int64)] = got["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` per bucket, in doubles."""
    b = float(len(source))
    odds = (target + 1.0) * (source.sum() + b) / ((source + 1.0) * (target.sum() + b))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def _weights(rows: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean gain of a row's features."""
    width = _buckets_of(longest, len(gains))[1]
    held = rows.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        table = held.value
        for batch in batches:
            weight = [int(table[x].sum()) // len(x) if len(x) else 0 for x in (np.frombuffer(c.as_buffer(), width) for c in batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _with_rank(rows: DataFrame, order: list, drawn: int) -> DataFrame:
    """Adds ``rank``, 1 for the first row in ``order``, null beyond ``drawn``.

    Rows are dealt by ranges of the order and sorted inside each; a row's
    place is its place in the range plus the rows of all earlier ranges. No
    range is gathered, and only one count per range goes to the driver.
    """
    low = (1 << 33) - 1
    placed = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    spark = rows.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, before long"))  # one row per partition of the sort
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(low)) + 1
    joined = placed.withColumn("part", F.shiftright("at", 33)).join(offsets, "part")
    return joined.withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, longest: int = 2, buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``.

    Features are all runs of 1 to ``longest`` words ``[^ASCII but a-z and 0-9]+``
    after lower-casing A-Z, repeats counted, hashed to ``buckets`` by CRC. A
    bucket gains where ``target(text)`` has it oftener than ``docs``; a row's
    weight is its mean gain, and its score adds Gumbel noise from a hash of
    its id, so the highest scores are a weighted draw without replacement:
    ``share`` percent (rounded down) of the rows with ``least_words`` words.

    Null and empty texts have no features and weight 0; a null id is hashed as
    the empty text and ranks last among equals; equal scores go to the smaller
    id; rows that repeat an id are drawn separately, equal ones in an order
    that a row number fixes; extra columns are ignored; an empty table gives
    no rows, an empty target counts 0 in every bucket.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), target[text_col].cast("string").alias("text"))
    rows = save(bucket_rows(texts, longest, buckets), "buckets")
    gains = gains_of(bucket_counts(rows, longest, buckets), bucket_counts(bucket_rows(wanted, longest, buckets), longest, buckets))

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = save(_weights(rows, gains, longest).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    ranked = _with_rank(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], share * n // 100)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(out).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(out))
