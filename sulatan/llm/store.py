"""Tables written below the shared checkpoint folder, and bounded collects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sulatan.session import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stored table, file or folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    A lost executor then costs a re-read, not a recomputation.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int) -> dict[str, np.ndarray]:
    """The columns of a table that its construction bounds to ``most`` rows.

    Raises if the bound does not hold; nothing is cut off.
    """
    table = df.toArrow()
    if table.num_rows > most:
        raise ValueError(f"{table.num_rows} rows where at most {most} can be")
    return {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names}


def docs_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just id and text, under fixed names, so other columns cannot clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


#: bits of the filter that picks texts by id before a join
FILTER_BITS = 1 << 22


def texts_in(docs: DataFrame, wanted: DataFrame, then=None, schema: str = "doc_id long, text string") -> DataFrame:
    """``(doc_id, text)`` rows that may be in ``wanted(doc_id)``; a join follows.

    A bit table of fixed size, whatever the number of ids, keeps most other
    texts out of the join's shuffle. ``then`` takes the batches that are left
    in the same worker and gives those of ``schema``.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = wanted.select(spot.alias("s")).select((F.col("s") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = bounded(bits, FILTER_BITS // 64)
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[got["w"].astype(np.int64)] = got["b"].astype(np.int64)
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(np.unpackbits(table.view(np.uint8), bitorder="little")))

    def keep(batches):
        on = np.unpackbits(flags.value).astype(bool)
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(on[batch.column(2).to_numpy()]))

    def run(batches):
        yield from then(keep(batches)) if then else keep(batches)

    return docs.select("doc_id", "text", spot.alias("s")).mapInArrow(run, schema)


def held_out() -> "F.Column":
    """The fold that is never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, text, label)`` of the rows outside the held-out fold that have a label of 0 or 1.

    An id with several labels counts with the larger one.
    """
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    # a sort-merge join at every size: labels grow with the texts
    return texts_in(docs.where("doc_id is not null"), rows).join(rows.hint("merge"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
