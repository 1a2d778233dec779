"""Giant texts as chunk rows that tasks can share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def short_and_long(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows of up to ``chunk`` characters (null: empty), and the other rows."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > chunk
    return docs.where(~long), docs.where(long)


def cut(long: DataFrame, chunk: int, ahead: int = 0, gap: str = " ") -> DataFrame:
    """``(row, doc_id, k, text, ahead, lead)``: each row's text in chunks, dealt over all tasks.

    ``row`` tells rows apart, also with equal ids; ``ahead`` holds the next
    few characters; ``lead`` is how far before the chunk the last run of
    ``gap`` (or the text) began.
    """

    def run(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                begin = 0
                for k, at in enumerate(range(0, len(text), chunk)):
                    spot = text.rfind(gap, begin, at + 1)
                    while spot > begin and text[spot - 1] == gap:
                        spot -= 1
                    begin = max(begin, spot)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([k], pa.int64()), pa.array([text[at : at + chunk]]), pa.array([text[at + chunk : at + chunk + ahead]]), pa.array([at - begin], pa.int64())], ["row", "doc_id", "k", "text", "ahead", "lead"])

    keyed = long.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return keyed.mapInArrow(run, "row long, doc_id long, k long, text string, ahead string, lead long").repartition("row", "k")
