"""A training corpus in five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept, and returns the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sulatan.llm import decontamination, jaccard, quality_rules, secrets, sentencepiece_scan
from sulatan.llm.queries import PIECES
from sulatan.llm.store import read, save


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.good_rows(docs)


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` and ``_row``, a 64-bit hash of id and text: rows that repeat both share it, others do not."""
    return docs.withColumn("_row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (a null id only if all are null).

    Rows that repeat id and text become one; rows that only share an id, or
    have none, are judged by their own groups.
    """
    rows = _with_row(docs)
    groups = save(jaccard.jaccard_components(rows, "_row").select(F.col("doc_id").alias("_row"), "component_id"), "groups")
    more = groups.where("_row <> component_id").distinct()
    members = more.union(more.select(F.col("component_id").alias("_row"), "component_id").distinct()).join(rows.select("_row", "doc_id").distinct(), "_row")
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("m")).select("m._row")
    out = rows.join(save(members.select("_row").join(kept, "_row", "left_anti"), "copies"), "_row", "left_anti")
    again = groups.groupBy("_row").count().where("count > 1").select("_row")
    if again.isEmpty():
        return out.select(docs.columns)
    once = out.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return out.join(again, "_row", "left_anti").select(docs.columns).union(once.select(docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a test item, whatever other rows share their id."""
    rows = _with_row(docs)
    found = decontamination.leaks(rows, read(spark, sf_dir, "benchmark"), id_col="_row").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(found, "_row", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts (``n_chars`` follows)."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns) if "n_chars" in docs.columns else out


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_pieces)`` of all documents."""
    rows = sentencepiece_scan.encode(docs, public_tokenizers.path(PIECES))
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard", keep_one_of_group),
    ("decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("sentencepiece", to_pieces),
]

#: alignment scores, character models and piece lattices are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
