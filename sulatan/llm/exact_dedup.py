"""Exact duplicates: 128-bit content hashes, compared byte by byte inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sulatan.llm.store import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: groups with more than one row are broadcast up to this many (16 bytes of key each)
BROADCAST_GROUPS = 1 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; texts of one byte a character take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _small(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", hashed=content_hash, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row, by built-in functions.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. ``keep`` says which id stays, ``largest`` or ``smallest``. Rows are
    grouped by a 128-bit hash; inside a group of two or more, the least and
    the greatest text by bytes must be the same, which tasks check before and
    after the shuffle, so a group is never gathered. A group that holds
    different texts (a collision) is grouped again by hash and text.

    A null id ranks behind all others and is kept only if all ids are null;
    of rows that repeat the kept id and its text exactly one is kept; extra
    columns are ignored; an empty table gives no rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be largest or smallest")
    text = lower_ascii(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).withColumn("key", hashed(F.col("text")))
    # rows get a number that stays, so that rows alike in id and text can be told apart
    rows = save(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "hashed")
    groups = save(_members(rows, ["key"], keep).where("group_size > 1"), "groups")
    n_groups = groups.count()

    # whole texts move only for groups; copies in one task become one before they do
    member = texts.select("key", "text").join(_small(groups.select("key"), n_groups, broadcast_groups), "key", "left_semi") if n_groups <= broadcast_groups else texts.select("key", "text")
    ends = member.groupBy("key").agg(F.min("text").alias("first"), F.max("text").alias("last"))
    collided = save(ends.where("first <> last").select("key"), "collided")
    if collided.isEmpty():
        return _judged(rows, groups, ["key"], n_groups, broadcast_groups)

    # sha256 tells texts apart only once the bytes have: it names each distinct text of a collided hash
    odd = texts.join(collided, "key", "left_semi").groupBy("key", "text").agg(F.count("*").alias("n")).select("key", "text")
    part = odd.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    if part.count() != part.select("key", "text_sha256").distinct().count():
        raise ValueError("different texts share both hashes")
    fine = rows.join(collided, "key", "left_semi")
    split = save(_members(fine, ["key", "text_sha256"], keep).where("group_size > 1"), "split")
    alone = _judged(rows.join(collided, "key", "left_anti"), groups, ["key"], n_groups, broadcast_groups)
    return alone.unionByName(_judged(fine, split, ["key", "text_sha256"], n_groups, broadcast_groups))


def _members(rows: DataFrame, by: list[str], keep: str) -> DataFrame:
    """Size, kept id and kept row of each group; only sums and extremes are shuffled."""
    if keep == "largest":
        best, top = F.coalesce("doc_id", F.lit(-(1 << 63))), F.max_by
    else:
        best, top = F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.min_by
    last = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    return rows.groupBy(*by).agg(F.count("*").alias("group_size"), last.alias("keep_id"), top("row", best).alias("keep_row"))


def _judged(rows: DataFrame, groups: DataFrame, by: list[str], n_groups: int, broadcast_groups: int) -> DataFrame:
    """Each row beside its group; a row without one is alone.

    Up to the bound the groups are broadcast; beyond it, rows and groups are
    shuffled by hash and Spark splits the partition of a large group.
    """
    joined = rows.join(_small(groups, n_groups, broadcast_groups), by, "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row of ``docs`` per distinct text, with all its columns.

    Ties, nulls and repeated rows as in `exact_groups`; rows with equal id and text count as one.
    """
    kept = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    keyed = docs.withColumns({"_id": docs[id_col].cast("long"), "_sha": F.sha2(lower_ascii(F.coalesce(docs[text_col].cast("string"), F.lit(""))).cast("binary"), 256)})
    found = keyed.alias("d").join(kept.alias("k"), F.col("d._id").eqNullSafe(F.col("k._id")) & (F.col("d._sha") == F.col("k._sha")), "left_semi")
    return found.dropDuplicates(["_id", "_sha"]).drop("_id", "_sha")
