"""Word lists: one word per line, first CSV field, or every alphabetic token."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sulatan.functions.baybayin import strip_ws


@F.pandas_udf(StringType())
def nfc(words: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no built-in normalisation."""
    return words.map(lambda w: None if w is None else unicodedata.normalize("NFC", w))


def token_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct lower-cased ``[A-Za-z]+`` tokens of a text column."""
    per_row = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)))
    return df.select(F.explode(per_row).alias("word")).select(F.lower("word").alias("word")).distinct()


def line_words(df: DataFrame, line: str = "value", first_field: bool = False) -> DataFrame:
    """Distinct words of a table of lines: no byte-order mark, NFC, lower case."""
    word = F.regexp_replace(line, r"^\x{FEFF}", "")
    if first_field:
        word = F.split(word, ",")[0]
    plain = df.select(strip_ws(word).alias("word"))
    # only words outside ASCII can change under NFC, so only those visit Python
    ascii_only = plain.filter(F.col("word").rlike(r"^[\x00-\x7F]+$"))
    other = plain.filter(F.col("word").rlike(r"[^\x00-\x7F]")).select(nfc("word").alias("word"))
    return ascii_only.unionByName(other).select(F.lower("word").alias("word")).filter("word <> ''").distinct()


def read_wordlist(spark: SparkSession, path: str, mode: str = "line") -> DataFrame:
    """Load a word list file as a one-column table ``word``.

    ``mode``: ``line`` (whole line), ``csv`` (first field), ``tokens``.
    """
    lines = spark.read.text(path)
    if mode == "tokens":
        return token_words(lines, "value")
    if mode in ("line", "csv"):
        return line_words(lines, "value", first_field=mode == "csv")
    raise ValueError(f"unknown mode {mode!r}")
