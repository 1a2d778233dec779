"""Recognition replies stored as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_replies(df: DataFrame, json: str = "json", out: str = "reply") -> DataFrame:
    """Add the reply as a variant; null when it is unusable.

    Unusable are: null or empty text, malformed JSON, JSON that is not an
    object, and objects that carry a non-null ``error``.
    """
    parsed = F.try_parse_json(json)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    failed = F.try_variant_get(parsed, "$.error", "variant")
    carries_error = failed.isNotNull() & ~F.is_variant_null(failed)
    return df.withColumn(out, F.when(is_object & ~F.coalesce(carries_error, F.lit(False)), parsed))


def reply_field(reply, name: str, kind: str = "string"):
    return F.try_variant_get(reply, f"$.{name}", kind)
