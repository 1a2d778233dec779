"""Checks over transliterated text: rule consistency, pass rates, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.functions.baybayin import (CHART_LETTERS, FOREIGN_LETTERS, FOREIGN_PENALTY, GLYPHS, TWO_MARKS, VIRAMA,
                                        native_confidence, syllable_breakdown, transliterate)


def translate_table(df: DataFrame, text: str = "text", profile: str = "standard") -> DataFrame:
    """Add the Baybayin text and the confidence of every row."""
    return df.withColumns({"baybayin": transliterate(text, profile), "confidence": native_confidence(text, profile)})


def rule_violations(words: DataFrame, word: str = "word") -> DataFrame:
    """Per word: piece counts and the number of broken rules R2 to R9."""
    pieces = F.col("_pieces")
    cv = "^(ng|[bkdrghlmnpstwy])([aeiou])$"
    lone = "^(ng|[bkdrghlmnpstwy])$"

    def count(test):
        return F.size(F.filter(pieces, test)).cast("long")

    def mark_of(vowels: str):
        return rf"^(ng|[bkdrghlmnpstwy])[{vowels}]$"

    low = F.lower(F.col(word))
    foreign = F.regexp_count(low, F.lit(f"[{FOREIGN_LETTERS}]"))
    vowels = {"a": GLYPHS["a"], "e": GLYPHS["e"], "i": GLYPHS["i"], "o": GLYPHS["o"], "u": GLYPHS["u"]}
    lone_vowel = F.create_map(*[F.lit(x) for kv in vowels.items() for x in kv])
    df = words.select(word, syllable_breakdown(word).alias("_pieces"), transliterate(word).alias("_text"),
                      native_confidence(word).alias("_conf"))
    return df.select(
        word,
        F.size(pieces).cast("long").alias("pieces"),
        count(lambda p: p["latin"].rlike(cv)).alias("consonant_vowel"),
        count(lambda p: p["latin"].rlike(lone)).alias("lone_consonant"),
        (F.array_join(F.transform(pieces, lambda p: p["baybayin"]), "") != F.col("_text")).cast("long").alias("r2"),
        (~F.col("_text").rlike(r"^[\x{1700}-\x{1714}\x{1735}\x{1736}\s]*$")).cast("long").alias("r3"),
        (F.col("_conf") != F.greatest(F.lit(0.0), F.lit(100.0) - FOREIGN_PENALTY * foreign)).cast("long").alias("r4"),
        count(lambda p: (p["latin"].rlike(mark_of("ei")) & ~p["baybayin"].endswith(TWO_MARKS["i"]))
              | (p["latin"].rlike(mark_of("ou")) & ~p["baybayin"].endswith(TWO_MARKS["u"]))
              | (p["latin"].rlike(mark_of("a")) & (F.length(p["baybayin"]) != 1))).alias("r5"),
        count(lambda p: p["latin"].rlike(lone) & ~p["baybayin"].endswith(VIRAMA)).alias("r6"),
        count(lambda p: p["latin"].rlike("^[aeiou]$") & (p["baybayin"] != lone_vowel[p["latin"]])).alias("r7"),
        count(lambda p: p["latin"].rlike("^[dr]") & ~p["baybayin"].startswith(GLYPHS["d"])).alias("r8"),
        count(lambda p: p["latin"].startswith("ng") & ~p["baybayin"].startswith(GLYPHS["N"])).alias("r9"),
    )


RULES = ("r2", "r3", "r4", "r5", "r6", "r7", "r8", "r9")


def translation_rule_check(words: DataFrame, word: str = "word") -> DataFrame:
    """One row: words, pieces and violations per rule over a whole word list."""
    checked = rule_violations(words, word)
    names = ("pieces", "consonant_vowel", "lone_consonant", *RULES)
    return checked.agg(F.count(F.lit(1)).alias("words"), *[F.sum(n).alias(n) for n in names])


def rule_failures(words: DataFrame, word: str = "word", first: int = 20) -> DataFrame:
    """The first broken words, alphabetically, for a report."""
    broken = F.lit(0)
    for r in RULES:
        broken = broken + F.col(r)
    return rule_violations(words, word).filter(broken > 0).orderBy(word).limit(first)


def pass_rate(df: DataFrame, confidence: str = "confidence", at_least: float = 95.0, target: float = 0.95) -> DataFrame:
    """Share of rows at or above the cut, the mean, and whether the target is met."""
    passed = F.sum(F.when(F.col(confidence) >= at_least, 1).otherwise(0))
    out = df.agg(F.count(F.lit(1)).alias("total"), passed.cast("long").alias("passed"), F.avg(confidence).alias("average"))
    rate = F.col("passed") / F.greatest(F.col("total"), F.lit(1))
    return out.withColumns({"pass_rate": rate, "target_met": rate >= target})


def result_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Characters (no white space), words and lines of every text."""
    from sulatan.functions.baybayin import WS, count_words

    return df.withColumns({
        "n_characters": F.length(F.regexp_replace(text, f"[{WS}]+", "")).cast("long"),
        "n_words": count_words(text),
        "n_lines": F.size(F.split(text, "\n")).cast("long"),
    })


def script_chart(words: DataFrame, word: str = "word") -> DataFrame:
    """The letter chart with its glyphs and how many words use each letter."""
    spark = words.sparkSession
    chart = spark.createDataFrame(CHART_LETTERS, "letter string, syllable string")
    chart = chart.withColumn("baybayin", transliterate("syllable"))
    marked = F.upper(F.replace(F.lower(F.col(word)), F.lit("ng"), F.lit("_")))
    used = F.array_distinct(F.regexp_extract_all(marked, F.lit("[A-Z_]"), F.lit(0)))
    letters = words.select(F.explode(used).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n_words"))
    letters = letters.withColumn("letter", F.when(F.col("letter") == "_", "NG").otherwise(F.col("letter")))
    return chart.join(letters, "letter", "left").fillna(0, ["n_words"])
