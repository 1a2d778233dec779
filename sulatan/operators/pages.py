"""Multi-page results, text reports, and unions over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sulatan.functions.baybayin import count_words, readable_time, strip_ws
from sulatan.functions.replies import is_finite

PAGES_PER_CHUNK = 64

# Report wording per language.
WORDING = {
    "en": {"title": "Baybayin to Latin result", "exported": "Exported", "result": "RESULT (IN LATIN)", "none": "(no text)",
           "characters": "Characters", "words": "Words", "lines": "Lines", "average": "Average confidence",
           "breakdown": "CHARACTER BREAKDOWN", "empty": "No individual characters detected.", "line": "Line"},
    "fil": {"title": "Resulta ng Baybayin sa Latin", "exported": "Na-export", "result": "RESULTA (SA LATIN)", "none": "(walang teksto)",
            "characters": "Karakter", "words": "Salita", "lines": "Linya", "average": "Karaniwang kumpiyansa",
            "breakdown": "BAWAT KARAKTER", "empty": "Walang nakitang karakter.", "line": "Linya"},
}


def combined_text(pages: DataFrame, keys: list[str], page: str = "page_no", text: str = "text", separator: str = "\n\n",
                  chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """Text of the read pages in page order, joined in two steps.

    Runs of ``chunk`` pages are joined in parallel; the second step only sees the
    joined runs. The result of one scan is one cell, as in the app, so a scan is
    limited by what a single cell can hold.
    """
    read = pages.filter("is_read").select(*keys, F.floor(F.col(page) / chunk).alias("_c"), page, strip_ws(text).alias("_t"))

    def joined(item: Column, order: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), item.alias("t")))), lambda x: x["t"]), separator)

    first = read.groupBy(*keys, "_c").agg(joined(F.col("_t"), page).alias("_run"))
    return first.groupBy(*keys).agg(joined(F.col("_run"), "_c").alias("combined_text"))


def combined_confidence(detections: DataFrame, keys: list[str], page: str = "page_no", by: str = "character",
                        confidence: str = "confidence") -> DataFrame:
    """Confidence of a whole scan: over all characters, or the mean of page values above 0."""
    if by == "character":
        ok = F.when(is_finite(confidence), F.col(confidence))
        return detections.groupBy(*keys).agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("combined_confidence"))
    if by == "page":
        means = detections.groupBy(*keys, page).agg(F.avg(F.when(is_finite(confidence), F.col(confidence))).alias("_m"))
        return means.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("_m") > 0, F.col("_m"))), F.lit(0.0)).alias("combined_confidence"))
    raise ValueError("by must be 'character' or 'page'")


def combined_pages(pages: DataFrame, keys: list[str], by: str = "page", separator: str = "\n\n") -> DataFrame:
    """Per scan: combined text, confidence of read pages, read and unread counts."""
    counts = pages.groupBy(*keys).agg(
        F.sum(F.col("is_read").cast("long")).alias("n_read"), F.sum((~F.col("is_read")).cast("long")).alias("n_unread"))
    conf = combined_confidence(pages.filter("is_read"), keys, by=by)
    out = counts.join(combined_text(pages, keys, separator=separator), keys, "left").join(conf, keys, "left")
    return out.fillna("", ["combined_text"]).fillna(0.0, ["combined_confidence"])


def report_text(text, filter_name, lines, created_at, average_confidence, character_count, language: str = "en",
                title: str | None = None, footer: str | None = None) -> Column:
    """The plain-text report of one page, built from the arrays of its row.

    ``lines`` is ``array<array<struct<char, confidence>>>``.
    """
    w = WORDING[language]
    c = {k: (F.col(v) if isinstance(v, str) else v) for k, v in {
        "text": text, "filter": filter_name, "lines": lines, "at": created_at, "avg": average_confidence, "n": character_count}.items()}

    def percent(x: Column) -> Column:
        # ordinary figures round half up as decimals, without a format read anew for each character
        usual = F.when((x > 0) & (x <= 1e6), F.concat(x.cast("decimal(9,1)").cast("string"), F.lit("%")))
        return usual.otherwise(F.format_string("%.1f%%", x))

    def number_line(ch: Column, j: Column) -> Column:
        padded = F.when(F.length(ch["char"]) < 4, F.rpad(ch["char"], 4, " ")).otherwise(ch["char"])
        return F.concat(F.lit("  "), (j + 1).cast("string"), F.lit(". "), padded, F.lit(" "), percent(ch["confidence"]), F.lit("\n"))

    def line_block(line: Column, i: Column) -> Column:
        head = F.concat(F.lit(f"\n{w['line']} "), (i + 1).cast("string"), F.lit(": "),
                        F.array_join(F.transform(line, lambda ch: ch["char"]), " "), F.lit("\n"))
        return F.concat(head, F.array_join(F.transform(line, number_line), ""))

    average = F.when(c["avg"] > 0, F.concat(F.lit(f"{w['average']}: "), F.round(c["avg"]).cast("long").cast("string"), F.lit("%\n"))).otherwise("")
    body = F.when(F.size(c["lines"]) == 0, F.lit(w["empty"] + "\n")).otherwise(F.array_join(F.transform(c["lines"], line_block), ""))
    return F.concat(
        F.lit(f"{title or w['title']}\n{w['exported']}: "), readable_time(c["at"]), F.lit(f"\n\n{w['result']}\n"),
        F.when(c["text"] == "", w["none"]).otherwise(c["text"]), F.lit("\n\nFilter: "), c["filter"],
        F.lit(f"\n{w['characters']}: "), c["n"].cast("string"), F.lit(f"\n{w['words']}: "), count_words(c["text"]).cast("string"),
        F.lit(f"\n{w['lines']}: "), F.size(c["lines"]).cast("string"), F.lit("\n"), average,
        F.lit(f"\n{w['breakdown']}\n"), body, F.lit(f"\n{footer}\n" if footer else ""))


def flatten_pages(*pages: DataFrame) -> DataFrame:
    """All rows of several page tables as one table."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


def new_pieces(pieces: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Distinct pieces that are not known yet."""
    return pieces.select(*on).distinct().join(known.select(*on), on, "left_anti")
