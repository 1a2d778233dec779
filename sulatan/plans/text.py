"""Queries on text: transliteration, syllables, rules, counts, time labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sulatan.functions import baybayin as B
from sulatan.operators import text as T
from sulatan.plans import views as V
from sulatan.plans.views import with_views
from sulatan.sources.wordlist import line_words

WS = B.WS
BLOCK = r"[\x{1700}-\x{171F}\x{1735}\x{1736}]"


# --- SQL building blocks ------------------------------------------------------

def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_mga(e: str, to: str = "maNa") -> str:
    for _ in range(2):
        e = f"regexp_replace({e}, '(^|[^A-Za-z0-9_])mga([^A-Za-z0-9_]|$)', '\\1{to}\\2', 'g')"
    return e


def sql_prepare(e: str) -> str:
    return f"replace(lower({sql_strip(f'regexp_replace({e}, chr(1) || {chr(39)}|{BLOCK}{chr(39)}, {chr(39)}-{chr(39)}, {chr(39)}g{chr(39)})')}), 'ng', 'N')"


def sql_spell(e: str, marks: dict[str, str] = B.TWO_MARKS, ra: str = B.GLYPHS["r"], punct: bool = True) -> str:
    e = f"regexp_replace({e}, '([N{B.CONSONANTS}])', '\\1{B.VIRAMA}', 'g')"
    for vowel, mark in marks.items():
        e = f"replace({e}, '{B.VIRAMA}{vowel}', '{mark}')"
    letters = dict(B.GLYPHS, r=ra)
    if punct:
        letters |= {".": B.DOUBLE_DANDA, ",": B.DANDA}
    for latin, glyph in letters.items():
        e = f"replace({e}, '{latin}', '{glyph}')"
    return e


def sql_keep(e: str, extra: str) -> str:
    return f"regexp_replace({e}, '[^\\x{{1700}}-\\x{{1716}}{extra}]+', '', 'g')"


PUNCT = B.DANDA + B.DOUBLE_DANDA


def sql_standard(e: str) -> str:
    return sql_keep(sql_spell(sql_mga(sql_prepare(e))), PUNCT + WS)


def sql_confidence(e: str) -> str:
    clean = f"lower({sql_strip(e)})"
    return (f"CASE WHEN {clean} = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE - 15 * "
            f"len(regexp_extract_all({clean}, '[{B.FOREIGN_LETTERS}]'))) END")


_PIECE = f"M|[N{B.CONSONANTS}]?[aeiou]|[N{B.CONSONANTS}]|[{WS}]+|[.,]"
_PIECES_SQL = f"regexp_extract_all({sql_mga(sql_prepare('text'), 'M')}, '{_PIECE}')"


def _sql_piece(e: str) -> str:
    return sql_spell(f"replace({e}, 'M', 'maNa')")


def _breakdown(spark, sf):
    df = V.v_text(spark, sf).withColumn("p", B.syllable_breakdown("text"))
    return df.select("src", "id", F.size("p").cast("long").alias("n_pieces"),
                     F.array_join("p.latin", "|").alias("latin"), F.array_join("p.baybayin", "|").alias("baybayin"))


def _marked(spark, sf):
    words = V.v_vocab(spark, sf).select(F.replace("word", F.lit("x"), F.lit("?")).alias("word")).distinct()
    return words.select("word", B.transliterate_marked("word").alias("baybayin"))


def _paragraphs(spark, sf):
    return V.v_text(spark, sf).select("src", "id", B.format_paragraph(F.split("text", "\n")).alias("paragraph"))


def _time_labels(spark, sf):
    ev = V.table(spark, sf, "events")
    return ev.select("event_id", B.file_stamp("ts").alias("stamp"), B.file_stamp_millis("ts").alias("stamp_ms"),
                     B.readable_time("ts").alias("readable"))


def _pass_rate(spark, sf):
    scored = V.v_text(spark, sf).select("src", B.native_confidence("text").alias("confidence"))
    words = V.v_vocab(spark, sf).select(F.lit("vocabulary").alias("src"), B.native_confidence("word").alias("confidence"))
    return T.pass_rate(scored.unionByName(words), target=0.5)


QUERIES = {
    "transliterate": lambda s, d: T.translate_table(V.v_text(s, d)).drop("text"),
    "transliterate_four_mark": lambda s, d: T.translate_table(V.v_text(s, d), profile="four_mark").drop("text"),
    "transliterate_words_only": lambda s, d: V.v_text(s, d).select("src", "id", B.transliterate("text", "words_only").alias("baybayin")),
    "syllable_breakdown": _breakdown,
    "native_confidence": lambda s, d: V.v_text(s, d).select("src", "id", B.native_confidence("text").alias("confidence")),
    "transliterate_marked": _marked,
    "format_paragraph": _paragraphs,
    "script_chart": lambda s, d: T.script_chart(V.v_vocab(s, d)),
    "time_labels": _time_labels,
    "result_counts": lambda s, d: T.result_counts(V.v_text(s, d)).drop("text"),
    "pass_rate": _pass_rate,
    "translation_rule_check": lambda s, d: T.translation_rule_check(V.v_vocab(s, d)),
    "wordlist_load": V.v_vocab,
    "wordlist_lines": lambda s, d: line_words(V.v_lines(s, d), "line"),
    "wordlist_first_field": lambda s, d: line_words(V.v_lines(s, d), "line", first_field=True),
}

_CHART = ", ".join(f"('{a}', '{b}')" for a, b in B.CHART_LETTERS)

ORACLES = {
    "transliterate": with_views(f"SELECT src, id, {sql_standard('text')} AS baybayin, {sql_confidence('text')} AS confidence FROM v_text", "v_text"),
    "transliterate_four_mark": with_views(f"""
        SELECT src, id, CASE WHEN {sql_prepare('text')} = 'mga' THEN '{B.GLYPHS["m"] + B.GLYPHS["g"]}' ELSE
               {sql_keep(sql_spell(sql_prepare('text'), B.FOUR_MARKS, B.RA_GLYPH), PUNCT + WS)} END AS baybayin,
               CASE WHEN text = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE - 15 *
               len(regexp_extract_all(lower(text), '[{B.FOREIGN_LETTERS}]'))) END AS confidence FROM v_text""", "v_text"),
    "transliterate_words_only": with_views(f"""
        SELECT src, id, array_to_string(list_transform(string_split(lower(text), chr(10)), lambda line:
            array_to_string(list_filter(list_transform(regexp_extract_all(line, '[a-z]+'), lambda w:
                {sql_keep(sql_spell("CASE WHEN w = 'mga' THEN 'maNa' ELSE replace(w, 'ng', 'N') END", punct=False), '')}),
                lambda b: b <> ''), ' ')), chr(10)) AS baybayin FROM v_text""", "v_text"),
    "syllable_breakdown": with_views(f"""
        SELECT src, id, len(p)::BIGINT AS n_pieces,
               array_to_string(list_transform(p, lambda t: replace(replace(t, 'N', 'ng'), 'M', 'mga')), '|') AS latin,
               array_to_string(list_transform(p, lambda t: {_sql_piece('t')}), '|') AS baybayin
        FROM (SELECT src, id, {_PIECES_SQL} AS p FROM v_text)""", "v_text"),
    "native_confidence": with_views(f"SELECT src, id, {sql_confidence('text')} AS confidence FROM v_text", "v_text"),
    "transliterate_marked": with_views(f"""
        SELECT word, array_to_string(list_transform(string_split(word, '?'), lambda c:
               {sql_keep(sql_spell("CASE WHEN c = 'mga' THEN 'maNa' ELSE replace(c, 'ng', 'N') END", punct=False), '')}), '?') AS baybayin
        FROM (SELECT DISTINCT replace(word, 'x', '?') AS word FROM v_vocab)""", "v_vocab"),
    "format_paragraph": with_views(f"""
        SELECT src, id, upper(substr(p, 1, 1)) || substr(p, 2) AS paragraph FROM (
          SELECT src, id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
                 lambda l: lower({sql_strip('l')})), lambda l: l <> ''), chr(10)) AS p FROM v_text)""", "v_text"),
    "script_chart": with_views(f"""
        SELECT letter, syllable, {sql_standard('syllable')} AS baybayin,
               (SELECT count(*) FROM v_vocab WHERE contains(upper(replace(word, 'ng', '_')), CASE letter WHEN 'NG' THEN '_' ELSE letter END))
               AS n_words
        FROM (VALUES {_CHART}) t(letter, syllable)""", "v_vocab"),
    "time_labels": """
        SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y%m%d_%H%M%S') || '_' || strftime(ts, '%g') AS stamp_ms,
               strftime(ts, '%Y-%m-%d %H:%M') AS readable FROM events""",
    "result_counts": with_views(f"""
        SELECT src, id, length(regexp_replace(text, '[{WS}]+', '', 'g'))::BIGINT AS n_characters,
               len(regexp_extract_all(text, '[^{WS}]+'))::BIGINT AS n_words, len(string_split(text, chr(10)))::BIGINT AS n_lines
        FROM v_text""", "v_text"),
    "pass_rate": with_views(f"""
        WITH c AS (SELECT {sql_confidence('text')} AS confidence FROM v_text UNION ALL SELECT {sql_confidence('word')} FROM v_vocab)
        SELECT count(*) AS total, sum(CASE WHEN confidence >= 95 THEN 1 ELSE 0 END)::BIGINT AS passed, avg(confidence) AS average,
               sum(CASE WHEN confidence >= 95 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS pass_rate,
               sum(CASE WHEN confidence >= 95 THEN 1 ELSE 0 END)::DOUBLE / count(*) >= 0.5 AS target_met FROM c""", "v_text", "v_vocab"),
    "translation_rule_check": with_views(f"""
        WITH w AS (SELECT word, regexp_extract_all({sql_mga(sql_prepare('word'), 'M')}, '{_PIECE}') AS p FROM v_vocab)
        SELECT count(*) AS words, sum(len(p))::BIGINT AS pieces,
               sum(len(list_filter(p, lambda t: regexp_full_match(t, '[N{B.CONSONANTS}][aeiou]'))))::BIGINT AS consonant_vowel,
               sum(len(list_filter(p, lambda t: regexp_full_match(t, '[N{B.CONSONANTS}]'))))::BIGINT AS lone_consonant,
               {', '.join(f'0::BIGINT AS {r}' for r in T.RULES)} FROM w""", "v_vocab"),
    "wordlist_load": with_views("SELECT word FROM v_vocab", "v_vocab"),
    "wordlist_lines": with_views(f"""
        SELECT DISTINCT lower(nfc_normalize({sql_strip("regexp_replace(line, '^' || chr(65279), '')")})) AS word FROM v_lines
        WHERE {sql_strip("regexp_replace(line, '^' || chr(65279), '')")} <> ''""", "v_lines"),
    "wordlist_first_field": with_views(f"""
        SELECT DISTINCT lower(nfc_normalize({sql_strip("string_split(line, ',')[1]")})) AS word FROM v_lines
        WHERE {sql_strip("string_split(line, ',')[1]")} <> ''""", "v_lines"),
}
