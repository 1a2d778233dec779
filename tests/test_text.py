import random
import re

from pyspark.sql import functions as F

from sulatan.functions import baybayin as B
from sulatan.operators import text as T
from sulatan.sources.wordlist import line_words, read_wordlist

G = B.GLYPHS
I, U, V = "ᜒ", "ᜓ", "᜔"


def column(spark, texts, expr):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expr.alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def plain_pieces(text):
    """Piece by piece, the way the rules are written down."""
    text = text.lower().strip().replace("ng", "N")
    out = []
    for m in re.finditer(r"\bmga\b|[Nbkdrghlmnpstwy]?[aeiou]|[Nbkdrghlmnpstwy]|\s+|[.,]", text, re.ASCII):
        p = m.group()
        if p == "mga":
            b = G["m"] + G["N"]
        elif p.isspace():
            b = p
        elif p in ".,":
            b = {".": B.DOUBLE_DANDA, ",": B.DANDA}[p]
        elif p in "aeiou":
            b = G[p]
        elif len(p) == 2:
            b = G[p[0]] + B.TWO_MARKS[p[1]]
        else:
            b = G[p] + V
        out.append((p.replace("N", "ng"), b))
    return out


def test_stated_examples(spark):
    cases = {"a": G["a"], "e": G["i"], "o": G["u"], "ba": G["b"], "be": G["b"] + I, "bu": G["b"] + U, "nga": G["N"], "ngo": G["N"] + U,
             "lakad": G["l"] + G["k"] + G["d"] + V, "mga": G["m"] + G["N"], "mga bahay": G["m"] + G["N"] + " " + G["b"] + G["h"] + G["y"] + V,
             "ra": G["d"], "r": G["d"] + V, "sige.": G["s"] + I + G["g"] + I + B.DOUBLE_DANDA, "123": "", "ñ": "", "😀": "", "\t\n": "", "": ""}
    assert column(spark, list(cases), B.transliterate("t")) == list(cases.values())
    texts = ["bahay", "taxi", "cfjqzvx", "", "   "]
    assert column(spark, texts, B.native_confidence("t")) == [100.0, 85.0, 0.0, 0.0, 0.0]
    assert column(spark, ["   "], B.native_confidence("t", "four_mark")) == [100.0]


def test_profiles(spark):
    assert column(spark, ["mga", "re mga"], B.transliterate("t", "four_mark")) == [G["m"] + G["g"], "ᜍ᜕ " + G["m"] + V + G["g"]]
    assert column(spark, ["ang x bahay!\nmga"], B.transliterate("t", "words_only")) == [
        G["a"] + G["N"] + V + " " + G["b"] + G["h"] + G["y"] + V + "\n" + G["m"] + G["N"]]


def test_random_texts_against_pieces(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abegikmngorxdñ .,\n?A9_") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["mga" + s + "mga" for s in ("", " ", "_", "-", "ng", "ñ")]
    want = [plain_pieces(t) for t in texts]
    assert column(spark, texts, B.transliterate("t")) == ["".join(b for _, b in w) for w in want]
    got = column(spark, texts, B.syllable_breakdown("t"))
    assert [[(p["latin"], p["baybayin"]) for p in g] for g in got] == want


def test_long_texts_pass_few_patterns(spark):
    """No negated class holds all white space, and no step is made twice: both took most of the time of long texts."""
    def patterns(expr):
        return str(spark.range(1).select(F.lit("").alias("t")).repartition(1).select(expr.alias("o"))._jdf.queryExecution().analyzed()).count("regexp_replace(")

    for profile in ("standard", "four_mark"):
        assert "[^" + B.WS not in str(B.transliterate("t", profile)).replace("&&[^" + B.WS, "") and B.DOUBLE_DANDA + B.WS not in str(B.transliterate("t", profile))
        assert patterns(B.transliterate("t", profile)) <= 7
    assert patterns(B.native_confidence("t")) == 1
    assert patterns(B.syllable_breakdown("t")) <= 2 * 7


def test_white_space_and_foreign_letters(spark):
    texts = ["\u2003ba\u00a0", "ba \u0085", "\u0085ba", "k\u212aa", "ba\u0001ba", "\u1700ba", "ABA MNG", "b\x00a", "mga\n", "\ufeff"]
    b, k, v = G["b"], G["k"], V
    assert column(spark, texts, B.strip_ws("t")) == ["ba", "ba\u0085", "\u0085ba", *texts[3:8], "mga", ""]
    assert column(spark, texts, B.transliterate("t", "four_mark")) == [b, b, b, k + v + k, b + b, b, G["a"] + b + " " + G["m"] + v + G["N"] + v, b + v + G["a"], G["m"] + G["g"], ""]


def test_marked_and_paragraph(spark):
    assert column(spark, ["m?ga", "mga?ba"], B.transliterate_marked("t")) == [G["m"] + V + "?" + G["g"], G["m"] + G["N"] + "?" + G["b"]]
    assert column(spark, [" ANG \n\n Bahay\n"], B.format_paragraph(F.split("t", "\n"))) == ["Ang\nbahay"]
    assert column(spark, ["", " \n "], B.format_paragraph(F.split("t", "\n"))) == ["", ""]


def test_rules_and_chart(spark):
    words = spark.createDataFrame([(w,) for w in ("bahay", "ngayon", "taxi", "ñ", "mga", "rada")], "word string")
    row = T.translation_rule_check(words).first()
    assert row["words"] == 6 and all(row[r] == 0 for r in T.RULES)
    assert T.rule_failures(words).count() == 0
    chart = {r["letter"]: r for r in T.script_chart(words).collect()}
    assert len(chart) == 20 and chart["NG"]["n_words"] == 1 and chart["D"]["baybayin"] == chart["R"]["baybayin"]


def test_wordlist_file(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_bytes("﻿Bahay,1\n bahay ,2\nNiño,3\nNiño,4\n\n".encode())
    assert {r["word"] for r in read_wordlist(spark, str(path), "csv").collect()} == {"bahay", "niño"}
    lines = spark.createDataFrame([("Araw",), ("araw",), ("  ",)], "value string")
    assert [r["word"] for r in line_words(lines).collect()] == ["araw"]
