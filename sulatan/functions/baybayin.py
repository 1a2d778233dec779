"""Latin-to-Baybayin conversion as built-in string expressions.

The conversion never tokenises row by row in Python. It rewrites the text in
place: a consonant without a vowel receives the vowel-killer mark, a vowel
without a consonant becomes a capital, and one table swaps single letters for
glyphs and marks and drops everything else. Nothing can be dropped before that,
because a dropped letter still separates syllables (``kxa`` is K-virama + A).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode Tagalog block letters, signs and punctuation.
GLYPHS = {
    "a": "ᜀ", "e": "ᜁ", "i": "ᜁ", "o": "ᜂ", "u": "ᜂ",
    "b": "ᜊ", "k": "ᜃ", "d": "ᜇ", "r": "ᜇ", "g": "ᜄ", "h": "ᜑ", "l": "ᜎ", "m": "ᜋ",
    "n": "ᜈ", "N": "ᜅ", "p": "ᜉ", "s": "ᜐ", "t": "ᜆ", "w": "ᜏ", "y": "ᜌ",
}
RA_GLYPH = "ᜍ"
VIRAMA = "᜔"
DANDA = "᜵"
DOUBLE_DANDA = "᜶"
TWO_MARKS = {"a": "", "e": "ᜒ", "i": "ᜒ", "o": "ᜓ", "u": "ᜓ"}
FOUR_MARKS = {"a": "", "e": "᜕", "i": "ᜒ", "o": "ᜓ", "u": "᜖"}
LONE_VOWELS = {"a": "A", "ei": "E", "ou": "O"}
FOREIGN_LETTERS = "cfjqzvx"
FOREIGN_PENALTY = 15
CONSONANTS = "bkdrghlmnpstwy"
UNKNOWN_MARK = "?"

# White space as the app's regex engine sees it (wider than Java's plain \s).
WS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_CHARS = "\t\n\v\f\r \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
# The whole Tagalog block; such characters in the input count as foreign.
_SCRIPT_BLOCK = r"[\x{1700}-\x{171F}\x{1735}\x{1736}]"
_PIECE_END = "\u0001"
# What can neither be spelled nor is white space. Plain letters fail its first part; a negated class with
# all of WS takes ten times as long a character.
_OTHER = rf"[[^\x00\x02-\x7F]&&[^{WS}]]"
_NEXT_LINE = "\u0085"
_MGA = r"mga(?<![A-Za-z0-9_]mga)(?![A-Za-z0-9_])"

PROFILES = ("standard", "four_mark", "words_only")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading and trailing white space, including Unicode spaces."""
    c = _col(c)
    # to a pattern, a last U+0085 ends the line before it
    return F.when(c.endswith(_NEXT_LINE), F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")).otherwise(F.btrim(c, F.lit(WS_CHARS)))


def _prepare(c) -> Column:
    """Lower-case, strip, hide foreign characters, make ``ng`` one letter: plain characters and white space are left."""
    text = F.regexp_replace(F.lower(strip_ws(c)), _OTHER, "-")
    return F.replace(text, F.lit("ng"), F.lit("N"))


def _spell(c: Column, marks: dict[str, str], ra: str, extra_from: str, extra_to: str, drop: str = "") -> Column:
    """Turn prepared letters into glyphs; other characters are left in place, those to ``drop`` go.

    Vowels without a consonant become capitals first, so that one table swaps in glyphs and marks.
    """
    out = F.regexp_replace(c, f"[N{CONSONANTS}](?![aeiou])", "$0" + VIRAMA)
    for vowels, lone in LONE_VOWELS.items():
        out = F.regexp_replace(out, f"[{vowels}](?<![N{CONSONANTS}].)", lone)
    # no glyph for a: a consonant has it of its own; what has none comes last
    letters = {k: v for k, v in GLYPHS.items() if k not in marks} | {"r": ra} | {lone: GLYPHS[vowels[0]] for vowels, lone in LONE_VOWELS.items()}
    letters |= {v: m for v, m in marks.items() if m}
    none = "".join(v for v, m in marks.items() if not m)
    return F.translate(out, "".join(letters) + extra_from + none + drop, "".join(letters.values()) + extra_to)


def _plain_but(kept: str) -> str:
    """Plain characters that are neither kept, nor white space, nor the end mark."""
    return "".join(c for c in map(chr, range(128)) if c not in kept + WS_CHARS + _PIECE_END)


_UNSPELLED = _plain_but("".join([*GLYPHS, *LONE_VOWELS.values()]) + ".,MG")


def _keep(c: Column, extra: str) -> Column:
    return F.regexp_replace(c, rf"[^\x{{1700}}-\x{{1716}}{extra}]+", "")


def transliterate(text, profile: str = "standard") -> Column:
    """Baybayin text for a Latin text column.

    ``standard``    two vowel marks, D and R share a letter, the word ``mga`` is MA+NGA.
    ``four_mark``   four vowel marks, own RA letter, ``mga`` only as the whole input (MA+GA).
    ``words_only``  runs of ``[a-z]`` per line, joined by one space.
    """
    c = _col(text)
    if profile == "standard":
        prepared = F.regexp_replace(_prepare(c), _MGA, "maNa")
        return _spell(prepared, TWO_MARKS, GLYPHS["r"], ".,", DOUBLE_DANDA + DANDA, _UNSPELLED + "MG")
    if profile == "four_mark":
        prepared = F.regexp_replace(_prepare(c), r"\Amga\z", "MG")
        return _spell(prepared, FOUR_MARKS, RA_GLYPH, ".,MG", DOUBLE_DANDA + DANDA + GLYPHS["m"] + GLYPHS["g"], _UNSPELLED)
    if profile == "words_only":
        return _words_only(c)
    raise ValueError(f"unknown profile {profile!r}; expected one of {PROFILES}")


def _words_only(c: Column) -> Column:
    # Everything but letters and line breaks separates words. Words that leave
    # no glyph vanish together with their space, so squeeze spaces at the end.
    text = F.lower(F.regexp_replace(c, f"{_SCRIPT_BLOCK}", "-"))
    text = F.regexp_replace(text, r"[^a-z\n]+", " ")
    text = F.replace(text, F.lit("ng"), F.lit("N"))
    text = F.regexp_replace(text, r"(?<![A-Za-z])mga(?![A-Za-z])", "maNa")
    text = _keep(_spell(text, TWO_MARKS, GLYPHS["r"], "", ""), r" \n")
    return F.regexp_replace(F.regexp_replace(text, " +", " "), r"(?m)^ | $", "")


def native_confidence(text, profile: str = "standard") -> Column:
    """100 minus 15 for every letter foreign to the script, never below 0."""
    c = _col(text)
    foreign = F.length(F.regexp_replace(c, f"[^{FOREIGN_LETTERS}{FOREIGN_LETTERS.upper()}]+", ""))
    score = F.greatest(F.lit(0.0), F.lit(100.0) - FOREIGN_PENALTY * foreign)
    blank = (c == "") if profile == "four_mark" else ~c.rlike(f"[^{WS}]")
    return F.when(c.isNull() | blank, F.lit(0.0)).otherwise(score)


def _split_pieces(c: Column) -> Column:
    """Prepared text with an end mark after every piece and the rest dropped."""
    marked = F.regexp_replace(_prepare(c), _MGA, "M")
    piece = f"([N{CONSONANTS}]?[aeiou]|[MN{CONSONANTS}.,]|[{WS}]+)"
    ended = F.regexp_replace(marked, piece, "$1" + _PIECE_END)
    return F.translate(ended, _plain_but(f"MN{CONSONANTS}aeiou.,"), "")


def syllable_breakdown(text) -> Column:
    """Pieces of a text as ``array<struct<latin, baybayin>>``.

    Both halves are produced on the whole string with an end mark between
    pieces and split afterwards, so no per-piece lambda is evaluated.
    Joining the ``baybayin`` fields gives ``transliterate(text)``.
    """
    pieces = _split_pieces(_col(text))
    latin = F.replace(F.replace(pieces, F.lit("N"), F.lit("ng")), F.lit("M"), F.lit("mga"))
    script = F.replace(pieces, F.lit("M"), F.lit("maNa"))
    script = _spell(script, TWO_MARKS, GLYPHS["r"], ".,", DOUBLE_DANDA + DANDA)

    def cut(c: Column) -> Column:
        # no piece is empty: only what follows the last end mark is
        return F.array_remove(F.split(c, _PIECE_END), "")

    zipped = F.arrays_zip(cut(latin).alias("latin"), cut(script).alias("baybayin"))
    return zipped.cast("array<struct<latin:string,baybayin:string>>")


def transliterate_marked(word) -> Column:
    """Word conversion in which a rejected letter ``?`` stays visible."""
    text = F.lower(F.regexp_replace(_col(word), _SCRIPT_BLOCK, "-"))
    text = F.replace(text, F.lit("ng"), F.lit("N"))
    text = F.regexp_replace(text, r"(^|(?<=\?))mga(?=\?|$)", "maNa")
    return _keep(_spell(text, TWO_MARKS, GLYPHS["r"], "", ""), r"\?")


def format_paragraph(lines) -> Column:
    """Join non-empty lower-cased lines; only the very first letter is a capital."""
    clean = F.filter(F.transform(_col(lines), lambda x: F.lower(strip_ws(x))), lambda x: x != "")
    text = F.array_join(clean, "\n")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def count_words(text) -> Column:
    """Number of non-empty white-space separated words."""
    pieces = F.split(_col(text), f"[{WS}]+")
    return F.size(F.filter(pieces, lambda x: x != "")).cast("long")


# The letters of the chart and the syllable each stands for.
CHART_LETTERS = (
    ("A", "a"), ("B", "ba"), ("D", "da"), ("E", "e"), ("G", "ga"),
    ("H", "ha"), ("I", "i"), ("K", "ka"), ("L", "la"), ("M", "ma"),
    ("N", "na"), ("NG", "nga"), ("O", "o"), ("P", "pa"), ("R", "ra"),
    ("S", "sa"), ("T", "ta"), ("U", "u"), ("W", "wa"), ("Y", "ya"),
)


def file_stamp(ts) -> Column:
    """``yyyyMMdd_HHmmss`` label."""
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss")


def file_stamp_millis(ts) -> Column:
    """``yyyyMMdd_HHmmss_SSS`` label."""
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss_SSS")


def readable_time(ts) -> Column:
    """``yyyy-MM-dd HH:mm`` label."""
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm")
