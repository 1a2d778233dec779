"""Rules on recognition replies: status, outcome, sanitising, settings, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sulatan.functions.baybayin import strip_ws

# Accepted input types, statuses, settings and their defaults.
INPUT_TYPES = ("marker", "pentel_pen", "pen")
SETTING_CHOICES = {
    "cameraInputType": (("marker", "pen"), "marker"),
    "resultFilter": (("Raw", "Black and White", "HOG"), "HOG"),
    "language": (("en", "fil"), "en"),
    "theme": (("light", "dark", "system"), "system"),
}
SETTING_FLAGS = {
    "cameraGridByDefault": False,
    "showBoundingBoxesByDefault": False,
    "hapticsEnabled": True,
    "hasSeenIntro": False,
}
DEFAULT_MIN_CONFIDENCE = 23.0
MIN_CONFIDENCE_RANGE = (0.0, 90.0)
SUCCESS_ABOVE = 60.0
NOISE_CUTS = {"marker": 0.20, "pentel_pen": 0.20, "pen": 0.30, "latin": 0.30}
MIN_BRIGHTNESS = 40.0
MIN_BLUR_SCORE = 60.0
OUTCOMES = {
    "success": "success", "low_confidence": "lowConfidence", "no_characters": "noCharacters",
    "blurry_image": "blurry", "invalid_image": "invalidImage",
}
MIN_MARK_PIXELS = 16
SOLIDITY_CUT = 0.80
VOWEL_CLASSES = ("A", "EI", "OU")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _double(value) -> Column:
    return F.lit(float(value))


def is_finite(c) -> Column:
    c = _col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _double("inf"))


# --- input types and statuses ---------------------------------------------

def normalize_input_type(raw, allowed: Sequence[str] = INPUT_TYPES, default: str = "marker") -> Column:
    """Known input types pass, anything else becomes the default."""
    return F.when(_col(raw).isin(*allowed), _col(raw)).otherwise(F.lit(default))


def classify_status(is_blurry, n_detections, confidence, request=None) -> Column:
    """Blur first, then an empty page, then the confidence cut.

    ``request`` is a status already settled by the request itself; it wins.
    """
    status = (F.when(_col(is_blurry), "Blurry_Image")
              .when(F.coalesce(_col(n_detections), F.lit(0)) <= 0, "No_Characters")
              .when(_col(confidence) > SUCCESS_ABOVE, "Success")
              .otherwise("Low_Confidence"))
    return status if request is None else F.coalesce(_col(request), status)


def request_status(mode, has_file, text, crashed, image_mode: str = "image", text_mode: str = "text") -> Column:
    """Status of a request that needs no recognition result, else null."""
    return (F.when(_col(crashed), "Error")
            .when((_col(mode) == image_mode) & ~_col(has_file), "No_File")
            .when((_col(mode) == text_mode) & (F.coalesce(_col(text), F.lit("")) == ""), "No_Text")
            .when(_col(mode) == text_mode, "Success")
            .when(_col(mode).isNull() | (_col(mode) != image_mode), "Invalid_Mode"))


def recognition_outcome(status, error=None, is_missing=None) -> Column:
    """One of six outcomes; missing, failed and unknown replies are ``failed``."""
    lowered = F.lower(_col(status).cast("string"))
    chain = F.when(F.lit(False), F.lit(""))
    if is_missing is not None:
        chain = chain.when(_col(is_missing), "failed")
    if error is not None:
        chain = chain.when(_col(error).isNotNull(), "failed")
    for name, outcome in OUTCOMES.items():
        chain = chain.when(lowered == name, outcome)
    return chain.otherwise("failed")


def has_text(outcome) -> Column:
    return _col(outcome).isin("success", "lowConfidence")


def page_quality(brightness, blur_score, min_brightness: float = MIN_BRIGHTNESS,
                 min_blur: float = MIN_BLUR_SCORE) -> Column:
    """Darkness is reported before blur, because a dark page is always blurry too."""
    return (F.when(_col(brightness) < min_brightness, "dark")
            .when(_col(blur_score) < min_blur, "blurry").otherwise("ok"))


def page_problem(is_missing, status, text, script: str = "baybayin") -> Column:
    """Why an unread page is left out of a combined result."""
    lowered = F.lower(F.coalesce(_col(status).cast("string"), F.lit("")))
    if script == "latin":
        blurry = F.coalesce(_col(status).cast("string"), F.lit("")) == "blurry"
    else:
        blurry = lowered.contains("blur") | F.lower(F.coalesce(_col(text), F.lit(""))).contains("too blurry")
    return F.when(_col(is_missing), "not_processed").when(blurry, "too_blurry").otherwise("no_letters")


def page_is_read(status, text, error=None, script: str = "baybayin") -> Column:
    """A page counts as read when it succeeded and carries text."""
    filled = F.coalesce(_col(text), F.lit("")) != ""
    if script == "latin":
        return (F.coalesce(_col(status).cast("string"), F.lit("")) == "ok") & filled
    return has_text(recognition_outcome(status, error)) & filled


def confidence_band(confidence, cuts: Sequence[float] = (90.0, 80.0, 70.0)) -> Column:
    """0 for the best band, counting up; values below every cut get ``len(cuts)``."""
    c = _col(confidence)
    chain = F.when(c >= _double(cuts[0]), 0)
    for i, cut in enumerate(cuts[1:], 1):
        chain = chain.when(c >= _double(cut), i)
    return chain.otherwise(len(cuts))


# --- numbers, boxes and settings -------------------------------------------

def valid_confidence(value) -> Column:
    """A finite cut clamped to its range, else the default."""
    low, high = MIN_CONFIDENCE_RANGE
    c = _col(value).cast("double")
    return F.when(is_finite(c), F.greatest(F.least(c, _double(high)), _double(low))).otherwise(DEFAULT_MIN_CONFIDENCE)


def passes_confidence(confidence, cut) -> Column:
    return _col(confidence) >= valid_confidence(cut)


def above_noise(probability, input_type) -> Column:
    """Keep readings at or above the noise cut of their input type."""
    chain = F.when(F.lit(False), _double(0))
    for name, cut in NOISE_CUTS.items():
        chain = chain.when(_col(input_type) == name, _double(cut))
    return _col(probability) >= chain.otherwise(_double(NOISE_CUTS["marker"]))


def setting(name: str, raw) -> Column:
    """One stored setting (text as JSON wrote it) with its own fallback.

    String settings must be one of their choices, flags must be JSON booleans,
    and the confidence cut must be a number; a wrong type resets that setting only.
    """
    c = _col(raw)
    if name in SETTING_CHOICES:
        choices, default = SETTING_CHOICES[name]
        return F.when(c.isin(*choices), c).otherwise(default)
    if name in SETTING_FLAGS:
        return F.when(c.isin("true", "false"), c == "true").otherwise(SETTING_FLAGS[name])
    if name == "minConfidence":
        return valid_confidence(c.try_cast("double"))
    raise ValueError(f"unknown setting {name!r}")


def read_number(value, fallback: float = 0.0) -> Column:
    """A number out of a variant: finite numbers and numeric strings, else the fallback."""
    v = _col(value)
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
    text = F.try_variant_get(v, "$", "string").try_cast("double")
    return (F.when(numeric & is_finite(number), number)
            .when(kind == "STRING", F.coalesce(text, _double(fallback)))
            .otherwise(_double(fallback)))


def _box_number(value) -> Column:
    """A box corner: only true finite numbers count, numeric strings do not."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$") & is_finite(number), number)


def valid_box(box) -> Column:
    """``struct<x0,y0,x1,y1>`` of a variant box, or null if it is unusable."""
    v = _col(box)
    corners = {k: _box_number(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("x0", "y0", "x1", "y1")}
    ok = (corners["x1"] > corners["x0"]) & (corners["y1"] > corners["y0"])
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & ok, F.struct(*[c.alias(k) for k, c in corners.items()]))


def sanitize_detections(reply) -> Column:
    """Detections of a reply variant: objects only, bad boxes null, bad numbers 0."""
    empty = F.array().cast("array<variant>")

    def clean(v: Column) -> Column:
        is_list = F.schema_of_variant(F.try_variant_get(v, "$.individual_detections", "variant")).startswith("ARRAY")
        items = F.when(is_list, F.try_variant_get(v, "$.individual_detections", "array<variant>"))
        maps = F.filter(F.coalesce(items, empty), lambda d: F.schema_of_variant(d).startswith("OBJECT"))
        return F.transform(maps, lambda d: F.struct(
            F.try_variant_get(d, "$.char", "string").alias("char"),
            read_number(F.try_variant_get(d, "$.confidence", "variant")).alias("confidence"),
            valid_box(F.try_variant_get(d, "$.bbox", "variant")).alias("bbox"),
        ))

    # bound to a lambda variable, the reply is parsed once however often it is used
    return F.transform(F.array(_col(reply)), clean)[0]


# --- glyph readings ---------------------------------------------------------

def fuse_glyph_reading(whole_base, whole_conf, base, base_conf, mark, mark_conf, position, solidity, mark_area,
                       pen: bool = False, cross_class: str = "X") -> Column:
    """Combine the whole-glyph, base and mark predictions into one reading.

    ``mark`` null means the glyph did not split into base and mark. Returns
    ``struct<base, mark, text, confidence, position>``; the text may hold
    ``{e/i}``, ``{o/u}`` or ``{d/r}`` slots.
    """
    w_base, w_conf, s_base, s_conf = map(_col, (whole_base, whole_conf, base, base_conf))
    pos, split = _col(position), _col(mark).isNotNull()
    tiny = _col(mark_area) < MIN_MARK_PIXELS
    shape = F.when(tiny, "Dot").when(_col(solidity) < SOLIDITY_CUT, cross_class).otherwise("Dot")
    if pen:
        shape = F.when((pos == "Above") & shape.isin("X", "Cross"), "Dot").otherwise(shape)
    surer = w_conf >= s_conf
    use_whole = ~split | (surer & (w_base.isin(*VOWEL_CLASSES) | tiny))
    out_base = F.when(use_whole, w_base).otherwise(s_base)
    out_mark = F.when(use_whole, "None").otherwise(shape)
    out_pos = F.when(use_whole, "None").otherwise(pos)
    conf = F.when(use_whole, w_conf).otherwise(F.least(s_conf, _col(mark_conf)))
    return F.struct(out_base.alias("base"), out_mark.alias("mark"),
                    slot_text(out_base, out_mark, out_pos).alias("text"),
                    conf.alias("confidence"), out_pos.alias("position"))


def slot_text(base, mark, position) -> Column:
    """Latin text of a base class with its mark, leaving unclear vowels as slots."""
    base, pos, low = _col(base), _col(position), F.lower(_col(mark))
    is_da = F.upper(F.trim(base)) == "DA"
    stem = F.when(is_da, "{d/r}").otherwise(F.substring(base, F.lit(1), F.length(base) - 1))
    dot = low.contains("dot")
    return (F.when(base == "EI", "{e/i}").when(base == "OU", "{o/u}").when(base == "A", base)
            .when(low.contains("cross") | low.contains("x"), stem)
            .when((pos == "Above") & dot, F.concat(stem, F.lit("{e/i}")))
            .when((pos == "Below") & dot, F.concat(stem, F.lit("{o/u}")))
            .when(is_da, F.concat(stem, F.right(base, F.lit(1))))
            .otherwise(base))


def safe_name(text) -> Column:
    """Characters unsafe in a file name become ``-``; an empty name is ``unknown``."""
    clean = F.regexp_replace(_col(text).cast("string"), "[^A-Za-z0-9_-]", "-")
    return F.when(clean == "", "unknown").otherwise(clean)


def crop_label_prefix(base, mark, position) -> Column:
    """File name prefix of a glyph crop: class, mark and mark position."""
    prefix, low, pos = safe_name(base), F.lower(strip_ws(_col(mark))), _col(position)
    return (F.when(low.isin("", "none"), prefix)
            .when(low.contains("cross") | low.contains("x"), F.concat(prefix, F.lit("_Cross")))
            .when(low.contains("dot") & pos.isin("Above", "Below"), F.concat(prefix, F.lit("_Dot_"), pos))
            .when(low.contains("dot"), F.concat(prefix, F.lit("_Dot")))
            .otherwise(F.concat(prefix, F.lit("_"), safe_name(mark))))
