"""Column functions on recognised text: trimming, sanitising, confusions, predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# The characters that count as white space in recognised text. Java's own \s is
# ASCII only, so the wider set is spelled out.
WS_CLASS = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")

# Patterns whose results have to agree with existing labels and reports.
CONFUSION_SPAN = r"(?i)[0-9OIil|][0-9OIil|.\-/,:년월일" + WS_CLASS[1:-1] + r"]+[0-9OIil|]"
CONFUSION_FROM, CONFUSION_TO = "OoIil|", "001111"
DATEISH = r"\d{2,4}\s*[.\-/년]\s*\d{1,2}|\d{6,8}"
SANITIZE_DATEISH = r"(?i)(?:\d|[OIil|])[^\n]{0,18}(?:\d|[OIil|])"
SOFT_REMOVE = r"[^0-9A-Za-z가-힣./:\-" + WS_CLASS[1:-1] + "]"
NUMERIC_DATE_REMOVE = r"(?i)[^0-9OIil|./:\-]"
FULL_DATE = r"^\d{4}-\d{2}-\d{2}$"

SANITIZE_MODES = ("none", "soft", "date_context", "numeric_date")


def trim_ws(c: Column) -> Column:
    """Strip all white space, not only blanks, from both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def sanitize_text(c: Column, mode: str = "none") -> Column:
    if mode == "none":
        return c
    if mode == "soft":
        return F.regexp_replace(c, SOFT_REMOVE, "")
    if mode == "date_context":
        return F.when(c.rlike(SANITIZE_DATEISH), F.regexp_replace(c, SOFT_REMOVE, "")).otherwise(c)
    if mode == "numeric_date":
        return F.when(c.rlike(SANITIZE_DATEISH),
                      F.regexp_replace(c, NUMERIC_DATE_REMOVE, "")).otherwise(c)
    raise ValueError(f"Unknown sanitization mode: {mode}; expected one of {SANITIZE_MODES}")


def sanitize_tokens(tokens: DataFrame, mode: str = "none") -> DataFrame:
    """Parser-facing copy of a token table; the raw text is kept next to any changed text."""
    if mode == "none":
        return tokens.withColumns({"raw_text": F.lit(None).cast("string"),
                                   "sanitizer_mode": F.lit(None).cast("string")})
    clean = tokens.withColumn("__clean", sanitize_text(F.col("text"), mode))
    changed = F.col("__clean") != F.col("text")
    return (clean
            .withColumns({"raw_text": F.when(changed, F.col("text")),
                          "sanitizer_mode": F.when(changed, F.lit(mode))})
            .withColumn("text", F.col("__clean"))
            .drop("__clean"))


def correct_numeric_confusions(c: Column) -> Column:
    """Read O, I, l and | as digits, but only inside spans that look numeric.

    One regex pass marks the spans, a split separates them, and every second piece is translated.
    """
    pieces = F.split(F.regexp_replace(c, CONFUSION_SPAN, "\u0001$0\u0001"), "\u0001", -1)
    fixed = F.transform(pieces, lambda s, i: F.when(
        i % 2 == 1, F.translate(s, CONFUSION_FROM, CONFUSION_TO)).otherwise(s))
    return F.when(c.rlike("[OoIil|]"), F.array_join(fixed, "")).otherwise(c)


def is_dateish(c: Column) -> Column:
    return c.rlike(DATEISH)


def looks_date_like(c: Column) -> Column:
    digits = F.regexp_count(c, F.lit("[0-9OIil|]"))
    return (digits >= 4) | ((digits >= 2) & c.rlike(r"[./:/\-]"))


def is_full_date(c: Column) -> Column:
    return c.rlike(FULL_DATE)


def numeric_target(c: Column) -> Column:
    """The digits of a label when there are exactly eight of them, else null."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(digits) == 8, digits)


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def zfill(c: Column, width: int) -> Column:
    """Left-pad with zeros without ever cutting, unlike a bare lpad."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def pad_label_parts(df: DataFrame) -> DataFrame:
    """Zero-pad ids to six and months and days to two characters; NONE stays as it is."""
    def part(name: str) -> Column:
        c = trim_ws(F.col(name))
        return F.when(c.rlike(r"^[0-9]+$"), zfill(c, 2)).otherwise(c)
    return df.withColumns({"image_id": zfill(trim_ws(F.col("image_id")), 6),
                           "year": trim_ws(F.col("year")), "month": part("month"),
                           "day": part("day"), "final_date": trim_ws(F.col("final_date"))})


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "lime").when(c >= 0.5, "yellow").otherwise("red")


# Which configuration keys are secrets and which hold paths.
SECRET_KEY = r"(?i)(token|secret|password|api[_-]?key|credential)"
PATH_KEY = r"(?i)(path|dir|directory|file)"


def redact_params(params: Column) -> Column:
    """Hide secret values and shorten paths in a map of flattened (dotted) parameters.

    A secret word in any part of the dotted key hides the value; the path rule looks only at
    the key's last named part, so list positions such as ``paths.0`` count as ``paths``.
    """
    def safe(k: Column, v: Column) -> Column:
        last = F.element_at(F.split(F.regexp_replace(k, r"(\.\d+)+$", ""), r"\."), -1)
        return (F.when(k.rlike(SECRET_KEY), F.lit("<redacted>"))
                .when(last.rlike(PATH_KEY) & (F.length(v) > 0),
                      F.element_at(F.split(F.regexp_replace(v, "/+$", ""), "/"), -1))
                .otherwise(v))
    return F.transform_values(params, safe)


CONFIG_SECTIONS = ("preprocess", "ocr", "selector", "normalizer", "runtime", "weights")


def redact_config(config: Column) -> Column:
    """Keep the six documented sections of a flattened configuration, redacted."""
    keep = F.map_filter(config, lambda k, v: F.split(k, r"\.")[0].isin(*CONFIG_SECTIONS))
    return redact_params(keep)


def keyword_regex(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike(keyword_regex(words))
