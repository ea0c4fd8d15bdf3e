"""Digits, separators, white space and Arabic letter forms as Column expressions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic-Indic and Persian digits with their ASCII forms; characters that may separate a number's
# digits; marks that Arabic spelling may leave out; letter forms that are spelt alike.
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"
#: For use inside brackets.  A pattern tries the ranges of a class one by one at each character: a wider class that is told at once comes first.
DIGIT = r"[\p{Nd}&&[0-9\x{0660}-\x{0669}\x{06F0}-\x{06F9}]]"
SEPARATOR = r"\x20\t\x{00A0}\x{2009}\x{202F}\-\x{2010}-\x{2013}\x{2212}.\x{066B}\x{066C}()\x{200E}\x{200F}\x{061C}\x{202A}-\x{202E}\x{2066}-\x{2069}"
MAX_SEPARATORS = 3
TASHKEEL = r"\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}"
LETTER_FORMS = ("أإآٱىة", "اااايه")
INVISIBLE = r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}\x{061C}"
BLANKS = r"[\p{Z}\p{Cc}&&[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
ARABIC_LETTER = r"\x{0621}-\x{064A}\x{0671}-\x{06D3}"
#: Separators that normalize drops.
DROPPED = f"(?<=[{DIGIT}])[{SEPARATOR}]{{1,{MAX_SEPARATORS}}}(?=[{DIGIT}])"

#: Stands for a dropped separator while offsets are counted.
GAP = ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: a plain expression is worked out again at each of its uses in a branch, and for each
    element where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def ascii_digits(text: Column) -> Column:
    """Eastern digits as ASCII ones; all else stays."""
    return F.when(~is_ascii(text) & text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, EASTERN_DIGITS, ASCII_DIGITS)).otherwise(text)


def normalize(text: Column) -> Column:
    """ASCII digits, and no separators (one to three) between two digits."""
    some = text.rlike(f"[{DIGIT}][{SEPARATOR}]{{1,{MAX_SEPARATORS}}}[{DIGIT}]")
    return F.when(some, F.regexp_replace(ascii_digits(text), DROPPED, "")).otherwise(ascii_digits(text))


def offsets(text: Column) -> Column:
    """For each character of normalize(text) its place in text, from 0."""
    length = F.length(text)
    inside = "|".join(f"(?<=[{DIGIT}][{SEPARATOR}]{{{k}}})[{SEPARATOR}](?=[{SEPARATOR}]{{0,{MAX_SEPARATORS - 1 - k}}}[{DIGIT}])" for k in range(MAX_SEPARATORS))
    marked = F.split(F.regexp_replace(text, inside, GAP), "")
    places = F.transform(marked, lambda c, i: F.when(c != GAP, i))
    same = ~text.rlike(f"[{DIGIT}][{SEPARATOR}]{{1,{MAX_SEPARATORS}}}[{DIGIT}]")  # nothing is dropped
    kept = F.when(same, F.sequence(F.lit(0), length - 1)).otherwise(F.filter(places, lambda i: i.isNotNull()))
    return F.when(length > 0, kept).otherwise(F.array().cast("array<int>"))


def to_original(offset_map: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A half-open span of the normalized text as one of the original text; null out of range."""
    ok = (start >= 0) & (start < end) & (end <= F.size(offset_map))
    return F.when(ok, F.get(offset_map, start)), F.when(ok, F.get(offset_map, end - 1) + 1)


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def arabic_forms(text: Column) -> Column:
    """Without vowel marks and tatweel, alef, yeh and teh marbuta in one form each."""
    return F.translate(F.regexp_replace(text, f"[{TASHKEEL}]", ""), *LETTER_FORMS)


def normalize_name(text: Column) -> Column:
    """arabic_forms with single blanks and none at the ends."""
    return strip(F.regexp_replace(arabic_forms(text), f"[{BLANKS}]+", " "))


def flatten(text: Column) -> Column:
    """normalize without white space and brackets."""
    # most values hold nothing of what this drops or changes
    same = is_ascii(text) & ~text.rlike(r"[\x09-\x0D\x1C-\x20\-.()]")
    return F.when(same, text).otherwise(F.regexp_replace(normalize(text), f"[{BLANKS}()]", ""))


def redact(text: Column) -> Column:
    """Account numbers, mail addresses and runs of seven digits or more, of any script, as stars."""
    out = F.regexp_replace(text, r"(?i)\bSA\s?\d{2}[\p{Nd}\s]{10,}", "***")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "***")
    return F.regexp_replace(out, rf"\p{{Nd}}(?:[{SEPARATOR}]{{0,3}}\p{{Nd}}){{6,}}", "***")
