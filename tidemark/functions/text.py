"""Text normalisation as JVM expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's strip() and split() treat as white space.
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same as a pattern: the Unicode property lacks four ASCII separators. Java
# matches it much faster than a class that lists the characters.
SPACE = r"(?U)[\s\x1c-\x1f]+"

# Control characters, zero-width marks and the byte-order mark.
INVISIBLE = r"[\x00-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{feff}]"
PUNCTUATION = r"[^\p{L}\p{N}_\s]"

_HANGUL = range(0xAC00, 0xD7A4)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks."""
    accented, plain = [], []
    for code in range(0x80, min(sys.maxunicode, 0x2FFFF) + 1):
        if 0xD800 <= code <= 0xDFFF or code in _HANGUL:
            continue
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != char:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def strip_accents(column: Column) -> Column:
    """Drop accents; plain ASCII text skips the table."""
    accented, plain = _accent_table()
    mapped = F.regexp_replace(F.translate(column, accented, plain), r"\p{Mn}", "")
    return F.when(F.octet_length(column) == F.length(column), column).otherwise(mapped)


def strip_accents_text(text: str) -> str:
    """The same on the driver, for column names."""
    decomposed = unicodedata.normalize("NFD", text)
    return "".join(c for c in decomposed if unicodedata.category(c) != "Mn")


def strip_spaces(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACE_CHARACTERS))


def trim_invisible(column: Column) -> Column:
    """Delete invisible characters, then trim; text left empty becomes NULL."""
    visible = F.regexp_replace(column, INVISIBLE, "")
    return F.nullif(strip_spaces(visible), F.lit(""))


def normalize_key(
    column: Column,
    lowercase: bool = True,
    accents: bool = True,
    punctuation: bool = True,
) -> Column:
    """Join key text: NULL is the empty key; every step but trimming is optional."""
    text = strip_spaces(F.coalesce(column.cast("string"), F.lit("")))
    if lowercase:
        text = F.lower(text)
    if accents:
        text = strip_accents(text)
    if punctuation:
        text = F.regexp_replace(text, "(?U)" + PUNCTUATION, "")
    return text


def split_words(column: Column) -> Column:
    """Words between white space; no words in blank text."""
    text = strip_spaces(column)
    return F.when(text != "", F.split(text, SPACE)).otherwise(F.array().cast("array<string>"))


def has_words(column: Column) -> Column:
    """Cheap enough for Spark to push below joins and shuffles."""
    return strip_spaces(column) != ""
