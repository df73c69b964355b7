"""Numbers written as text in US or European style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_spaces

_NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"


def _float(text: Column) -> Column:
    """Only spellings that every engine reads alike reach the cast."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def plain_number(column: Column) -> Column:
    """Text to double without any separator handling; NULL if it is no number."""
    return _float(strip_spaces(column))


def number_from_text(column: Column) -> Column:
    """Text to double; the later of comma and dot is the decimal mark.

    A lone comma with at most three digits behind it is a decimal comma,
    any other comma separates thousands. Unreadable text gives NULL.
    """
    text = strip_spaces(column)
    # Distance from the end; 0 means the mark does not occur.
    from_end = F.reverse(text)
    comma = F.instr(from_end, ",")
    dot = F.instr(from_end, ".")
    one_comma = F.length(text) - F.length(F.replace(text, F.lit(","))) == 1
    no_commas = F.replace(text, F.lit(","))
    comma_as_dot = F.replace(text, F.lit(","), F.lit("."))
    readable = (
        F.when(comma == 0, text)
        .when((dot > 0) & (comma < dot), F.replace(F.replace(text, F.lit(".")), F.lit(","), F.lit(".")))
        .when(dot > 0, no_commas)
        .when(one_comma & (comma <= 4), comma_as_dot)
        .otherwise(no_commas)
    )
    return _float(readable)
