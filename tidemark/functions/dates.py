"""Best-effort dates: the shape of the text picks the format, month first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_spaces

# Names of date formats in rule sets and their Spark patterns.
RULE_DATE_FORMATS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "MM-DD-YYYY": "MM-dd-yyyy",
    "DD/MM/YYYY": "dd/MM/yyyy",
    "YYYY/MM/DD": "yyyy/MM/dd",
}

_YEAR_FIRST = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"
_OTHER_NUMERIC = r"^(\d{8}$|\d{4}[/.]\d{1,2}[/.]\d|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})"
_MONTH_NAME = r"^([A-Za-z]{3,9} \d{1,2},? \d{4}|\d{1,2} [A-Za-z]{3,9} \d{4})$"
_NAMED_MONTH = ["[MMMM][MMM] d[,] yyyy", "d [MMMM][MMM] yyyy"]


def timestamp_from_text(column: Column) -> Column:
    """Timestamp, or NULL where no known form fits.

    The usual year-month-day is cast as it is. Other numeric forms are
    rewritten to it first; a month above twelve means the day came before the
    month. Named months have two patterns.
    """
    text = strip_spaces(column)
    iso = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "$3-$1-$2")
    day_first = F.regexp_replace(text, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "$3-$2-$1")
    named = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in _NAMED_MONTH])
    return (
        F.when(text.rlike(_YEAR_FIRST), text.try_cast("timestamp"))
        .when(text.rlike(_OTHER_NUMERIC), F.coalesce(iso.try_cast("timestamp"), day_first.try_cast("timestamp")))
        .when(text.rlike(_MONTH_NAME), named)
    )


def unreadable_date(column: Column, pattern: str) -> Column:
    """True where text is present but does not follow the pattern."""
    return column.isNotNull() & F.try_to_date(column, pattern).isNull()
