"""Column names in snake_case."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.text import strip_accents_text


def normalize_name(name: str) -> str:
    """Trim, drop accents, blanks and hyphens to ``_``, other marks away, lower case."""
    plain = strip_accents_text(name.strip())
    joined = re.sub(r"[\s\-]+", "_", plain)
    return re.sub(r"[^\w]", "", joined).lower()


def normalized_names(names: list[str], distinct: bool = True) -> list[str]:
    """With ``distinct``, later equal names get ``_2``, ``_3`` and so on."""
    result: list[str] = []
    for name in names:
        base = candidate = normalize_name(name)
        number = 2
        while distinct and candidate in result:
            candidate = f"{base}_{number}"
            number += 1
        result.append(candidate)
    return result


def normalize_headers(df: DataFrame, distinct: bool = True) -> DataFrame:
    names = normalized_names(df.columns, distinct)
    return df if names == df.columns else df.toDF(*names)
