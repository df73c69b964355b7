"""Checks against a declared schema, and typed values from text."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import TEXTUAL, quoted
from ..functions.numbers import plain_number
from ..functions.text import strip_spaces
from .profile import spark_type_name

# Names of declared types and their Spark types.
DECLARED_TYPES = {
    "string": "string",
    "int": "int",
    "integer": "int",
    "long": "bigint",
    "float": "float",
    "double": "double",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp",
}


def schema_conformance(df: DataFrame, expected: Mapping[str, str | None]) -> DataFrame:
    """One row per expected or surplus column.

    Status is ``ok``, ``type_differs``, ``missing`` or ``unexpected``; for
    text columns of another declared type, ``bad_values`` counts the cells
    that do not convert. A missing type means string, with a warning.
    """
    actual = {f.name: f.dataType for f in df.schema}
    rows = []
    for name, declared in expected.items():
        if not declared:
            warnings.warn(f"column {name!r} has no declared type; string is assumed", stacklevel=2)
            declared = "string"
        target = DECLARED_TYPES[declared.lower()]
        bad = F.lit(0).cast("long")
        found = None
        if name not in actual:
            status = "missing"
        else:
            found = actual[name].simpleString()
            wanted = T._parse_datatype_string(target)
            status = "ok" if actual[name] == wanted else "type_differs"
            if isinstance(actual[name], TEXTUAL) and target != "string":
                column = F.col(quoted(name))
                bad = F.count_if(column.isNotNull() & column.try_cast(target).isNull())
        rows.append((name, target, found, status, bad))
    for name in df.columns:
        if name not in expected:
            rows.append((name, None, actual[name].simpleString(), "unexpected", F.lit(0).cast("long")))
    structs = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(wanted).cast("string").alias("expected_type"),
            F.lit(found).cast("string").alias("actual_type"),
            F.lit(status).alias("status"),
            bad.alias("bad_values"),
        )
        for name, wanted, found, status, bad in rows
    ]
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def coerced(column: Column, declared: str) -> Column:
    """Text cell to its declared type; blank, ``null``, ``none`` and misfits give NULL.

    Integers are cut towards zero; ``true``, ``1`` and ``yes`` are true and
    any other text is false; dates stay text.
    """
    text = strip_spaces(column)
    text = F.when(~F.lower(text).isin("", "null", "none"), text)
    if declared == "integer":
        number = plain_number(text)
        return number.try_cast("bigint")
    if declared in ("float", "price"):
        return plain_number(text)
    if declared == "boolean":
        return F.lower(text).isin("true", "1", "yes")
    return text


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns named in ``types`` become typed, the others pass through."""
    return df.select(
        *[
            coerced(F.col(quoted(c)), types[c]).alias(c) if c in types else F.col(quoted(c))
            for c in df.columns
        ]
    )


def typed_schema(df: DataFrame) -> dict[str, str]:
    return {f.name: spark_type_name(f.dataType) for f in df.schema}
