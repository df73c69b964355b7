"""Synthetic rows from a column spec.

Every cell is a hash of (row id, seed, column), so the rows are the same on
any partitioning and an executor that is lost only repeats its own rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from math import gcd
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The column types a spec may name.
TYPES = (
    "string", "integer", "float", "boolean", "date", "datetime", "category", "email",
    "phone", "address", "product_name", "price", "uuid", "custom_pattern",
)
MAX_PREVIEW = 100

FIRST = ["ana", "bruno", "carla", "diego", "elisa", "fabio", "gina", "hugo", "iris", "joao"]
LAST = ["silva", "souza", "costa", "lima", "rocha", "alves", "dias", "melo", "nunes", "pires"]
STREETS = ["Rua das Flores", "Avenida Central", "Rua do Sol", "Travessa Norte", "Alameda Verde"]
PRODUCTS = ["Chair", "Table", "Lamp", "Phone", "Mouse", "Cable", "Shelf", "Desk"]
ADJECTIVES = ["Basic", "Smart", "Ultra", "Eco", "Classic", "Mini", "Prime"]
WORDS = ["alpha", "delta", "river", "stone", "cloud", "amber", "north", "field"]


def validate_spec(spec: list[Mapping[str, Any]], max_columns: int | None = None) -> list[str]:
    """Everything that is wrong with a spec, as messages; ``max_columns`` is the caller's limit, if any."""
    errors: list[str] = []
    if not isinstance(spec, list) or not spec:
        return ["At least one column is required"]
    if max_columns is not None and len(spec) > max_columns:
        return [f"at most {max_columns} columns are allowed, the spec has {len(spec)}"]
    seen: set[str] = set()
    for i, column in enumerate(spec):
        name = column.get("name") if isinstance(column, Mapping) else None
        if not name or not isinstance(name, str):
            errors.append(f"Column {i} has no valid name")
            continue
        if name in seen:
            errors.append(f"Duplicate column name: {name}")
        seen.add(name)
        errors += [f"Column '{name}': {e}" for e in _option_errors(column)]
    return errors


def _option_errors(column: Mapping[str, Any]) -> list[str]:
    kind, options = column.get("type"), column.get("options", {})
    if kind not in TYPES:
        return [f"unsupported type {kind!r}, use one of {', '.join(sorted(TYPES))}"]
    if not isinstance(options, Mapping):
        return ["options must be a dictionary"]
    if kind in ("integer", "float", "price") and {"min", "max"} <= options.keys():
        try:
            if float(options["min"]) >= float(options["max"]):
                return ["min must be less than max"]
        except (TypeError, ValueError):
            return ["min/max must be numeric"]
    if kind in ("date", "datetime") and not {"start", "end"} <= options.keys():
        return ["start and end are required"]
    if kind == "category" and not options.get("categories"):
        return ["categories are required"]
    return []


def _check(spec, rows=None, max_rows=None) -> None:
    errors = validate_spec(spec)
    if rows is not None and (not isinstance(rows, int) or rows < 1):
        errors.append("'rows' must be an integer of at least 1")
    elif max_rows is not None and rows is not None and rows > max_rows:
        errors.append(f"'rows' must not exceed {max_rows:,}")
    if errors:
        raise ValueError("; ".join(errors))


class _Cell:
    """Hash draws for one column."""

    def __init__(self, row_id: Column, seed: int, name: str):
        self.row_id, self.seed, self.name = row_id, seed, name

    def digest(self, purpose: str = "") -> Column:
        key = F.concat_ws(":", self.row_id.cast("string"), F.lit(str(self.seed)), F.lit(self.name + purpose))
        return F.md5(key.cast("binary"))

    def draw(self, purpose: str = "") -> Column:
        """48 bits of the hash as a number."""
        return F.conv(F.substring(self.digest(purpose), 1, 12), 16, 10).cast("bigint")

    def below(self, n: int, purpose: str = "") -> Column:
        return F.pmod(self.draw(purpose), F.lit(n).cast("bigint"))

    def unit(self, purpose: str = "") -> Column:
        return self.draw(purpose) / F.lit(float(2**48))

    def pick(self, values: list, purpose: str = "") -> Column:
        choices = F.array(*[F.lit(v) for v in values])
        return F.get(choices, self.below(len(values), purpose).cast("int"))


def _distinct_step(size: int, seed: int) -> int:
    """A multiplier that visits every residue of ``size`` once."""
    step = (0x9E3779B1 + 2 * seed) % size or 1
    while gcd(step, size) != 1:
        step = step % size + 1
    return step


def _position(cell: _Cell, size: int, unique: bool, position: Column | None, rows: int | None) -> Column:
    """A draw below ``size``; with ``unique``, a different one for every row."""
    if not unique:
        return cell.below(size)
    if rows is None or position is None:
        raise ValueError(f"column '{cell.name}': unique values need consecutive row ids and a row count")
    if rows > size:
        raise ValueError(f"column '{cell.name}': {rows:,} unique values asked, only {size:,} exist")
    step = _distinct_step(size, cell.seed)
    # decimal arithmetic: the product may not fit into 64 bits
    product = position.cast("decimal(20,0)") * F.lit(step).cast("decimal(18,0)")
    return F.pmod(product, F.lit(size).cast("decimal(19,0)")).cast("bigint")


def _days(options) -> tuple[date, int]:
    start, end = (date.fromisoformat(options.get(k, d)) for k, d in (("start", "2020-01-01"), ("end", "2025-12-31")))
    if start > end:
        start, end = end, start
    return start, (end - start).days + 1


def _weighted(cell: _Cell, weights: Mapping[str, float]) -> Column:
    total = float(sum(weights.values()))
    unit, reached, chosen = cell.unit(), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        reached += weights[name] / total
        chosen = (F if chosen is None else chosen).when(unit < F.lit(reached), F.lit(name))
    return F.lit(names[-1]) if chosen is None else chosen.otherwise(F.lit(names[-1]))


def _pattern(cell: _Cell, pattern: str) -> Column:
    """``#`` becomes a digit and ``?`` a capital letter; other characters stay."""
    parts = []
    for i, char in enumerate(pattern):
        if char == "#":
            parts.append(cell.below(10, f":{i}").cast("string"))
        elif char == "?":
            parts.append(F.char(cell.below(26, f":{i}") + 65))
        else:
            parts.append(F.lit(char))
    return F.concat(*parts) if parts else F.lit("")


def _text(cell: _Cell, kind: str, options: Mapping[str, Any]) -> Column:
    number = lambda n, width, purpose: F.lpad(cell.below(n, purpose).cast("string"), width, "0")
    if kind == "category":
        categories = options["categories"]
        return _weighted(cell, categories) if isinstance(categories, Mapping) else cell.pick(list(categories))
    if kind == "email":
        return F.concat(
            cell.pick(FIRST, ":first"), F.lit("."), cell.pick(LAST, ":last"),
            cell.below(10_000, ":number").cast("string"), F.lit("@example.com"),
        )
    if kind == "phone":
        return F.concat(
            F.lit("("), number(90, 2, ":area"), F.lit(") 9"), number(10_000, 4, ":head"), F.lit("-"), number(10_000, 4, ":tail")
        )
    if kind == "address":
        return F.concat(cell.pick(STREETS, ":street"), F.lit(", "), (cell.below(9_999, ":number") + 1).cast("string"))
    if kind == "product_name":
        return F.concat(cell.pick(ADJECTIVES, ":adjective"), F.lit(" "), cell.pick(PRODUCTS, ":noun"))
    if kind == "uuid":
        digest = cell.digest()
        parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
        return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in parts])
    if kind == "custom_pattern":
        return _pattern(cell, options.get("pattern", "????-####"))
    words = options.get("vocabulary")
    text = cell.pick(list(words)) if isinstance(words, (list, tuple)) else F.concat_ws(
        " ", cell.pick(WORDS, ":first"), cell.pick(WORDS, ":second")
    )
    if "length" in options:
        length = int(options["length"])
        return F.substring(F.repeat(F.concat(text, F.lit(" ")), length), 1, length)
    return text


def _value(cell, column, position, rows) -> Column:
    kind, options = column["type"], column.get("options", {})
    unique = bool(options.get("unique"))
    if kind == "integer":
        low, high = int(options.get("min", 0)), int(options.get("max", 100))
        return _position(cell, high - low + 1, unique, position, rows) + F.lit(low).cast("bigint")
    if kind in ("float", "price"):
        low, high = float(options.get("min", 0)), float(options.get("max", 100))
        decimals = int(options.get("decimals", 2))
        if unique:
            steps = int(round((high - low) * 10**decimals)) + 1
            return F.round(_position(cell, steps, True, position, rows) / 10**decimals + low, decimals)
        return F.round(cell.unit() * (high - low) + low, decimals)
    if kind == "boolean":
        return _position(cell, 2, unique, position, rows) == 0
    if kind in ("date", "datetime"):
        start, days = _days(options)
        day = F.date_add(F.lit(start), _position(cell, days, unique, position, rows).cast("int"))
        if kind == "date":
            return F.date_format(day, "yyyy-MM-dd")
        seconds = cell.below(86_400, ":time")
        clock = [F.lpad((part).cast("string"), 2, "0") for part in
                 (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)]
        return F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.concat_ws(":", *clock))
    if kind == "category" and unique:
        names = list(options["categories"])
        return F.get(F.array(*[F.lit(n) for n in names]), _position(cell, len(names), True, position, rows).cast("int"))
    text = _text(cell, kind, options)
    if unique and kind != "uuid":
        if kind == "email":
            return F.concat(cell.row_id.cast("string"), F.lit("."), text)
        return F.concat_ws("-", text, cell.row_id.cast("string"))
    return text


def synthesize(
    ids: DataFrame, spec: list[Mapping[str, Any]], seed: int = 42, id_column: str = "id",
    rows: int | None = None, keep_id: bool = False,
) -> DataFrame:
    """One synthetic row per id. ``rows`` says the ids are 0 to rows - 1."""
    _check(spec, rows)
    row_id = F.col(id_column)
    columns = []
    for column in spec:
        cell = _Cell(row_id, seed, column["name"])
        value = _value(cell, column, row_id if rows is not None else None, rows)
        nulls = float(column.get("options", {}).get("allow_nulls", 0))
        if nulls > 0:
            value = F.when(cell.unit(":null") >= F.lit(nulls / 100), value)
        columns.append(value.alias(column["name"]))
    return ids.select(*([row_id] if keep_id else []), *columns)


def generate(
    spark: SparkSession, spec: list[Mapping[str, Any]], rows: int, seed: int = 42, max_rows: int | None = None
) -> DataFrame:
    """Exactly ``rows`` synthetic rows."""
    _check(spec, rows, max_rows)
    return synthesize(spark.range(rows), spec, seed, rows=rows)


def preview(spark: SparkSession, spec: list[Mapping[str, Any]], rows: int = 20, seed: int = 42) -> DataFrame:
    return generate(spark, spec, rows, seed, max_rows=MAX_PREVIEW)
