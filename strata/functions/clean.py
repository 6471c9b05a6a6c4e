"""Trimming and null-safe typing (silver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accepted type names; "float" deliberately maps to double.
TYPE_NAMES = {
    "int": "int", "integer": "int", "long": "bigint", "bigint": "bigint",
    "double": "double", "float": "double", "string": "string",
    "date": "date", "timestamp": "timestamp",
}


def clean_string_columns(df: DataFrame, columns: list[str] | None = None,
                         blank_to_null: bool = False) -> DataFrame:
    """Trim the listed (default: all string) columns; unknown names ignored."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    todo = {}
    for c in columns:
        if c in df.columns:
            t = F.trim(F.col(c))
            todo[c] = F.when(t != "", t) if blank_to_null else t
    return df.withColumns(todo) if todo else df


def cast_columns(df: DataFrame, column_types: dict[str, str]) -> DataFrame:
    """Cast by type name with ``try_cast`` (bad values become null under ANSI).

    Decimal types (``decimal(p,s)``) are accepted as well; an unknown column
    or type name is ignored.
    """
    todo = {}
    for c, t in column_types.items():
        if c not in df.columns:
            continue
        name = t.lower().strip()
        target = TYPE_NAMES.get(name) or (name if name.startswith("decimal") else None)
        if target:
            todo[c] = F.col(c).try_cast(target)
    return df.withColumns(todo) if todo else df
