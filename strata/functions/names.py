"""Column-name standardisation (bronze)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def generic_name(name: str) -> str:
    """The runs of ASCII letters and digits, lower-cased, joined by '_'."""
    return "_".join(re.findall("[a-z0-9]+", name.lower()))


def currency_name(name: str) -> str:
    """Lower-cased; a blank reads '_', and a '$' (with the blank or underscore
    after it) reads 'dollar_'. Other characters stay."""
    return re.sub(r"(\$[ _]?)| ", lambda m: "dollar_" if m[1] else "_", name.strip().lower())


RULES = {"generic": generic_name, "currency": currency_name}


def standardize_column_names(df: DataFrame, rule: str = "currency") -> DataFrame:
    """Rename every column by ``rule``; raise if two columns map to one name.

    A single ``toDF`` keeps the plan to one Project however wide the frame is.
    """
    fn = RULES[rule]
    new = [fn(c) for c in df.columns]
    dupes = sorted({n for n in new if new.count(n) > 1})
    if dupes:
        raise ValueError(f"column names collide after standardisation: {dupes}")
    return df.toDF(*new)


def business_columns(df: DataFrame) -> list[str]:
    """Columns that are not audit columns (audit columns start with '_')."""
    return [c for c in df.columns if not c.startswith("_")]


def audit_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_")]
