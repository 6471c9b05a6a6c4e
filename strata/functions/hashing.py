"""Primary keys and row hashes for change detection.

Two forms exist:

* ``token`` (default): values cast to string, trimmed, null written as the
  token ``NULL``, joined by ``|``; columns of a row hash taken in name order.
  Null and the string "NULL" collide, which is accepted and documented.
* ``skip``: values cast to string, trimmed, nulls skipped, joined by ``||``;
  columns of a row hash taken in frame order. (null, "y") and ("y", null)
  collide in this form.

Both stay inside whole-stage codegen (md5 / sha2 / concat_ws are built-ins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators, null token and the audit columns left out of a row hash.
TOKEN_SEP = "|"
SKIP_SEP = "||"
NULL_TOKEN = "NULL"
HASH_EXCLUDE = ["_pk", "_row_hash", "_source_file", "_source_path", "_ingestion_date",
                "_ingestion_timestamp", "_batch_id", "_updated_at", "_layer"]


def _part(c: str, form: str, trim: bool) -> Column:
    v = F.col(c).cast("string")
    if trim:
        v = F.trim(v)
    return F.coalesce(v, F.lit(NULL_TOKEN)) if form == "token" else v


def concat_key(cols: list[str], form: str = "token", trim: bool = True) -> Column:
    sep = TOKEN_SEP if form == "token" else SKIP_SEP
    return F.concat_ws(sep, *[_part(c, form, trim) for c in cols])


def _check(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    if not cols:
        raise ValueError("at least one key column is required")


def primary_key_expr(df: DataFrame, key_columns: list[str], form: str = "token",
                     trim: bool = True) -> Column:
    _check(df, key_columns)
    return F.md5(concat_key(key_columns, form, trim))


def row_hash_expr(df: DataFrame, exclude_columns: list[str] | None = None,
                  form: str = "token", trim: bool = True) -> Column:
    return F.sha2(concat_key(hash_columns(df, exclude_columns, form), form, trim), 256)


def add_primary_key(df: DataFrame, key_columns: list[str], form: str = "token",
                    trim: bool = True, name: str = "_pk") -> DataFrame:
    """``_pk`` = md5 of the joined key values."""
    return df.withColumn(name, primary_key_expr(df, key_columns, form, trim))


def hash_columns(df: DataFrame, exclude: list[str] | None = None,
                 form: str = "token") -> list[str]:
    skip = set(HASH_EXCLUDE if exclude is None else list(exclude) + HASH_EXCLUDE)
    cols = [c for c in df.columns if c not in skip]
    return sorted(cols) if form == "token" else cols


def add_row_hash(df: DataFrame, exclude_columns: list[str] | None = None,
                 form: str = "token", trim: bool = True) -> DataFrame:
    """``_row_hash`` = sha256 of all non-audit columns. Never mutates arguments."""
    return df.withColumn("_row_hash", row_hash_expr(df, exclude_columns, form, trim))


def hash_key(cols: list[str]) -> Column:
    """Stable 60-bit bigint surrogate from the natural key (md5 prefix).

    Needs no global ordering, so dimension keys are assigned in parallel and
    stay equal across runs, partitionings and engines.
    """
    return F.conv(F.substring(F.md5(concat_key(cols, "token", False)), 1, 15), 16, 10).cast("bigint")
