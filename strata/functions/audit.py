"""Audit columns stamped on every layer."""

from __future__ import annotations

import datetime as _dt
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_id_for(ts: _dt.datetime | None = None) -> str:
    return (ts or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y%m%d%H%M%S")


def _ts(batch_ts: str | None) -> Column:
    return F.to_timestamp(F.lit(batch_ts)) if batch_ts else F.current_timestamp()


def audit_exprs(source_file: str | None = None, source_path: str | None = None, layer: str = "bronze",
                batch_id: str | None = None, batch_ts: str | None = None) -> dict[str, Column]:
    if source_file is None:
        path = F.col("_metadata.file_path")
        name = F.element_at(F.split(path, "/"), -1)
    else:
        path = F.lit(source_path or source_file)
        name = F.lit(posixpath.basename(source_file))
    ts = _ts(batch_ts)
    return {
        "_source_file": name,
        "_source_path": path,
        "_ingestion_date": F.to_date(ts),
        "_ingestion_timestamp": ts,
        "_batch_id": F.lit(batch_id or batch_id_for()),
        "_updated_at": ts,
        "_layer": F.lit(layer),
    }


def add_audit_columns(df: DataFrame, source_file: str | None = None,
                      source_path: str | None = None, layer: str = "bronze",
                      batch_id: str | None = None, batch_ts: str | None = None) -> DataFrame:
    """Seven lineage columns.

    ``source_file=None`` takes the path per row from the file source's hidden
    ``_metadata`` column, so one read of many files keeps per-file lineage.
    ``batch_ts`` pins the load time (replays, tests); default is now.
    """
    return df.withColumns(audit_exprs(source_file, source_path, layer, batch_id, batch_ts))


def update_layer_timestamp(df: DataFrame, layer: str, batch_ts: str | None = None) -> DataFrame:
    ts = _ts(batch_ts)
    return df.withColumns({"_updated_at": ts, "_layer": F.lit(layer), f"_{layer}_timestamp": ts})


def add_consumption_audit(df: DataFrame, table_name: str, batch_ts: str | None = None) -> DataFrame:
    return update_layer_timestamp(df, "consumption", batch_ts).withColumn(
        "_table_name", F.lit(table_name))


def audit_first(df: DataFrame) -> DataFrame:
    """Reorder: audit columns first, business columns after."""
    a = [c for c in df.columns if c.startswith("_")]
    return df.select(*a, *[c for c in df.columns if c not in a])
