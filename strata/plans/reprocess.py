"""Reprocessing of quarantined sales: replay, re-check, merge, mark.

Pending records of the sales source are read back with the schema stored with
the bronze history and checked again. Those that pass now are typed, enriched
and merged into the current silver table (a new committed version), and their
quarantine records are marked in the partitions that hold them.

Two tables change, silver and the quarantine, and a run can end between them. So
the records to be released are written down first (``reprocess_intents``, one
partition per batch). The silver commit decides: ``recover``, the first step of
every call, marks what a committed batch had written down; an intent without a
commit is void, its records are still pending. A repeated call finds nothing
pending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from ..operators.quality import apply_dq_sales, mark_as_reprocessed, pending_reprocess, replay
from ..sources.tables import TableStore
from .current import merge_into_silver
from .layers import SALES_TABLE, Profile, silver_sales

INTENTS = "reprocess_intents"


def mark(store: TableStore, ids: DataFrame, batch_id: str, batch_ts: str | None = None) -> None:
    """Mark the quarantine records; only partitions that hold one are rewritten,
    from a hand-over table, as a plan must not read what it replaces."""
    quarantine = store.read("control", "quarantine")
    touched = quarantine.join(ids.select("quarantine_id"), "quarantine_id", "left_semi").select("batch_id").distinct()
    marked = mark_as_reprocessed(quarantine.join(touched, "batch_id", "left_semi"), ids, batch_id, batch_ts)
    store.overwrite_partitions(materialize(marked.select(*quarantine.columns), "marked"), "control", "quarantine", ["batch_id"])


def recover(store: TableStore, batch_ts: str | None = None) -> list[str]:
    """Finish batches whose silver commit was made and whose records are still
    pending. Returns their ids."""
    if not store.has_rows_to_read("control", INTENTS):
        return []
    intents = store.read("control", INTENTS)
    pending = pending_reprocess(store.read("control", "quarantine")).select("quarantine_id")
    open_ = intents.join(pending, "quarantine_id", "left_semi").select("reprocess_batch_id").distinct().collect()  # batches
    done = sorted(r[0] for r in open_ if store.is_committed("silver", SALES_TABLE, r[0]))
    for batch in done:
        mark(store, intents.filter(F.col("reprocess_batch_id") == batch), batch, batch_ts)
    return done


def reprocess_sales(store: TableStore, profile: Profile, batch_id: str, batch_ts: str | None = None) -> dict:
    """Counts: released records, records still held, and merge actions."""
    recover(store, batch_ts)
    schema = store.saved_schema("bronze", SALES_TABLE)
    pending = pending_reprocess(store.read("control", "quarantine"), f"bronze.{SALES_TABLE}")
    again = materialize(apply_dq_sales(replay(pending, schema), years=profile.years), "reprocess")
    passed = again.filter(F.col("_dq_code").isNull())
    out = {"released": passed.count(), "held": again.filter(F.col("_dq_code").isNotNull()).count(), "actions": {}}
    if not out["released"]:
        return out
    if store.is_committed("silver", SALES_TABLE, batch_id):
        raise ValueError(f"batch {batch_id} has been committed; records that pass since need a new batch id")
    store.overwrite_partitions(passed.select("quarantine_id", F.lit(batch_id).alias("reprocess_batch_id")),
                               "control", INTENTS, ["reprocess_batch_id"])
    counts = merge_into_silver(store, profile, silver_sales(passed.drop("quarantine_id"), batch_ts), batch_id)
    out["actions"] = {a: n for a, n in counts.items() if n and a != "rows"}
    mark(store, passed.select("quarantine_id"), batch_id, batch_ts)
    return out
