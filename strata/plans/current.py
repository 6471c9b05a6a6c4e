"""Writing the current tables by what has changed.

``merge_into_silver`` is the one way into the silver sales table, for a batch, a
stream's micro-batch and a reprocess: enrich, find the periods touched, merge
these, commit. Gold and the fact are projections of silver, period by period:
``refresh`` rebuilds the periods whose silver folders differ from those that the
table was last built from. Periods that are not touched keep their files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.cdc import INSERT, KEEP, STALE, UNCHANGED, UPDATE, merge
from ..operators.control import observed_values
from ..operators.materialize import materialize
from ..sources.tables import Commit, TableStore
from .layers import CHANNEL_TABLE, SALES_TABLE, Profile, enrich_with_channels

# Periods, the partitions of silver, gold and fact.
PERIOD_PARTITIONS = ["year", "month"]
ACTIONS = (INSERT, UPDATE, UNCHANGED, STALE, KEEP)


def touched_periods(store: TableStore, base: Commit, source: DataFrame, key_has_period: bool) -> set[str]:
    """Partitions that a merge of ``source`` changes: those of its rows and,
    where a key can move to another period, those that hold its keys now (a
    scan of three columns of the other partitions against the increment's keys)."""
    touched = store.partition_names(source, PERIOD_PARTITIONS)
    others = set(base.folders) - touched
    if not key_has_period and others:
        held = store.load("silver", SALES_TABLE, base, others).select("_pk", *PERIOD_PARTITIONS)
        touched |= store.partition_names(held.join(source.select("_pk").distinct(), "_pk", "left_semi"), PERIOD_PARTITIONS)
    return touched


def merge_into_silver(store: TableStore, profile: Profile, typed: DataFrame, version: str) -> dict:
    """Merge typed sales into the current table under ``version``: counts by
    action, and ``rows`` of the table. Without a channel master the rows have
    no channel columns, and an update keeps those that are there. If another
    writer commits meanwhile, the merge is done again on its result."""
    if store.has_rows_to_read("silver", CHANNEL_TABLE):
        typed = enrich_with_channels(typed, store.read("silver", CHANNEL_TABLE))
    source = materialize(typed, "increment")
    buckets = profile.current_buckets
    key_has_period = set(PERIOD_PARTITIONS) <= set(profile.key_columns)
    seen: dict = {}

    def build(base: Commit | None):
        scoped = base is not None and not buckets and base.partitions == PERIOD_PARTITIONS
        only = touched_periods(store, base, source, key_has_period) if scoped else None
        if base is None:
            current = store.spark.createDataFrame([], source.schema)
        else:
            current = store.load("silver", SALES_TABLE, base, only)
        seen["obs"] = Observation()
        merged = merge(source, current, num_partitions=buckets)
        return merged.observe(seen["obs"], *(F.count_if(F.col("_action") == a).alias(a) for a in ACTIONS)).drop("_action"), only

    store.update("silver", SALES_TABLE, build, version, None if buckets else PERIOD_PARTITIONS,
                 (buckets, "_pk") if buckets else None)
    rows = store.read("silver", SALES_TABLE, version).count()  # row counts of the file footers
    done = observed_values(seen["obs"], lambda: rows)
    counts = {a: done[a] for a in ACTIONS if a != KEEP}
    return {**counts, KEEP: rows - sum(counts.values()), "rows": rows}


def fingerprint(profile: Profile) -> str:
    """Changes when a parameter of the derived tables does: they are built anew."""
    return hashlib.md5(repr(profile).encode()).hexdigest()


def refresh(store: TableStore, layer: str, table: str, source: tuple[str, str], version: str, profile: Profile,
            build: Callable[[DataFrame], DataFrame]) -> None:
    """Commit ``build`` of the newest source version, whose periods are the
    table's: only those that have changed since the table was last built."""
    now = store.newest(*source)
    inputs = {".".join(source): now.version, "profile": fingerprint(profile)}

    def rows(base: Commit | None):
        only = None
        if base is not None and base.partitions == PERIOD_PARTITIONS and base.inputs.get("profile") == inputs["profile"]:
            only = store.changed(*source, base.inputs.get(".".join(source)))
        return build(store.load(*source, now, only)), only

    store.update(layer, table, rows, version, PERIOD_PARTITIONS, inputs=inputs)
