"""One batch through every layer, written to a ``TableStore`` with run control.

landing -> bronze (history, one partition per batch: a re-run replaces it)
        -> silver (DQ split, quarantine, typing, enrichment, keyed merge into
           the current table, of which only the periods touched are written)
        -> gold (business rules) and the fact: the periods that silver changed
        -> consumption (dimensions and the three marts, new versions)

A step whose output version for this batch is already committed is skipped,
so re-running a batch after a failure resumes where it stopped and re-running
a finished batch changes nothing (bronze is a per-batch partition overwrite).

The landing files of a batch are written to a ledger (path, length, time) before
its first step. A re-run over other files would give bronze one content and
silver another, so it is refused (``LandingChanged``), or, with
``on_change="reload"``, runs every step again as a new revision of the batch.

Each step is bracketed by ``ProcessControl.track`` (start before the work,
end after it) and takes its record counts from ``observe`` on the frame it
writes, so counting costs no extra pass. Every step reads its input back
from storage: the hand-over between layers is the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audit import add_consumption_audit
from ..operators import star
from ..operators.control import ProcessControl, observed, observed_values
from ..operators.quality import apply_dq_sales, quarantine_records, rule_description
from ..sources.files import changed_files, landing_files
from ..sources.tables import TableStore
from . import marts
from .current import PERIOD_PARTITIONS, merge_into_silver, refresh  # noqa: F401 - the first is part of this module's interface
from .layers import (CHANNEL_TABLE, SALES_TABLE, Profile, bronze_channels, bronze_sales,
                     gold_channels, gold_sales, silver_channels, silver_sales)

# Storage layout. History by load date and batch (a re-run
# replaces exactly its own partition).
BRONZE_PARTITIONS = ["_ingestion_date", "_batch_id"]
# Lookup key of each dimension; it must be unique.
DIMENSION_KEYS = {"dim_date": "date_key", "dim_region": "region_key", "dim_product": "product_key",
                  "dim_channel": "channel_key"}
MART_TABLES = ("agg_sales_region_tradegroup", "agg_sales_brand_month", "agg_sales_brand_region")


LEDGER = "landing_files"


class LandingChanged(RuntimeError):
    """The landing files differ from those that this batch was started with."""


def checked_landing(store: TableStore, now: DataFrame, batch_id: str, on_change: str) -> str:
    """The version that the batch's steps commit: the batch id, or after a
    reload the id and a revision. The ledger keeps a partition per version."""
    revisions = [batch_id]
    if store.has_rows_to_read("control", LEDGER):
        ledger = store.read("control", LEDGER)
        names = {r[0] for r in ledger.filter((F.col("batch_id") == batch_id) | F.col("batch_id").startswith(f"{batch_id}.r"))
                 .select("batch_id").distinct().collect()}  # revisions of one batch
        revisions = sorted(names, key=lambda v: int(v.partition(".r")[2] or 0)) or revisions
        if names:
            changes = changed_files(ledger.filter(F.col("batch_id") == revisions[-1]), now)
            if changes.isEmpty():
                return revisions[-1]
            if on_change != "reload":
                first = changes.orderBy("path").first()
                raise LandingChanged(f"batch {batch_id}: {first['path']} was {first['change']} since the batch was started")
            revisions.append(f"{batch_id}.r{int(revisions[-1].partition('.r')[2] or 0) + 1}")
    store.overwrite_partitions(now.withColumn("batch_id", F.lit(revisions[-1])), "control", LEDGER, ["batch_id"])
    return revisions[-1]


def run_batch(spark: SparkSession, store: TableStore, sales_landing: DataFrame,
              channel_landing: DataFrame, profile: Profile, batch_id: str,
              batch_ts: str | None = None, control: ProcessControl | None = None, on_change: str = "refuse") -> dict:
    pc = control or ProcessControl(spark, sink=lambda d: store.append(d, "control", "process_control"))
    out: dict = {}
    now = landing_files(sales_landing, SALES_TABLE, batch_id).unionByName(landing_files(channel_landing, CHANNEL_TABLE, batch_id))
    version = checked_landing(store, now, batch_id, on_change)

    def written(layer: str, table: str):
        """Rows of this batch's write, for an observation that reported none."""
        def count() -> int:
            if layer == "bronze":
                return store.read(layer, table).filter(F.col("_batch_id") == batch_id).count()
            if layer == "control":
                return store.read(layer, table).filter(F.col("batch_id") == batch_id).count()
            return store.read(layer, table, version).count()
        return count

    def step(layer: str, table: str, build, versioned: bool = True) -> None:
        """Run one write under run control unless its version is committed."""
        if versioned and store.is_committed(layer, table, version):
            out.setdefault("skipped", []).append(f"{layer}.{table}")
            return
        with pc.track(batch_id, layer, table) as run:
            run.update(build())

    # ---- bronze: append-only history, one partition per batch -------------------
    def bronze_sales_step():
        b, obs = observed(bronze_sales(sales_landing, profile, batch_id, batch_ts))
        store.overwrite_partitions(b, "bronze", SALES_TABLE, BRONZE_PARTITIONS)
        out["bronze_rows"] = observed_values(obs, written("bronze", SALES_TABLE))["rows"]
        return {"records_read": out["bronze_rows"], "records_written": out["bronze_rows"]}

    def bronze_channels_step():
        c, obs = observed(bronze_channels(channel_landing, profile, batch_id, batch_ts))
        store.overwrite_partitions(c, "bronze", CHANNEL_TABLE, BRONZE_PARTITIONS)
        return {"records_written": observed_values(obs, written("bronze", CHANNEL_TABLE))["rows"]}

    # ---- silver ------------------------------------------------------------------
    def silver_channels_step():
        ch, obs = observed(silver_channels(store.read("bronze", CHANNEL_TABLE), batch_ts))
        store.replace(ch, "silver", CHANNEL_TABLE, version=version)
        return {"records_written": observed_values(obs, written("silver", CHANNEL_TABLE))["rows"]}

    def silver_sales_step():
        # only this batch's partition of the history is read (partition pruning)
        src = store.read("bronze", SALES_TABLE).filter(F.col("_batch_id") == batch_id)
        dq = apply_dq_sales(src, years=profile.years)
        bad = dq.filter(F.col("_dq_code").isNotNull())
        q, qobs = observed(quarantine_records(bad, f"bronze.{SALES_TABLE}", f"silver.{SALES_TABLE}",
                                              batch_id, F.col("_dq_code"), rule_description(F.col("_dq_code")),
                                              batch_ts=batch_ts))
        store.overwrite_partitions(q, "control", "quarantine", ["batch_id"])
        typed = silver_sales(dq.filter(F.col("_dq_code").isNull()), batch_ts)
        m = merge_into_silver(store, profile, typed, version)
        out.update({"inserted": m["insert"], "updated": m["update"], "unchanged": m["unchanged"], "kept": m["keep"]})
        out["quarantined"], out["silver_rows"] = observed_values(qobs, written("control", "quarantine"))["rows"], m["rows"]
        return {"records_read": m["insert"] + m["update"] + m["unchanged"] + out["quarantined"],
                "records_written": m["rows"], "records_quarantined": out["quarantined"]}

    # ---- gold ----------------------------------------------------------------------
    def gold_sales_step():
        refresh(store, "gold", SALES_TABLE, ("silver", SALES_TABLE), version, profile,
                lambda silver: gold_sales(silver, profile, batch_ts))
        out["gold_rows"] = store.read("gold", SALES_TABLE, version).count()
        return {"records_written": out["gold_rows"]}

    def gold_channels_step():
        gc, obs = observed(gold_channels(store.read("silver", CHANNEL_TABLE), batch_ts))
        store.replace(gc, "gold", CHANNEL_TABLE, version=version)
        return {"records_written": observed_values(obs, written("gold", CHANNEL_TABLE))["rows"]}

    step("bronze", SALES_TABLE, bronze_sales_step, versioned=False)
    step("bronze", CHANNEL_TABLE, bronze_channels_step, versioned=False)
    step("silver", CHANNEL_TABLE, silver_channels_step)
    step("silver", SALES_TABLE, silver_sales_step)
    step("gold", SALES_TABLE, gold_sales_step)
    step("gold", CHANNEL_TABLE, gold_channels_step)

    # ---- consumption -----------------------------------------------------------------
    def write(name: str, build):
        def run():
            built = build()
            if key := DIMENSION_KEYS.get(name):
                twice = star.check_unique(built, key).first()
                if twice is not None:
                    raise ValueError(f"{name}.{key} is not unique: {twice[key]} occurs {twice['n']} times")
            d, obs = observed(add_consumption_audit(built, name, batch_ts) if name not in MART_TABLES else built)
            store.replace(d, "consumption", name, version=version)
            out[f"{name}_rows"] = observed_values(obs, written("consumption", name))["rows"]
            return {"records_written": out[f"{name}_rows"]}
        return run

    gold = lambda: store.read("gold", SALES_TABLE)
    step("consumption", "dim_date", write("dim_date", lambda: star.dim_date(gold())))
    step("consumption", "dim_region", write("dim_region", lambda: star.dim_region(gold())))
    step("consumption", "dim_product", write("dim_product", lambda: star.dim_product(gold())))
    step("consumption", "dim_channel", write("dim_channel", lambda: star.dim_channel(
        gold(), store.read("gold", CHANNEL_TABLE))))

    def fact_step():
        refresh(store, "consumption", "fact_sales", ("gold", SALES_TABLE), version, profile, lambda g: add_consumption_audit(
            star.fact_sales(g, profile.null_safe_lookup), "fact_sales", batch_ts))
        out["fact_sales_rows"] = store.read("consumption", "fact_sales", version).count()
        return {"records_written": out["fact_sales_rows"]}

    step("consumption", "fact_sales", fact_step)
    s = lambda n: store.read("consumption", n)
    step("consumption", MART_TABLES[0], write(MART_TABLES[0], lambda: marts.top_trade_groups(
        s("fact_sales"), s("dim_region"), s("dim_channel"), None)))
    step("consumption", MART_TABLES[1], write(MART_TABLES[1], lambda: marts.brand_month(
        s("fact_sales"), s("dim_product"), s("dim_date"))))
    step("consumption", MART_TABLES[2], write(MART_TABLES[2], lambda: marts.brand_region(
        s("fact_sales"), s("dim_product"), s("dim_region"))))
    return out
