"""Governance and observability as tables: catalog, lineage, DQ results,
retention, alerts and dashboard series."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .materialize import materialize

# Lineage of the pipeline (source -> target, description).
LINEAGE = [
    ("landing.beverage_sales", "bronze.beverage_sales", "ingest with key, hash and audit columns"),
    ("landing.beverage_channel_group", "bronze.beverage_channel_group", "ingest with key, hash and audit columns"),
    ("bronze.beverage_sales", "silver.beverage_sales", "quality rules, typing, merge"),
    ("bronze.beverage_channel_group", "silver.beverage_channel_group", "latest per key, trim"),
    ("silver.beverage_channel_group", "silver.beverage_sales", "channel enrichment"),
    ("silver.beverage_sales", "gold.beverage_sales", "business rules"),
    ("silver.beverage_channel_group", "gold.beverage_channel_group", "channel rules"),
    ("gold.beverage_sales", "consumption.dim_date", "calendar dimension"),
    ("gold.beverage_sales", "consumption.dim_region", "region dimension"),
    ("gold.beverage_sales", "consumption.dim_product", "product dimension"),
    ("gold.beverage_sales", "consumption.dim_channel", "channel dimension"),
    ("gold.beverage_channel_group", "consumption.dim_channel", "channel attributes"),
    ("gold.beverage_sales", "consumption.fact_sales", "sales fact"),
    ("consumption.fact_sales", "consumption.agg_sales_region_tradegroup", "top trade groups"),
    ("consumption.fact_sales", "consumption.agg_sales_brand_month", "brand by month"),
    ("consumption.fact_sales", "consumption.agg_sales_brand_region", "brand by region"),
]
# Retention per layer as (archive after days, retain days).
RETENTION_DAYS = {"landing": (30, 90), "bronze": (180, 365), "silver": (365, 730),
                  "gold": (730, 1095), "consumption": (730, 1095), "control": (180, 365)}
# Classification of tables by name, by prefix and by layer; the
# most exact entry decides. Prefixes name the layered tables of the sales domain.
CLASSIFICATION = {
    "exact": {"bronze.beverage_sales": "INTERNAL", "silver.beverage_sales": "INTERNAL", "gold.beverage_sales": "INTERNAL",
              "consumption.fact_sales": "INTERNAL", "consumption.dim_date": "PUBLIC", "consumption.dim_region": "PUBLIC",
              "consumption.dim_product": "INTERNAL", "consumption.dim_channel": "INTERNAL",
              "control.process_control": "CONFIDENTIAL", "control.quarantine": "CONFIDENTIAL"},
    "prefix": {"consumption.agg_sales_": "INTERNAL", "control.reprocess_": "CONFIDENTIAL"},
    "layer": {"control": "CONFIDENTIAL"},
    "default": "INTERNAL",
}
# The team and the business owner responsible for a table.
STEWARDS = {
    "exact": {}, "prefix": {},
    "layer": {"bronze": "Data Engineering", "silver": "Data Engineering", "gold": "Data Engineering",
              "consumption": "Data Engineering"},
    "default": "Data Engineering Team",
}
BUSINESS_OWNERS = {"exact": {}, "prefix": {}, "layer": {"gold": "Analytics Team", "consumption": "BI Team"}, "default": None}
# Tags of the tables.
TAGS = {
    "exact": {"consumption.fact_sales": ["fact"]},
    "prefix": {"consumption.dim_": ["dimension"], "consumption.agg_": ["aggregate"]},
    "layer": {layer: [layer] for layer in ("landing", "bronze", "silver", "gold", "consumption", "control")},
    "default": [],
}
# Alert thresholds.
STAGE_SECONDS_LIMIT = 3600
QUARANTINE_PER_HOUR_LIMIT = 100
QUARANTINE_RATE_LIMIT = 0.05
SLOW_FACTOR = 2.0
FRESHNESS_HOURS = 24


def resolve(policy: dict, layer: str, table: str):
    """The entry of a policy for one table: its exact name, else the longest
    prefix, else the layer's, else the default. Names are ``layer.table``."""
    name = f"{layer}.{table}"
    if name in policy["exact"]:
        return policy["exact"][name]
    prefixes = [p for p in policy["prefix"] if name.startswith(p)]
    if prefixes:
        return policy["prefix"][max(prefixes, key=len)]
    return policy["layer"].get(layer, policy["default"])


def catalog_rows(spark: SparkSession, tables: dict[str, tuple[str, DataFrame]],
                 owners: dict[str, str] | None = None, descriptions: dict[str, str] | None = None) -> DataFrame:
    """One row per column of every table, from the schemas (no data read), with
    the table's classification, owner, business owner and tags. A given owner
    goes before the policy's."""
    rows = []
    for name, (layer, df) in tables.items():
        of_table = ((owners or {}).get(name) or resolve(STEWARDS, layer, name), resolve(BUSINESS_OWNERS, layer, name),
                    resolve(CLASSIFICATION, layer, name), [*resolve(TAGS, layer, name)])
        for i, f in enumerate(df.schema.fields):
            rows.append((name, layer, (descriptions or {}).get(name), f.name, f.dataType.simpleString(),
                         f.nullable, i + 1, f.name.startswith("_"), *of_table))
    return spark.createDataFrame(rows, "table_name string, layer string, description string, "
                                       "column_name string, data_type string, nullable boolean, ordinal int, "
                                       "is_audit boolean, owner string, business_owner string, classification string, "
                                       "tags array<string>")


def lineage_edges(spark: SparkSession, edges: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(edges or LINEAGE, "source string, target string, description string")


def column_edges(target: DataFrame, target_name: str, sources: dict[str, DataFrame]) -> DataFrame:
    """(source_table, source_column, target_table, target_column): which source
    columns every column of ``target`` is computed from.

    Read from the analysed plan, no data: a named expression refers to the
    attributes below it by their expression ids, and these are followed down to
    the outputs of the given source frames, which the target must be built on.
    Columns that decide which rows there are (filters, join and grouping keys
    that are not put out) are not among them. A column built from constants has
    no edges."""
    known: dict[int, list[tuple[str, str]]] = {}
    plans = {name: df._jdf.queryExecution().analyzed() for name, df in sources.items()}

    def is_source(plan, name: str) -> None:
        out, names = plan.output(), plans[name].output()
        for i in range(out.size()):
            places = known.setdefault(out.apply(i).exprId().id(), [])
            if (name, names.apply(i).name()) not in places:
                places.append((name, names.apply(i).name()))

    for name, plan in plans.items():
        is_source(plan, name)
    made: dict[int, set[int]] = {}
    united: set[int] = set()

    def ids(attributes) -> set[int]:
        it, found = attributes.iterator(), set()
        while it.hasNext():
            found.add(it.next().exprId().id())
        return found

    def walk(plan) -> None:
        kind, children = plan.getClass().getSimpleName(), plan.children()
        for name, source in plans.items():  # a frame used twice occurs with other ids
            if plan.output().size() == source.output().size() and plan.sameResult(source):
                is_source(plan, name)
        if kind == "Union":  # by position; the first child's ids may go on
            out = plan.output()
            for i in range(out.size()):
                united.add(out.apply(i).exprId().id())
                made.setdefault(out.apply(i).exprId().id(), set()).update(
                    children.apply(c).output().apply(i).exprId().id() for c in range(children.size()))
        elif kind == "Generate":
            for a in ids(plan.generatorOutput()):
                made.setdefault(a, set()).update(ids(plan.generator().references()))
        else:
            expressions = plan.expressions()
            for i in range(expressions.size()):
                e = expressions.apply(i)
                if e.getClass().getSimpleName() == "Alias":
                    made.setdefault(e.exprId().id(), set()).update(ids(e.references()))
        for c in range(children.size()):
            walk(children.apply(c))

    analysed = target._jdf.queryExecution().analyzed()
    walk(analysed)
    rows, out = [], analysed.output()
    for i in range(out.size()):
        seen, open_ = set(), [out.apply(i).exprId().id()]
        while open_:
            a = open_.pop()
            if a in seen:
                continue
            seen.add(a)
            rows += [(*place, target_name, out.apply(i).name()) for place in known.get(a, ())]
            if a not in known or a in united:
                open_ += made.get(a, ())
    return target.sparkSession.createDataFrame(
        sorted(set(rows)), "source_table string, source_column string, target_table string, target_column string")


def lineage_upstream(spark: SparkSession, edges_view: str, table: str) -> DataFrame:
    """Every ancestor of ``table`` with its least distance, at any depth.

    A walk from the table upwards: each round joins the edges with the tables
    found in the round before and keeps those not seen yet, so the work follows
    the ancestors, not the whole graph, and a cycle ends."""
    edges = materialize(spark.table(edges_view).select(F.col("source").alias("ancestor"), F.col("target").alias("node")).distinct(),
                        "lineage")
    frontier = spark.createDataFrame([(table,)], "node string")
    seen, depth = spark.createDataFrame([], "ancestor string, depth int"), 0
    while True:
        depth += 1
        found = edges.join(frontier, "node").select("ancestor").distinct().join(seen, "ancestor", "left_anti")
        found = materialize(found.withColumn("depth", F.lit(depth)), "lineage")
        if found.isEmpty():
            return seen
        seen = seen.unionByName(found)  # of written tables, one per round
        frontier = found.select(F.col("ancestor").alias("node"))


def dq_summary(results: DataFrame) -> DataFrame:
    """Pass / fail totals of a DQ result table (``passed`` column)."""
    return results.groupBy("passed").agg(F.count(F.lit(1)).alias("tests"))


def last_batches(history: DataFrame, column: str, batch_col: str = "_batch_id",
                 ts_col: str = "_ingestion_timestamp") -> DataFrame:
    """Newest batch (by load time) and number of batches per value of ``column``.

    A text in an aggregate's result makes Spark sort all rows by group. So the
    rows are first hashed down to one per value and batch with its last load
    time; ``max_by`` runs over these."""
    loads = history.groupBy(column, batch_col).agg(F.max(ts_col).alias("_loaded"))
    return loads.groupBy(column).agg(F.max_by(batch_col, "_loaded").alias("last_batch_id"),
                                     F.count_distinct(batch_col).alias("batches"))


def retention_split(df: DataFrame, layer: str, date_col: str = "_ingestion_date",
                    today: str | None = None) -> DataFrame:
    """Label rows keep / archive / drop by age; a filter on the label prunes
    partitions when the table is partitioned by ``date_col``."""
    keep, archive = RETENTION_DAYS[layer]  # archive after ``keep`` days, drop after ``archive``
    ref = F.to_date(F.lit(today)) if today else F.current_date()
    age = F.datediff(ref, F.col(date_col))
    return df.withColumn("_retention", F.when(age <= keep, "keep").when(age <= archive, "archive")
                         .otherwise("drop"))


def retention_plan(store, layer: str, table: str, date_col: str = "_ingestion_date", today: str | None = None) -> list[tuple[str, str]]:
    """(partition folder, keep / archive / drop) of a history table partitioned
    by ``date_col`` first: from the folder names, no row is read. A folder
    without a date is kept."""
    keep, most = RETENTION_DAYS[layer]
    ref = _dt.date.fromisoformat(today) if today else _dt.datetime.now(_dt.timezone.utc).date()
    plan = []
    for name, _ in sorted(store.folders(layer, table)):
        if not name.startswith(f"{date_col}="):
            continue
        try:
            age = (ref - _dt.date.fromisoformat(name.split("=", 1)[1])).days
        except ValueError:
            age = 0
        plan.append((name, "keep" if age <= keep else "archive" if age <= most else "drop"))
    return plan


def apply_retention(store, layer: str, table: str, date_col: str = "_ingestion_date", today: str | None = None,
                    keep_versions: int = 3) -> dict[str, list[str]]:
    """Carry out the plan: archived partitions are moved to the same place under
    the store's ``archive`` folder, dropped ones deleted; of a table with
    versions the older ones go too. What has been done is not to be done again."""
    done: dict[str, list[str]] = {"keep": [], "archive": [], "drop": []}
    for folder, label in retention_plan(store, layer, table, date_col, today):
        if label == "archive":
            store.archive(layer, table, folder)
        elif label == "drop":
            store.remove(layer, table, folder)
        done[label].append(folder)
    done["versions"] = store.prune_versions(layer, table, keep_versions)
    return done


def hourly_counts(events: DataFrame, by: str, ts_col: str = "ts") -> DataFrame:
    """(by, hour, n, mean_before): rows per hour and the mean of all earlier
    hours that have rows. The frame runs over the hourly counts, not the rows."""
    hours = events.filter(F.col(ts_col).isNotNull()).groupBy(by, F.window(ts_col, "1 hour")["start"].alias("hour")) \
        .agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(by).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    return hours.withColumn("mean_before", F.sum("n").over(before) / F.count("n").over(before))


def event_alerts(events: DataFrame, by: str, ts_col: str = "ts", burst: int = QUARANTINE_PER_HOUR_LIMIT,
                 factor: float = SLOW_FACTOR) -> DataFrame:
    """(alert, subject, hour, value, bound): hours with more than ``burst`` rows,
    and hours with more than ``factor`` times the mean of those before."""
    h = hourly_counts(events, by, ts_col)
    cases = F.array(
        F.struct(F.lit("hourly_burst").alias("alert"), F.lit(float(burst)).alias("bound")),
        F.struct(F.lit("above_history").alias("alert"), (factor * F.col("mean_before")).alias("bound")))
    return h.select(F.col(by).cast("string").alias("subject"), "hour", F.col("n").alias("value"), F.explode(cases).alias("c")) \
        .select("c.alert", "subject", "hour", "value", "c.bound").filter(F.col("value") > F.col("bound"))


def alerts(control: DataFrame, quarantine: DataFrame, now: str | None = None) -> DataFrame:
    """Alert rows (alert, subject, value) from the control and quarantine tables.

    Includes ``stale_table``: a (layer, table) whose newest successful run
    ended more than 24 hours before ``now`` (default: the current time)."""
    from .control import with_historical_mean
    c = with_historical_mean(control.filter(F.col("status") != "RUNNING"))
    subject = F.concat_ws(".", "layer", "table_name", "batch_id")
    slow = c.filter(F.col("duration_seconds") > STAGE_SECONDS_LIMIT).select(
        F.lit("stage_too_long").alias("alert"), subject.alias("subject"),
        F.col("duration_seconds").cast("double").alias("value"))
    failed = c.filter(F.col("status") == "FAILED").select(
        F.lit("run_failed").alias("alert"), subject.alias("subject"), F.lit(1.0).alias("value"))
    slower = c.filter(F.col("duration_seconds") > SLOW_FACTOR * F.col("historical_mean_seconds")).select(
        F.lit("slower_than_history").alias("alert"), subject.alias("subject"),
        F.col("duration_seconds").cast("double").alias("value"))
    rate = c.filter((F.col("records_read") > 0)
                    & (F.col("records_quarantined") / F.col("records_read") > QUARANTINE_RATE_LIMIT)).select(
        F.lit("quarantine_rate").alias("alert"), subject.alias("subject"),
        (F.col("records_quarantined") / F.col("records_read")).alias("value"))
    hourly = (quarantine.groupBy(F.window("created_at", "1 hour").alias("w"))
              .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > QUARANTINE_PER_HOUR_LIMIT)
              .select(F.lit("quarantine_burst").alias("alert"),
                      F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("subject"),
                      F.col("n").cast("double").alias("value")))
    unknown = (quarantine.filter(~F.col("is_known_rule") & ~F.col("reprocessed"))
               .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
               .select(F.lit("unknown_errors").alias("alert"), F.lit("quarantine").alias("subject"),
                       F.col("n").cast("double").alias("value")))
    ref = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    age_h = (F.unix_timestamp(ref) - F.unix_timestamp(F.col("last_success"))) / 3600.0
    stale = (c.filter(F.col("status") == "SUCCESS").groupBy("layer", "table_name")
             .agg(F.max("end_timestamp").alias("last_success"))
             .filter(age_h > FRESHNESS_HOURS)
             .select(F.lit("stale_table").alias("alert"), F.concat_ws(".", "layer", "table_name").alias("subject"),
                     F.round(age_h, 2).alias("value")))
    return (slow.unionByName(failed).unionByName(slower).unionByName(rate).unionByName(hourly)
            .unionByName(unknown).unionByName(stale))


def dashboard_series(control: DataFrame) -> dict[str, DataFrame]:
    c = control.filter(F.col("status") != "RUNNING")
    return {
        "runs_by_status": c.groupBy("status").agg(F.count(F.lit(1)).alias("runs")),
        "quarantined_total": c.agg(F.sum("records_quarantined").alias("records_quarantined")),
        "mean_duration": c.agg(F.avg("duration_seconds").alias("mean_duration_seconds")),
        "per_stage": c.groupBy("layer", "table_name").agg(
            F.avg("duration_seconds").alias("mean_duration_seconds"),
            F.sum("records_written").alias("records_written")),
    }
