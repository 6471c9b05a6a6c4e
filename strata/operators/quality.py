"""Declarative data-quality rules, quarantine records and replay.

A rule list compiles to ONE projection: an array of violation labels per row
(``array_compact`` of ``when`` expressions). Valid rows have an empty array.
Both outputs of a split are filters over that single flagged frame, so a
caller that writes them together (``partitionBy`` on the flag, or one
``foreachBatch``) scans the input once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .joins import bounded_broadcast, partitions_for

# The quarantine table layout.
QUARANTINE_SCHEMA = (
    "quarantine_id string, batch_id string, source_table string, target_table string, "
    "record_data string, error_type string, error_code string, error_description string, "
    "dq_rule_name string, is_known_rule boolean, reprocessed boolean, "
    "reprocess_batch_id string, created_at timestamp, updated_at timestamp")

# Error types of known and of unknown rules.
VALIDATION_ERROR, UNKNOWN_ERROR = "VALIDATION_ERROR", "UNKNOWN_ERROR"

# The sales rules that run in the pipeline (first match wins).
SALES_RULES = [
    ("DQ_SALES_001", "brand_nm", "not_null", "brand_nm must not be null"),
    ("DQ_SALES_002", "trade_chnl_desc", "not_null", "trade_chnl_desc must not be null"),
]
# Declared rules (documented for the sources, enforced here).
SALES_DECLARED_YEARS = (2000, 2030)
SALES_DECLARED_RULES = [
    ("DQ_SALES_003", "dollar_volume must be numeric"),
    ("DQ_SALES_004", "date must be M/d/yyyy"),
    ("DQ_SALES_006", "year must be within 2000-2030"),
    ("DQ_SALES_007", "month must be within 1-12"),
    ("DQ_SALES_008", "trade channel must exist in the channel master"),
]
CHANNEL_DECLARED_RULES = [
    ("DQ_CHANNEL_001", "trade_chnl_desc must not be null"),
    ("DQ_CHANNEL_002", "trade_group_desc must not be null"),
    ("DQ_CHANNEL_003", "trade_chnl_desc must be unique"),
    ("DQ_CHANNEL_004", "trade_type_desc must be an allowed value"),
]
CHANNEL_ALLOWED_TYPES = ["ALCOHOLIC", "NON ALCOHOLIC", "MIX"]


# --- generic rule engine ----------------------------------------------------

# Error label suffix per rule type ("<column>:<suffix>").
RULE_LABELS = {"not_null": "null", "positive": "not_positive",
               "in_list": "not_in_list", "regex": "regex_mismatch"}


def rule_description(code: Column) -> Column:
    """Description of a sales or channel rule code (for quarantine rows)."""
    from ..functions.rules import map_lookup
    text = {c: d for c, _, _, d in SALES_RULES}
    text.update(dict(SALES_DECLARED_RULES))
    text.update(dict(CHANNEL_DECLARED_RULES))
    return map_lookup(code, text, "unknown rule")


def _violation(rule: dict) -> Column | None:
    c = F.col(rule["column"])
    kind = rule["rule"]
    if kind not in RULE_LABELS:
        raise ValueError(f"unknown rule type {kind!r}")
    label = F.lit(f"{rule['column']}:{RULE_LABELS[kind]}")
    if kind == "not_null":
        bad = c.isNull()
    elif kind == "positive":          # null counts as valid
        bad = c <= 0
    elif kind == "in_list":           # null counts as valid
        bad = ~c.isin(list(rule.get("values", [])))
    elif kind == "regex":             # null counts as valid
        bad = ~c.rlike(rule.get("pattern", ".*"))
    return F.when(F.coalesce(bad, F.lit(False)), label)


def flag_violations(df: DataFrame, rules: list[dict], strict: bool = True) -> DataFrame:
    """Add ``_violations`` (array of ``column:rule`` labels)."""
    checks = []
    for r in rules:
        if r.get("column") not in df.columns:
            if strict:
                raise ValueError(f"rule on unknown column {r.get('column')!r}")
            continue
        checks.append(_violation(r))
    arr = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("_violations", arr)


def apply_data_quality_rules(df: DataFrame, rules: list[dict], strict: bool = True,
                             batch_ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, quarantine). Quarantine keeps ``_validation_errors``
    ("; "-joined labels) and gains ``_quarantine_timestamp``."""
    flagged = flag_violations(df, rules, strict)
    ok = F.size("_violations") == 0
    valid = flagged.filter(ok).drop("_violations")
    ts = F.to_timestamp(F.lit(batch_ts)) if batch_ts else F.current_timestamp()
    bad = (flagged.filter(~ok)
           .withColumn("_validation_errors", F.concat_ws("; ", "_violations"))
           .drop("_violations")
           .withColumn("_quarantine_timestamp", ts))
    return valid, bad


# --- pipeline rules (first match) -------------------------------------------

def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Code of the first failing check, null when all pass."""
    e = None
    for code, bad in checks:
        b = F.coalesce(bad, F.lit(False))
        e = F.when(b, F.lit(code)) if e is None else e.when(b, F.lit(code))
    return e


def trim_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trim and turn whitespace-only values into null, before null tests."""
    return df.withColumns({c: F.when(F.trim(c) != "", F.trim(c)) for c in columns})


def sales_checks(declared: bool = True, channels: DataFrame | None = None,
                 years: tuple[int, int] = SALES_DECLARED_YEARS) -> list[tuple[str, Column]]:
    checks = [(code, F.col(col).isNull()) for code, col, _, _ in SALES_RULES]
    if declared:
        lo, hi = years
        y = F.col("year").try_cast("int")
        m = F.col("month").try_cast("int")
        checks += [
            ("DQ_SALES_003", F.col("dollar_volume").try_cast("decimal(18,2)").isNull()),
            ("DQ_SALES_004", F.try_to_date(F.col("date"), "M/d/yyyy").isNull()),
            ("DQ_SALES_006", y.isNull() | ~y.between(lo, hi)),
            ("DQ_SALES_007", m.isNull() | ~m.between(1, 12)),
        ]
        if channels is not None:
            checks.append(("DQ_SALES_008", F.col("_channel_missing")))
    return checks


def apply_dq_sales(df: DataFrame, declared: bool = True, channels: DataFrame | None = None,
                   years: tuple[int, int] = SALES_DECLARED_YEARS) -> DataFrame:
    """Bronze sales -> rows with ``_dq_code`` (null = valid).

    Trims brand, channel and region first and treats blanks as null, so
    whitespace-only values cannot pass the not-null rules. ``declared`` adds the
    value rules (003, 004, 006, 007). The referential rule (008) runs when the
    channel master is given: a left join on the channel key.
    """
    df = trim_blank(df, ["brand_nm", "trade_chnl_desc", "region"])
    if declared and channels is not None:
        keys = bounded_broadcast(channels.select(F.trim("trade_chnl_desc").alias("_ck")).distinct())
        df = (df.join(keys, F.col("trade_chnl_desc") == F.col("_ck"), "left")
              .withColumn("_channel_missing", F.col("_ck").isNull()).drop("_ck"))
    out = df.withColumn("_dq_code", first_failure(sales_checks(declared, channels, years)))
    return out.drop("_channel_missing") if "_channel_missing" in out.columns else out


def channel_checks(df: DataFrame) -> DataFrame:
    """Channel master rules 001-004 with ``_dq_code``; uniqueness by an
    aggregate joined back (skew-safe: one row per key on the small side)."""
    dup = (df.groupBy("trade_chnl_desc").agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > 1).select("trade_chnl_desc", F.lit(True).alias("_dup")))
    j = df.join(dup, "trade_chnl_desc", "left")
    checks = [
        ("DQ_CHANNEL_001", F.col("trade_chnl_desc").isNull()),
        ("DQ_CHANNEL_002", F.col("trade_group_desc").isNull()),
        ("DQ_CHANNEL_003", F.col("_dup")),
        ("DQ_CHANNEL_004", ~F.col("trade_type_desc").isin(CHANNEL_ALLOWED_TYPES)),
    ]
    return j.withColumn("_dq_code", first_failure(checks)).drop("_dup")


# --- quarantine records -------------------------------------------------------

def quarantine_records(df: DataFrame, source_table: str, target_table: str, batch_id: str,
                       error_code: Column | str, error_description: Column | str,
                       dq_rule_name: Column | str | None = None, is_known_rule: bool = True,
                       batch_ts: str | None = None, place: Column | None = None) -> DataFrame:
    """Rows in the 14-column quarantine layout.

    ``record_data`` is the whole row as JSON with nulls kept, so the row can be
    replayed with ``from_json`` and its stored schema (source path included, as
    it is an audit column). ``quarantine_id`` is a hash of batch, target, code,
    record, input partition and occurrence among equal records there: unique,
    and the same when a task is tried again. The partition also spreads a
    record that a third of the rows repeat. Rows of a stored table need no such
    numbering, for which whole records are shuffled and sorted: ``place`` (see
    ``materialize.stored_place``) then tells equal records apart.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    payload = [c for c in df.columns if c not in ("_dq_code", "_violations", "_place")]
    rec = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    ts = F.to_timestamp(F.lit(batch_ts)) if batch_ts else F.current_timestamp()
    code = lit(error_code)
    equal = Window.partitionBy("_place", "error_code", "record_data").orderBy(F.lit(1))
    nth = F.row_number().over(equal) if place is None else F.lit(1)
    return (df.select(rec.alias("record_data"), code.alias("error_code"),
                      lit(error_description).alias("error_description"),
                      lit(dq_rule_name if dq_rule_name is not None else error_code).alias("dq_rule_name"),
                      (F.spark_partition_id() if place is None else place).alias("_place"))
            .withColumn("_nth", nth)
            .select(
                F.sha2(F.concat_ws("|", F.lit(batch_id), F.lit(target_table), "error_code", "record_data",
                                   F.col("_place").cast("string"), F.col("_nth").cast("string")),
                       256).alias("quarantine_id"),
                F.lit(batch_id).alias("batch_id"), F.lit(source_table).alias("source_table"),
                F.lit(target_table).alias("target_table"), "record_data",
                F.lit(VALIDATION_ERROR if is_known_rule else UNKNOWN_ERROR).alias("error_type"), "error_code", "error_description",
                "dq_rule_name", F.lit(is_known_rule).alias("is_known_rule"),
                F.lit(False).alias("reprocessed"), F.lit(None).cast("string").alias("reprocess_batch_id"),
                ts.alias("created_at"), ts.alias("updated_at")))


def pending_reprocess(quarantine: DataFrame, source_table: str | None = None) -> DataFrame:
    q = quarantine.filter(~F.col("reprocessed"))
    return q.filter(F.col("source_table") == source_table) if source_table else q


def unknown_errors(quarantine: DataFrame) -> DataFrame:
    return quarantine.filter(~F.col("is_known_rule") & ~F.col("reprocessed"))


def mark_as_reprocessed(quarantine: DataFrame, ids: DataFrame, batch_id: str,
                        batch_ts: str | None = None) -> DataFrame:
    """New quarantine table with the given ids marked (write it with a staged
    replace). ``ids`` has a ``quarantine_id`` column; a left join on it
    scales with both sides (no driver-side id list). Ids of 64 hex digits meet
    as their 32 bytes, others as they are; the ids' partitions, and with them
    the join's, are as many as their input asks for. A null id marks nothing:
    it becomes a key that no record has, as a test for null would compute every
    id once more."""
    name = F.col("quarantine_id")
    digest = name.rlike("^[0-9a-f]{64}$")
    keys = {"_packed": F.when(digest, F.unhex(name)).otherwise(F.lit(b"")),
            "_other": F.when(digest, "").otherwise(F.concat(F.lit("="), name))}
    hit = ids.select(*(F.coalesce(e, F.lit(b"" if k == "_packed" else "")).alias(f"{k}_hit") for k, e in keys.items()))
    hit = hit.repartition(partitions_for(ids), *hit.columns).distinct().withColumn("_hit", F.lit(True))
    ts = F.to_timestamp(F.lit(batch_ts)) if batch_ts else F.current_timestamp()
    same = [F.col(k) == F.col(f"{k}_hit") for k in keys]
    j = quarantine.withColumns(keys).join(hit, same, "left")
    h = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(
        *[c for c in quarantine.columns if c not in ("reprocessed", "reprocess_batch_id", "updated_at")],
        F.when(h, F.lit(True)).otherwise(F.col("reprocessed")).alias("reprocessed"),
        F.when(h, F.lit(batch_id)).otherwise(F.col("reprocess_batch_id")).alias("reprocess_batch_id"),
        F.when(h, ts).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*quarantine.columns)


def replay(quarantine: DataFrame, schema: StructType | str) -> DataFrame:
    """Pending quarantine rows back as typed rows (plus ``quarantine_id``)."""
    return (pending_reprocess(quarantine)
            .select("quarantine_id", F.from_json("record_data", schema).alias("_r"))
            .select("quarantine_id", "_r.*"))


# --- metrics --------------------------------------------------------------------

# Quality thresholds.
THRESHOLDS = {"completeness": 0.95, "uniqueness": 1.0, "validity": 0.98, "freshness_hours": 24.0}


def dq_metrics(df: DataFrame, table_name: str, critical_columns: list[str], key: str,
               valid_flag: Column | None = None, ts_col: str | None = None,
               now: str | None = None) -> DataFrame:
    """Completeness per critical column, key uniqueness, validity and
    freshness in ONE aggregation, returned as a long table with pass/fail."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count(F.col(c)).alias(f"_c_{i}") for i, c in enumerate(critical_columns)]
    aggs.append(F.count_distinct(F.col(key)).alias("_k"))
    aggs.append(F.count_if(valid_flag if valid_flag is not None else F.lit(True)).alias("_v"))
    if ts_col:
        aggs.append(F.max(ts_col).alias("_ts"))
    a = df.agg(*aggs)
    n = F.col("_n").cast("double")
    ratio = lambda c: F.when(n > 0, F.round(F.col(c) / n, 6))
    rows = [F.struct(F.lit("completeness").alias("metric"), F.lit(c).alias("column_name"),
                     ratio(f"_c_{i}").alias("value"), F.lit(THRESHOLDS["completeness"]).alias("threshold"))
            for i, c in enumerate(critical_columns)]
    rows.append(F.struct(F.lit("uniqueness").alias("metric"), F.lit(key).alias("column_name"),
                         ratio("_k").alias("value"), F.lit(THRESHOLDS["uniqueness"]).alias("threshold")))
    rows.append(F.struct(F.lit("validity").alias("metric"), F.lit(None).cast("string").alias("column_name"),
                         ratio("_v").alias("value"), F.lit(THRESHOLDS["validity"]).alias("threshold")))
    if ts_col:
        ref = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        hours = F.round((F.unix_timestamp(ref) - F.unix_timestamp(F.col("_ts"))) / 3600.0, 6)
        rows.append(F.struct(F.lit("freshness_hours").alias("metric"),
                             F.lit(ts_col).alias("column_name"), hours.alias("value"),
                             F.lit(THRESHOLDS["freshness_hours"]).alias("threshold")))
    out = a.select(F.explode(F.array(*rows)).alias("m")).select("m.*")
    passed = (F.when(F.col("metric") == "freshness_hours", F.col("value") <= F.col("threshold"))
              .otherwise(F.col("value") >= F.col("threshold")))
    return out.select(F.lit(table_name).alias("table_name"), "*", F.coalesce(passed, F.lit(False)).alias("passed"))
