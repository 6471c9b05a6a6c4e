"""Driver-facing queries (Spark) and their oracle SQL (DuckDB), side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as RU
from ..functions.clean import cast_columns, clean_string_columns
from ..functions.hashing import add_primary_key, add_row_hash
from ..functions.names import standardize_column_names
from ..operators import catalog as CAT
from ..operators import cdc
from ..operators import metrics as MT
from ..operators import quality as Q
from ..operators import star as ST
from ..operators.control import latest_batch_counts
from ..operators.joins import bounded_broadcast
from ..operators.materialize import materialize, stored_place
from ..sources import driver as D
from ..sources.driver import REFERENCE_KEY
from . import marts
from . import oracle as O
from .domain import BATCH_ID, BATCH_TS, SECOND_BATCH_ID, SECOND_BATCH_TS, DriverDomain, Extracts
from .layers import bronze_sales, silver_sales

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- Q41
@register("q41_top_trade_groups", O.with_gold("""
SELECT * FROM (
  SELECT region_name, trade_group_desc, total_dollar_volume, transaction_count,
         CAST(row_number() OVER (PARTITION BY region_name
              ORDER BY total_dollar_volume DESC, trade_group_desc ASC NULLS FIRST) AS INTEGER) AS rank
  FROM (SELECT region AS region_name, trade_group_desc,
               CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume,
               COUNT(*) AS transaction_count
        FROM gold GROUP BY 1, 2) a) r
WHERE rank <= 3"""))
def q41_top_trade_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.top_trade_groups_of(DriverDomain(spark, sf_dir).gold, 3)


def _dom(spark: SparkSession, sf_dir: str) -> DriverDomain:
    return DriverDomain(spark, sf_dir)


MONEY = marts.MONEY


# ---------------------------------------------------------------- Q42
@register("q42_brand_month", O.with_gold("""
SELECT brand_nm, year, month, strftime(transaction_date, '%Y-%m') AS year_month,
       CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume,
       COUNT(*) AS transaction_count
FROM gold GROUP BY brand_nm, year, month, strftime(transaction_date, '%Y-%m')"""))
def q42_brand_month(spark, sf_dir):
    return marts.brand_month_of(_dom(spark, sf_dir).gold)


# ---------------------------------------------------------------- Q43
_BRAND_REGION = """
SELECT region_name, brand_nm, total_dollar_volume, transaction_count,
       CAST(row_number() OVER (PARTITION BY region_name
            ORDER BY total_dollar_volume ASC, brand_nm ASC NULLS FIRST) AS INTEGER) AS rank_asc,
       CAST(row_number() OVER (PARTITION BY region_name
            ORDER BY total_dollar_volume DESC, brand_nm ASC NULLS FIRST) AS INTEGER) AS rank_desc
FROM (SELECT region AS region_name, brand_nm,
             CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume,
             COUNT(*) AS transaction_count
      FROM gold GROUP BY 1, 2) a"""


@register("q43_brand_region_ranks", O.with_gold(_BRAND_REGION))
def q43_brand_region_ranks(spark, sf_dir):
    return marts.brand_region_of(_dom(spark, sf_dir).gold)


@register("q43_lowest_brand_per_region",
          O.with_gold(f"SELECT * FROM ({_BRAND_REGION}) x WHERE rank_asc = 1"))
def q43_lowest_brand_per_region(spark, sf_dir):
    return marts.lowest_brand_of(_dom(spark, sf_dir).gold)


# ---------------------------------------------------------------- Q44 (SQL over views)
@register("q44_sql_region_trade_group", O.with_gold("""
SELECT region AS region_name, trade_group_desc,
       CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume,
       COUNT(*) AS transaction_count
FROM gold GROUP BY 1, 2"""))
def q44_sql_region_trade_group(spark, sf_dir):
    """SQL over a view of gold: aggregate by the lookup attributes first (rows
    without one drop out, as in the star), then by the names."""
    _dom(spark, sf_dir).gold.createOrReplaceTempView("gold_sales")
    return spark.sql("""
        WITH by_channel AS (
          SELECT region, chnl_group, trade_chnl_desc, trade_group_desc, COUNT(*) AS n, SUM(dollar_volume) AS v
          FROM gold_sales
          WHERE region IS NOT NULL AND chnl_group IS NOT NULL AND trade_chnl_desc IS NOT NULL
          GROUP BY ALL)
        SELECT region AS region_name, trade_group_desc, CAST(SUM(v) AS DECIMAL(38,2)) AS total_dollar_volume,
               SUM(n) AS transaction_count
        FROM by_channel GROUP BY region, trade_group_desc""")


@register("q44_sql_brand_month", O.with_gold("""
SELECT brand_nm, year_month, CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume
FROM (SELECT brand_nm, strftime(transaction_date, '%Y-%m') AS year_month, dollar_volume FROM gold) g
GROUP BY 1, 2"""))
def q44_sql_brand_month(spark, sf_dir):
    """SQL over a view of gold, which is read once: first by the attributes that
    the star joins on (rows without one drop out, as there), then by name."""
    _dom(spark, sf_dir).gold.createOrReplaceTempView("gold_sales")
    return spark.sql("""
        WITH sold AS (
          SELECT brand_nm, transaction_date, SUM(dollar_volume) AS v FROM gold_sales
          WHERE transaction_date IS NOT NULL AND ce_brand_flvr IS NOT NULL AND brand_nm IS NOT NULL AND pkg_cat IS NOT NULL
            AND pkg_cat_desc IS NOT NULL AND tsr_pckg_nm IS NOT NULL
          GROUP BY ALL)
        SELECT brand_nm, date_format(transaction_date, 'yyyy-MM') AS year_month,
               CAST(SUM(v) AS DECIMAL(38,2)) AS total_dollar_volume
        FROM sold GROUP BY ALL""")


# ---------------------------------------------------------------- Q45 presentation
@register("q45_region_totals", O.with_gold("""
SELECT region, CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume,
       CAST(SUM(abs(dollar_volume)) AS DECIMAL(38,2)) AS gross_dollar_volume,
       COUNT(*) AS transaction_count
FROM gold GROUP BY region"""))
def q45_region_totals(spark, sf_dir):
    return marts.region_totals(_dom(spark, sf_dir).layers.gold_sales)


@register("q45_top_brands", O.with_gold("""
SELECT brand_nm, CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume
FROM gold GROUP BY brand_nm ORDER BY total_dollar_volume DESC, brand_nm ASC LIMIT 10"""))
def q45_top_brands(spark, sf_dir):
    return marts.top_brands(_dom(spark, sf_dir).layers.gold_sales, 10)


@register("q45_seasonality", O.with_gold("""
SELECT month, CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume,
       CAST(SUM(dollar_volume) / COUNT(*) AS DECIMAL(38,2)) AS avg_dollar_volume,
       COUNT(*) AS transaction_count
FROM gold GROUP BY month"""))
def q45_seasonality(spark, sf_dir):
    return marts.seasonality(_dom(spark, sf_dir).layers.gold_sales)


_GROUPS = ["ENTERTAINMENT", "GROCERY", "SERVICES", "NO_GROUP"]


@register("q45_region_group_matrix", O.with_gold("SELECT region, " + ", ".join(
    f"CAST(SUM(CASE WHEN coalesce(trade_group_desc, 'NO_GROUP') = '{g}' THEN dollar_volume END) "
    f"AS DECIMAL(38,2)) AS {g}" for g in _GROUPS) + """,
    CAST(SUM(CASE WHEN coalesce(trade_group_desc, 'NO_GROUP') NOT IN ('ENTERTAINMENT', 'GROCERY', 'SERVICES', 'NO_GROUP')
             THEN dollar_volume END) AS DECIMAL(38,2)) AS OTHER FROM gold GROUP BY region"""))
def q45_region_group_matrix(spark, sf_dir):
    return marts.region_group_matrix(_dom(spark, sf_dir).layers.gold_sales, _GROUPS)


@register("q45_executive_summary", O.with_gold("""
SELECT COUNT(*) AS transaction_count,
       CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume,
       CAST(MIN(dollar_volume) AS DECIMAL(38,2)) AS min_dollar_volume,
       CAST(MAX(dollar_volume) AS DECIMAL(38,2)) AS max_dollar_volume,
       CAST(SUM(dollar_volume) / COUNT(*) AS DECIMAL(38,2)) AS avg_dollar_volume,
       COUNT(DISTINCT brand_nm) AS brands, COUNT(DISTINCT region) AS regions
FROM gold"""))
def q45_executive_summary(spark, sf_dir):
    return marts.executive_summary(_dom(spark, sf_dir).layers.gold_sales)


# ================================================================ change capture


_KEYCOLS = ["order_id", "line_no", "ce_brand_flvr", "supplier_id"]


@register("c1_c2_keys_and_hashes", f"""
WITH b AS ({O.bronze()})
SELECT order_id, line_no, ce_brand_flvr, supplier_id, _pk, _row_hash FROM b""")
def c1_c2_keys_and_hashes(spark, sf_dir):
    """Primary key (md5) and row hash (sha256) of every bronze sales line."""
    return _dom(spark, sf_dir).layers.bronze_sales.select(*_KEYCOLS, "_pk", "_row_hash")


@register("c3_latest_per_key", f"""
WITH {O.extracts()},
h AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
SELECT _pk, _row_hash, _batch_id, dollar_volume FROM (
  SELECT *, row_number() OVER (PARTITION BY _pk
            ORDER BY _ingestion_timestamp DESC, _row_hash DESC) AS rn FROM h) x
WHERE rn = 1""")
def c3_latest_per_key(spark, sf_dir):
    """Newest version of every key in the bronze history of two loads."""
    h = Extracts(_dom(spark, sf_dir)).history
    return cdc.latest_per_key(h, "_pk").select("_pk", "_row_hash", "_batch_id", "dollar_volume")


_MERGE_SQL = f"""
WITH {O.extracts()},
j AS (
  SELECT CASE WHEN t._pk IS NULL THEN 'insert' WHEN s._pk IS NULL THEN 'keep'
              WHEN s._row_hash = t._row_hash THEN 'unchanged'
              WHEN s._ingestion_timestamp >= t._ingestion_timestamp THEN 'update'
              ELSE 'stale' END AS _action,
         coalesce(s._pk, t._pk) AS _pk, s._row_hash AS s_h, t._row_hash AS t_h,
         s._batch_id AS s_b, t._batch_id AS t_b,
         s.dollar_volume AS s_v, t.dollar_volume AS t_v
  FROM b2 s FULL OUTER JOIN b1 t ON s._pk = t._pk)"""


@register("c5_merge_stats", _MERGE_SQL + """
SELECT _action, COUNT(*) AS records FROM j GROUP BY _action""")
def c5_merge_stats(spark, sf_dir):
    """Insert / update / unchanged / keep counts of merging load 2 into the
    current table built from load 1 (one full outer join)."""
    e = Extracts(_dom(spark, sf_dir))
    slim = ["_pk", "_row_hash", "_ingestion_timestamp"]
    return cdc.merge_stats(cdc.merge(e.silver(e.bronze2, SECOND_BATCH_TS).select(*slim),
                                     e.silver(e.bronze1, BATCH_TS).select(*slim)))


@register("c5_merged_table", _MERGE_SQL + """
SELECT _pk, _action,
       CASE WHEN _action IN ('insert', 'update') THEN s_h ELSE t_h END AS _row_hash,
       CASE WHEN _action IN ('insert', 'update') THEN s_b ELSE t_b END AS _batch_id,
       CAST(CASE WHEN _action IN ('insert', 'update') THEN s_v ELSE t_v END AS DECIMAL(18,2)) AS dollar_volume
FROM j""")
def c5_merged_table(spark, sf_dir):
    e = Extracts(_dom(spark, sf_dir))
    slim = ["_pk", "_row_hash", "_ingestion_timestamp", "_batch_id", "dollar_volume"]
    m = cdc.merge(e.silver(e.bronze2, SECOND_BATCH_TS).select(*slim), e.silver(e.bronze1, BATCH_TS).select(*slim))
    return m.select("_pk", "_action", "_row_hash", "_batch_id", "dollar_volume")


@register("c4_merge_union_form", f"""
WITH {O.extracts()}
SELECT _pk, _row_hash, _batch_id FROM b2 WHERE _pk NOT IN (SELECT _pk FROM b1)
UNION ALL
SELECT s._pk, s._row_hash, s._batch_id FROM b2 s JOIN b1 t ON s._pk = t._pk WHERE s._row_hash <> t._row_hash
UNION ALL
SELECT t._pk, t._row_hash, t._batch_id FROM b1 t JOIN b2 s ON s._pk = t._pk WHERE s._row_hash = t._row_hash
UNION ALL
SELECT _pk, _row_hash, _batch_id FROM b1 WHERE _pk NOT IN (SELECT _pk FROM b2)""")
def c4_merge_union_form(spark, sf_dir):
    """Library merge form (anti joins + inner joins + union by name)."""
    e = Extracts(_dom(spark, sf_dir))
    return cdc.merge_union_form(e.bronze2, e.bronze1).select("_pk", "_row_hash", "_batch_id")


@register("a9_key_uniqueness", f"""
WITH b AS ({O.bronze()})
SELECT 'sales_key' AS key_name, COUNT(*) AS total_rows, COUNT(DISTINCT _pk) AS distinct_keys,
       COUNT(*) - COUNT(DISTINCT _pk) AS duplicate_rows FROM b
UNION ALL
SELECT 'reference_key', COUNT(*), COUNT(DISTINCT (ce_brand_flvr, region, trade_chnl_desc, year, month)),
       COUNT(*) - COUNT(DISTINCT (ce_brand_flvr, region, trade_chnl_desc, year, month)) FROM b""")
def a9_key_uniqueness(spark, sf_dir):
    """Totals, distinct keys and duplicates for the line key and for the
    original (brand, region, channel, year, month) key."""
    b = _dom(spark, sf_dir).layers.bronze_sales
    return cdc.key_reports(b, {"sales_key": "_pk", "reference_key": REFERENCE_KEY})



# ================================================================ data quality

_D1_RULES = [
    {"column": "trade_group_desc", "rule": "not_null"},
    {"column": "dollar_volume", "rule": "positive"},
    {"column": "chnl_group", "rule": "in_list", "values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]},
    {"column": "tsr_pckg_nm", "rule": "regex", "pattern": "^[0-9]$"},
]


@register("d1_quality_split", O.with_gold("""
SELECT nullif(concat_ws('; ',
         CASE WHEN trade_group_desc IS NULL THEN 'trade_group_desc:null' END,
         CASE WHEN dollar_volume <= 0 THEN 'dollar_volume:not_positive' END,
         CASE WHEN NOT chnl_group IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'chnl_group:not_in_list' END,
         CASE WHEN NOT regexp_matches(tsr_pckg_nm, '^[0-9]$') THEN 'tsr_pckg_nm:regex_mismatch' END), '')
         AS validation_errors,
       COUNT(*) AS rows
FROM gold GROUP BY 1"""))
def d1_quality_split(spark, sf_dir):
    """Rule list -> valid / quarantine split; rows per error combination."""
    valid, bad = Q.apply_data_quality_rules(_dom(spark, sf_dir).layers.silver_sales, _D1_RULES)
    both = (valid.select(F.lit(None).cast("string").alias("validation_errors"))
            .unionByName(bad.select(F.col("_validation_errors").alias("validation_errors"))))
    return both.groupBy("validation_errors").agg(F.count(F.lit(1)).alias("rows"))


def _dq_sql(rows: str, low: int = 2000) -> str:
    return f"""
WITH b AS ({rows}),
ch AS ({O.CHANNELS}),
t AS (SELECT b.*, CASE WHEN trim(b.brand_nm) <> '' THEN trim(b.brand_nm) END AS brand_t,
             CASE WHEN trim(b.trade_chnl_desc) <> '' THEN trim(b.trade_chnl_desc) END AS chnl_t,
             ch.trade_chnl_desc IS NULL AS ch_missing
      FROM b LEFT JOIN ch ON trim(b.trade_chnl_desc) = ch.trade_chnl_desc),
c AS (SELECT t.*, CASE
        WHEN brand_t IS NULL THEN 'DQ_SALES_001'
        WHEN chnl_t IS NULL THEN 'DQ_SALES_002'
        WHEN TRY_CAST(dollar_volume AS DECIMAL(18,2)) IS NULL THEN 'DQ_SALES_003'
        WHEN try_strptime(date, '%m/%d/%Y') IS NULL THEN 'DQ_SALES_004'
        WHEN TRY_CAST(year AS INTEGER) IS NULL OR NOT TRY_CAST(year AS INTEGER) BETWEEN {low} AND 2030 THEN 'DQ_SALES_006'
        WHEN TRY_CAST(month AS INTEGER) IS NULL OR NOT TRY_CAST(month AS INTEGER) BETWEEN 1 AND 12 THEN 'DQ_SALES_007'
        WHEN ch_missing THEN 'DQ_SALES_008' END AS dq_code FROM t)"""


_DQ_SQL = _dq_sql(O.bronze())
_BAD_SQL = _dq_sql(O.defective(), 1990)
_BAD_YEARS = (1990, 2030)


def _defective(spark, sf_dir, channels: bool = True):
    """(domain, bronze rows with injected defects and their rule code)."""
    d = _dom(spark, sf_dir)
    bronze = bronze_sales(D.defective_landing(spark, sf_dir), d.profile, BATCH_ID, BATCH_TS)
    return d, Q.apply_dq_sales(bronze, channels=d.layers.silver_channels if channels else None, years=_BAD_YEARS)


def _quarantined(bad, place=None):
    return Q.quarantine_records(bad, "bronze_beverage_sales", "silver_beverage_sales", BATCH_ID,
                                F.col("_dq_code"), Q.rule_description(F.col("_dq_code")), batch_ts=BATCH_TS, place=place)


@register("d3_d4_sales_rules", _BAD_SQL + "\nSELECT dq_code, COUNT(*) AS rows FROM c GROUP BY dq_code")
def d3_d4_sales_rules(spark, sf_dir):
    """Coded (001, 002) and declared (003, 004, 006, 007, 008) sales rules over
    rows in which every rule is broken, first failure wins; rows per rule code
    (null = valid)."""
    return _defective(spark, sf_dir)[1].groupBy(F.col("_dq_code").alias("dq_code")).agg(F.count(F.lit(1)).alias("rows"))


@register("d4_year_rule", _DQ_SQL + "\nSELECT dq_code, COUNT(*) AS rows FROM c GROUP BY dq_code")
def d4_year_rule(spark, sf_dir):
    """The same rules with the declared years over the rows as they are."""
    d = _dom(spark, sf_dir)
    dq = Q.apply_dq_sales(d.layers.bronze_sales, channels=d.layers.silver_channels)
    return dq.groupBy(F.col("_dq_code").alias("dq_code")).agg(F.count(F.lit(1)).alias("rows"))


_RULE_TEXTS = "CASE dq_code " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in [
    *((c, t) for c, _, _, t in Q.SALES_RULES), *Q.SALES_DECLARED_RULES]) + " END"
_RECORD = ["date", "ce_brand_flvr", "region", "order_id", "line_no", "supplier_id", "dollar_volume", "year", "month"]


@register("d6_quarantine_records", _BAD_SQL + f"""
SELECT '20240101000000' AS batch_id, 'bronze_beverage_sales' AS source_table,
       'silver_beverage_sales' AS target_table, 'VALIDATION_ERROR' AS error_type, dq_code AS error_code,
       {_RULE_TEXTS} AS error_description, dq_code AS dq_rule_name, true AS is_known_rule, false AS reprocessed,
       CAST(NULL AS VARCHAR) AS reprocess_batch_id, brand_t AS brand_nm, chnl_t AS trade_chnl_desc,
       {', '.join(_RECORD)}
FROM c WHERE dq_code IS NOT NULL""")
def d6_quarantine_records(spark, sf_dir):
    """Quarantine records of the failing sales in full: the fixed layout
    (without ids and times) and the row read back from ``record_data``."""
    _, dq = _defective(spark, sf_dir)
    bad = dq.filter(F.col("_dq_code").isNotNull())
    q = _quarantined(bad).withColumn("r", F.from_json("record_data", bad.drop("_dq_code").schema))
    return q.select("batch_id", "source_table", "target_table", "error_type", "error_code", "error_description",
                    "dq_rule_name", "is_known_rule", "reprocessed", "reprocess_batch_id", "r.brand_nm",
                    "r.trade_chnl_desc", *[f"r.{c}" for c in _RECORD])


@register("d6_quarantine_ids", _BAD_SQL + """
SELECT COUNT(*) AS records, COUNT(*) AS ids FROM (
  SELECT 1 FROM c WHERE dq_code IS NOT NULL UNION ALL SELECT 1 FROM c WHERE dq_code IS NOT NULL) x""")
def d6_quarantine_ids(spark, sf_dir):
    """Every bad row twice: the records are as many as their ids."""
    bad = _defective(spark, sf_dir)[1].filter(F.col("_dq_code").isNotNull())
    q = _quarantined(bad.unionByName(bad))
    return q.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("quarantine_id").alias("ids"))


@register("d12_pipeline_reconciles", _dq_sql(O.defective(), 1990) + """
SELECT COUNT(*) AS bronze_rows,
       COUNT(*) FILTER (WHERE dq_code IS NULL OR dq_code = 'DQ_SALES_008') AS silver_rows,
       COUNT(*) FILTER (WHERE dq_code <> 'DQ_SALES_008') AS quarantined_rows,
       COUNT(*) FILTER (WHERE (dq_code IS NULL OR dq_code = 'DQ_SALES_008') AND (month IS NULL OR date IS NULL)) AS untyped_rows
FROM c""")
def d12_pipeline_reconciles(spark, sf_dir):
    """The pipeline's own rules (without the referential one) over rows with
    defects: silver + quarantine = bronze, and no untyped value in silver."""
    _, dq = _defective(spark, sf_dir, channels=False)
    ok = F.col("_dq_code").isNull()
    typed = silver_sales(dq.withColumn("_ok", ok), BATCH_TS)
    untyped = F.greatest(*[F.col(c).isNull() for c in ("transaction_date", "year", "month", "dollar_volume")])
    return typed.agg(F.count(F.lit(1)).alias("bronze_rows"), F.count_if("_ok").alias("silver_rows"),
                     F.count_if(~F.col("_ok")).alias("quarantined_rows"),
                     F.count_if(F.col("_ok") & untyped).alias("untyped_rows"))


@register("d9_unknown_errors", _BAD_SQL + """
SELECT 'UNKNOWN_ERROR' AS error_type, dq_code AS error_code, COUNT(*) AS rows
FROM c WHERE dq_code IN ('DQ_SALES_003', 'DQ_SALES_004') GROUP BY dq_code""")
def d9_unknown_errors(spark, sf_dir):
    """Failures that no known rule explains, among known ones, still pending."""
    _, dq = _defective(spark, sf_dir)
    strange = F.col("_dq_code").isin("DQ_SALES_003", "DQ_SALES_004")
    known = _quarantined(dq.filter(F.col("_dq_code").isNotNull() & ~strange))
    unknown = Q.quarantine_records(dq.filter(strange), "bronze_beverage_sales", "silver_beverage_sales", BATCH_ID,
                                   F.col("_dq_code"), "unexplained", is_known_rule=False, batch_ts=BATCH_TS)
    return Q.unknown_errors(known.unionByName(unknown)).groupBy("error_type", "error_code") \
        .agg(F.count(F.lit(1)).alias("rows"))


@register("d10_replay_after_rule_fix", _DQ_SQL + """
SELECT CASE WHEN TRY_CAST(year AS INTEGER) BETWEEN 1990 AND 2030 THEN 'released' ELSE 'held' END AS outcome,
       COUNT(*) AS rows
FROM c WHERE dq_code = 'DQ_SALES_006' GROUP BY 1""")
def d10_replay_after_rule_fix(spark, sf_dir):
    """Replay: quarantined year-rule rows are read back from their JSON with
    the stored schema and re-checked under a corrected year range."""
    d = _dom(spark, sf_dir)
    bronze = d.layers.bronze_sales
    dq = Q.apply_dq_sales(bronze, channels=d.layers.silver_channels)
    bad = dq.filter(F.col("_dq_code") == "DQ_SALES_006").drop("_dq_code")
    q = Q.quarantine_records(bad, "bronze_beverage_sales", "silver_beverage_sales", "20240101000000",
                             "DQ_SALES_006", "year out of range", batch_ts="2024-01-01 00:00:00")
    rows = Q.replay(q, bad.schema)
    y = F.col("year").try_cast("int")
    return (rows.select(F.when(y.between(1990, 2030), "released").otherwise("held").alias("outcome"))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("rows")))


_CHANNEL_ROWS = f"""SELECT * FROM ({O.CHANNELS}) UNION ALL SELECT * FROM (VALUES {", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in D.CHANNEL_DEFECTS)}) v"""


@register("d5_channel_rules", f"""
WITH ch AS ({_CHANNEL_ROWS})
SELECT trade_chnl_desc, trade_group_desc, trade_type_desc,
       CASE WHEN trade_chnl_desc IS NULL THEN 'DQ_CHANNEL_001'
            WHEN trade_group_desc IS NULL THEN 'DQ_CHANNEL_002'
            WHEN COUNT(*) OVER (PARTITION BY trade_chnl_desc) > 1 THEN 'DQ_CHANNEL_003'
            WHEN NOT trade_type_desc IN ('ALCOHOLIC', 'NON ALCOHOLIC', 'MIX') THEN 'DQ_CHANNEL_004'
       END AS dq_code
FROM ch""")
def d5_channel_rules(spark, sf_dir):
    """Channel rules over the master and rows that break each of them."""
    ch = D.defective_channels(spark, sf_dir).toDF("trade_chnl_desc", "trade_group_desc", "trade_type_desc")
    return Q.channel_checks(ch).withColumnRenamed("_dq_code", "dq_code")


_D11_SQL = """
SELECT 'silver_sales' AS table_name, metric, column_name, value, CAST(threshold AS DOUBLE) AS threshold,
       coalesce(CASE WHEN metric = 'freshness_hours' THEN value <= threshold ELSE value >= threshold END, false) AS passed FROM (
  SELECT 'completeness' AS metric, 'brand_nm' AS column_name, round(COUNT(brand_nm) / COUNT(*), 6) AS value, 0.95 AS threshold FROM gold
  UNION ALL SELECT 'completeness', 'trade_group_desc', round(COUNT(trade_group_desc) / COUNT(*), 6), 0.95 FROM gold
  UNION ALL SELECT 'completeness', 'transaction_date', round(COUNT(transaction_date) / COUNT(*), 6), 0.95 FROM gold
  UNION ALL SELECT 'uniqueness', '_pk', round(COUNT(DISTINCT (order_id, line_no, ce_brand_flvr, supplier_id)) / COUNT(*), 6), 1.0 FROM gold
  UNION ALL SELECT 'validity', NULL, round(COUNT(*) FILTER (WHERE dollar_volume > 0) / COUNT(*), 6), 0.98 FROM gold
  UNION ALL SELECT 'freshness_hours', '_ingestion_timestamp', 30.5, 24.0) m"""


@register("d11_dq_metrics", O.with_gold(_D11_SQL))
def d11_dq_metrics(spark, sf_dir):
    """Completeness, uniqueness, validity and freshness (30.5 hours at the
    pinned time) against thresholds in one pass."""
    s = _dom(spark, sf_dir).layers.silver_sales
    return Q.dq_metrics(s, "silver_sales", ["brand_nm", "trade_group_desc", "transaction_date"], "_pk",
                        valid_flag=F.col("dollar_volume") > 0, ts_col="_ingestion_timestamp", now="2024-01-02 06:30:00")


@register("g4_dq_summary", O.with_gold(f"SELECT passed, COUNT(*) AS tests FROM ({_D11_SQL}) r GROUP BY passed"))
def g4_dq_summary(spark, sf_dir):
    """Pass / fail totals of the DQ result rows."""
    return CAT.dq_summary(d11_dq_metrics(spark, sf_dir))


# Attributes of the fact's lookups that are null in some orders, by order number modulo D.DEFECT_EVERY.
_NULLED = {8: "region", 9: "chnl_group", 10: "pkg_cat", 11: "transaction_date"}


@register("d12_fact_null_keys", O.with_gold(f"""
, holed AS (SELECT * REPLACE ({", ".join(
    f"CASE WHEN CAST(order_id AS BIGINT) % {D.DEFECT_EVERY} <> {k} THEN {c} END AS {c}" for k, c in _NULLED.items())}) FROM gold)
SELECT COUNT(*) AS fact_rows,
       COUNT(*) FILTER (WHERE transaction_date IS NULL OR region IS NULL OR ce_brand_flvr IS NULL
          OR brand_nm IS NULL OR pkg_cat IS NULL OR pkg_cat_desc IS NULL OR tsr_pckg_nm IS NULL
          OR chnl_group IS NULL OR trade_chnl_desc IS NULL) AS null_key_rows FROM holed"""))
def d12_fact_null_keys(spark, sf_dir):
    """Fact rows with a null key, over sales of which some lack an attribute."""
    rest = F.col("order_id").cast("bigint") % D.DEFECT_EVERY
    holed = _dom(spark, sf_dir).layers.gold_sales.withColumns(
        {c: F.when(rest != k, F.col(c)) for k, c in _NULLED.items()})
    return ST.fact_null_keys(ST.fact_sales(holed))


@register("j4_channel_orphans", O.with_gold("""
SELECT trade_chnl_desc, COUNT(*) AS orphan_rows FROM gold WHERE trade_group_desc IS NULL
GROUP BY trade_chnl_desc"""))
def j4_channel_orphans(spark, sf_dir):
    """Sales lines whose trade channel is missing from the channel master."""
    s = _dom(spark, sf_dir).layers.silver_sales
    return (s.filter(F.col("trade_group_desc").isNull()).groupBy("trade_chnl_desc")
            .agg(F.count(F.lit(1)).alias("orphan_rows")))


# ================================================================ business rules
@register("b14_gold_sales_rules", O.with_gold("""
SELECT order_id, line_no, ce_brand_flvr, supplier_id, volume_category, is_negative_sale,
       region_group, sales_quarter, is_weekend_sale, country FROM gold"""))
def b14_gold_sales_rules(spark, sf_dir):
    """Volume category, negative flag, region group, quarter, weekend, country."""
    return _dom(spark, sf_dir).layers.gold_sales.select(
        *_KEYCOLS, "volume_category", "is_negative_sale", "region_group", "sales_quarter",
        "is_weekend_sale", "country")


@register("b11_gold_channel_rules", f"""
WITH ch AS ({O.CHANNELS})
SELECT trade_chnl_desc, trade_group_desc, trade_type_desc,
       coalesce(trade_type_desc IN ('ALCOHOLIC', 'MIX'), false) AS is_alcoholic_channel,
       CASE trade_group_desc WHEN 'GROCERY' THEN 'RETAIL' WHEN 'ENTERTAINMENT' THEN 'ON_PREMISE'
            WHEN 'SERVICES' THEN 'CONVENIENCE' ELSE 'OTHER' END AS channel_category
FROM ch""")
def b11_gold_channel_rules(spark, sf_dir):
    return _dom(spark, sf_dir).layers.gold_channels.select(
        "trade_chnl_desc", "trade_group_desc", "trade_type_desc", "is_alcoholic_channel", "channel_category")


_B1_RULES = {
    "price_band": {"type": "category", "source_column": "dollar_volume",
                   "conditions": [{"range": [None, 0], "value": "Return"},
                                  {"range": [0, 10000], "value": "Small"},
                                  {"range": [10000, 50000], "value": "Medium"},
                                  {"range": [50000, None], "value": "Large"}]},
    "volume_per_period": {"type": "calculation", "calc_type": "divide",
                          "source_columns": ["dollar_volume", "period"]},
    "year_plus_month": {"type": "calculation", "calc_type": "sum", "source_columns": ["year", "month"]},
    "year_times_month": {"type": "calculation", "calc_type": "multiply", "source_columns": ["year", "month"]},
    "year_less_month": {"type": "calculation", "calc_type": "subtract", "source_columns": ["year", "month"]},
    "region_brand": {"type": "derived", "operation": "concat", "source_columns": ["region", "brand_nm"]},
}


@register("b1_b3_rule_engine", O.with_gold("""
SELECT order_id, line_no, ce_brand_flvr, supplier_id,
       CASE WHEN dollar_volume < 0 THEN 'Return'
            WHEN dollar_volume >= 0 AND dollar_volume < 10000 THEN 'Small'
            WHEN dollar_volume >= 10000 AND dollar_volume < 50000 THEN 'Medium'
            WHEN dollar_volume >= 50000 THEN 'Large' ELSE 'Unknown' END AS price_band,
       CAST(round(dollar_volume / period, 6) AS DECIMAL(38,6)) AS volume_per_period,
       year + month AS year_plus_month, year * month AS year_times_month, year - month AS year_less_month,
       concat_ws('_', region, brand_nm) AS region_brand,
       year AS year, CAST(quarter(transaction_date) AS INTEGER) AS quarter
FROM gold"""))
def b1_b3_rule_engine(spark, sf_dir):
    """Parameterised rules: category ranges, calculations, derived concat,
    plus time dimensions from the transaction date."""
    g = RU.apply_business_rules(_dom(spark, sf_dir).layers.silver_sales, _B1_RULES)
    g = RU.add_time_dimensions(g.drop("year", "month"), "transaction_date")
    return g.select(*_KEYCOLS, "price_band",
                    F.round("volume_per_period", 6).cast("decimal(38,6)").alias("volume_per_period"),
                    "year_plus_month", "year_times_month", "year_less_month", "region_brand", "year", "quarter")


# ================================================================ star schema
@register("m2_dim_date", O.with_gold("""
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date,
       CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
       'Q' || CAST(quarter(d) AS VARCHAR) AS quarter_name, CAST(month(d) AS INTEGER) AS month,
       strftime(d, '%B') AS month_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
       CAST(dayofmonth(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week,
       strftime(d, '%A') AS day_name, dayofweek(d) IN (0, 6) AS is_weekend,
       strftime(d, '%Y-%m') AS year_month
FROM (SELECT DISTINCT transaction_date AS d FROM gold WHERE transaction_date IS NOT NULL) x"""))
def m2_dim_date(spark, sf_dir):
    return _dom(spark, sf_dir).star["dim_date"]


@register("m3_dim_region", O.with_gold(f"""
SELECT DISTINCT {O.hkey(['region'])} AS region_key, region AS region_name, region_group, country
FROM gold"""))
def m3_dim_region(spark, sf_dir):
    return _dom(spark, sf_dir).star["dim_region"]


_PRODUCT = ["ce_brand_flvr", "brand_nm", "pkg_cat", "pkg_cat_desc", "tsr_pckg_nm"]


@register("m4_dim_product", O.with_gold(f"""
SELECT DISTINCT {O.hkey(_PRODUCT)} AS product_key, {', '.join(_PRODUCT)} FROM gold"""))
def m4_dim_product(spark, sf_dir):
    return _dom(spark, sf_dir).star["dim_product"]


@register("m5_dim_channel", O.with_gold(f"""
SELECT {O.hkey(['chnl_group', 'trade_chnl_desc'])} AS channel_key, chnl_group, trade_chnl_desc,
       trade_group_desc, trade_type_desc,
       CASE WHEN trade_group_desc IS NULL THEN NULL ELSE coalesce(trade_type_desc IN ('ALCOHOLIC', 'MIX'), false) END AS is_alcoholic_channel,
       CASE WHEN trade_group_desc IS NULL THEN NULL ELSE CASE trade_group_desc WHEN 'GROCERY' THEN 'RETAIL'
            WHEN 'ENTERTAINMENT' THEN 'ON_PREMISE' WHEN 'SERVICES' THEN 'CONVENIENCE' ELSE 'OTHER' END END AS channel_category
FROM (SELECT DISTINCT chnl_group, trade_chnl_desc, trade_group_desc, trade_type_desc FROM gold) x"""))
def m5_dim_channel(spark, sf_dir):
    return _dom(spark, sf_dir).star["dim_channel"]


@register("m6_fact_sales", O.with_gold(f"""
SELECT CAST(strftime(transaction_date, '%Y%m%d') AS INTEGER) AS date_key,
       {O.hkey(['region'])} AS region_key, {O.hkey(_PRODUCT)} AS product_key,
       {O.hkey(['chnl_group', 'trade_chnl_desc'])} AS channel_key,
       dollar_volume, volume_category, is_negative_sale, year, month,
       'driver_sales' AS _source_file, DATE '2024-01-01' AS _ingestion_date
FROM gold"""))
def m6_fact_sales(spark, sf_dir):
    return _dom(spark, sf_dir).star["fact_sales"]


@register("m1_dimension_table", O.with_gold(f"""
SELECT DISTINCT brand_nm, region_group, {O.hkey(['brand_nm', 'region_group'])} AS brand_sk,
       true AS _is_current FROM gold"""))
def m1_dimension_table(spark, sf_dir):
    """Generic dimension builder: distinct natural rows + surrogate + validity."""
    g = _dom(spark, sf_dir).layers.gold_sales
    return ST.create_dimension_table(g, "brand_nm", ["region_group"], "brand_sk").select(
        "brand_nm", "region_group", "brand_sk", "_is_current")


# ================================================================ metrics
@register("a1_business_metrics", O.with_gold("""
SELECT g.order_id, g.line_no, g.ce_brand_flvr, g.supplier_id, g.region, g.trade_group_desc,
       m.dollar_volume_total, m.dollar_volume_avg, m.dollar_volume_max, m.dollar_volume_min, m.record_count
FROM gold g LEFT JOIN (
  SELECT region, trade_group_desc,
         CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS dollar_volume_total,
         CAST(SUM(dollar_volume) / COUNT(*) AS DECIMAL(38,2)) AS dollar_volume_avg,
         MAX(dollar_volume) AS dollar_volume_max, MIN(dollar_volume) AS dollar_volume_min,
         COUNT(*) AS record_count
  FROM gold GROUP BY 1, 2) m
ON g.region = m.region AND g.trade_group_desc = m.trade_group_desc"""))
def a1_business_metrics(spark, sf_dir):
    """Group metrics joined back to every row (null group keys get nulls). The
    columns it needs are handed over, so the source joins run once for both passes."""
    g = materialize(_dom(spark, sf_dir).layers.gold_sales.select(*_KEYCOLS, "region", "trade_group_desc", "dollar_volume"), "sales")
    m = MT.add_business_metrics(g, "dollar_volume", ["region", "trade_group_desc"])
    return m.select(*_KEYCOLS, "region", "trade_group_desc",
                    F.col("dollar_volume_total").cast(MONEY).alias("dollar_volume_total"),
                    F.col("dollar_volume_avg").cast(MONEY).alias("dollar_volume_avg"),
                    "dollar_volume_max", "dollar_volume_min", "record_count")


@register("a2_fact_table", O.with_gold("""
SELECT region, year, CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS dollar_volume_sum,
       COUNT(order_id) AS order_id_count, MAX(month) AS month_max
FROM gold GROUP BY region, year"""))
def a2_fact_table(spark, sf_dir):
    """Configurable aggregation: {column: aggregate} -> <column>_<aggregate>."""
    g = _dom(spark, sf_dir).layers.gold_sales
    f = MT.create_fact_table(g, ["region", "year"], ["dollar_volume"],
                             {"dollar_volume": "sum", "order_id": "count", "month": "max"})
    return f.withColumn("dollar_volume_sum", F.col("dollar_volume_sum").cast(MONEY))


@register("a7_category_frequencies", O.with_gold("""
SELECT 'volume_category' AS attribute, volume_category AS value, COUNT(*) AS rows FROM gold GROUP BY 2
UNION ALL SELECT 'region_group', region_group, COUNT(*) FROM gold GROUP BY 2
UNION ALL SELECT 'sales_quarter', sales_quarter, COUNT(*) FROM gold GROUP BY 2
UNION ALL SELECT 'is_negative_sale', CAST(is_negative_sale AS VARCHAR), COUNT(*) FROM gold GROUP BY 2"""))
def a7_category_frequencies(spark, sf_dir):
    g = _dom(spark, sf_dir).layers.gold_sales
    return MT.category_frequencies(g, ["volume_category", "region_group", "sales_quarter", "is_negative_sale"])


@register("a14_analyze_table", O.with_gold("""
SELECT 'gold_sales' AS table_name, (SELECT COUNT(*) FROM gold) AS row_count, 37 AS column_count,
       column_name, sum_value, avg_value, min_value, max_value, non_null FROM (
  SELECT 'dollar_volume' AS column_name, CAST(SUM(CAST(dollar_volume AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS sum_value,
         CAST(SUM(CAST(dollar_volume AS DECIMAL(38,4))) / COUNT(dollar_volume) AS DECIMAL(38,4)) AS avg_value,
         CAST(MIN(dollar_volume) AS DECIMAL(38,4)) AS min_value, CAST(MAX(dollar_volume) AS DECIMAL(38,4)) AS max_value,
         COUNT(dollar_volume) AS non_null FROM gold
  UNION ALL SELECT 'year', SUM(year), CAST(SUM(year) / COUNT(year) AS DECIMAL(38,4)), MIN(year), MAX(year), COUNT(year) FROM gold
  UNION ALL SELECT 'month', SUM(month), CAST(SUM(month) / COUNT(month) AS DECIMAL(38,4)), MIN(month), MAX(month), COUNT(month) FROM gold
  UNION ALL SELECT 'period', SUM(period), CAST(SUM(period) / COUNT(period) AS DECIMAL(38,4)), MIN(period), MAX(period), COUNT(period) FROM gold) x"""))
def a14_analyze_table(spark, sf_dir):
    """Row/column counts and exact sum/avg/min/max of every numeric column."""
    return MT.analyze_table(_dom(spark, sf_dir).layers.gold_sales, "gold_sales")


@register("a15_null_negative_counts", O.with_gold("""
SELECT 'dollar_volume' AS column_name, COUNT(*) FILTER (WHERE dollar_volume IS NULL) AS null_count,
       COUNT(*) FILTER (WHERE dollar_volume < 0) AS negative_count FROM gold
UNION ALL SELECT 'trade_group_desc', COUNT(*) FILTER (WHERE trade_group_desc IS NULL), NULL FROM gold
UNION ALL SELECT 'brand_nm', COUNT(*) FILTER (WHERE brand_nm IS NULL), NULL FROM gold
UNION ALL SELECT 'year', COUNT(*) FILTER (WHERE year IS NULL), COUNT(*) FILTER (WHERE year < 0) FROM gold"""))
def a15_null_negative_counts(spark, sf_dir):
    g = _dom(spark, sf_dir).layers.gold_sales
    return MT.null_negative_counts(g, ["dollar_volume", "trade_group_desc", "brand_nm", "year"])


# ================================================================ layer checks and control
def _layer_counts(d: DriverDomain):
    """(layer, table_name, rows) of every table in ONE aggregation of the
    bronze rows with their rule codes and typed attributes."""
    L = d.layers
    declared = Q.first_failure(Q.sales_checks(channels=L.silver_channels))
    rows = Q.apply_dq_sales(L.bronze_sales, years=d.profile.years)
    keys = L.silver_channels.select(F.trim("trade_chnl_desc").alias("_ck")).distinct()
    rows = rows.join(bounded_broadcast(keys), F.col("trade_chnl_desc") == F.col("_ck"), "left") \
        .withColumn("_channel_missing", F.col("_ck").isNull()).withColumn("_declared", declared)
    ok = F.col("_dq_code").isNull()
    sold = F.try_to_date(F.col("date"), "M/d/yyyy")

    def members(cols):
        return F.count_distinct(F.when(ok, F.struct(*[F.coalesce(F.col(c), F.lit("\x00")) for c in cols])))

    n = {("bronze", "bronze_sales"): F.count(F.lit(1)), ("silver", "silver_sales"): F.count_if(ok),
         ("gold", "gold_sales"): F.count_if(ok), ("control", "quarantine"): F.count_if(F.col("_declared").isNotNull()),
         ("consumption", "dim_date"): F.count_distinct(F.when(ok, sold)),
         ("consumption", "dim_region"): members(["region"]), ("consumption", "dim_product"): members(ST.PRODUCT_COLS),
         ("consumption", "dim_channel"): members(ST.CHANNEL_LOOKUP), ("consumption", "fact_sales"): F.count_if(ok)}
    one = rows.agg(*(e.alias(t) for (_, t), e in n.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(layer).alias("layer"), F.lit(t).alias("table_name"),
                                                   F.col(t).alias("rows")) for layer, t in n))).alias("r")).select("r.*")


_COUNTS_SQL = f"""
WITH b AS ({O.bronze()}), gold AS ({O.gold()}),
ch AS ({O.CHANNELS}),
q AS (SELECT COUNT(*) AS n FROM b LEFT JOIN ch ON trim(b.trade_chnl_desc) = ch.trade_chnl_desc
      WHERE NOT TRY_CAST(year AS INTEGER) BETWEEN 2000 AND 2030 OR ch.trade_chnl_desc IS NULL),
counts AS (
  SELECT 'bronze' AS layer, 'bronze_sales' AS table_name, (SELECT COUNT(*) FROM b) AS rows
  UNION ALL SELECT 'silver', 'silver_sales', (SELECT COUNT(*) FROM gold)
  UNION ALL SELECT 'gold', 'gold_sales', (SELECT COUNT(*) FROM gold)
  UNION ALL SELECT 'control', 'quarantine', (SELECT n FROM q)
  UNION ALL SELECT 'consumption', 'dim_date', (SELECT COUNT(DISTINCT transaction_date) FROM gold)
  UNION ALL SELECT 'consumption', 'dim_region', (SELECT COUNT(DISTINCT region) FROM gold)
  UNION ALL SELECT 'consumption', 'dim_product', (SELECT COUNT(*) FROM (SELECT DISTINCT ce_brand_flvr, brand_nm, pkg_cat, pkg_cat_desc, tsr_pckg_nm FROM gold) x)
  UNION ALL SELECT 'consumption', 'dim_channel', (SELECT COUNT(*) FROM (SELECT DISTINCT chnl_group, trade_chnl_desc FROM gold) x)
  UNION ALL SELECT 'consumption', 'fact_sales', (SELECT COUNT(*) FROM gold))"""


@register("a16_layer_totals", _COUNTS_SQL + """
SELECT layer, COUNT(*) AS tables, CAST(SUM(rows) AS BIGINT) AS rows,
       COUNT(*) FILTER (WHERE rows = 0) AS empty_tables
FROM counts GROUP BY layer""")
def a16_layer_totals(spark, sf_dir):
    """Tables, rows and empty tables per layer (one job over all tables)."""
    return MT.layer_totals(_layer_counts(_dom(spark, sf_dir)))


@register("d13_layer_monotonicity", _dq_sql(O.defective(), 1990) + """,
n AS (SELECT COUNT(*) AS bronze_rows, COUNT(*) FILTER (WHERE dq_code IS NULL OR dq_code = 'DQ_SALES_008') AS silver_rows,
             COUNT(DISTINCT (trim(brand_nm), region)) FILTER (WHERE dq_code IS NULL OR dq_code = 'DQ_SALES_008') AS mart_rows FROM c)
SELECT bronze_rows, silver_rows, silver_rows AS gold_rows, mart_rows,
       bronze_rows >= silver_rows AND silver_rows >= mart_rows AS monotonic FROM n""")
def d13_layer_monotonicity(spark, sf_dir):
    """bronze >= silver >= gold >= mart rows over sales with defects, in one
    pass: gold has silver's rows, the brand mart one per brand and region."""
    _, dq = _defective(spark, sf_dir, channels=False)
    ok = F.col("_dq_code").isNull()
    n = dq.agg(F.count(F.lit(1)).alias("bronze_rows"), F.count_if(ok).alias("silver_rows"),
               F.count_distinct(F.when(ok, F.struct(F.trim("brand_nm"), "region"))).alias("mart_rows"))
    return n.select("bronze_rows", "silver_rows", F.col("silver_rows").alias("gold_rows"), "mart_rows",
                    ((F.col("bronze_rows") >= F.col("silver_rows")) & (F.col("silver_rows") >= F.col("mart_rows")))
                    .alias("monotonic"))


@register("r6_latest_batch_counts", f"""
WITH {O.extracts()}
SELECT region, COUNT(*) AS rows FROM b2 GROUP BY region""")
def r6_latest_batch_counts(spark, sf_dir):
    """Rows per region in the newest batch of the bronze history (SQL with a
    scalar subquery)."""
    Extracts(_dom(spark, sf_dir)).history.createOrReplaceTempView("bronze_sales_history")
    return latest_batch_counts(spark, "bronze_sales_history", "region")


@register("o3_last_batch_per_region", f"""
WITH {O.extracts()}, h AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
SELECT region, arg_max(_batch_id, _ingestion_timestamp) AS last_batch_id, COUNT(DISTINCT _batch_id) AS batches
FROM h GROUP BY region""")
def o3_last_batch_per_region(spark, sf_dir):
    """Newest batch per region by load time."""
    return CAT.last_batches(Extracts(_dom(spark, sf_dir)).history, "region")


# ================================================================ governance over the history
RETENTION_TODAY = "2024-06-30"


@register("g6_retention_labels", f"""
WITH {O.extracts()}, h AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2),
a AS (SELECT date_diff('day', CAST(_ingestion_timestamp AS DATE), DATE '{RETENTION_TODAY}') AS age FROM h)
SELECT CASE WHEN age <= 180 THEN 'keep' WHEN age <= 365 THEN 'archive' ELSE 'drop' END AS retention,
       COUNT(*) AS rows
FROM a GROUP BY 1""")
def g6_retention_labels(spark, sf_dir):
    """Keep / archive / drop labels of the bronze history at a pinned date."""
    h = Extracts(_dom(spark, sf_dir)).history
    return (CAT.retention_split(h, "bronze", today=RETENTION_TODAY)
            .groupBy(F.col("_retention").alias("retention")).agg(F.count(F.lit(1)).alias("rows")))


@register("d7_d9_reprocess_status", _DQ_SQL + """
SELECT dq_code AS error_code, dq_code = 'DQ_SALES_006' AS reprocessed,
       CASE WHEN dq_code = 'DQ_SALES_006' THEN '20240102000000' END AS reprocess_batch_id,
       COUNT(*) AS rows
FROM c WHERE dq_code IS NOT NULL GROUP BY dq_code""")
def d7_d9_reprocess_status(spark, sf_dir):
    """Quarantine of the failing sales; the year-rule rows released by the
    replay are marked reprocessed."""
    d = _dom(spark, sf_dir)
    dq = Q.apply_dq_sales(d.layers.bronze_sales, channels=d.layers.silver_channels)
    # the failing rows are handed over: an id depends on where a record lies, which must be the same in both passes
    bad = materialize(dq.filter(F.col("_dq_code").isNotNull()), "bad_sales", compression="zstd")
    q = _quarantined(bad, stored_place())
    released = Q.pending_reprocess(q).filter(F.col("error_code") == "DQ_SALES_006").select("quarantine_id")
    marked = Q.mark_as_reprocessed(q, released, SECOND_BATCH_ID, SECOND_BATCH_TS)
    return marked.groupBy("error_code", "reprocessed", "reprocess_batch_id").agg(F.count(F.lit(1)).alias("rows"))


# ================================================================ null keys, late rows, drifting columns
@register("c5_merge_edge_cases", f"""
WITH {O.extracts()},
s AS (SELECT CASE WHEN line_no = '7' THEN NULL ELSE _pk END AS _pk, _row_hash, supplier_id AS only_new,
             CASE WHEN line_no = '1' THEN TIMESTAMP '2023-12-31 00:00:00' ELSE _ingestion_timestamp END AS ts FROM b2),
t AS (SELECT CASE WHEN line_no = '7' THEN NULL ELSE _pk END AS _pk, _row_hash, order_id AS only_old,
             _ingestion_timestamp AS ts FROM b1)
SELECT CASE WHEN t._row_hash IS NULL THEN 'insert' WHEN s._row_hash IS NULL THEN 'keep'
            WHEN s._row_hash = t._row_hash THEN 'unchanged' WHEN s.ts >= t.ts THEN 'update' ELSE 'stale' END AS _action,
       COUNT(*) AS records, COUNT(*) FILTER (WHERE coalesce(s._pk, t._pk) IS NULL) AS null_keys,
       COUNT(*) FILTER (WHERE s._row_hash IS NOT NULL AND (t._row_hash IS NULL OR s._row_hash <> t._row_hash AND s.ts >= t.ts)) AS with_new,
       COUNT(*) FILTER (WHERE t._row_hash IS NOT NULL) AS with_old
FROM s FULL OUTER JOIN t ON s._pk = t._pk GROUP BY 1""")
def c5_merge_edge_cases(spark, sf_dir):
    """Merge in which some keys are null on both sides, some rows of the new
    load are older than the current table, and each side has a column of its
    own: every row comes out, and an update keeps the column the load lacks."""
    e = Extracts(_dom(spark, sf_dir))
    unkeyed = F.when(F.col("line_no") != "7", F.col("_pk")).alias("_pk")
    late = F.when(F.col("line_no") == "1", F.to_timestamp(F.lit("2023-12-31 00:00:00"))) \
        .otherwise(F.col("_ingestion_timestamp")).alias("_ingestion_timestamp")
    new = e.bronze2.select(unkeyed, "_row_hash", F.col("supplier_id").alias("only_new"), late)
    old = e.bronze1.select(unkeyed, "_row_hash", F.col("order_id").alias("only_old"), "_ingestion_timestamp")
    m = cdc.merge(new, old)
    return m.groupBy("_action").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("_pk").isNull()).alias("null_keys"),
        F.count("only_new").alias("with_new"), F.count("only_old").alias("with_old"))


@register("c5_partial_columns", f"""
WITH {O.extracts()}
SELECT coalesce(s._pk, t._pk) AS _pk, CASE WHEN t._pk IS NULL THEN 'insert' WHEN s._pk IS NULL THEN 'keep'
            WHEN s._row_hash = t._row_hash THEN 'unchanged'
            WHEN s._ingestion_timestamp >= t._ingestion_timestamp THEN 'update' ELSE 'stale' END AS _action,
       CAST(CASE WHEN t._pk IS NULL OR s._row_hash <> t._row_hash AND s._ingestion_timestamp >= t._ingestion_timestamp
            THEN s.dollar_volume ELSE t.dollar_volume END AS DECIMAL(18,2)) AS dollar_volume,
       t.region, t.trade_chnl_desc
FROM b2 s FULL OUTER JOIN b1 t ON s._pk = t._pk""")
def c5_partial_columns(spark, sf_dir):
    """Merge of a load that lacks columns of the current table: updated rows
    keep what the table has in them, inserted rows have none."""
    e = Extracts(_dom(spark, sf_dir))
    slim = ["_pk", "_row_hash", "_ingestion_timestamp", "dollar_volume"]
    m = cdc.merge(e.silver(e.bronze2, SECOND_BATCH_TS).select(*slim),
                  e.silver(e.bronze1, BATCH_TS).select(*slim, "region", "trade_chnl_desc"))
    return m.select("_pk", "_action", "dollar_volume", "region", "trade_chnl_desc")


@register("c5_keyless_rows", f"""
WITH {O.extracts()},
s AS (SELECT CASE WHEN CAST(order_id AS BIGINT) % 3 > 0 THEN _pk END AS _pk, _row_hash, _ingestion_timestamp AS ts, region FROM b2),
t AS (SELECT CASE WHEN CAST(order_id AS BIGINT) % 3 > 0 THEN _pk END AS _pk, _row_hash, _ingestion_timestamp AS ts, region FROM b1)
SELECT coalesce(s.region, t.region) AS region, CASE WHEN t._row_hash IS NULL THEN 'insert' WHEN s._row_hash IS NULL THEN 'keep'
            WHEN s._row_hash = t._row_hash THEN 'unchanged' WHEN s.ts >= t.ts THEN 'update' ELSE 'stale' END AS _action,
       COUNT(*) AS records, COUNT(*) FILTER (WHERE coalesce(s._pk, t._pk) IS NULL) AS keyless
FROM s FULL OUTER JOIN t ON s._pk = t._pk GROUP BY 1, 2""")
def c5_keyless_rows(spark, sf_dir):
    """Merge in which a third of both sides has no key: these rows don't take
    part in the join."""
    e = Extracts(_dom(spark, sf_dir))
    keyed = F.when(F.col("order_id").cast("bigint") % 3 > 0, F.col("_pk")).alias("_pk")
    rows = lambda b: b.select(keyed, "_row_hash", "_ingestion_timestamp", "region")
    return cdc.merge(rows(e.bronze2), rows(e.bronze1)).groupBy("region", "_action").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("_pk").isNull()).alias("keyless"))


@register("g7_event_alerts", f"""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, COUNT(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, SUM(n) OVER w / COUNT(n) OVER w AS mean_before FROM h
      WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'hourly_burst' AS alert, event_type AS subject, hour, n AS value, CAST(5 AS DOUBLE) AS bound FROM m WHERE n > 5
UNION ALL
SELECT 'above_history', event_type, hour, n, 2.0 * mean_before FROM m WHERE n > 2.0 * mean_before""")
def g7_event_alerts(spark, sf_dir):
    """Hours of the event stream with a burst, and with more than twice the mean
    of the hours before."""
    return CAT.event_alerts(D.table(spark, sf_dir, "events"), "event_type", burst=5)


@register("b13_silver_channels", f"""
WITH ch AS ({O.CHANNELS})
SELECT trade_chnl_desc, trade_group_desc, trade_type_desc, {O.hkey(["trade_chnl_desc"])} AS channel_sk FROM ch""")
def b13_silver_channels(spark, sf_dir):
    """The channel master with its ids."""
    return _dom(spark, sf_dir).layers.silver_channels.select("trade_chnl_desc", "trade_group_desc", "trade_type_desc", "channel_sk")


@register("b10_country", """
SELECT region, CASE WHEN upper(region) = 'CANADA' THEN 'CANADA' ELSE 'USA' END AS country, COUNT(*) AS customers
FROM (SELECT CASE WHEN n_name IN ('CANADA', 'BRAZIL') THEN n_name ELSE r_name END AS region
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x GROUP BY 1, 2""")
def b10_country(spark, sf_dir):
    """The country rule where both countries occur: customers by region, with
    some nations as regions of their own."""
    t = lambda n: D.table(spark, sf_dir, n)
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.when(F.col("n_name").isin("CANADA", "BRAZIL"), F.col("n_name")).otherwise(F.col("r_name")).alias("region")
    return c.select(region).withColumn("country", RU.country("region")).groupBy("region", "country") \
        .agg(F.count(F.lit(1)).alias("customers"))


# ================================================================ library forms
@register("p1_generic_names", """
SELECT l_orderkey AS order_key, l_extendedprice AS extended_price, l_returnflag AS return_flag_r_a_n FROM lineitem""")
def p1_generic_names(spark, sf_dir):
    """Generic name rule over awkward column names."""
    li = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(" Order Key "), F.col("l_extendedprice").alias("Extended--Price"),
        F.col("l_returnflag").alias("Return Flag (R/A/N)"))
    return standardize_column_names(li, "generic")


@register("c1_c2_skip_form", """
SELECT c_custkey, md5(concat_ws('||', trim(c_name), trim(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END))) AS _pk,
       sha256(concat_ws('||', CAST(c_custkey AS VARCHAR), trim(c_name),
              trim(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END))) AS _row_hash
FROM customer""")
def c1_c2_skip_form(spark, sf_dir):
    """Key and row hash in the form that skips nulls, columns in frame order."""
    c = D.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit(" "), "c_name").alias("c_name"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    keyed = add_primary_key(c, ["c_name", "c_mktsegment"], form="skip")
    return add_row_hash(keyed, form="skip").select("c_custkey", "_pk", "_row_hash")


@register("p9_p10_trim_and_cast", """
SELECT c_custkey, c_mktsegment, CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS DOUBLE) AS c_acctbal
FROM customer""")
def p9_p10_trim_and_cast(spark, sf_dir):
    """Padded text trimmed, text cast to numbers (null when it is none)."""
    c = D.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    return cast_columns(clean_string_columns(c, ["c_mktsegment"]), {"c_acctbal": "double"})


@register("u2_union_null_fill", """
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""")
def u2_union_null_fill(spark, sf_dir):
    """Union by name of frames with a column each that the other lacks."""
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                                  F.col("c_mktsegment").alias("segment"))
    s = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"),
                                                  F.col("s_suppkey").alias("key"))
    return c.unionByName(s, allowMissingColumns=True)


@register("o1_sorted_brand_months", O.with_gold("""
SELECT brand_nm, year, month, strftime(transaction_date, '%Y-%m') AS year_month,
       CAST(SUM(dollar_volume) AS DECIMAL(38,2)) AS total_dollar_volume, COUNT(*) AS transaction_count
FROM gold GROUP BY ALL ORDER BY year DESC, month DESC, total_dollar_volume DESC, brand_nm"""))
def o1_sorted_brand_months(spark, sf_dir):
    """The brand and month mart in reading order: newest month, greatest first."""
    return marts.sorted_report(marts.brand_month_of(_dom(spark, sf_dir).gold), "year", "month",
                               "total_dollar_volume", then=("brand_nm",))


@register("b12_sales_ids", f"""
WITH b AS ({O.bronze()}) SELECT order_id, line_no, 'S-' || _pk AS sales_id FROM b""")
def b12_sales_ids(spark, sf_dir):
    """The reproducible sales id of every silver row."""
    return _dom(spark, sf_dir).layers.silver_sales.select("order_id", "line_no", "sales_id")
