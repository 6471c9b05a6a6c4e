"""The medallion layers as lazy DataFrame plans.

Each function is a pure transformation; writing and run control are the
caller's (``sources.tables.TableStore``, ``operators.control``). Audit time
stamps can be pinned with ``batch_ts`` for replays and tests.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.audit import add_audit_columns, audit_exprs, audit_first, update_layer_timestamp
from ..functions.hashing import add_primary_key, add_row_hash, hash_key, primary_key_expr, row_hash_expr
from ..functions.names import standardize_column_names
from ..operators import star
from ..operators.cdc import latest_per_key
from ..operators.joins import bounded_broadcast
from ..operators.quality import SALES_DECLARED_YEARS, apply_dq_sales

# The region column rename and the source table names.
REGION_SOURCE_COLUMN = "btlr_org_lvl_c_desc"
SALES_TABLE, CHANNEL_TABLE = "beverage_sales", "beverage_channel_group"
# The channel master is master data; broadcast it only under this bound.
CHANNEL_BROADCAST_ROWS = 100_000


@dataclass
class Profile:
    """Parameters of one sales domain."""
    key_columns: list[str]
    channel_key: list[str] = field(default_factory=lambda: ["trade_chnl_desc"])
    region_groups: dict = field(default_factory=lambda: dict(R.BEVERAGE_REGION_GROUPS))
    volume_high: float = R.VOLUME_HIGH
    volume_medium: float = R.VOLUME_MEDIUM
    source_file: str = "beverage_sales.tsv"
    channel_file: str = "beverage_channel_group.csv"
    null_safe_lookup: bool = False
    # Years that the value rule accepts.
    years: tuple[int, int] = SALES_DECLARED_YEARS
    # Buckets of the silver current table by ``_pk`` (None = not bucketed).
    # Bucketed, a merge shuffles only the increment, never the current table.
    current_buckets: int | None = None


# --- bronze -------------------------------------------------------------------

def bronze_sales(landing: DataFrame, profile: Profile, batch_id: str,
                 batch_ts: str | None = None, source_file: str | None = None) -> DataFrame:
    """Names, key, row hash and audit columns in ONE projection (audit first)."""
    df = standardize_column_names(landing, "currency")
    if REGION_SOURCE_COLUMN in df.columns:
        df = df.withColumnRenamed(REGION_SOURCE_COLUMN, "region")
    audit = audit_exprs(source_file or profile.source_file, None, "bronze", batch_id, batch_ts)
    return df.select(primary_key_expr(df, profile.key_columns).alias("_pk"),
                     row_hash_expr(df).alias("_row_hash"),
                     *[e.alias(n) for n, e in audit.items()], *df.columns)


def bronze_channels(landing: DataFrame, profile: Profile, batch_id: str,
                    batch_ts: str | None = None) -> DataFrame:
    df = standardize_column_names(landing, "currency")
    df = add_row_hash(add_primary_key(df, profile.channel_key))
    return audit_first(add_audit_columns(df, profile.channel_file, None, "bronze", batch_id, batch_ts))


# --- silver -------------------------------------------------------------------

def silver_channels(bronze: DataFrame, batch_ts: str | None = None) -> DataFrame:
    """Newest version per key (history may hold several loads), trimmed, with
    ``channel_sk``: a hash of the channel, so it is the same in every load."""
    df = latest_per_key(bronze, "_pk")
    df = df.withColumns({c: F.trim(c) for c in ("trade_chnl_desc", "trade_group_desc", "trade_type_desc")})
    return update_layer_timestamp(df.withColumn("channel_sk", hash_key(["trade_chnl_desc"])), "silver", batch_ts)


def sales_dq(bronze: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Bronze sales with ``_dq_code`` (null = valid) after trimming: the null
    rules and the value rules (number, date, year, month)."""
    return apply_dq_sales(bronze, years=profile.years if profile else SALES_DECLARED_YEARS)


def silver_sales(valid: DataFrame, batch_ts: str | None = None) -> DataFrame:
    """Typed sales in one projection (values that cannot be typed are in
    quarantine by now), with ``sales_id``, a key that a replay reproduces."""
    m = F.col("month").try_cast("int")
    y = F.col("year").try_cast("int")
    df = valid.withColumns({
        "transaction_date": F.try_to_date(F.col("date"), "M/d/yyyy"),
        "year": y, "month": m,
        "period": F.col("period").try_cast("int"),
        "dollar_volume": F.col("dollar_volume").try_cast("decimal(18,2)"),
        "sales_id": F.concat(F.lit("S-"), F.col("_pk")),
        "year_month": F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0")),
    }).drop("date", "_dq_code")
    return update_layer_timestamp(df, "silver", batch_ts)


def enrich_with_channels(sales: DataFrame, channels: DataFrame) -> DataFrame:
    """Left join on the trade channel; the master is deduped by key first and
    broadcast only behind a row-count check."""
    ch = channels.select("trade_chnl_desc", "trade_group_desc", "trade_type_desc")
    return sales.join(bounded_broadcast(ch, CHANNEL_BROADCAST_ROWS), "trade_chnl_desc", "left")


# --- gold ---------------------------------------------------------------------

def gold_sales(silver: DataFrame, profile: Profile, batch_ts: str | None = None) -> DataFrame:
    df = silver.withColumns({
        "volume_category": R.volume_category("dollar_volume", profile.volume_high, profile.volume_medium),
        "is_negative_sale": R.negative_sale("dollar_volume"),
        "region_group": R.region_group("region", profile.region_groups),
        "sales_quarter": R.sales_quarter("month"),
        "is_weekend_sale": R.weekend_flag("transaction_date"),
        "country": R.country("region"),
    })
    return update_layer_timestamp(df, "gold", batch_ts)


def gold_channels(silver: DataFrame, batch_ts: str | None = None) -> DataFrame:
    df = silver.withColumns({"is_alcoholic_channel": R.alcoholic_channel(),
                             "channel_category": R.channel_category()})
    return update_layer_timestamp(df, "gold", batch_ts)


# --- whole chain (no writes) ----------------------------------------------------

@dataclass
class Layers:
    bronze_sales: DataFrame
    bronze_channels: DataFrame
    dq_sales: DataFrame
    silver_sales: DataFrame
    silver_channels: DataFrame
    gold_sales: DataFrame
    gold_channels: DataFrame

    def star(self, profile: Profile) -> dict[str, DataFrame]:
        g = self.gold_sales
        return {
            "dim_date": star.dim_date(g),
            "dim_region": star.dim_region(g),
            "dim_product": star.dim_product(g),
            "dim_channel": star.dim_channel(g, self.gold_channels),
            "fact_sales": star.fact_sales(g, profile.null_safe_lookup),
        }


def build_layers(sales_landing: DataFrame, channel_landing: DataFrame, profile: Profile,
                 batch_id: str, batch_ts: str | None = None) -> Layers:
    bs = bronze_sales(sales_landing, profile, batch_id, batch_ts)
    bc = bronze_channels(channel_landing, profile, batch_id, batch_ts)
    sc = silver_channels(bc, batch_ts)
    dq = sales_dq(bs, profile)
    valid = dq.filter(F.col("_dq_code").isNull())
    ss = enrich_with_channels(silver_sales(valid, batch_ts), sc)
    gc = gold_channels(sc, batch_ts)
    return Layers(bs, bc, dq, ss, sc, gold_sales(ss, profile, batch_ts), gc)
