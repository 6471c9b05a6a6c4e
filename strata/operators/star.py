"""Star schema: dimensions with stable surrogate keys and the sales fact.

Surrogate keys are a 60-bit hash of the natural key (``hash_key``) and the
date key is ``yyyyMMdd``. Keys are therefore a pure function of each row:

* no global sort or single-partition numbering is needed to assign them;
* the fact gets its keys by projection, without joining the dimensions
  (zero shuffles), and saved dimension and saved fact always agree;
* the lookup keeps "equality" semantics: a row with a null attribute in a
  lookup column gets a null key, exactly as a left ``==`` join would.

Every dimension asserts lookup-key uniqueness through ``check_unique``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key

# Natural keys and attributes of each dimension.
REGION_COLS = ["region", "region_group", "country"]
PRODUCT_COLS = ["ce_brand_flvr", "brand_nm", "pkg_cat", "pkg_cat_desc", "tsr_pckg_nm"]
CHANNEL_COLS = ["chnl_group", "trade_chnl_desc", "trade_group_desc", "trade_type_desc"]
CHANNEL_LOOKUP = ["chnl_group", "trade_chnl_desc"]


def lookup_key(cols: list[str], null_safe: bool = False) -> Column:
    """Surrogate key of a natural key; null when any part is null unless
    ``null_safe`` (then nulls match nulls, like ``<=>``)."""
    k = hash_key(cols)
    if null_safe:
        return k
    return F.when(F.greatest(*[F.col(c).isNull() for c in cols]) if len(cols) > 1
                  else F.col(cols[0]).isNull(), F.lit(None).cast("bigint")).otherwise(k)


def date_key(col: str = "transaction_date") -> Column:
    return F.date_format(F.col(col), "yyyyMMdd").try_cast("int")


def create_dimension_table(df: DataFrame, key_column: str, attribute_columns: list[str],
                           surrogate_key_name: str = "sk", batch_ts: str | None = None) -> DataFrame:
    """Distinct natural rows + surrogate key + validity columns (``_valid_to``
    open, ``_is_current`` true)."""
    cols = [key_column] + [c for c in attribute_columns if c != key_column]
    ts = F.to_timestamp(F.lit(batch_ts)) if batch_ts else F.current_timestamp()
    return (df.select(*cols).distinct()
            .withColumn(surrogate_key_name, hash_key(cols))
            .withColumns({"_valid_from": ts, "_valid_to": F.lit(None).cast("timestamp"),
                          "_is_current": F.lit(True)}))


def check_unique(dim: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (empty when the dimension is sound)."""
    return dim.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def dim_date(sales: DataFrame) -> DataFrame:
    d = F.col("full_date")
    return (sales.select(F.col("transaction_date").alias("full_date")).filter(d.isNotNull()).distinct()
            .select(date_key("full_date").alias("date_key"), "full_date",
                    F.year(d).alias("year"), F.quarter(d).alias("quarter"),
                    F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"),
                    F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
                    F.weekofyear(d).alias("week_of_year"), F.dayofmonth(d).alias("day_of_month"),
                    F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
                    F.dayofweek(d).isin(1, 7).alias("is_weekend"),
                    F.date_format(d, "yyyy-MM").alias("year_month")))


def dim_region(sales: DataFrame) -> DataFrame:
    return (sales.select(*REGION_COLS).distinct()
            .select(lookup_key(["region"], null_safe=True).alias("region_key"),
                    F.col("region").alias("region_name"), "region_group", "country"))


def dim_product(sales: DataFrame) -> DataFrame:
    return (sales.select(*PRODUCT_COLS).distinct()
            .select(lookup_key(PRODUCT_COLS, null_safe=True).alias("product_key"), *PRODUCT_COLS))


def dim_channel(sales: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels seen in sales, with the channel master's gold attributes."""
    attrs = channels.select("trade_chnl_desc", "is_alcoholic_channel", "channel_category")
    return (sales.select(*CHANNEL_COLS).distinct()
            .join(attrs, "trade_chnl_desc", "left")
            .select(lookup_key(CHANNEL_LOOKUP, null_safe=True).alias("channel_key"), *CHANNEL_COLS,
                    "is_alcoholic_channel", "channel_category"))


def fact_sales(sales: DataFrame, null_safe: bool = False) -> DataFrame:
    """One row per sale; keys by projection (no dimension joins)."""
    return sales.select(
        date_key().alias("date_key"),
        lookup_key(["region"], null_safe).alias("region_key"),
        lookup_key(PRODUCT_COLS, null_safe).alias("product_key"),
        lookup_key(CHANNEL_LOOKUP, null_safe).alias("channel_key"),
        "dollar_volume", "volume_category", "is_negative_sale", "year", "month",
        *[c for c in ("_source_file", "_ingestion_date") if c in sales.columns])


def fact_null_keys(fact: DataFrame) -> DataFrame:
    """Referential check: fact rows with any null key, plus the total."""
    anynull = (F.col("date_key").isNull() | F.col("region_key").isNull()
               | F.col("product_key").isNull() | F.col("channel_key").isNull())
    return fact.agg(F.count(F.lit(1)).alias("fact_rows"), F.count_if(anynull).alias("null_key_rows"))
