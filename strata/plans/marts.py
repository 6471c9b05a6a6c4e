"""Business questions over the star schema.

Pattern used throughout: aggregate the fact on its surrogate keys first
(map-side partial aggregation shrinks every hot key inside each task), then
join the far smaller result to the dimensions, then roll up by the names.
Sums and counts decompose, so this equals joining first and aggregating
after, but the fact itself is never shuffled for a join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.star import CHANNEL_LOOKUP, PRODUCT_COLS


# Money output type of every mart (wide enough for any sum).
MONEY = "decimal(38,2)"


def _by_keys(fact: DataFrame, keys: list[str]) -> DataFrame:
    return fact.groupBy(*keys).agg(F.sum("dollar_volume").alias("_v"), F.count(F.lit(1)).alias("_n"))


def _rollup(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy(*names).agg(F.sum("_v").cast(MONEY).alias("total_dollar_volume"),
                                  F.sum("_n").alias("transaction_count"))


def _dim(df: DataFrame, *cols: str) -> DataFrame:
    # The fact side is already reduced to one row per key combination, so no
    # broadcast hint is forced here: AQE turns the join into a broadcast at
    # runtime when the dimension stage is small, without a separate count job.
    return df.select(*cols)


def top_trade_groups(fact: DataFrame, dim_region: DataFrame, dim_channel: DataFrame,
                     top_n: int | None = 3) -> DataFrame:
    """Trade groups per region ranked by volume (ties by group name)."""
    a = (_by_keys(fact, ["region_key", "channel_key"])
         .join(_dim(dim_region, "region_key", "region_name"), "region_key")
         .join(_dim(dim_channel, "channel_key", "trade_group_desc"), "channel_key"))
    agg = _rollup(a, ["region_name", "trade_group_desc"])
    w = Window.partitionBy("region_name").orderBy(F.desc("total_dollar_volume"),
                                                  F.asc_nulls_first("trade_group_desc"))
    out = agg.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= top_n) if top_n else out


def brand_month(fact: DataFrame, dim_product: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Volume per brand per month."""
    a = (_by_keys(fact, ["product_key", "date_key"])
         .join(_dim(dim_product, "product_key", "brand_nm"), "product_key")
         .join(_dim(dim_date, "date_key", "year", "month", "year_month"), "date_key"))
    return _rollup(a, ["brand_nm", "year", "month", "year_month"])


def brand_region(fact: DataFrame, dim_product: DataFrame, dim_region: DataFrame) -> DataFrame:
    """Brands per region with ascending and descending rank (one exchange)."""
    a = (_by_keys(fact, ["product_key", "region_key"])
         .join(_dim(dim_product, "product_key", "brand_nm"), "product_key")
         .join(_dim(dim_region, "region_key", "region_name"), "region_key"))
    agg = _rollup(a, ["region_name", "brand_nm"])
    wa = Window.partitionBy("region_name").orderBy(F.asc("total_dollar_volume"), F.asc_nulls_first("brand_nm"))
    wd = Window.partitionBy("region_name").orderBy(F.desc("total_dollar_volume"), F.asc_nulls_first("brand_nm"))
    return agg.withColumn("rank_asc", F.row_number().over(wa)).withColumn("rank_desc", F.row_number().over(wd))


def lowest_brand_per_region(fact: DataFrame, dim_product: DataFrame, dim_region: DataFrame) -> DataFrame:
    return brand_region(fact, dim_product, dim_region).filter(F.col("rank_asc") == 1)


# --- the same questions straight from gold ---------------------------------------
#
# With nothing saved, each star table would run the source joins again. Gold
# holds the attributes that the star joins would bring back, so these read it
# once; rows with a null lookup attribute drop out, as in the inner star joins.

def _named(gold: DataFrame, lookup: list[str], names: list[str]) -> DataFrame:
    whole = gold.filter(reduce(and_, [F.col(c).isNotNull() for c in lookup]))
    return whole.groupBy(*names).agg(F.sum("dollar_volume").cast(MONEY).alias("total_dollar_volume"),
                                     F.count(F.lit(1)).alias("transaction_count"))


def ranked(df: DataFrame, group: str, name: str, descending: bool, rank: str) -> DataFrame:
    """Row number per group by volume; ties by name, nulls first."""
    volume = F.desc("total_dollar_volume") if descending else F.asc("total_dollar_volume")
    return df.withColumn(rank, F.row_number().over(
        Window.partitionBy(group).orderBy(volume, F.asc_nulls_first(name))))


def top_trade_groups_of(gold: DataFrame, top_n: int | None = 3) -> DataFrame:
    agg = _named(gold.withColumnRenamed("region", "region_name"), ["region_name", *CHANNEL_LOOKUP],
                 ["region_name", "trade_group_desc"])
    out = ranked(agg, "region_name", "trade_group_desc", True, "rank")
    return out.filter(F.col("rank") <= top_n) if top_n else out


def brand_month_of(gold: DataFrame) -> DataFrame:
    named = gold.withColumn("year_month", F.date_format("transaction_date", "yyyy-MM"))
    return _named(named, ["transaction_date", *PRODUCT_COLS], ["brand_nm", "year", "month", "year_month"])


def brand_region_of(gold: DataFrame) -> DataFrame:
    agg = _named(gold.withColumnRenamed("region", "region_name"), ["region_name", *PRODUCT_COLS],
                 ["region_name", "brand_nm"])
    return ranked(ranked(agg, "region_name", "brand_nm", False, "rank_asc"), "region_name", "brand_nm", True, "rank_desc")


def lowest_brand_of(gold: DataFrame) -> DataFrame:
    return brand_region_of(gold).filter(F.col("rank_asc") == 1)


def sorted_report(df: DataFrame, *descending: str, then: tuple[str, ...] = ()) -> DataFrame:
    """A mart in reading order: greatest first, then by name."""
    return df.orderBy(*map(F.desc, descending), *map(F.asc_nulls_first, then))


# --- presentation queries over the gold table ------------------------------------

def region_totals(gold: DataFrame) -> DataFrame:
    """Totals per region, greatest volume first."""
    return (gold.groupBy("region")
            .agg(F.sum("dollar_volume").cast(MONEY).alias("total_dollar_volume"),
                 F.sum(F.abs("dollar_volume")).cast(MONEY).alias("gross_dollar_volume"),
                 F.count(F.lit(1)).alias("transaction_count"))
            # a row per region: one partition sorts them, without the sampling job of a range exchange
            .coalesce(1).sortWithinPartitions(F.desc("total_dollar_volume"), F.asc("region")))


def top_brands(gold: DataFrame, n: int = 10) -> DataFrame:
    """Top-n brands by volume (a top-k report: the limit is the feature)."""
    return (gold.groupBy("brand_nm").agg(F.sum("dollar_volume").cast(MONEY).alias("total_dollar_volume"))
            .orderBy(F.desc("total_dollar_volume"), F.asc("brand_nm")).limit(n))


def seasonality(gold: DataFrame) -> DataFrame:
    return (gold.groupBy("month")
            .agg(F.sum("dollar_volume").cast(MONEY).alias("total_dollar_volume"),
                 F.avg("dollar_volume").cast(MONEY).alias("avg_dollar_volume"),
                 F.count(F.lit(1)).alias("transaction_count")))


def region_group_matrix(gold: DataFrame, groups: list[str]) -> DataFrame:
    """Region x trade group volume. The pivot values are passed, so Spark
    needs no extra job to discover them; a null group becomes ``NO_GROUP`` and
    a group outside the list adds to ``OTHER``, so a row's sum is the region's."""
    g = F.coalesce(F.col("trade_group_desc"), F.lit("NO_GROUP"))
    g = F.when(g.isin(groups), g).otherwise("OTHER")
    return (gold.withColumn("_g", g).groupBy("region").pivot("_g", [*groups, "OTHER"])
            .agg(F.sum("dollar_volume").cast(MONEY)))


def executive_summary(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("dollar_volume").cast(MONEY).alias("total_dollar_volume"),
        F.min("dollar_volume").cast(MONEY).alias("min_dollar_volume"),
        F.max("dollar_volume").cast(MONEY).alias("max_dollar_volume"),
        F.avg("dollar_volume").cast(MONEY).alias("avg_dollar_volume"),
        F.count_distinct("brand_nm").alias("brands"),
        F.count_distinct("region").alias("regions"),
    )
