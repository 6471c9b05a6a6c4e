"""The sales pipeline wired to the driver tables (see ``sources.driver``)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import star
from ..sources import driver as D
from .layers import Layers, Profile, bronze_sales, build_layers, sales_dq, silver_sales

# A pinned batch so audit columns are reproducible.
BATCH_ID = "20240101000000"
BATCH_TS = "2024-01-01 00:00:00"
SECOND_BATCH_ID = "20240102000000"
SECOND_BATCH_TS = "2024-01-02 00:00:00"

PROFILE = Profile(key_columns=list(D.SALES_KEY), region_groups=dict(D.REGION_GROUPS),
                  volume_high=D.VOLUME_HIGH, volume_medium=D.VOLUME_MEDIUM,
                  source_file="driver_sales", channel_file="driver_channels", years=(1990, 2030))


# The gold columns the star schema reads.
STAR_INPUT = ["transaction_date", "region", "region_group", "country", "ce_brand_flvr", "brand_nm",
              "pkg_cat", "pkg_cat_desc", "tsr_pckg_nm", "chnl_group", "trade_chnl_desc",
              "trade_group_desc", "trade_type_desc", "dollar_volume", "volume_category",
              "is_negative_sale", "year", "month", "_source_file", "_ingestion_date"]


class DriverDomain:
    def __init__(self, spark: SparkSession, sf_dir: str, profile: Profile = PROFILE):
        self.spark, self.sf_dir, self.profile = spark, sf_dir, profile

    def table(self, name: str) -> DataFrame:
        return D.table(self.spark, self.sf_dir, name)

    @cached_property
    def sales_landing(self) -> DataFrame:
        return D.sales_landing(self.spark, self.sf_dir)

    @cached_property
    def channel_landing(self) -> DataFrame:
        return D.channel_landing(self.spark, self.sf_dir)

    @cached_property
    def layers(self) -> Layers:
        return build_layers(self.sales_landing, self.channel_landing, self.profile, BATCH_ID, BATCH_TS)

    @cached_property
    def gold(self) -> DataFrame:
        """The gold columns of the star schema, as a lazy plan: building a query
        starts no job, and Catalyst reads only the columns a query uses."""
        return self.layers.gold_sales.select(*STAR_INPUT)

    @cached_property
    def star(self) -> dict[str, DataFrame]:
        g = self.gold
        return {
            "dim_date": star.dim_date(g),
            "dim_region": star.dim_region(g),
            "dim_product": star.dim_product(g),
            "dim_channel": star.dim_channel(g, self.layers.gold_channels),
            "fact_sales": star.fact_sales(g, self.profile.null_safe_lookup),
        }


class Extracts:
    """Two overlapping extracts of the sales lines for change capture: the
    first (returns not yet booked) ends inside 1998-1999, the second starts
    there and books returns, so the overlap holds unchanged and changed
    lines, and each side has keys of its own."""

    def __init__(self, domain: DriverDomain):
        self.d = domain
        spark, sf = domain.spark, domain.sf_dir
        p = domain.profile
        l1 = D.sales_landing(spark, sf, returns_booked=False, date_before=D.FIRST_EXTRACT_END)
        l2 = D.sales_landing(spark, sf, returns_booked=True, date_from=D.SECOND_EXTRACT_START)
        self.bronze1 = bronze_sales(l1, p, BATCH_ID, BATCH_TS)
        self.bronze2 = bronze_sales(l2, p, SECOND_BATCH_ID, SECOND_BATCH_TS)

    @property
    def history(self) -> DataFrame:
        """The append-only bronze history after both loads."""
        return self.bronze1.unionByName(self.bronze2)

    def silver(self, bronze: DataFrame, batch_ts: str) -> DataFrame:
        dq = sales_dq(bronze, self.d.profile)
        return silver_sales(dq.filter(dq["_dq_code"].isNull()), batch_ts)
