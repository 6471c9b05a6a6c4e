"""The driver's TPC-H-style tables standing in for the sales domain.

One sale = one line item. Its attributes come from the order, the customer,
the customer's nation and region, and the part:

==================  ======================================================
sales column        driver expression
==================  ======================================================
DATE                o_orderdate as ``M/d/yyyy`` text
CE_BRAND_FLVR       p_partkey
BRAND_NM            p_brand with a leading space (like the source file)
Btlr_Org_LVL_C_Desc r_name
CHNL_GROUP          o_orderpriority
TRADE_CHNL_DESC     c_mktsegment
PKG_CAT / Pkg_Cat_Desc / TSR_PCKG_NM   p_type / p_name / p_size
$ Volume            l_extendedprice as decimal(18,2), negative for returns
YEAR MONTH PERIOD   parts of o_orderdate
ORDER_ID LINE_NO SUPPLIER_ID  l_orderkey, l_linenumber, l_suppkey
==================  ======================================================

Everything is landing-shaped (strings with the source header names), so the
bronze -> silver path parses and types it exactly as it would a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import map_lookup

# Fixed values of the driver-table sales domain.
# Trade channel master: market segment -> (trade group, trade type). MACHINERY
# has no entry, so its sales have no channel match (orphans), as in real data.
CHANNEL_GROUPS = {"AUTOMOBILE": "SERVICES", "BUILDING": "GROCERY",
                  "FURNITURE": "ENTERTAINMENT", "HOUSEHOLD": "GROCERY"}
CHANNEL_TYPES = {"AUTOMOBILE": "MIX", "BUILDING": "MIX",
                 "FURNITURE": "ALCOHOLIC", "HOUSEHOLD": "NON ALCOHOLIC"}
# Region groups for the five driver regions.
REGION_GROUPS = {"AFRICA": "EMEA", "EUROPE": "EMEA", "MIDDLE EAST": "EMEA",
                 "AMERICA": "AMERICAS", "ASIA": "APAC"}
# Volume thresholds: line prices run from about 900 to 105,000.
VOLUME_HIGH, VOLUME_MEDIUM = 50000, 20000
# Identifying columns: one sale line (unique in the driver data).
SALES_KEY = ["order_id", "line_no", "ce_brand_flvr", "supplier_id"]
# The original key (brand code, region, channel, year, month); not unique.
REFERENCE_KEY = ["ce_brand_flvr", "region", "trade_chnl_desc", "year", "month"]
# The two extracts used for change capture: the first ends, the second starts
# inside 1998-1999; the second also books returns (negative volume).
FIRST_EXTRACT_END = "2000-01-01"
SECOND_EXTRACT_START = "1998-01-01"



# Schemas of the driver tables this domain reads. Declaring them
# skips schema inference (a footer read per table at plan time).
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    r = spark.read
    if name in SCHEMAS:
        r = r.schema(SCHEMAS[name])
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_landing(spark: SparkSession, sf_dir: str, returns_booked: bool = True,
                  date_from: str | None = None, date_before: str | None = None) -> DataFrame:
    """Sales lines as the landing file would hold them (all strings).

    Join order keeps the big-big joins to two shuffles of line-item size:
    orders+customer (+ broadcast nation, region) meets line items on the
    order key; parts meet line items on the part key. Date bounds are
    pushed into the orders scan.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if date_from:
        o = o.filter(F.col("o_orderdate") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_before:
        o = o.filter(F.col("o_orderdate") < F.lit(date_before).cast("timestamp_ntz"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation and region are tiny files: the planner broadcasts them from
    # their size statistics (autoBroadcastJoinThreshold), with no extra job.
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")

    oc = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
          .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    j = li.join(oc, li.l_orderkey == oc.o_orderkey).join(p, F.col("l_partkey") == F.col("p_partkey"))

    price = F.col("l_extendedprice").cast("decimal(18,2)")
    vol = F.when(F.col("l_returnflag") == "R", -price).otherwise(price) if returns_booked else price
    d = F.col("o_orderdate")
    s = lambda c: F.col(c).cast("string")
    return j.select(
        F.date_format(d, "M/d/yyyy").alias("DATE"),
        s("p_partkey").alias("CE_BRAND_FLVR"),
        F.concat(F.lit(" "), F.col("p_brand")).alias("BRAND_NM"),
        F.col("r_name").alias("Btlr_Org_LVL_C_Desc"),
        F.col("o_orderpriority").alias("CHNL_GROUP"),
        F.col("c_mktsegment").alias("TRADE_CHNL_DESC"),
        F.col("p_type").alias("PKG_CAT"),
        F.col("p_name").alias("Pkg_Cat_Desc"),
        s("p_size").alias("TSR_PCKG_NM"),
        vol.cast("string").alias("$ Volume"),
        F.year(d).cast("string").alias("YEAR"),
        F.month(d).cast("string").alias("MONTH"),
        F.month(d).cast("string").alias("PERIOD"),
        s("l_orderkey").alias("ORDER_ID"),
        s("l_linenumber").alias("LINE_NO"),
        s("l_suppkey").alias("SUPPLIER_ID"),
    )


# Injected defects, by order number modulo DEFECT_EVERY. Each
# breaks one rule: (remainder, landing column, value).
DEFECT_EVERY = 50
DEFECTS = [(1, "BRAND_NM", None), (2, "TRADE_CHNL_DESC", "  "), (3, "$ Volume", "12,5"), (4, "DATE", "2020-31-31"),
           (5, "YEAR", "1899"), (6, "MONTH", "13"), (7, "TRADE_CHNL_DESC", "UNLISTED")]


def defective_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines in which some orders break a rule each."""
    df = sales_landing(spark, sf_dir)
    rest = F.col("ORDER_ID").cast("bigint") % DEFECT_EVERY
    for column in dict.fromkeys(c for _, c, _ in DEFECTS):
        value = F.col(f"`{column}`")
        for k, c, bad in DEFECTS:
            if c == column:
                value = F.when(rest == k, F.lit(bad)).otherwise(value)
        df = df.withColumn(column, value)
    return df


# Channel rows that break each channel rule, added to the master.
CHANNEL_DEFECTS = [(None, "SERVICES", "MIX"), ("KIOSK", None, "MIX"), ("BUILDING", "GROCERY", "MIX"),
                   ("VENDING", "SERVICES", "FROZEN")]


def defective_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = channel_landing(spark, sf_dir)
    return good.unionByName(spark.createDataFrame(CHANNEL_DEFECTS, good.schema))


def channel_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel master rows (landing-shaped) for the segments present in the data."""
    seg = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("TRADE_CHNL_DESC")).distinct()
    grp = map_lookup(F.col("TRADE_CHNL_DESC"), CHANNEL_GROUPS, None)
    return (seg.withColumns({"TRADE_GROUP_DESC": grp,
                             "TRADE_TYPE_DESC": map_lookup(F.col("TRADE_CHNL_DESC"), CHANNEL_TYPES, None)})
            .filter(F.col("TRADE_GROUP_DESC").isNotNull()))
