"""Two batches through every layer with run control; a re-run is idempotent."""

from pyspark.sql import functions as F

from strata.plans.batch import run_batch
from strata.plans.layers import Profile
from strata.sources.tables import TableStore

KEY = ["ce_brand_flvr", "region", "trade_chnl_desc", "year", "month"]
SALES = ("DATE string, CE_BRAND_FLVR string, BRAND_NM string, Btlr_Org_LVL_C_Desc string, "
         "CHNL_GROUP string, TRADE_CHNL_DESC string, PKG_CAT string, Pkg_Cat_Desc string, "
         "TSR_PCKG_NM string, `$ Volume` string, YEAR string, MONTH string, PERIOD string")
CH = "TRADE_CHNL_DESC string, TRADE_GROUP_DESC string, TRADE_TYPE_DESC string"


def _row(code, brand, region, chan, vol, month="1"):
    return (f"{month}/5/2006", code, brand, region, "OFF", chan, "P1", "Can", "12oz", vol, "2006", month, month)


import pytest


@pytest.mark.parametrize("buckets", [None, 4])
def test_two_batches(spark, tmp_path, buckets):
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=KEY, current_buckets=buckets)
    ch = spark.createDataFrame([("SUPERETTE", "SERVICES", "MIX"), ("SPORT VENUE", "ENTERTAINMENT", "ALCOHOLIC")], CH)
    day1 = spark.createDataFrame([_row("B1", " A", "WEST", "SUPERETTE", "10.00"),
                                  _row("B2", " B", "CANADA", "SPORT VENUE", "2000.00"),
                                  _row("B3", None, "WEST", "SUPERETTE", "1.00")], SALES)
    r1 = run_batch(spark, store, day1, ch, prof, "20240101000000", "2024-01-01 00:00:00")
    assert (r1["bronze_rows"], r1["quarantined"], r1["inserted"], r1["silver_rows"]) == (3, 1, 2, 2)
    day2 = spark.createDataFrame([_row("B1", " A", "WEST", "SUPERETTE", "15.00"),
                                  _row("B4", " C", "WEST", "SPORT VENUE", "-5.00", "2")], SALES)
    r2 = run_batch(spark, store, day2, ch, prof, "20240102000000", "2024-01-02 00:00:00")
    assert (r2["inserted"], r2["updated"], r2["kept"], r2["silver_rows"]) == (1, 1, 1, 3)
    silver = {r["ce_brand_flvr"]: str(r["dollar_volume"]) for r in store.read("silver", "beverage_sales").collect()}
    assert silver == {"B1": "15.00", "B2": "2000.00", "B4": "-5.00"}
    fact = store.read("consumption", "fact_sales")
    assert fact.count() == 3 and fact.filter(F.col("channel_key").isNull()).count() == 0
    top = store.read("consumption", "agg_sales_region_tradegroup")
    assert top.agg(F.sum("transaction_count")).first()[0] == 3
    from strata.operators.control import latest_runs
    ctrl = store.read("control", "process_control")
    assert latest_runs(ctrl).filter(F.col("status") != "SUCCESS").count() == 0
    assert ctrl.filter(F.col("status") == "RUNNING").count() == latest_runs(ctrl).count()
    assert ctrl.select("batch_id").distinct().count() == 2
    # re-running day 2 changes nothing: bronze partition replaced, later steps skipped
    r3 = run_batch(spark, store, day2, ch, prof, "20240102000000", "2024-01-02 00:00:00")
    assert "silver.beverage_sales" in r3["skipped"] and len(r3["skipped"]) == 12
    bronze = store.read("bronze", "beverage_sales")
    assert bronze.count() == 5
    assert dict(bronze.dtypes)["_batch_id"] == "string" and dict(bronze.dtypes)["_ingestion_date"] == "date"
    assert store.read("silver", "beverage_sales").count() == 3


def test_reprocess_after_a_rule_change(spark, tmp_path):
    """Quarantined rows that pass a corrected rule reach silver, and only they
    are marked; a second call finds nothing."""
    from dataclasses import replace

    from strata.plans.reprocess import reprocess_sales
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=KEY)
    ch = spark.createDataFrame([("SUPERETTE", "SERVICES", "MIX")], CH)
    old = lambda code: tuple(v if i not in (0, 10) else ("1/5/1998" if i == 0 else "1998")
                             for i, v in enumerate(_row(code, " A", "WEST", "SUPERETTE", "10.00")))
    day = spark.createDataFrame([_row("B1", " A", "WEST", "SUPERETTE", "10.00"), old("B2"), old("B3"),
                                 _row("B4", " A", "WEST", "SUPERETTE", "abc"), _row("B4", " A", "WEST", "SUPERETTE", "abc")], SALES)
    r = run_batch(spark, store, day, ch, prof, "20240101000000", "2024-01-01 00:00:00")
    assert (r["quarantined"], r["silver_rows"]) == (4, 1)
    q = store.read("control", "quarantine")
    assert q.select("quarantine_id").distinct().count() == 4
    assert {x["error_type"] for x in q.collect()} == {"VALIDATION_ERROR"}
    fixed = replace(prof, years=(1990, 2030))
    out = reprocess_sales(store, fixed, "20240102000000", "2024-01-02 00:00:00")
    assert out == {"released": 2, "held": 2, "actions": {"insert": 2, "keep": 1}}
    silver = {x["ce_brand_flvr"]: x["trade_group_desc"] for x in store.read("silver", "beverage_sales").collect()}
    assert silver == {"B1": "SERVICES", "B2": "SERVICES", "B3": "SERVICES"}
    marked = {(x["error_code"], x["reprocessed"], x["reprocess_batch_id"]) for x in store.read("control", "quarantine").collect()}
    assert marked == {("DQ_SALES_006", True, "20240102000000"), ("DQ_SALES_003", False, None)}
    assert reprocess_sales(store, fixed, "20240103000000")["released"] == 0


def test_dimension_with_a_repeated_key_stops_the_batch(spark, tmp_path):
    """Two attribute rows under one channel key: the dimension is refused."""
    from strata.operators import star
    store = TableStore(spark, str(tmp_path / "lake"))
    ch = spark.createDataFrame([("SUPERETTE", "SERVICES", "MIX")], CH)
    day = spark.createDataFrame([_row("B1", " A", "WEST", "SUPERETTE", "1.00")], SALES)
    sound = star.dim_channel
    star.dim_channel = lambda gold, channels: sound(gold, channels).unionByName(sound(gold, channels))
    try:
        with pytest.raises(ValueError, match="channel_key is not unique"):
            run_batch(spark, store, day, ch, Profile(key_columns=KEY), "20240101000000", "2024-01-01 00:00:00")
    finally:
        star.dim_channel = sound
    assert not store.is_committed("consumption", "dim_channel", "20240101000000")
    assert "_table_name" in store.read("consumption", "dim_region").columns
