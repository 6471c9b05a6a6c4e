"""Unit checks of the column builders (value assertions, not just shapes)."""

import pytest
from pyspark.sql import functions as F

from strata.functions.audit import add_audit_columns
from strata.functions.clean import cast_columns, clean_string_columns
from strata.functions.hashing import add_primary_key, add_row_hash, hash_key
from strata.functions.names import standardize_column_names
from strata.functions import rules as R


def test_standardize_generic(spark):
    df = spark.createDataFrame([("a", 1)], "`Column Name` string, `Another COLUMN` long")
    assert standardize_column_names(df, "generic").columns == ["column_name", "another_column"]


def test_standardize_rules_differ_on_currency(spark):
    df = spark.createDataFrame([("1", "x")], "`$ Volume` string, `Btlr_Org_LVL_C_Desc` string")
    assert standardize_column_names(df, "generic").columns == ["volume", "btlr_org_lvl_c_desc"]
    assert standardize_column_names(df, "currency").columns == ["dollar_volume", "btlr_org_lvl_c_desc"]


def test_standardize_collision_raises(spark):
    df = spark.createDataFrame([("1", "x")], "`a b` string, `a_b` string")
    with pytest.raises(ValueError):
        standardize_column_names(df, "currency")


def test_audit_columns(spark):
    df = spark.createDataFrame([("x", 1)], "col1 string, col2 long")
    out = add_audit_columns(df, "/landing/f.csv", None, "bronze", "20240101120000", "2024-01-01 12:00:00")
    r = out.first()
    assert r["_batch_id"] == "20240101120000" and r["_layer"] == "bronze"
    assert r["_source_file"] == "f.csv" and r["_source_path"] == "/landing/f.csv"
    assert str(r["_ingestion_date"]) == "2024-01-01"


def test_primary_key_equal_rows_equal(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "col1 string, col2 long")
    rows = add_primary_key(df, ["col1", "col2"]).collect()
    assert rows[0]["_pk"] == rows[2]["_pk"] != rows[1]["_pk"]
    assert len(rows[0]["_pk"]) == 32


def test_primary_key_missing_column(spark):
    df = spark.createDataFrame([("a", 1)], "col1 string, col2 long")
    with pytest.raises(ValueError):
        add_primary_key(df, ["col1", "nope"])


def test_row_hash_forms(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "col1 string, col2 long")
    rows = add_row_hash(df).collect()
    assert rows[0]["_row_hash"] == rows[2]["_row_hash"] != rows[1]["_row_hash"]
    assert len(rows[0]["_row_hash"]) == 64
    # token form: null and "y" do not collide by position
    d2 = spark.createDataFrame([(None, "y"), ("y", None)], "a string, b string")
    h = [r["_row_hash"] for r in add_row_hash(d2).collect()]
    assert h[0] != h[1]
    # skip form collides, as documented
    h = [r["_row_hash"] for r in add_row_hash(d2, form="skip").collect()]
    assert h[0] == h[1]


def test_row_hash_ignores_audit_and_trims(spark):
    df = spark.createDataFrame([(" a ", "x"), ("a", "y")], "v string, _batch_id string")
    h = [r["_row_hash"] for r in add_row_hash(df).collect()]
    assert h[0] == h[1]


def test_hash_key_stable(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    k1 = df.select(hash_key(["x", "y"])).first()[0]
    k2 = df.repartition(3).select(hash_key(["x", "y"])).first()[0]
    assert k1 == k2 and 0 <= k1 < 2 ** 60


def test_trim(spark):
    df = spark.createDataFrame([("  hello  ", 1), ("world  ", 2)], "text string, num long")
    assert [r["text"] for r in clean_string_columns(df).orderBy("num").collect()] == ["hello", "world"]
    b = spark.createDataFrame([("   ",)], "t string")
    assert clean_string_columns(b, blank_to_null=True).first()["t"] is None


def test_cast_bad_values_become_null(spark):
    df = spark.createDataFrame([("123", "2024-01-15"), ("x", "bad")], "value string, date string")
    out = cast_columns(df, {"value": "int", "date": "date", "missing": "int", "value2": "nope"})
    rows = out.collect()
    assert rows[0]["value"] == 123 and str(rows[0]["date"]) == "2024-01-15"
    assert rows[1]["value"] is None and rows[1]["date"] is None
    assert dict(out.dtypes)["value"] == "int"


def test_business_rules(spark):
    df = spark.createDataFrame([(5.0, 2.0, "a", "b"), (150.0, 3.0, "c", None), (None, 0.0, None, None)],
                               "v double, w double, s string, t string")
    out = R.apply_business_rules(df, {
        "cat": {"type": "category", "source_column": "v",
                "conditions": [{"range": [0, 100], "value": "Low"}, {"range": [100, None], "value": "High"}]},
        "ratio": {"type": "calculation", "calc_type": "divide", "source_columns": ["v", "w"]},
        "both": {"type": "derived", "source_columns": ["s", "t"]},
    }).collect()
    assert [r["cat"] for r in out] == ["Low", "High", "Unknown"]
    assert out[0]["ratio"] == 2.5 and out[2]["ratio"] is None
    assert [r["both"] for r in out] == ["a_b", "c", ""]


def test_gold_rules_null_handling(spark):
    df = spark.createDataFrame([(None, None, None)], "dollar_volume decimal(18,2), region string, month int")
    r = df.select(R.volume_category().alias("vc"), R.negative_sale().alias("neg"),
                  R.region_group().alias("rg"), R.sales_quarter().alias("q"), R.country().alias("c")).first()
    assert (r["vc"], r["neg"], r["rg"], r["q"], r["c"]) == ("LOW", False, "OTHER", "Q4", "USA")
    d2 = spark.createDataFrame([("canada", 1500.0, 5)], "region string, dollar_volume double, month int")
    r = d2.select(R.region_group().alias("rg"), R.country().alias("c"), R.volume_category().alias("vc"),
                  R.sales_quarter().alias("q")).first()
    assert (r["rg"], r["c"], r["vc"], r["q"]) == ("CANADA", "CANADA", "HIGH", "Q2")


def test_time_dimensions(spark):
    df = spark.createDataFrame([("2024-05-17",)], "d string").select(F.to_date("d").alias("d"))
    r = R.add_time_dimensions(df, "d", "sale").first()
    assert (r["sale_year"], r["sale_month"], r["sale_quarter"]) == (2024, 5, 2)
