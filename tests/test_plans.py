"""Plan-shape guards: built-ins only, keys by projection, pushdown, ties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from strata.plans import marts
from strata.plans.registry import QUERIES
from strata.plans.domain import DriverDomain

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q41_top_trade_groups", "c5_merge_stats", "d3_d4_sales_rules",
                                  "b14_gold_sales_rules", "a1_business_metrics"])
def test_no_python_in_plans(spark, name):
    p = _plan(E.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert bad not in p


def test_fact_needs_no_shuffle(spark):
    from strata.operators.materialize import materialize
    from strata.operators.star import fact_sales
    gold = materialize(DriverDomain(spark, SF).gold, "gold")
    assert "Exchange" not in _plan(fact_sales(gold))


@pytest.mark.parametrize("name", ["q41_top_trade_groups", "q42_brand_month", "q43_brand_region_ranks",
                                  "q44_sql_region_trade_group", "m6_fact_sales", "a16_layer_totals"])
def test_building_a_query_starts_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"building-{name}", name)
    try:
        QUERIES[name](spark, SF)
        assert tracker.getJobIdsForGroup(f"building-{name}") == []
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_latest_per_key_shuffles_no_unused_column(spark):
    plan = _plan(QUERIES["c3_latest_per_key"](spark, SF))
    assert "WindowGroupLimit" in plan
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert exchanges
    window = plan[:plan.index("WindowGroupLimit")]
    assert "pkg_cat_desc" not in window and "chnl_group" not in window


def test_matrix_keeps_groups_outside_the_list(spark):
    gold = spark.createDataFrame([("R", "A", 1), ("R", "NEW", 2), ("R", None, 4)],
                                 "region string, trade_group_desc string, dollar_volume int")
    r = marts.region_group_matrix(gold, ["A", "NO_GROUP"]).first()
    assert (int(r["A"]), int(r["NO_GROUP"]), int(r["OTHER"])) == (1, 4, 2)


def test_group_metrics_leave_the_rows_in_place(spark):
    """The group table is small: no exchange between the row side and the join."""
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.lit(1).alias("v"))
    from strata.operators.metrics import add_business_metrics
    plan = _plan(add_business_metrics(rows, "v", ["g"]))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_scan_pruning_and_pushdown(spark):
    d = DriverDomain(spark, SF)
    from strata.sources.driver import sales_landing
    df = sales_landing(spark, SF, date_from="1998-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    # line items: only the six needed columns are read
    assert "l_extendedprice" in plan
    for unused in ("l_tax", "l_discount", "l_quantity", "o_totalprice", "c_acctbal", "p_retailprice"):
        assert unused not in plan
    assert d.sf_dir == SF


def test_rank_ties_broken_by_name(spark):
    fact = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 5)],
                                 "region_key long, channel_key long, dollar_volume int")
    dr = spark.createDataFrame([(1, "R")], "region_key long, region_name string")
    dc = spark.createDataFrame([(1, "B"), (2, "A"), (3, "C")], "channel_key long, trade_group_desc string")
    out = [(r["trade_group_desc"], r["rank"]) for r in
           marts.top_trade_groups(fact, dr, dc, None).orderBy("rank").collect()]
    assert out == [("A", 1), ("B", 2), ("C", 3)]


def test_mart_totals_equal_fact_totals(spark):
    s = DriverDomain(spark, SF).star
    fact_sum = s["fact_sales"].agg(F.sum("dollar_volume")).first()[0]
    m = marts.brand_month(s["fact_sales"], s["dim_product"], s["dim_date"])
    assert m.agg(F.sum("total_dollar_volume")).first()[0] == fact_sum
    assert m.agg(F.sum("transaction_count")).first()[0] == s["fact_sales"].count()


def test_bounded_broadcast_checks_size(spark):
    from strata.operators.joins import bounded_broadcast, is_small
    small = spark.createDataFrame([(1, "a")], "k int, v string")
    big = spark.range(5000).withColumnRenamed("id", "k")
    assert is_small(small) and not is_small(big, max_rows=100, max_bytes=10)
    assert not is_small(big, max_rows=100, max_bytes=10, count=False)
    j1 = big.join(bounded_broadcast(small), "k")
    j2 = small.join(bounded_broadcast(big, max_rows=100, max_bytes=10), "k")
    assert "ResolvedHint (strategy=broadcast)" in j1._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in j2._jdf.queryExecution().analyzed().toString()


def test_no_row_caps_in_registered_queries(spark):
    """Every registered query runs over whole tables: the only limit is the
    top-k report itself."""
    capped = []
    for name, fn in QUERIES.items():
        plan = fn(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        if "GlobalLimit" in plan or "LocalLimit" in plan or "Sample" in plan:
            capped.append(name)
    assert capped == ["q45_top_brands"]
