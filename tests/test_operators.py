"""Operators: quality split, metrics, fact aggregation, dimensions, merge."""

import pytest
from pyspark.sql import functions as F

from strata.operators import catalog as CAT, cdc, metrics as M, quality as Q, star as S
from strata.operators.joins import input_bytes, partitions_for
from strata.operators.materialize import materialize, stored_place


def test_not_null_split(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", None)], "name string, value long")
    valid, bad = Q.apply_data_quality_rules(df, [{"column": "name", "rule": "not_null"},
                                                 {"column": "value", "rule": "not_null"}])
    assert valid.count() == 1 and bad.count() == 2
    errs = sorted(r["_validation_errors"] for r in bad.collect())
    assert errs == ["name:null", "value:null"]
    assert "_quarantine_timestamp" in bad.columns and "_violations" not in valid.columns


def test_positive_split_and_null_is_valid(spark):
    df = spark.createDataFrame([(100,), (-50,), (0,), (None,)], "amount long")
    valid, bad = Q.apply_data_quality_rules(df, [{"column": "amount", "rule": "positive"}])
    assert sorted(r["amount"] for r in bad.collect()) == [-50, 0]
    assert valid.count() == 2  # 100 and null


def test_in_list_regex_labels(spark):
    df = spark.createDataFrame([("A", "x1"), ("Z", "11"), (None, None)], "c string, p string")
    valid, bad = Q.apply_data_quality_rules(df, [
        {"column": "c", "rule": "in_list", "values": ["A", "B"]},
        {"column": "p", "rule": "regex", "pattern": "^[a-z][0-9]$"}])
    assert valid.count() == 2
    assert bad.first()["_validation_errors"] == "c:not_in_list; p:regex_mismatch"


def test_unknown_rule_column(spark):
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(ValueError):
        Q.apply_data_quality_rules(df, [{"column": "b", "rule": "not_null"}])
    v, b = Q.apply_data_quality_rules(df, [{"column": "b", "rule": "not_null"}], strict=False)
    assert v.count() == 1 and b.count() == 0


def test_valid_plus_quarantine_is_input(spark):
    df = spark.range(1000).select((F.col("id") % 7 - 3).alias("v"), F.when(F.col("id") % 5 == 0, None)
                                  .otherwise(F.col("id")).alias("w"))
    v, b = Q.apply_data_quality_rules(df, [{"column": "v", "rule": "positive"},
                                           {"column": "w", "rule": "not_null"}])
    assert v.count() + b.count() == 1000


def test_quarantine_json_keeps_nulls_and_replays(spark):
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    q = Q.quarantine_records(df, "src", "tgt", "b1", "E1", "desc", batch_ts="2024-01-01 00:00:00")
    r = q.first()
    assert '"y":null' in r["record_data"] and r["reprocessed"] is False and len(q.columns) == 14
    back = Q.replay(q, df.schema).first()
    assert (back["x"], back["y"], back["z"]) == ("a", None, 3)
    marked = Q.mark_as_reprocessed(q, q.select("quarantine_id"), "b2")
    m = marked.first()
    assert m["reprocessed"] is True and m["reprocess_batch_id"] == "b2"
    assert Q.pending_reprocess(marked).count() == 0 and Q.unknown_errors(q).count() == 0


def test_sales_dq_blank_is_null_and_first_match(spark):
    df = spark.createDataFrame([("  ", "X", "R"), (None, None, "R"), (" b ", "   ", "R"), ("c", "Y", " R ")],
                               "brand_nm string, trade_chnl_desc string, region string")
    out = Q.apply_dq_sales(df, declared=False).collect()
    assert [r["_dq_code"] for r in out] == ["DQ_SALES_001", "DQ_SALES_001", "DQ_SALES_002", None]
    assert out[3]["region"] == "R"


def test_channel_checks(spark):
    df = spark.createDataFrame([("A", "GROCERY", "MIX"), ("A", "GROCERY", "MIX"), ("B", None, "MIX"),
                                ("C", "OTHER", "WATER"), ("D", "OTHER", "ALCOHOLIC")],
                               "trade_chnl_desc string, trade_group_desc string, trade_type_desc string")
    codes = sorted((r["trade_chnl_desc"], r["_dq_code"] or "") for r in Q.channel_checks(df).collect())
    assert codes == [("A", "DQ_CHANNEL_003"), ("A", "DQ_CHANNEL_003"), ("B", "DQ_CHANNEL_002"),
                     ("C", "DQ_CHANNEL_004"), ("D", "")]


def test_business_metrics(spark, sample_sales):
    out = M.add_business_metrics(sample_sales, "hl_qty", ["btlr_org_lvl_c"])
    for c in ("hl_qty_total", "hl_qty_avg", "hl_qty_max", "hl_qty_min", "record_count"):
        assert c in out.columns
    a = out.filter(F.col("btlr_org_lvl_c") == "REGION_A").first()
    assert (a["hl_qty_total"], a["hl_qty_avg"], a["record_count"]) == (300.0, 150.0, 2)


def test_business_metrics_null_group_gets_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("g", 3.0)], "g string, v double")
    out = {r["g"]: r["v_total"] for r in M.add_business_metrics(df, "v", ["g"]).collect()}
    assert out == {None: None, "g": 3.0}


def test_fact_table(spark, sample_sales):
    f = M.create_fact_table(sample_sales, ["btlr_org_lvl_c", "month_id"], ["hl_qty"])
    assert f.count() == 2 and "hl_qty_sum" in f.columns
    f2 = M.create_fact_table(sample_sales, ["btlr_org_lvl_c"], [], {"hl_qty": "avg", "transaction_count": "max"})
    assert set(f2.columns) == {"btlr_org_lvl_c", "hl_qty_avg", "transaction_count_max"}
    with pytest.raises(ValueError):
        M.create_fact_table(sample_sales, ["btlr_org_lvl_c"], [], {"hl_qty": "median"})


def test_dimension_table(spark, sample_sales):
    d = S.create_dimension_table(sample_sales, "brand_nm", [], "brand_sk")
    assert d.count() == 3
    for c in ("brand_sk", "_valid_from", "_valid_to", "_is_current"):
        assert c in d.columns
    assert d.select("brand_sk").distinct().count() == 3
    assert S.check_unique(d, "brand_sk").count() == 0


def test_lookup_key_equality_semantics(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    r = df.select(S.lookup_key(["x", "y"]).alias("k"), S.lookup_key(["x", "y"], null_safe=True).alias("n")).collect()
    assert r[0]["k"] is None and r[0]["n"] is not None and r[1]["k"] == r[1]["n"]


def _bronze(spark, rows, ts):
    df = spark.createDataFrame(rows, "_pk string, v string, _row_hash string")
    return df.withColumn("_ingestion_timestamp", F.to_timestamp(F.lit(ts)))


def test_merge_actions_and_idempotence(spark):
    tgt = _bronze(spark, [("k1", "a", "h1"), ("k2", "b", "h2"), ("k3", "c", "h3")], "2024-01-01 00:00:00")
    src = _bronze(spark, [("k2", "b", "h2"), ("k3", "C", "h3x"), ("k4", "d", "h4")], "2024-01-02 00:00:00")
    m = cdc.merge(src, tgt)
    acts = {r["_pk"]: r["_action"] for r in m.collect()}
    assert acts == {"k1": "keep", "k2": "unchanged", "k3": "update", "k4": "insert"}
    new = cdc.merged_table(m)
    assert {r["_pk"]: r["v"] for r in new.collect()} == {"k1": "a", "k2": "b", "k3": "C", "k4": "d"}
    again = {r["_action"]: r["records"] for r in cdc.merge_stats(cdc.merge(src, new)).collect()}
    assert again.get("insert", 0) == 0 and again.get("update", 0) == 0


def test_merge_stale_source_keeps_target(spark):
    tgt = _bronze(spark, [("k1", "new", "h2")], "2024-01-03 00:00:00")
    src = _bronze(spark, [("k1", "old", "h1")], "2024-01-01 00:00:00")
    r = cdc.merge(src, tgt).first()
    assert (r["_action"], r["v"]) == ("stale", "new")


def test_merge_schema_drift_null_fill(spark):
    tgt = _bronze(spark, [("k1", "a", "h1")], "2024-01-01 00:00:00")
    src = _bronze(spark, [("k2", "b", "h2")], "2024-01-02 00:00:00").withColumn("extra", F.lit("e"))
    out = {r["_pk"]: r["extra"] for r in cdc.merged_table(cdc.merge(src, tgt)).collect()}
    assert out == {"k1": None, "k2": "e"}


def test_latest_per_key_deterministic_under_partitioning(spark):
    rows = [("k", str(i), f"h{i:03d}") for i in range(50)]
    df = _bronze(spark, rows, "2024-01-01 00:00:00")
    a = cdc.latest_per_key(df).first()
    b = cdc.latest_per_key(df.repartition(7)).first()
    assert a == b and a["_row_hash"] == "h049"


def test_key_report(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    r = cdc.key_report(df, "k").first()
    assert (r["total_rows"], r["distinct_keys"], r["duplicate_rows"]) == (3, 2, 1)


def test_union_form_matches_one_join_on_unique_keys(spark):
    tgt = _bronze(spark, [("k1", "a", "h1"), ("k2", "b", "h2")], "2024-01-01 00:00:00")
    src = _bronze(spark, [("k2", "B", "h2x"), ("k3", "c", "h3")], "2024-01-02 00:00:00")
    u = sorted((r["_pk"], r["v"]) for r in cdc.merge_union_form(src, tgt).collect())
    j = sorted((r["_pk"], r["v"]) for r in cdc.merged_table(cdc.merge(src, tgt)).collect())
    assert u == j


def test_profiles(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (-3, None, None)], "a int, b double, s string")
    p = {r["column_name"]: r for r in M.analyze_table(df, "t").collect()}
    assert p["a"]["row_count"] == 2 and p["a"]["column_count"] == 3 and float(p["a"]["sum_value"]) == -2
    n = {r["column_name"]: r for r in M.null_negative_counts(df).collect()}
    assert (n["a"]["negative_count"], n["b"]["null_count"], n["s"]["negative_count"]) == (1, 1, None)
    f = {(r["attribute"], r["value"]): r["rows"] for r in M.category_frequencies(df, ["s"]).collect()}
    assert f == {("s", "x"): 1, ("s", None): 1}


def test_merge_null_keys_on_both_sides(spark):
    """A null key matches nothing: target rows stay, source rows are inserted."""
    tgt = _bronze(spark, [(None, "old", "h0"), ("k1", "a", "h1")], "2024-01-01 00:00:00")
    src = _bronze(spark, [(None, "n1", "h8"), (None, "n2", "h9"), ("k1", "A", "h1x")], "2024-01-02 00:00:00")
    out = sorted((r["_pk"] or "", r["v"], r["_action"]) for r in cdc.merge(src, tgt).collect())
    assert out == [("", "n1", "insert"), ("", "n2", "insert"), ("", "old", "keep"), ("k1", "A", "update")]


def test_latest_per_key_needs_an_order(spark):
    with pytest.raises(ValueError):
        cdc.latest_per_key(spark.createDataFrame([("k", 1)], "_pk string, v int"))


def test_merge_all_actions(spark):
    tgt = _bronze(spark, [(f"k{i}", str(i), f"h{i}") for i in range(40)], "2024-01-01 00:00:00")
    src = _bronze(spark, [(f"k{i}", str(i) + ("x" if i % 3 == 0 else ""), f"h{i}" + ("x" if i % 3 == 0 else ""))
                          for i in range(30, 50)], "2024-01-02 00:00:00")
    assert cdc.merge(src, tgt).count() == 50
    acts = {r["_action"]: r["records"] for r in cdc.merge_stats(cdc.merge(src, tgt)).collect()}
    assert acts == {"keep": 30, "unchanged": 6, "update": 4, "insert": 10}


def test_hot_key_third_of_rows(spark):
    """One key holds a third of the rows: results stay whole and exact."""
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("_pk"),
        F.col("id").cast("string").alias("v"),
        F.format_string("h%05d", "id").alias("_row_hash"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("_ingestion_timestamp"))
    latest = cdc.latest_per_key(df)
    assert latest.count() == 1 + 2 * n // 3
    assert latest.filter(F.col("_pk") == "hot").first()["v"] == str(n - 3)  # greatest hash among hot rows
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # each map task cuts the hot key to one row
    m = M.add_business_metrics(df.withColumn("x", F.lit(1)), "x", ["_pk"])
    assert m.filter(F.col("_pk") == "hot").select("record_count").distinct().first()[0] == n // 3
    assert m.count() == n


def test_dq_metrics_with_freshness(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), (None, 2, "2024-01-01 06:00:00"),
                                ("c", 2, "2024-01-01 12:00:00")], "name string, k int, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    out = {(r["metric"], r["column_name"]): (r["value"], r["passed"]) for r in
           Q.dq_metrics(df, "t", ["name"], "k", F.col("k") > 1, "ts", now="2024-01-02 00:00:00").collect()}
    assert out[("completeness", "name")] == (round(2 / 3, 6), False)
    assert out[("uniqueness", "k")] == (round(2 / 3, 6), False)
    assert out[("validity", None)] == (round(2 / 3, 6), False)
    assert out[("freshness_hours", "ts")] == (12.0, True)


def test_rule_descriptions(spark):
    df = spark.createDataFrame([("DQ_SALES_001",), ("DQ_SALES_008",), ("X",)], "c string")
    d = [r[0] for r in df.select(Q.rule_description(F.col("c"))).collect()]
    assert d == ["brand_nm must not be null", "trade channel must exist in the channel master", "unknown rule"]


def test_q22_history_replay_keeps_newest_version(spark):
    """Silver holds v2; the whole bronze history (v1 and v2) is merged again:
    the newest load wins, silver never falls back to v1."""
    v1 = _bronze(spark, [("k", "v1", "h1")], "2024-01-01 00:00:00")
    v2 = _bronze(spark, [("k", "v2", "h2")], "2024-01-02 00:00:00")
    silver = cdc.merged_table(cdc.merge(v2, v1))
    again = cdc.merged_table(cdc.merge(v1.unionByName(v2), silver))
    assert [r["v"] for r in again.collect()] == ["v2"]


def test_quarantine_ids_of_a_stored_table(spark):
    """Equal records of a stored table are told apart by their places, without a shuffle of records."""
    rows = spark.createDataFrame([("a", None, 3)] * 5 + [("b", "c", 4)], "x string, y string, z int").repartition(3)
    stored = materialize(rows, "rows", compression="zstd")
    q = Q.quarantine_records(stored, "src", "tgt", "b1", "E1", "desc", batch_ts="2024-01-01 00:00:00", place=stored_place())
    assert "Exchange" not in q._jdf.queryExecution().executedPlan().toString()
    assert len(q.columns) == 14 and q.select("quarantine_id").distinct().count() == 6
    assert sorted(q.select("quarantine_id").collect()) == sorted(q.repartition(2).select("quarantine_id").collect())
    assert Q.replay(q, rows.schema).drop("quarantine_id").groupBy("x").count().orderBy("x").collect() == [("a", 5), ("b", 1)]
    marked = Q.mark_as_reprocessed(q, q.filter(F.col("record_data").contains('"a"')).select("quarantine_id"), "b2")
    assert marked.filter("reprocessed").count() == 5 and marked.count() == 6


def test_marked_ids_of_any_form(spark):
    ids = ["ab" * 32, "AB" * 32, "ab" * 31, "", "é", None, "cd" * 32]
    names = [c.split()[0] for c in Q.QUARANTINE_SCHEMA.split(", ")]
    rows = [tuple(i if n == "quarantine_id" else False if n == "reprocessed" else None for n in names) for i in ids]
    marks = spark.createDataFrame([(i,) for i in [*ids[:6], *ids[:6]]], "quarantine_id string")
    got = Q.mark_as_reprocessed(spark.createDataFrame(rows, Q.QUARANTINE_SCHEMA), marks, "b2").collect()
    assert {r["quarantine_id"] for r in got if r["reprocessed"]} == {*ids[:5]} and len(got) == len(ids)


def test_partitions_follow_the_input(spark):
    stored = materialize(spark.range(100_000), "ids")
    size = input_bytes(stored)
    assert size and partitions_for(stored.filter("id > 3"), size // 20) >= 20
    assert partitions_for(stored) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) == partitions_for(stored)


def test_last_batches_without_a_sort_of_rows(spark):
    rows = [("N", "b1", "2024-01-01"), ("N", "b2", "2024-01-03"), ("N", "b1", "2024-01-02"), ("N", None, "2024-01-02"),
            ("N", "b3", None), (None, "b1", "2024-01-01"), ("S", None, "2024-01-01"), ("E", "b1", None)]
    df = spark.createDataFrame(rows, "region string, _batch_id string, t string") \
        .select("region", "_batch_id", F.col("t").cast("timestamp").alias("_ingestion_timestamp"))
    got = CAT.last_batches(df, "region")
    assert {tuple(r) for r in got.collect()} == {("N", "b2", 3), (None, "b1", 1), ("S", None, 0), ("E", None, 1)}
    plain = df.groupBy("region").agg(F.max_by("_batch_id", "_ingestion_timestamp"), F.count_distinct("_batch_id"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plain.collect()}
    lines = CAT.last_batches(df, "region")._jdf.queryExecution().executedPlan().toString().splitlines()
    rowwise = [line for line in lines if "partial_max(_ingestion_timestamp" in line]
    assert len(rowwise) == 1 and "HashAggregate" in rowwise[0]


def test_key_reports_deal_out_by_input(spark, monkeypatch):
    """Tasks follow the input, a hot key is counted in many of them, and nulls count as before."""
    asked = []
    monkeypatch.setattr(cdc, "partitions_for", lambda df, each: asked.append(each) or 37)
    hot = spark.range(0, 6000, 1, 4).select(
        F.when(F.col("id") % 3 > 0, 7).when(F.col("id") > 30, F.col("id")).alias("k"),
        F.when(F.col("id") % 2 == 0, (F.col("id") % 5).cast("string")).alias("a"), (F.col("id") % 3).alias("b"))
    plain = hot.agg(F.count(F.lit(1)), F.count_distinct("k"), F.count_distinct(F.struct("a", "b")), F.count_distinct("a")).first()
    report = cdc.key_reports(hot, {"one": "k", "two": ["a", "b"], "three": "a"})
    got = {r["key_name"]: (r["total_rows"], r["distinct_keys"], r["duplicate_rows"]) for r in report.collect()}
    assert got == {name: (6000, d, 6000 - d) for name, d in zip(("one", "two", "three"), plain[1:])}
    assert asked == [cdc.KEY_BYTES] and report._jdf.queryExecution().executedPlan().toString().count(", 37), REPARTITION_BY_NUM") >= 2
    empty = cdc.key_reports(hot.filter("b > 5"), {"one": "k", "two": ["a", "b"]})
    assert [tuple(r) for r in empty.collect()] == [("one", 0, 0, 0), ("two", 0, 0, 0)]
    assert report.columns == ["key_name", "total_rows", "distinct_keys", "duplicate_rows"]
    assert dict(report.dtypes)["total_rows"] == dict(report.dtypes)["distinct_keys"] == "bigint"
