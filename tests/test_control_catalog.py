"""Run control and governance tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strata.operators import catalog as C
from strata.operators import control as R
from strata.operators.control import PROCESS_SCHEMA


def _rec(spark, rows):
    base = dt.datetime(2024, 1, 1)
    out = []
    for i, (layer, table, status, secs, read, quar) in enumerate(rows):
        st = base + dt.timedelta(hours=i)
        out.append((f"p{i}", f"2024010{i % 9 + 1}000000", layer, table, status, st,
                    st + dt.timedelta(seconds=secs), Decimal(str(secs)), read, read - quar, quar, 0,
                    None, None, "app", None, st))
    return spark.createDataFrame(out, PROCESS_SCHEMA)


def test_process_control_track(spark):
    recorded = []
    pc = R.ProcessControl(spark, sink=recorded.append)
    with pc.track("b1", "silver", "sales") as run:
        df, obs = R.observed(spark.range(10))
        df.write.format("noop").mode("overwrite").save()
        run["records_written"] = obs.get["rows"]
    with pytest.raises(RuntimeError):
        with pc.track("b1", "gold", "sales"):
            raise RuntimeError("boom")
    rows = [d.first() for d in recorded]
    assert [r["status"] for r in rows] == ["RUNNING", "SUCCESS", "RUNNING", "FAILED"]
    assert rows[1]["records_written"] == 10 and "boom" in rows[3]["error_message"]
    assert rows[1]["end_timestamp"] >= rows[1]["start_timestamp"]
    allrows = recorded[0]
    for d in recorded[1:]:
        allrows = allrows.unionByName(d)
    assert sorted(r["status"] for r in R.latest_runs(allrows).collect()) == ["FAILED", "SUCCESS"]
    pc.start("b2", "gold", "sales")  # driver "dies" here
    allrows = allrows.unionByName(recorded[-1])
    assert R.stuck_runs(allrows, 0, now="2999-01-01 00:00:00").count() == 1
    with pytest.raises(ValueError):
        pc.end("missing")


def test_history_and_last_success(spark):
    c = _rec(spark, [("silver", "sales", "SUCCESS", 10, 100, 0), ("silver", "sales", "FAILED", 5, 100, 0),
                     ("silver", "sales", "SUCCESS", 12, 100, 0), ("gold", "sales", "SUCCESS", 1, 1, 0)])
    assert R.last_successful_batch(c, "silver", "sales").first()["batch_id"] == "20240103000000"
    assert R.last_successful_batch(c, "bronze", "x").count() == 0
    h = R.process_history(c, "silver", "sales", limit=2).collect()
    assert [r["process_id"] for r in h] == ["p2", "p1"]
    c.createOrReplaceTempView("process_control")
    assert R.recent_executions(spark, n=3).count() == 3


def test_alerts(spark):
    c = _rec(spark, [("silver", "s", "SUCCESS", 10, 100, 1), ("silver", "s", "SUCCESS", 10, 100, 1),
                     ("silver", "s", "SUCCESS", 50, 100, 10), ("gold", "s", "SUCCESS", 4000, 10, 0),
                     ("gold", "t", "FAILED", 1, 1, 0)])
    q = spark.createDataFrame([(i % 2 == 0, False, dt.datetime(2024, 1, 1, 10, i % 60)) for i in range(150)],
                              "is_known_rule boolean, reprocessed boolean, created_at timestamp")
    kinds = sorted(r["alert"] for r in C.alerts(c, q, now="2024-01-01 06:00:00").collect())
    assert kinds == ["quarantine_burst", "quarantine_rate", "run_failed", "slower_than_history",
                     "stage_too_long", "unknown_errors"]
    stale = {r["subject"] for r in C.alerts(c, q, now="2024-01-02 04:00:00").collect()
             if r["alert"] == "stale_table"}
    assert stale == {"silver.s"}
    d = C.dashboard_series(c)
    assert {r["status"]: r["runs"] for r in d["runs_by_status"].collect()} == {"SUCCESS": 4, "FAILED": 1}


def test_catalog_and_lineage(spark):
    t = {"fact_sales": ("consumption", spark.createDataFrame([(1, "x")], "k int, _layer string"))}
    cat = C.catalog_rows(spark, t, owners={"fact_sales": "sales-team"}).collect()
    assert [(r["column_name"], r["is_audit"], r["classification"]) for r in cat] == [
        ("k", False, "INTERNAL"), ("_layer", True, "INTERNAL")]
    C.lineage_edges(spark).createOrReplaceTempView("lineage")
    up = {r["ancestor"]: r["depth"] for r in C.lineage_upstream(spark, "lineage", "consumption.fact_sales").collect()}
    assert up["gold.beverage_sales"] == 1 and up["landing.beverage_sales"] == 4
    assert up["landing.beverage_channel_group"] == 5


def test_lineage_of_any_depth_and_with_a_cycle(spark):
    edges = [(f"t{i + 1}", f"t{i}", "") for i in range(40)] + [("t0", "t40", "cycle")]
    C.lineage_edges(spark, edges).createOrReplaceTempView("deep")
    up = {r["ancestor"]: r["depth"] for r in C.lineage_upstream(spark, "deep", "t0").collect()}
    assert len(up) == 41 and up["t40"] == 40 and up["t0"] == 41


def test_errors_are_stored_whole(spark):
    recorded = []
    with pytest.raises(RuntimeError):
        with R.ProcessControl(spark, sink=recorded.append).track("b", "gold", "t"):
            raise RuntimeError("x" * 50_000)
    assert len(recorded[-1].first()["error_message"]) == 50_000


def test_missing_metrics_are_zero_only_if_nothing_was_written():
    class Broken:
        @property
        def get(self):
            raise RuntimeError("no metrics")
    assert R.observed_values(Broken(), lambda: 0)["rows"] == 0
    for written in (None, lambda: 3):
        with pytest.raises(RuntimeError):
            R.observed_values(Broken(), written)


def test_retention_and_dq_summary(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2023-06-01",), ("2023-12-01",), ("2010-01-01",)], "d string").select(
        F.to_date("d").alias("_ingestion_date"))
    lab = [r["_retention"] for r in C.retention_split(df, "bronze", today="2024-03-01").collect()]
    assert lab == ["keep", "archive", "keep", "drop"]
    res = spark.createDataFrame([(True,), (False,), (True,)], "passed boolean")
    assert {r["passed"]: r["tests"] for r in C.dq_summary(res).collect()} == {True: 2, False: 1}


# ---- governance as actions and lookups ------------------------------------------------

def test_policies_by_precedence():
    p = {"exact": {"gold.a_b": 1}, "prefix": {"gold.a": 2, "gold.a_": 3}, "layer": {"gold": 4}, "default": 5}
    assert [C.resolve(p, *n) for n in (("gold", "a_b"), ("gold", "a_c"), ("gold", "ab"), ("gold", "x"), ("silver", "x"))] == [1, 3, 2, 4, 5]


def test_every_table_of_the_store_is_classified_and_owned(spark):
    frame = spark.createDataFrame([(1,)], "k int")
    names = {t for edge in C.LINEAGE for t in edge[:2]} | {"control.process_control", "control.quarantine", "control.reprocess_intents"}
    tables = {n.split(".")[1] + "@" + n.split(".")[0]: n for n in names}
    got = {}
    for layer, table in (n.split(".") for n in tables.values()):
        r = C.catalog_rows(spark, {table: (layer, frame)}).first()
        got[f"{layer}.{table}"] = (r["classification"], r["owner"], r["business_owner"], tuple(r["tags"]))
    assert got["consumption.dim_date"] == ("PUBLIC", "Data Engineering", "BI Team", ("dimension",))
    assert got["consumption.dim_product"][0] == "INTERNAL" and got["consumption.fact_sales"][3] == ("fact",)
    assert got["consumption.agg_sales_brand_month"] == ("INTERNAL", "Data Engineering", "BI Team", ("aggregate",))
    assert got["gold.beverage_sales"] == ("INTERNAL", "Data Engineering", "Analytics Team", ("gold",))
    assert got["control.quarantine"] == ("CONFIDENTIAL", "Data Engineering Team", None, ("control",))
    assert got["control.reprocess_intents"][0] == "CONFIDENTIAL"
    assert got["landing.beverage_sales"] == ("INTERNAL", "Data Engineering Team", None, ("landing",))
    assert all(c and o for c, o, _, _ in got.values())


def test_column_lineage_of_the_layers(spark):
    """Edges read from the plans, against a list written by hand."""
    from strata.plans.layers import Profile, build_layers
    from strata.plans.marts import brand_month_of
    from test_batch import CH, SALES, _row
    day = spark.createDataFrame([_row("B1", " A", "WEST", "SUPERETTE", "10.00")], SALES)
    ch = spark.createDataFrame([("SUPERETTE", "SERVICES", "MIX")], CH)
    prof = Profile(key_columns=["ce_brand_flvr", "region"])
    layers = build_layers(day, ch, prof, "b1")
    edges = lambda df, name, **src: {(r["source_table"], r["source_column"], r["target_column"])
                                     for r in C.column_edges(df, name, src).collect() if not r["target_column"].startswith("_")}
    gold = edges(layers.gold_sales, "gold", silver=layers.silver_sales)
    made = {"volume_category": {"dollar_volume"}, "is_negative_sale": {"dollar_volume"}, "region_group": {"region"},
            "sales_quarter": {"month"}, "is_weekend_sale": {"transaction_date"}, "country": {"region"}}
    for target, sources in made.items():
        assert {c for _, c, t in gold if t == target} == sources, target
    assert {t for _, c, t in gold if c == t} >= {"brand_nm", "dollar_volume", "trade_group_desc", "year"}
    silver = edges(layers.silver_sales, "silver", sales=layers.bronze_sales, channels=layers.bronze_channels)
    assert ("channels", "trade_group_desc", "trade_group_desc") in silver and ("sales", "date", "transaction_date") in silver
    assert {c for _, c, t in silver if t == "year_month"} == {"year", "month"}
    assert {c for _, c, t in silver if t == "sales_id"} == {"_pk"}
    fact = edges(layers.star(prof)["fact_sales"], "fact", gold=layers.gold_sales)
    keys = {"date_key": {"transaction_date"}, "region_key": {"region"}, "channel_key": {"chnl_group", "trade_chnl_desc"},
            "product_key": {"ce_brand_flvr", "brand_nm", "pkg_cat", "pkg_cat_desc", "tsr_pckg_nm"}}
    for target, sources in keys.items():
        assert {c for _, c, t in fact if t == target} == sources, target
    mart = edges(brand_month_of(layers.gold_sales), "mart", gold=layers.gold_sales)
    assert ("gold", "dollar_volume", "total_dollar_volume") in mart and ("gold", "transaction_date", "year_month") in mart
    both = layers.silver_sales.select("region").unionByName(layers.silver_sales.select(F.col("brand_nm").alias("region")))
    assert {c for _, c, _ in edges(both, "u", silver=layers.silver_sales)} == {"region", "brand_nm"}


def test_lineage_walk_follows_the_ancestors_only(spark):
    """Far more tables hang below than above: none of them is visited."""
    edges = [("a", "t", ""), ("b", "a", "")] + [("t", f"d{i}", "") for i in range(300)] + [(f"x{i}", f"y{i}", "") for i in range(300)]
    C.lineage_edges(spark, edges).createOrReplaceTempView("wide")
    assert {r["ancestor"]: r["depth"] for r in C.lineage_upstream(spark, "wide", "t").collect()} == {"a": 1, "b": 2}
    assert C.lineage_upstream(spark, "wide", "unknown").collect() == []


def test_retention_moves_and_drops_folders(spark, tmp_path):
    from strata.sources.tables import TableStore
    store = TableStore(spark, str(tmp_path / "lake"))
    days = ["2024-03-01", "2023-06-01", "2023-05-01", "2010-01-01"]
    store.append(spark.createDataFrame([(d, i) for i, d in enumerate(days)], "d string, n int").select(
        F.to_date("d").alias("_ingestion_date"), "n"), "bronze", "t", ["_ingestion_date"])
    assert dict(C.retention_plan(store, "bronze", "t", today="2024-03-02")) == {
        "_ingestion_date=2024-03-01": "keep", "_ingestion_date=2023-06-01": "archive", "_ingestion_date=2023-05-01": "archive",
        "_ingestion_date=2010-01-01": "drop"}
    done = C.apply_retention(store, "bronze", "t", today="2024-03-02")
    assert (len(done["keep"]), len(done["archive"]), len(done["drop"])) == (1, 2, 1)
    assert [r["n"] for r in store.read("bronze", "t").collect()] == [0]
    moved = spark.read.parquet(str(tmp_path / "lake/archive/bronze/t"))
    assert sorted(r["n"] for r in moved.collect()) == [1, 2]
    assert not (tmp_path / "lake/bronze/t/_ingestion_date=2010-01-01").exists()
    again = C.apply_retention(store, "bronze", "t", today="2024-03-02")
    assert again["archive"] == [] and again["drop"] == []
    for i in range(5):  # versions of a current table go by number
        store.replace(spark.createDataFrame([(i,)], "n int"), "gold", "c", version=str(i))
    assert C.apply_retention(store, "gold", "c", keep_versions=2)["versions"] == ["0", "1", "2"]


def test_partitions_leave_the_newest_version_without_a_scan(spark, tmp_path):
    from strata.sources.tables import TableStore
    store = TableStore(spark, str(tmp_path / "lake"))
    store.replace(spark.createDataFrame([(y, y) for y in (2001, 2002, 2003)], "year int, n int"), "gold", "t", version="1", partition_by=["year"])
    assert store.drop_partitions("gold", "t", ["year=2001", "year=1990"], "2") == "2"
    assert sorted(r["n"] for r in store.read("gold", "t").collect()) == [2002, 2003] and store.read("gold", "t", "1").count() == 3
    assert store.drop_partitions("gold", "t", ["year=1990"]) is None


def test_event_alerts(spark):
    rows = [("e", f"2024-01-01 {h:02d}:{m:02d}:00") for h, n in ((0, 2), (1, 2), (3, 9), (4, 3)) for m in range(n)] + [("e", None), (None, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "event_type string, t string").select("event_type", F.to_timestamp("t").alias("ts"))
    got = {(r["alert"], r["subject"], r["hour"].hour, r["value"], r["bound"]) for r in C.event_alerts(events, "event_type", burst=8).collect()}
    assert got == {("hourly_burst", "e", 3, 9, 8.0), ("above_history", "e", 3, 9, 4.0)}
    assert C.event_alerts(events.filter("false"), "event_type").collect() == []


def test_landing_that_changed_is_refused_or_reloaded(spark, tmp_path):
    import os

    from strata.plans.batch import LandingChanged, checked_landing
    from strata.sources.files import changed_files, landing_files
    from strata.sources.tables import TableStore
    store = TableStore(spark, str(tmp_path / "lake"))
    land = tmp_path / "landing"
    land.mkdir()
    (land / "a.csv").write_text("k\n1\n")
    (land / "b.csv").write_text("k\n2\n")
    now = lambda: landing_files(spark.read.option("header", True).schema("k string").csv(str(land)), "sales", "b1")
    assert checked_landing(store, now(), "b1", "refuse") == "b1" and checked_landing(store, now(), "b1", "refuse") == "b1"
    assert checked_landing(store, now(), "b10", "refuse") == "b10"
    (land / "a.csv").write_text("k\n100\n")
    os.remove(land / "b.csv")
    (land / "c.csv").write_text("k\n3\n")
    changes = {r["path"].rsplit("/", 1)[1]: r["change"] for r in changed_files(
        store.read("control", "landing_files").filter("batch_id = 'b1'"), now()).collect()}
    assert changes == {"a.csv": "changed", "b.csv": "removed", "c.csv": "added"}
    with pytest.raises(LandingChanged, match="a.csv was changed"):
        checked_landing(store, now(), "b1", "refuse")
    assert checked_landing(store, now(), "b1", "reload") == "b1.r1" and checked_landing(store, now(), "b1", "refuse") == "b1.r1"
    (land / "c.csv").write_text("k\n33\n")
    assert checked_landing(store, now(), "b1", "reload") == "b1.r2"
    frames = spark.createDataFrame([(1,)], "k int")  # a landing without files has no ledger
    assert checked_landing(store, landing_files(frames, "sales", "b3"), "b3", "refuse") == "b3"


def test_runs_of_the_newest_batch(spark):
    c = _rec(spark, [("silver", "sales", "SUCCESS", 10, 100, 1), ("gold", "sales", "SUCCESS", 5, 90, 2)])
    c.createOrReplaceTempView("control_runs")
    assert [tuple(r)[1:] for r in R.latest_batch_runs(spark, "control_runs").collect()] == [(90, 88, 2)]
