"""Commits between writers, partition-scoped merges, partial columns, rows
without key, reprocessing that is cut off."""

import os

import pytest
from pyspark.sql import functions as F

from strata.operators.cdc import merge, merged_table
from strata.operators.materialize import materialize
from strata.plans.batch import run_batch
from strata.plans.layers import Profile
from strata.sources.tables import CommitConflict, TableStore

from test_batch import CH, KEY, SALES, _row


def rows(spark, keys, value, ts="2024-01-01 00:00:00"):
    return spark.createDataFrame([(k, f"{value}{k}", f"{value}{k}") for k in keys], "_pk string, _row_hash string, v string") \
        .withColumn("_ingestion_timestamp", F.to_timestamp(F.lit(ts)))


# ---- commits ---------------------------------------------------------------------

def test_two_interleaved_writers_keep_both(spark, tmp_path):
    """The second writer commits between the first one's read and commit: the
    first one's merge is done again on the newer version."""
    store = TableStore(spark, str(tmp_path / "lake"))
    store.replace(rows(spark, ["a"], "x"), "silver", "t", version="base")
    built = []

    def first(base):
        built.append(base.version)
        df = merged_table(merge(rows(spark, ["b"], "y"), store.load("silver", "t", base)))
        if len(built) == 1:
            store.update("silver", "t", lambda b: (merged_table(merge(rows(spark, ["c"], "z"), store.load("silver", "t", b))), None),
                         version="second")
        return df, None

    store.update("silver", "t", first, version="first")
    assert built == ["base", "second"]
    assert sorted(r["_pk"] for r in store.read("silver", "t").collect()) == ["a", "b", "c"]
    assert [r["version"] for r in store.versions("silver", "t").orderBy("seq").collect()] == ["base", "second", "first"]


def test_overtaken_write_is_refused(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    store.replace(rows(spark, ["a"], "x"), "silver", "t", version="1")
    base = store.newest("silver", "t")
    store.replace(rows(spark, ["b"], "x"), "silver", "t", version="2")
    with pytest.raises(CommitConflict):
        store.replace(rows(spark, ["c"], "x"), "silver", "t", version="3", base=base)
    assert not store.is_committed("silver", "t", "3") and store.current_version("silver", "t") == "2"
    with pytest.raises(CommitConflict):  # the table was not there when it was read
        store.replace(rows(spark, ["c"], "x"), "silver", "t", version="3", base=None)
    store.replace(rows(spark, ["c"], "x"), "silver", "t", version="3", base=store.newest("silver", "t"))
    assert store.read("silver", "t").first()["_pk"] == "c"


def test_a_commit_number_is_taken_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    path = f"{store.path('silver', 't')}/_commits/000000000001.json"
    assert store._create(path, "{}") is True and store._create(path, "[]") is False
    assert open(path).read() == "{}" and os.listdir(os.path.dirname(path)) == [os.path.basename(path)]


# ---- partitions --------------------------------------------------------------------

def parquet_files(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
            for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    df = spark.createDataFrame([(y, m, y * 100 + m) for y in (2005, 2006) for m in (1, 2, 3)], "year int, month int, v int")
    store.replace(df, "silver", "t", version="1", partition_by=["year", "month"])
    first = store.newest("silver", "t")
    before = parquet_files(tmp_path / "lake/silver/t")
    new = spark.createDataFrame([(2006, 2, -1), (2007, 1, -2)], "year int, month int, v int")
    only = store.partition_names(new, ["year", "month"])
    assert only == {"year=2006/month=2", "year=2007/month=1"}
    store.replace(new, "silver", "t", version="2", partition_by=["year", "month"], base=first, only=only)
    after = parquet_files(tmp_path / "lake/silver/t")
    assert all(after[p] == t for p, t in before.items())
    assert all("/v=2/" in p and ("month=2" in p or "year=2007" in p) for p in set(after) - set(before))
    assert sorted(map(tuple, store.read("silver", "t").select("year", "month", "v").collect())) == [
        (2005, 1, 200501), (2005, 2, 200502), (2005, 3, 200503), (2006, 1, 200601), (2006, 2, -1), (2006, 3, 200603), (2007, 1, -2)]
    assert store.read("silver", "t", "1").count() == 6  # the older version is whole
    assert store.changed("silver", "t", "1") == only
    files = store.read("silver", "t").filter("year = 2006 and month = 2").inputFiles()
    assert len(files) >= 1
    # a partition without rows disappears, one that is not replaced can't get rows
    store.replace(new.filter("year = 2007"), "silver", "t", version="3", partition_by=["year", "month"],
                  base=store.newest("silver", "t"), only={"year=2007/month=1", "year=2005/month=1"})
    assert store.read("silver", "t").filter("year = 2005 and month = 1").count() == 0
    with pytest.raises(ValueError, match="outside"):
        store.replace(new, "silver", "t", version="4", partition_by=["year", "month"], base=store.newest("silver", "t"),
                      only={"year=2007/month=1"})
    # pruning keeps the folders that the kept versions list
    store.prune_versions("silver", "t", keep=1)
    assert store.read("silver", "t").count() == 6
    left = parquet_files(tmp_path / "lake/silver/t")
    assert not any("/v=1/year=2006/month=2/" in p or "/v=1/year=2005/month=1/" in p for p in left)


def test_odd_partition_values_and_a_column_named_v(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    df = spark.createDataFrame([("a/b=c %", 1), (None, 2), ("é", 3)], "p string, v int")
    store.replace(df, "gold", "t", version="1", partition_by=["p"])
    new = spark.createDataFrame([(None, 20), ("a/b=c %", 10)], "p string, v int")
    store.replace(new, "gold", "t", version="2", partition_by=["p"], base=store.newest("gold", "t"),
                  only=store.partition_names(new, ["p"]))
    assert sorted(map(tuple, store.read("gold", "t").select("p", "v").collect()), key=repr) == [("a/b=c %", 10), ("é", 3), (None, 20)]


def test_batches_write_the_periods_they_touch(spark, tmp_path):
    """Silver, gold and fact: a second batch leaves the other months' files, a
    key that moves to another month leaves its old one."""
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=["ce_brand_flvr"])  # the period is no part of the key
    ch = spark.createDataFrame([("SUPERETTE", "SERVICES", "MIX")], CH)
    day1 = spark.createDataFrame([_row(f"B{m}", " A", "WEST", "SUPERETTE", "10.00", str(m)) for m in (1, 2, 3, 4)], SALES)
    run_batch(spark, store, day1, ch, prof, "20240101000000", "2024-01-01 00:00:00")
    before = {layer: parquet_files(tmp_path / "lake" / layer) for layer in ("silver/beverage_sales", "gold/beverage_sales", "consumption/fact_sales")}
    day2 = spark.createDataFrame([_row("B2", " A", "WEST", "SUPERETTE", "99.00", "3")], SALES)  # from month 2 to 3
    out = run_batch(spark, store, day2, ch, prof, "20240102000000", "2024-01-02 00:00:00")
    assert (out["inserted"], out["updated"], out["kept"], out["silver_rows"], out["gold_rows"], out["fact_sales_rows"]) == (0, 1, 3, 4, 4, 4)
    for layer, old in before.items():
        now = parquet_files(tmp_path / "lake" / layer)
        assert {p: now.get(p) for p in old} == old
        assert all("month=3" in p for p in set(now) - set(old)), layer
    for layer, table in (("silver", "beverage_sales"), ("gold", "beverage_sales"), ("consumption", "fact_sales")):
        assert {r["month"]: r["n"] for r in store.read(layer, table).groupBy("month").agg(F.count("*").alias("n")).collect()} == {1: 1, 3: 2, 4: 1}
    # another parameter of the derived tables: gold is built anew, whole
    from dataclasses import replace

    from strata.plans.current import refresh
    from strata.plans.layers import gold_sales
    other = replace(prof, volume_high=5.0, volume_medium=2.0)
    refresh(store, "gold", "beverage_sales", ("silver", "beverage_sales"), "other", other, lambda x: gold_sales(x, other))
    assert set(store.newest("gold", "beverage_sales").folders.values()) == {f"v=other/year=2006/month={m}" for m in (1, 3, 4)}


# ---- merge ---------------------------------------------------------------------------

def test_update_sets_only_the_columns_of_the_source(spark):
    target = rows(spark, ["a", "b", "c"], "old").withColumn("extra", F.concat(F.lit("e"), "_pk"))
    source = rows(spark, ["a", "d"], "new", "2024-01-02 00:00:00").withColumn("only_new", F.lit(7))
    got = {r["_pk"]: (r["_action"], r["v"], r["extra"], r["only_new"]) for r in merge(source, target).collect()}
    assert got == {"a": ("update", "newa", "ea", 7), "b": ("keep", "oldb", "eb", None), "c": ("keep", "oldc", "ec", None),
                   "d": ("insert", "newd", None, 7)}


def test_rows_without_key_stay_out_of_the_join(spark):
    """A third of both sides has no key: the join's inputs hold none of them."""
    key = F.when(F.col("id") % 3 > 0, F.col("id").cast("string"))
    side = lambda tag, ts: spark.range(300).select(
        key.alias("_pk"), F.concat(F.lit(tag), F.col("id").cast("string")).alias("_row_hash"),
        F.to_timestamp(F.lit(ts)).alias("_ingestion_timestamp"), F.col("id").alias("v"))
    m = merge(materialize(side("n", "2024-01-02 00:00:00")), materialize(side("o", "2024-01-01 00:00:00")))
    counts = {(r["_action"], r["keyed"]): r["n"] for r in m.groupBy("_action", F.col("_pk").isNotNull().alias("keyed"))
              .agg(F.count("*").alias("n")).collect()}
    assert counts == {("update", True): 200, ("insert", False): 100, ("keep", False): 100}
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join FullOuter") == 1
    assert plan[plan.index("Join FullOuter"):].count("Filter isnotnull(_pk") == 2  # both inputs of the join


# ---- stream ---------------------------------------------------------------------------

def test_stream_update_keeps_the_channel_columns(spark, tmp_path):
    """An update through the stream is enriched as a batch's is, and the table
    keeps its layout."""
    from strata.streaming.ingest import process_batch
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=KEY)
    ch = spark.createDataFrame([("SUPERETTE", "SERVICES", "MIX")], CH)
    day1 = spark.createDataFrame([_row("B1", " A", "WEST", "SUPERETTE", "10.00")], SALES)
    run_batch(spark, store, day1, ch, prof, "20240101000000", "2024-01-01 00:00:00")
    more = spark.createDataFrame([_row("B1", " A", "WEST", "SUPERETTE", "11.00"), _row("B7", " A", "WEST", "SUPERETTE", "1.00", "2")], SALES)
    assert process_batch(more.withColumn("_path", F.lit("file:/landing/x.tsv")), 0, store, prof)
    got = {r["ce_brand_flvr"]: (str(r["dollar_volume"]), r["trade_group_desc"], r["trade_type_desc"])
           for r in store.read("silver", "beverage_sales").collect()}
    assert got == {"B1": ("11.00", "SERVICES", "MIX"), "B7": ("1.00", "SERVICES", "MIX")}
    assert store.newest("silver", "beverage_sales").partitions == ["year", "month"]


# ---- reprocessing ----------------------------------------------------------------------

def test_reprocess_cut_off_between_silver_and_marking(spark, tmp_path, monkeypatch):
    from dataclasses import replace

    from strata.plans import reprocess
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=KEY)
    ch = spark.createDataFrame([("SUPERETTE", "SERVICES", "MIX")], CH)
    late = list(_row("B2", " A", "WEST", "SUPERETTE", "10.00"))
    late[0], late[10] = "1/5/1998", "1998"
    day = spark.createDataFrame([_row("B1", " A", "WEST", "SUPERETTE", "10.00"), tuple(late)], SALES)
    run_batch(spark, store, day, ch, prof, "20240101000000", "2024-01-01 00:00:00")
    fixed = replace(prof, years=(1990, 2030))
    real = reprocess.mark

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(reprocess, "mark", die)
    with pytest.raises(KeyboardInterrupt):
        reprocess.reprocess_sales(store, fixed, "20240102000000")
    pending = lambda: store.read("control", "quarantine").filter("not reprocessed").count()
    assert store.read("silver", "beverage_sales").count() == 2 and pending() == 1
    monkeypatch.setattr(reprocess, "mark", real)
    again = reprocess.reprocess_sales(store, fixed, "20240102000000")  # the same call again
    assert again["released"] == 0 and pending() == 0
    assert store.read("silver", "beverage_sales").count() == 2
    assert store.read("control", "quarantine").first()["reprocess_batch_id"] == "20240102000000"


def test_reprocess_cut_off_before_the_silver_commit(spark, tmp_path, monkeypatch):
    """An intent without a commit is void: the records stay pending."""
    from dataclasses import replace

    from strata.plans import reprocess
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=KEY)
    ch = spark.createDataFrame([("SUPERETTE", "SERVICES", "MIX")], CH)
    late = list(_row("B2", " A", "WEST", "SUPERETTE", "10.00"))
    late[0], late[10] = "1/5/1998", "1998"
    run_batch(spark, store, spark.createDataFrame([tuple(late), _row("B1", " A", "WEST", "SUPERETTE", "1.00")], SALES), ch, prof,
              "20240101000000", "2024-01-01 00:00:00")
    fixed = replace(prof, years=(1990, 2030))
    real = reprocess.merge_into_silver
    monkeypatch.setattr(reprocess, "merge_into_silver", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        reprocess.reprocess_sales(store, fixed, "20240102000000")
    monkeypatch.setattr(reprocess, "merge_into_silver", real)
    assert reprocess.recover(store) == []
    assert reprocess.reprocess_sales(store, fixed, "20240103000000")["released"] == 1
    assert store.read("silver", "beverage_sales").count() == 2
