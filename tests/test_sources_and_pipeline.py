"""Landing files (UTF-16 TSV, BOM CSV), layer store, file pipeline, stream."""

import os

import pytest
from pyspark.sql import functions as F

from strata.operators import quality as Q
from strata.plans.layers import Profile, bronze_channels, bronze_sales, sales_dq, silver_channels, silver_sales
from strata.sources.files import SALES_COLUMNS, missing_sources, read_channel_csv, read_sales_tsv
from strata.sources.tables import TableStore

HEADER = "\t".join(SALES_COLUMNS)
# DATE, CE_BRAND_FLVR, BRAND_NM, region, CHNL_GROUP, TRADE_CHNL_DESC, PKG_CAT, Pkg_Cat_Desc,
# TSR_PCKG_NM, $ Volume, YEAR, MONTH, PERIOD
ROWS = [
    ["1/5/2006", "B1", " BRAND A", "NORTHEAST", "OFF", "SUPERETTE", "P1", "Can", "12oz", "10.50", "2006", "1", "1"],
    ["1/6/2006", "B2", " BRAND B", "CANADA", "ON", "SPORT VENUE", "P1", "Can", "12oz", "-3.25", "2006", "1", "1"],
    ["1/7/2006", "B3", "", "WEST", "ON", "SPORT VENUE", "P1", "Can", "12oz", "1", "2006", "1", "1"],
    ["1/8/2006", "B4", " BRAND D", "WEST", "ON", "", "P1", "Can", "12oz", "1", "2006", "1", "1"],
    ["1/9/2006", "B5", " BRAND E", "WEST", "ON", "   ", "P1", "Can", "12oz", "1", "2006", "1", "1"],
    ["1/9/2006", "B6", " BRAND F", "WEST", "ON", "SUPERETTE", "P1", "Can", "12oz", "abc", "2006", "1", "1"],
    ["13/45/2006", "B7", " BRAND G", "WEST", "ON", "SUPERETTE", "P1", "Can", "12oz", "2", "2006", "1", "1"],
    ["1/9/1999", "B8", " BRAND H", "WEST", "ON", "SUPERETTE", "P1", "Can", "12oz", "2", "1999", "1", "1"],
    ["1/9/2006", "B9", " BRAND I", "WEST", "ON", "SUPERETTE", "P1", "Can", "12oz", "2", "2006", "13", "13"],
    ["1/9/2006", "B10", " BRAND J", "WEST", "ON", "UNKNOWN CHANNEL", "P1", "Can", "12oz", "2", "2006", "1", "1"],
    ["1/5/2006", "B1", " BRAND A", "NORTHEAST", "OFF", "SUPERETTE", "P1", "Can", "12oz", "10.50", "2006", "1", "1"],
]
KEY = ["ce_brand_flvr", "region", "trade_chnl_desc", "year", "month"]


@pytest.fixture()
def landing(tmp_path):
    d = tmp_path / "landing"
    d.mkdir()
    text = "\r\n".join([HEADER] + ["\t".join(r) for r in ROWS]) + "\r\n"
    (d / "sales.tsv").write_bytes(text.encode("utf-16-le"))
    csv = ("TRADE_CHNL_DESC,TRADE_GROUP_DESC,TRADE_TYPE_DESC\n"
           "SPORT VENUE,ENTERTAINMENT,ALCOHOLIC\nSUPERETTE,SERVICES,MIX\n"
           "SUPERETTE,SERVICES,MIX\nPLANT,,MIX\nMASS MERCHANDISER,GROCERY,WATER\n")
    (d / "channels.csv").write_bytes(b"\xef\xbb\xbf" + csv.encode("utf-8"))
    return d


def test_read_utf16_tsv(spark, landing):
    df = read_sales_tsv(spark, str(landing / "sales.tsv"))
    rows = df.collect()
    assert len(rows) == len(ROWS)
    assert rows[0]["BRAND_NM"] == " BRAND A" and rows[1]["$ Volume"] == "-3.25"
    assert rows[0]["PERIOD"] == "1"  # no stray carriage return


def test_channel_csv_bom_and_rules(spark, landing):
    ch = read_channel_csv(spark, str(landing / "channels.csv"))
    assert ch.columns[0] == "TRADE_CHNL_DESC" and ch.count() == 5
    b = bronze_channels(ch, Profile(key_columns=KEY), "b1", "2024-01-01 00:00:00")
    codes = sorted((r["trade_chnl_desc"], r["_dq_code"]) for r in Q.channel_checks(b).collect())
    assert ("PLANT", "DQ_CHANNEL_002") in codes and ("MASS MERCHANDISER", "DQ_CHANNEL_004") in codes
    assert codes.count(("SUPERETTE", "DQ_CHANNEL_003")) == 2
    # silver keeps one version per channel key
    assert silver_channels(b).filter(F.col("trade_chnl_desc") == "SUPERETTE").count() == 1


def test_file_pipeline_rules(spark, landing):
    prof = Profile(key_columns=KEY)
    b = bronze_sales(read_sales_tsv(spark, str(landing / "sales.tsv")), prof, "b1", "2024-01-01 00:00:00",
                     source_file=str(landing / "sales.tsv"))
    assert "region" in b.columns and "dollar_volume" in b.columns and b.columns[0].startswith("_")
    ch = silver_channels(bronze_channels(read_channel_csv(spark, str(landing / "channels.csv")), prof, "b1"))
    dq = Q.apply_dq_sales(b, declared=True, channels=ch)
    codes = {r["ce_brand_flvr"]: r["_dq_code"] for r in dq.collect()}
    assert codes["B1"] is None and codes["B2"] is None
    assert codes["B3"] == "DQ_SALES_001" and codes["B4"] == "DQ_SALES_002" and codes["B5"] == "DQ_SALES_002"
    assert codes["B6"] == "DQ_SALES_003" and codes["B7"] == "DQ_SALES_004"
    assert codes["B8"] == "DQ_SALES_006" and codes["B9"] == "DQ_SALES_007" and codes["B10"] == "DQ_SALES_008"
    # exact duplicate rows share key and hash
    dup = b.filter(F.col("ce_brand_flvr") == "B1").select("_pk", "_row_hash").distinct().count()
    assert dup == 1
    s = silver_sales(sales_dq(b).filter(F.col("_dq_code").isNull())).collect()
    neg = [r for r in s if r["ce_brand_flvr"] == "B2"][0]
    assert str(neg["dollar_volume"]) == "-3.25" and str(neg["transaction_date"]) == "2006-01-06"
    # values that cannot be typed are quarantined by default, not kept as nulls
    assert {"B6", "B7", "B8", "B9"}.isdisjoint(r["ce_brand_flvr"] for r in s)
    assert all(r["dollar_volume"] is not None and r["transaction_date"] is not None for r in s)
    assert neg["sales_id"] == "S-" + neg["_pk"]


def test_missing_sources(spark, landing):
    miss = [r["file"] for r in missing_sources(spark, str(landing), ["sales.tsv", "absent.csv"]).collect()]
    assert miss == ["absent.csv"]


def test_table_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    assert store.read_if_exists("silver", "t", "k string, v int").count() == 0
    v1 = store.replace(df, "silver", "t", version="001")
    df2 = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    # read the current version lazily and replace it: never overwrites what the plan reads
    cur = store.read("silver", "t")
    store.replace(cur.unionByName(df2), "silver", "t", version="002")
    assert store.current_version("silver", "t") == "002" and v1 == "001"
    assert store.read("silver", "t").count() == 3 and store.read("silver", "t", "001").count() == 1
    with pytest.raises(ValueError):
        store.replace(df, "silver", "t", version="001")
    store.append(df.withColumn("d", F.lit("2024-01-01")), "bronze", "h", ["d"])
    store.append(df.withColumn("d", F.lit("2024-01-02")), "bronze", "h", ["d"])
    assert store.read("bronze", "h").count() == 2
    store.overwrite_partitions(df2.withColumn("d", F.lit("2024-01-02")), "bronze", "h", ["d"])
    assert store.read("bronze", "h").count() == 3
    assert store.register_views({"tv": ("silver", "t"), "nope": ("gold", "x")}) == ["tv"]
    assert spark.sql("SELECT COUNT(*) FROM tv").first()[0] == 3


def test_stream_ingest_incremental(spark, tmp_path, landing):
    from strata.streaming.ingest import run_incremental
    land = tmp_path / "stream_landing"
    land.mkdir()
    os.replace(landing / "sales.tsv", land / "day1.tsv")
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=KEY)
    ckpt = str(tmp_path / "ckpt")
    run_incremental(spark, str(land), store, ckpt, prof)
    silver1 = store.read("silver", "beverage_sales")
    n1 = silver1.count()
    assert store.read("bronze", "beverage_sales").count() == len(ROWS)
    assert store.read("control", "quarantine").count() == 7  # brand, channel (2), volume, date, year, month
    # day 2: one changed row, one new row
    rows2 = [ROWS[0][:9] + ["99.00"] + ROWS[0][10:], ["2/1/2006", "N1"] + ROWS[1][2:]]
    text = "\r\n".join([HEADER] + ["\t".join(r) for r in rows2]) + "\r\n"
    (land / "day2.tsv").write_bytes(text.encode("utf-16-le"))
    run_incremental(spark, str(land), store, ckpt, prof)
    s2 = store.read("silver", "beverage_sales")
    assert s2.count() == n1 + 1
    assert str(s2.filter(F.col("ce_brand_flvr") == "B1").first()["dollar_volume"]) == "99.00"
    assert store.read("bronze", "beverage_sales").count() == len(ROWS) + 2
    # nothing new: a third run changes nothing
    run_incremental(spark, str(land), store, ckpt, prof)
    assert store.read("silver", "beverage_sales").count() == n1 + 1


def test_bucketed_current_table_merge_shuffles_only_increment(spark, tmp_path):
    from strata.operators.cdc import merge, merged_table
    store = TableStore(spark, str(tmp_path / "lake"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tgt = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("_pk"),
                                   F.col("id").cast("string").alias("v"),
                                   F.md5(F.col("id").cast("string")).alias("_row_hash"),
                                   F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("_ingestion_timestamp"))
    store.replace(tgt, "silver", "cur", version="001", bucket_by=(n, "_pk"))
    src = tgt.filter(F.col("v").cast("int") >= 1500).withColumn("v", F.concat("v", F.lit("x"))) \
        .withColumn("_row_hash", F.md5("v")).withColumn("_ingestion_timestamp",
                                                         F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    m = merge(src, store.read("silver", "cur"))
    plan = m._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.split("\n") if "FileScan" in ln or "Scan parquet" in ln]
    assert any("SelectedBucketsCount" in ln for ln in scans)
    store.replace(merged_table(m), "silver", "cur", version="002", bucket_by=(n, "_pk"))
    out = store.read("silver", "cur")
    assert out.count() == 2000 and out.filter(F.col("v").endswith("x")).count() == 500
    assert "Exchange" not in out.groupBy("_pk").count()._jdf.queryExecution().executedPlan().toString()


def test_stream_batch_replay_is_idempotent(spark, tmp_path, landing):
    from strata.streaming.ingest import process_batch
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=KEY)
    batch = read_sales_tsv(spark, str(landing / "sales.tsv")).withColumn("_path", F.col("_metadata.file_path"))
    # a crash after the bronze write: the partition exists, silver is not committed
    from strata.streaming.ingest import to_bronze
    store.overwrite_partitions(to_bronze(batch, prof, "stream-default-000000000000"), "bronze", "beverage_sales",
                               ["_batch_id"])
    assert process_batch(batch, 0, store, prof) is True       # the replay finishes the batch
    assert process_batch(batch, 0, store, prof) is False      # a second replay is a no-op
    assert store.read("bronze", "beverage_sales").count() == len(ROWS)
    assert store.read("silver", "beverage_sales").count() == store.read(
        "silver", "beverage_sales").select("_pk").distinct().count()


def test_new_stream_checkpoint_is_another_stream(spark, tmp_path, landing):
    """Epochs start again at 0 with a new checkpoint; the data still arrives,
    and what a batch run committed before does not hide it."""
    from strata.streaming.ingest import process_batch
    store = TableStore(spark, str(tmp_path / "lake"))
    prof = Profile(key_columns=KEY)
    batch = read_sales_tsv(spark, str(landing / "sales.tsv")).withColumn("_path", F.col("_metadata.file_path"))
    assert process_batch(batch, 0, store, prof, stream="one")
    n = store.read("silver", "beverage_sales").count()
    store.replace(store.read("silver", "beverage_sales"), "silver", "beverage_sales", version="20240101000000")
    new = batch.withColumn("CE_BRAND_FLVR", F.concat(F.lit("NEW"), "CE_BRAND_FLVR"))
    assert process_batch(new, 0, store, prof, stream="two")
    assert store.read("silver", "beverage_sales").count() == 2 * n
    assert store.read("bronze", "beverage_sales").select("_batch_id").distinct().count() == 2


def test_commit_order_decides(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    for i, v in enumerate(["20240101000000", "000000000000", "20231231000000"]):
        store.replace(spark.createDataFrame([(i,)], "v int"), "silver", "t", version=v)
        assert store.current_version("silver", "t") == v and store.read("silver", "t").first()["v"] == i


def test_uncommitted_first_write_is_empty(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    spark.createDataFrame([(1,)], "v int").write.parquet(f"{store.path('silver', 't')}/v=001")
    assert store.read_if_exists("silver", "t", "v int").count() == 0
    assert store.register_views({"x": ("silver", "t")}) == []
    with pytest.raises(ValueError):
        store.read("silver", "t")
    store.replace(spark.createDataFrame([(2,)], "v int"), "silver", "t", version="001")
    assert store.read("silver", "t").first()["v"] == 2


def test_narrower_append_keeps_older_columns(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    store.append(spark.createDataFrame([(1, "x")], "k int, old string"), "bronze", "t")
    store.append(spark.createDataFrame([(2, 2.5)], "k int, new double"), "bronze", "t")
    rows = {r["k"]: (r["old"], r["new"]) for r in store.read("bronze", "t").collect()}
    assert rows == {1: ("x", None), 2: (None, 2.5)}
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(3, 4)], "k int, old int"), "bronze", "t")


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from strata.session import checkpoint_folder
    assert checkpoint_folder("spark://host:7077", "hdfs://x/ckpt") == "hdfs://x/ckpt"
    assert checkpoint_folder("local[4]", None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(master, None)


def test_q20_read_errors_surface(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    bad = tmp_path / "lake" / "silver" / "broken"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        store.read("silver", "broken").count()
    assert store.read_if_exists("silver", "absent", "a int").count() == 0


def test_prune_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    for i in range(5):
        store.replace(spark.createDataFrame([(i,)], "v int"), "gold", "t", version=f"00{i}")
    assert store.prune_versions("gold", "t", keep=2) == ["000", "001", "002"]
    assert store.read("gold", "t").first()["v"] == 4 and store.read("gold", "t", "003").first()["v"] == 3
    assert store.prune_versions("gold", "t", keep=2) == []


def test_utf16_file_split_across_many_tasks(spark, tmp_path):
    """A UTF-16LE file cut into many small byte splits (odd sizes) still reads
    every row whole: the reader realigns each split on the CRLF separator."""
    rows = ["\t".join([f"{i % 12 + 1}/5/2006", f"B{i}", " BRAND Ä", "WEST", "ON", "SUPERETTE", "P1", "Can",
                       "12oz", f"{i}.50", "2006", str(i % 12 + 1), str(i % 12 + 1)]) for i in range(2000)]
    (tmp_path / "s.tsv").write_bytes(("\r\n".join([HEADER] + rows) + "\r\n").encode("utf-16-le"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1001")
    try:
        df = read_sales_tsv(spark, str(tmp_path / "s.tsv"))
        assert df.rdd.getNumPartitions() > 100
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2000
    assert sorted(int(r["CE_BRAND_FLVR"][1:]) for r in got) == list(range(2000))
    assert all(r["BRAND_NM"] == " BRAND Ä" and r["PERIOD"] == str(int(r["MONTH"])) for r in got)


def test_per_file_lineage(spark, landing):
    from strata.functions.audit import add_audit_columns
    from strata.sources.files import with_file_lineage
    df = read_sales_tsv(spark, str(landing / "sales.tsv"))
    assert with_file_lineage(df).first()["_file_path"].endswith("/sales.tsv")
    r = add_audit_columns(df, None, None, "bronze", "b1", "2024-01-01 00:00:00").first()
    assert r["_source_file"] == "sales.tsv" and r["_source_path"].endswith("/landing/sales.tsv")
