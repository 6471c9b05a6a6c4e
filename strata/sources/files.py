"""Landing-file scans with explicit all-string schemas (no inference pass)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Source layouts of the two landing files.
SALES_COLUMNS = ["DATE", "CE_BRAND_FLVR", "BRAND_NM", "Btlr_Org_LVL_C_Desc", "CHNL_GROUP",
                 "TRADE_CHNL_DESC", "PKG_CAT", "Pkg_Cat_Desc", "TSR_PCKG_NM", "$ Volume",
                 "YEAR", "MONTH", "PERIOD"]
CHANNEL_COLUMNS = ["TRADE_CHNL_DESC", "TRADE_GROUP_DESC", "TRADE_TYPE_DESC"]


def string_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def read_sales_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """UTF-16LE, CRLF, TAB-separated file with header, read by the executors.

    Every column is a string here; typing happens in silver with ``try_cast``
    so bad values become quarantine rows instead of failed jobs.
    """
    return (spark.read.schema(string_schema(columns or SALES_COLUMNS))
            .option("header", True).option("sep", "\t")
            .option("encoding", "UTF-16LE").option("lineSep", "\r\n")
            .option("mode", "PERMISSIVE")
            .csv(path))


def read_channel_csv(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 (BOM stripped by Spark), comma-separated, header."""
    return (spark.read.schema(string_schema(CHANNEL_COLUMNS))
            .option("header", True).option("mode", "PERMISSIVE").csv(path))


def with_file_lineage(df: DataFrame) -> DataFrame:
    """Keep the source file path per row (hidden ``_metadata`` column)."""
    return df.withColumn("_file_path", F.col("_metadata.file_path"))


def missing_sources(spark: SparkSession, landing_glob: str, required: list[str]) -> DataFrame:
    """Required landing files that are absent (one row each).

    Lists files through the ``binaryFile`` source with the content column
    pruned, so only paths, sizes and times are read.
    """
    found = (spark.read.format("binaryFile").load(landing_glob)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "length",
                     "modificationTime"))
    req = spark.createDataFrame([(r,) for r in required], "file string")
    return req.join(found, "file", "left_anti")


LEDGER_SCHEMA = "source string, path string, length bigint, modified timestamp, batch_id string"


def landing_files(source: DataFrame, name: str, batch_id: str) -> DataFrame:
    """The ledger rows of a landing frame: path, length and time of every file
    it reads (contents are not). A frame that reads no files has none."""
    spark, paths = source.sparkSession, source.inputFiles()  # names of landing files, not data
    if not paths:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.format("binaryFile").load(paths).select(
        F.lit(name).alias("source"), "path", "length", F.col("modificationTime").alias("modified"), F.lit(batch_id).alias("batch_id"))


def changed_files(ledger: DataFrame, now: DataFrame) -> DataFrame:
    """(source, path, change): files that were added, removed or changed since
    the ledger of the same batch was written."""
    key = ["source", "path", "length", "modified"]
    new, old = now.select(*key), ledger.select(*key)
    added, gone = new.join(old, key, "left_anti"), old.join(new, key, "left_anti")
    both = added.select("source", "path", F.lit(1).alias("in_new")).unionByName(
        gone.select("source", "path", F.lit(0).alias("in_new")))
    return both.groupBy("source", "path").agg(F.collect_set("in_new").alias("s")).select(
        "source", "path", F.when(F.size("s") == 2, "changed").when(F.array_contains("s", 1), "added").otherwise("removed")
        .alias("change"))
