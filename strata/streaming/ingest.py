"""Incremental landing -> bronze -> silver with a file stream.

Each new landing file is read once (the stream's checkpoint remembers which
files are done), appended to the bronze history and merged into the silver
current table inside ``foreachBatch``. ``availableNow`` processes whatever
has landed and stops, which fits a daily scheduled run; the same query with
a processing-time trigger runs continuously. A restarted run resumes from the
checkpoint, and a batch that failed half-way is replayed with the same
epoch id. The silver version is named after the stream and the epoch: a replay
overwrites nothing that readers already use, and a stream with a new checkpoint,
whose epochs start again at 0, is another stream.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audit import add_audit_columns, audit_first
from ..functions.hashing import add_primary_key, add_row_hash
from ..functions.names import standardize_column_names
from ..operators.quality import apply_dq_sales, quarantine_records, rule_description
from ..sources.files import SALES_COLUMNS, string_schema
from ..sources.tables import TableStore
from ..plans.current import merge_into_silver
from ..plans.layers import REGION_SOURCE_COLUMN, SALES_TABLE, Profile, silver_sales


def sales_stream(spark: SparkSession, landing_dir: str, columns: list[str] | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(string_schema(columns or SALES_COLUMNS))
         .option("header", True).option("sep", "\t")
         .option("encoding", "UTF-16LE").option("lineSep", "\r\n"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # the file path is taken in the stream itself (the micro-batch frame
    # handed to foreachBatch no longer carries the hidden _metadata column)
    return r.csv(landing_dir).withColumn("_path", F.col("_metadata.file_path"))


def to_bronze(batch: DataFrame, profile: Profile, batch_id: str) -> DataFrame:
    df = standardize_column_names(batch, "currency")
    if REGION_SOURCE_COLUMN in df.columns:
        df = df.withColumnRenamed(REGION_SOURCE_COLUMN, "region")
    df = add_row_hash(add_primary_key(df, profile.key_columns), exclude_columns=["_path"])
    df = add_audit_columns(df, "stream", None, "bronze", batch_id)
    df = df.withColumns({"_source_path": F.col("_path"),
                         "_source_file": F.element_at(F.split("_path", "/"), -1)}).drop("_path")
    return audit_first(df)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query when the checkpoint was made."""
    row = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()
    return json.loads(row["value"])["id"].replace("-", "")


def process_batch(batch: DataFrame, epoch: int, store: TableStore, profile: Profile,
                  stream: str = "default") -> bool:
    """One micro-batch: bronze partition, quarantine partition, silver merge.

    The rows are enriched and written as a batch's are.
    Safe to call again for the same stream and epoch (the stream replays a batch whose
    commit it did not record): a committed silver version means the batch is
    done; otherwise the bronze and quarantine partitions of this batch are
    replaced and the merge reads the last committed silver version again.
    Returns False when the batch was already done.
    """
    batch_id = version = f"stream-{stream}-{epoch:012d}"
    table = SALES_TABLE
    if store.is_committed("silver", table, version):
        return False
    bronze = to_bronze(batch, profile, batch_id).persist()
    try:
        store.overwrite_partitions(bronze, "bronze", table, ["_batch_id"])
        dq = apply_dq_sales(bronze, years=profile.years)
        bad = dq.filter(F.col("_dq_code").isNotNull())
        store.overwrite_partitions(
            quarantine_records(bad, f"bronze.{table}", f"silver.{table}", batch_id,
                               F.col("_dq_code"), rule_description(F.col("_dq_code"))),
            "control", "quarantine", ["batch_id"])
        merge_into_silver(store, profile, silver_sales(dq.filter(F.col("_dq_code").isNull())), version)
    finally:
        bronze.unpersist()
    return True


def run_incremental(spark: SparkSession, landing_dir: str, store: TableStore, checkpoint: str,
                    profile: Profile) -> None:
    """Process all new landing files, then stop (``availableNow``)."""
    q = (sales_stream(spark, landing_dir).writeStream
         .option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, epoch: process_batch(
             batch, epoch, store, profile, stream_id(spark, checkpoint)))
         .trigger(availableNow=True).start())
    q.awaitTermination()
