"""Cutting lineage at layer boundaries.

A layer hand-over is a Parquet table written under the cluster's shared
``spark.checkpoint.dir`` and read back: a lost executor then costs a re-read,
never a recomputation of the upstream joins, and downstream scans get
column pruning and predicate pushdown on the written files (a plain RDD
checkpoint would be row-serialised and computed twice). Never a local
checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str = "stage", keep: bool = False, compression: str | None = None) -> DataFrame:
    """Write ``df`` under the checkpoint folder and return a scan of it.

    Unless ``keep``, the folder is removed when the session's JVM exits
    (Hadoop ``deleteOnExit``), so hand-over tables do not pile up.
    ``compression``: of the files; ``zstd`` halves hashes written as hex.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/strata-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path, compression=compression)
    if not keep:
        delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer inference


def stored_place() -> Column:
    """Where a row of a stored table lies: file name and row number there, the
    same in every pass over the table."""
    return F.concat_ws("#", "_metadata.file_name", F.col("_metadata.row_index").cast("string"))


def delete_on_exit(spark, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    except AttributeError:  # not a classic JVM session: leave cleanup to the folder's policy
        pass
