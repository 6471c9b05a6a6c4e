"""Session helpers: configuration a job needs, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Options every job relies on. AQE re-plans joins (runtime broadcast of small
# shuffle outputs, skew-join splitting) and coalesces small shuffle partitions.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Static broadcast threshold for local runs. Single-file test tables give
# one scan partition; broadcasting the line items would then run the whole
# pipeline in one task. Below this size a side is broadcast from its file
# statistics; above it the join is shuffled and runs in parallel. On a
# cluster the big tables are far above any threshold either way.
LOCAL_BROADCAST_BYTES = 1024 * 1024


def build_session(master: str = "local[*]", app: str = "strata",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks; clusters pass their own conf."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.autoBroadcastJoinThreshold", str(LOCAL_BROADCAST_BYTES))
         # catalog metadata of local runs stays out of the working directory
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="strata-warehouse-"))
         .config("spark.driver.memory", os.environ.get("STRATA_DRIVER_MEMORY", "8g")))
    for k, v in {**JOB_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable options to a session we did not build."""
    for k, v in JOB_CONF.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may go
    without (tests): executors elsewhere would not see a folder of the driver's.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(checkpoint_folder(sc.master, configured))
    return sc.getCheckpointDir()


def checkpoint_folder(master: str, configured: str | None) -> str:
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master!r}")
    return tempfile.mkdtemp(prefix="strata-ckpt-")
