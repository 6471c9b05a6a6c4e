"""Join helpers with a checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast only below this many rows unless the caller proves a smaller bound.
DEFAULT_BROADCAST_ROWS = 1_000_000
# Plan-statistics bound under which no counting job is needed.
DEFAULT_BROADCAST_BYTES = 8 * 1024 * 1024
# Input (compressed columns) behind one shuffle partition.
PARTITION_BYTES = 8 * 1024 * 1024
# Sizes from here on are Spark's stand-in for an unknown one.
UNKNOWN_BYTES = 1 << 60


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (the number Spark's own
    auto-broadcast uses). Without CBO it never shrinks below what the inputs
    allow: filters and aggregates keep their child's size."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # not a classic JVM session: no estimate
        return None


def input_bytes(df: DataFrame) -> int | None:
    """Size of all that a plan reads (its leaves, from file statistics); None
    where a leaf has no known size."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except AttributeError:  # not a classic JVM session: no estimate
        return None
    return sum(sizes) if all(s < UNKNOWN_BYTES for s in sizes) else None


def partitions_for(df: DataFrame, bytes_each: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for work on all rows of ``df``: as many as the session
    has, and more when the input is larger than ``bytes_each`` for each, so that
    a task's share doesn't grow with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(input_bytes(df) or 0) // bytes_each))


def is_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
             max_bytes: int = DEFAULT_BROADCAST_BYTES, count: bool = True) -> bool:
    """True when ``df`` is provably under both bounds: the plan estimate first,
    then (if ``count``) the rows and bytes of at most ``max_rows + 1`` rows."""
    est = estimated_bytes(df)
    if est is not None and est <= max_bytes:
        return True
    if not count:
        return False
    size = F.octet_length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when it is provably small, else leave the join to
    a shuffle (sort-merge with AQE skew splitting).

    First the plan's size estimate is checked (no job). If that is too large
    to decide, at most ``max_rows + 1`` rows are counted, so the check's cost
    stays bounded even when the side turns out to be large.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
