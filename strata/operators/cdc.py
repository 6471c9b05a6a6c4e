"""Change data capture: latest version per key, keyed merge, key reports.

Skew: a single key may hold a large share of the rows. ``latest_per_key`` is a
``row_number() = 1`` window: Spark cuts every key to one row per map task
before the shuffle (WindowGroupLimit), so a hot key arrives as one row per
task, and only the columns a query uses are shuffled. After that each key has
one row per side, and the merge's full outer join cannot skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import partitions_for

# Slots of a key report per shuffle partition: many, so partitions are alike.
# Input behind a partition: less than for a join, as every row is counted per key.
SLOTS, KEY_BYTES = 16, 4 * 1024 * 1024
# Merge actions.
INSERT, UPDATE, UNCHANGED, STALE, KEEP = "insert", "update", "unchanged", "stale", "keep"


def latest_per_key(df: DataFrame, key: str = "_pk",
                   order: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the row with the greatest ``order`` tuple.

    Default order is (``_ingestion_timestamp``, ``_row_hash``) when present;
    the row hash makes ties deterministic. Without any order column there is
    no "latest", and the call raises. Rows without a key have no identity and
    are all kept.
    """
    if order is None:
        order = [c for c in ("_ingestion_timestamp", "_updated_at", "_row_hash") if c in df.columns]
        if "_ingestion_timestamp" in order and "_updated_at" in order:
            order.remove("_updated_at")
    if not order:
        raise ValueError("latest_per_key needs at least one order column")
    newest = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    known = (df.filter(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(newest))
             .filter(F.col("_rank") == 1).drop("_rank"))
    return known.unionByName(df.filter(F.col(key).isNull())) if _nullable(df, key) else known


def _nullable(df: DataFrame, column: str) -> bool:
    return df.schema[column].nullable


def key_report(df: DataFrame, key_columns: list[str] | str) -> DataFrame:
    """Totals, distinct keys and duplicate rows in one aggregation pass."""
    return key_reports(df, {"key": key_columns}).drop("key_name")


def key_reports(df: DataFrame, keys: dict[str, list[str] | str]) -> DataFrame:
    """The same for several candidate keys, still in one pass over ``df``.

    Distinct values take memory for every one that a task sees, so the tasks
    are as many as the input asks for, whatever the session's shuffle
    partitions. First each map task's rows are dealt into slots (a hash of map
    task and keys, so a hot key is in many) and counted per slot, then the
    counts meet by key: a key comes once per slot at most, however hot it is.
    """
    names = list(keys)
    cols = [[k] if isinstance(k, str) else list(k) for k in keys.values()]
    n = partitions_for(df, KEY_BYTES)
    ks = [f"_k{i}" for i in range(len(cols))]
    slot = F.pmod(F.xxhash64(F.spark_partition_id(), *dict.fromkeys(c for k in cols for c in k)), F.lit(SLOTS * n))
    rows = df.select(slot.alias("_slot"), *((F.struct(*c) if len(c) > 1 else F.col(c[0])).alias(k) for k, c in zip(ks, cols))) \
        .repartition(n, "_slot")
    each = rows.select("_slot", F.explode(F.array(*map(F.lit, range(len(ks))))).alias("_key"), *ks) \
        .select("_slot", "_key", *(F.when(F.col("_key") == i, F.col(k)).alias(k) for i, k in enumerate(ks)))
    met = each.groupBy("_slot", "_key", *ks).agg(F.count(F.lit(1)).alias("_n")) \
        .repartition(n, "_key", *ks).groupBy("_key", *ks).agg(F.sum("_n").alias("_n"))
    distinct = [F.count(k).alias(f"_d{i}") for i, k in enumerate(ks)]
    one = met.agg(F.coalesce(F.sum(F.when(F.col("_key") == 0, F.col("_n"))), F.lit(0)).alias("total_rows"), *distinct)
    rows = F.array(*[F.struct(F.lit(n).alias("key_name"), "total_rows", F.col(f"_d{i}").alias("distinct_keys"))
                     for i, n in enumerate(names)])
    return (one.select(F.explode(rows).alias("r")).select("r.*")
            .withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_keys")))


def merge(source: DataFrame, target: DataFrame, key: str = "_pk", hash_col: str = "_row_hash",
          ts_col: str | None = "_ingestion_timestamp", dedupe_source: bool = True,
          num_partitions: int | None = None) -> DataFrame:
    """Keyed merge of an increment into the current table, by ONE full outer
    join on the key (each side shuffled once), whatever the sizes.

    ``num_partitions``: the bucket count of a target bucketed by ``key``. The
    increment is hash-partitioned to match once, before its dedupe, so the
    dedupe and the join reuse that one exchange and the target is read
    without any shuffle.

    Returns every row of the new current table plus ``_action``:
    ``insert`` (key only in source), ``keep`` (key only in target),
    ``unchanged`` (equal hash; target row kept), ``update`` (hash differs and
    the source row is not older), ``stale`` (hash differs, source older;
    target row kept). Which side a row comes from is told by a literal flag
    per side. Column sets may differ: an update sets only the columns that the
    source has and leaves the target's others; what neither side gives is null.
    Counting ``_action`` gives the merge statistics.

    Rows without a key match nothing: they are inserted, or kept. They don't
    take part in the join, where all of them would be one task's, but are
    added to its result (both sides of a key that can't be null skip that).
    """
    if num_partitions:
        source = source.repartition(num_partitions, key)
    loose_source, loose_target = (df.filter(F.col(key).isNull()) if _nullable(df, key) else None for df in (source, target))
    if loose_source is not None:
        source = source.filter(F.col(key).isNotNull())
    if loose_target is not None:
        target = target.filter(F.col(key).isNotNull())
    if dedupe_source:
        source = latest_per_key(source, key)
    cols = list(dict.fromkeys([*target.columns, *source.columns]))

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*[F.col(c).alias(p + c) for c in df.columns], F.lit(True).alias(f"{p}_here"))

    j = side(source, "s__").join(side(target, "t__"), F.col(f"s__{key}") == F.col(f"t__{key}"), "full_outer")
    newer = F.lit(True) if not ts_col else F.coalesce(F.col(f"s__{ts_col}") >= F.col(f"t__{ts_col}"), F.lit(True))
    action = (F.when(F.col("t___here").isNull(), F.lit(INSERT))
              .when(F.col("s___here").isNull(), F.lit(KEEP))
              .when(F.col(f"s__{hash_col}").eqNullSafe(F.col(f"t__{hash_col}")), F.lit(UNCHANGED))
              .when(newer, F.lit(UPDATE))
              .otherwise(F.lit(STALE)))
    j = j.withColumn("_action", action)
    from_source = F.col("_action").isin(INSERT, UPDATE)

    def merged(c: str):
        if c not in source.columns:
            return F.col(f"t__{c}")  # null for an insert
        old = F.col(f"t__{c}") if c in target.columns else F.lit(None)
        return F.when(from_source, F.col(f"s__{c}")).otherwise(old)

    out = j.select(*[merged(c).alias(c) for c in cols], "_action")
    for loose, label in ((loose_source, INSERT), (loose_target, KEEP)):
        if loose is not None:
            out = out.unionByName(loose.withColumn("_action", F.lit(label)), allowMissingColumns=True)
    return out


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy("_action").agg(F.count(F.lit(1)).alias("records"))


def merged_table(merged: DataFrame) -> DataFrame:
    return merged.drop("_action")


def merge_union_form(source: DataFrame, target: DataFrame, key: str = "_pk",
                     hash_col: str = "_row_hash") -> DataFrame:
    """The library form: source-only keys, changed rows (source), equal rows
    (target) and target-only keys, without dedupe and without a time guard. As
    these four cases are the cases of one full outer join, it is the merge
    with both options off, and each input is read once."""
    return merged_table(merge(source, target, key, hash_col, ts_col=None, dedupe_source=False))
