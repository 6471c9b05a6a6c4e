"""Layer tables: one directory per (layer, table).

* history tables are appended (``append``), partitioned by load date;
* current tables are replaced through a staged version plus a commit log
  (``replace``): data goes to ``<table>/v=<version>``, then the commit with the
  next sequence number is created as ``<table>/_commits/<number>.json``. The
  file must not exist yet and appears whole, so a number is taken once: of two
  writers one gets it, the other sees that it was overtaken. Readers resolve the
  greatest number, whatever the versions are called; a failed or running write
  is never seen (a table with nothing committed is empty), and a plan never
  overwrites the files it is reading.
* a commit lists the folder of every partition. A write that replaces some
  partitions (``only``) lists its own folders for these and carries the others
  over: their files are neither read nor copied.
* ``update`` builds a version from the newest commit and commits it only if
  that is still the newest, else builds it again from the newer one, so of
  writers that merge at once none loses the other's rows.

The format is chosen once per store (Delta when its extension is on the
session, else Parquet). Absence is tested with the file system, so any real
read error surfaces instead of being taken for a missing table.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LAYERS = ("landing", "bronze", "silver", "gold", "consumption", "control")
COMMIT_SCHEMA = ("seq bigint, version string, committed_at timestamp, buckets int, bucket_col string, "
                 "partitions array<string>, schema string, folders map<string,string>, inputs map<string,string>")


class CommitConflict(RuntimeError):
    """Another writer has committed since the base of this write was read."""


@dataclass(frozen=True)
class Commit:
    """One committed version. ``folders`` maps a partition (``year=2024/month=1``;
    empty for an unpartitioned table) to its folder below the table; ``inputs``
    says what the version was built from, for the writer's own use."""
    seq: int
    version: str
    committed_at: str
    buckets: int | None = None
    bucket_col: str | None = None
    partitions: list[str] = field(default_factory=list)
    schema: str | None = None
    folders: dict[str, str] = field(default_factory=dict)
    inputs: dict[str, str] = field(default_factory=dict)


#: ``base`` of a write that replaces whatever is there.
ANY = object()


def merged_schema(old: StructType | None, new: StructType) -> StructType:
    """Columns of both, the older ones first; one name must keep its type."""
    if old is None:
        return new
    known = {f.name: f.dataType for f in old.fields}
    for f in new.fields:
        if f.name in known and known[f.name] != f.dataType:
            raise ValueError(f"column {f.name} changes from {known[f.name].simpleString()} "
                             f"to {f.dataType.simpleString()}")
    return StructType([*old.fields, *(f for f in new.fields if f.name not in known)])


def table_format(spark: SparkSession) -> str:
    ext = spark.conf.get("spark.sql.extensions", "") or ""
    return "delta" if "delta" in ext.lower() else "parquet"


class TableStore:
    def __init__(self, spark: SparkSession, root: str, fmt: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.fmt = fmt or table_format(spark)

    def path(self, layer: str, table: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        return f"{self.root}/{layer}/{table}"

    # ---- history (append) ------------------------------------------------
    @staticmethod
    def _balanced(df: DataFrame, partition_by: list[str] | None) -> DataFrame:
        """Before a partitioned write, rebalance on the partition columns: AQE
        then packs small partitions together and splits a skewed one (a
        month holding a third of the rows is written by many tasks), so
        files are neither tiny nor huge."""
        return df.hint("rebalance", *partition_by) if partition_by else df

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def append(self, df: DataFrame, layer: str, table: str,
               partition_by: list[str] | None = None) -> None:
        df = self._balanced(df, partition_by)
        w = df.write.mode("append").format(self.fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(self.path(layer, table))
        self._save_schema(df, layer, table)

    def _save_schema(self, df: DataFrame, layer: str, table: str) -> None:
        """Keep the written schema next to a history table, so partition
        columns read back with their own types (a batch id such as
        ``20240101000000`` would otherwise be inferred as a number). Columns of
        earlier writes stay in it: files without them read as null."""
        schema = merged_schema(self.saved_schema(layer, table), df.schema)
        (self.spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path(layer, table)}/_schema"))

    def saved_schema(self, layer: str, table: str) -> StructType | None:
        path = f"{self.path(layer, table)}/_schema"
        if not self._exists(path):
            return None
        row = self.spark.read.parquet(path).first()
        return StructType.fromJson(json.loads(row["schema"])) if row else None

    def overwrite_partitions(self, df: DataFrame, layer: str, table: str,
                             partition_by: list[str]) -> None:
        """Replace only the partitions present in ``df`` (dynamic overwrite).
        Loading one batch per partition makes a replayed load idempotent."""
        (self._balanced(df, partition_by).write.mode("overwrite").format(self.fmt)
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_by).save(self.path(layer, table)))
        self._save_schema(df, layer, table)

    # ---- current (staged replace) ----------------------------------------
    def replace(self, df: DataFrame, layer: str, table: str, version: str | None = None,
                partition_by: list[str] | None = None, bucket_by: tuple[int, str] | None = None,
                base=ANY, only: Iterable[str] | None = None, inputs: dict[str, str] | None = None) -> str:
        """Write a new version and commit it.

        ``base`` is the commit that ``df`` was built from (None: an empty table);
        if another one has been committed since, nothing is committed and
        ``CommitConflict`` is raised. Without it the write replaces whatever is
        there. ``only`` names the partitions that ``df`` replaces (a partition
        without rows disappears); all others are carried over from ``base``.

        ``bucket_by=(n, key)`` writes the version bucketed (and sorted) by
        ``key`` into ``n`` buckets and registers it in the session catalog.
        A later join or merge on ``key`` then reads it already
        hash-partitioned: only the other side is shuffled. When the frame is
        already hash-partitioned by ``key`` into ``n`` partitions (a merge
        over a bucketed table), each task writes exactly one bucket file.
        """
        version = version or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
        root = self.path(layer, table)
        # An uncommitted version directory (a failed earlier attempt) is never
        # read, so overwriting it is safe; committed versions are immutable.
        if self.is_committed(layer, table, version):
            raise ValueError(f"version {version} of {layer}.{table} is already committed")
        only = None if only is None else set(only)
        if only is not None and (base is ANY or base is None or bucket_by or base.partitions != list(partition_by or [])):
            raise ValueError("partitions can be replaced in an equally partitioned base only")
        if not bucket_by:
            df = self._balanced(df, partition_by)
        w = df.write.mode("overwrite").format(self.fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        folder = f"v={version}"
        if bucket_by:
            n, key = bucket_by
            name = self._catalog_name(layer, table, version)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # metadata only: the table is external
            w.bucketBy(n, key).sortBy(key).option("path", f"{root}/{folder}").saveAsTable(name)
        else:
            w.save(f"{root}/{folder}")
        n, key = bucket_by or (None, None)
        folders = {"": folder}
        if partition_by:
            folders = {p: f"{folder}/{p}" for p in self._partition_folders(f"{root}/{folder}", len(partition_by))}
        if only is not None:
            if extra := set(folders) - only:
                raise ValueError(f"rows outside the replaced partitions: {sorted(extra)[:3]}")
            folders = {**{p: d for p, d in base.folders.items() if p not in only}, **folders}
        while True:
            last = self._commit(layer, table)
            if base is not ANY and (last.seq if last else 0) != (base.seq if base else 0):
                raise CommitConflict(f"{layer}.{table} has moved on to {last.version}")
            schema = df.schema
            if only is not None:  # columns that only carried files have stay readable
                schema = merged_schema(StructType.fromJson(json.loads(base.schema)), schema)
            commit = Commit((last.seq if last else 0) + 1, version, str(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)),
                            n, key, list(partition_by or []), schema.json(), folders, dict(inputs or {}))
            if self._create(f"{root}/_commits/{commit.seq:012d}.json", json.dumps(asdict(commit))):
                return version

    def update(self, layer: str, table: str, build: Callable[[Commit | None], tuple[DataFrame, Iterable[str] | None]],
               version: str | None = None, partition_by: list[str] | None = None,
               bucket_by: tuple[int, str] | None = None, inputs: dict[str, str] | None = None, attempts: int = 5) -> str:
        """Commit what ``build`` makes of the newest commit: the rows and the
        partitions that they replace (None: all). When another writer was
        faster, it is built again from that one's commit."""
        for attempt in range(attempts):
            base = self._commit(layer, table)
            df, only = build(base)
            try:
                return self.replace(df, layer, table, version, partition_by, bucket_by, base, only, inputs)
            except CommitConflict:
                if attempt == attempts - 1:
                    raise

    def _create(self, path: str, text: str) -> bool:
        """Create a file that must not exist; False when it does. It is written
        under another name first and then linked (local) or renamed (HDFS, which
        refuses an existing target in one step), so readers never see a part of
        it. A store whose rename replaces silently needs a table format of its own."""
        fs, p = self._fs(path)
        jvm = self.spark.sparkContext._jvm
        part = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.part")
        fs.mkdirs(p.getParent())
        out = fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(part.toUri().getPath(), p.toUri().getPath())
                return True
            return fs.rename(part, p)
        except FileExistsError:
            return False
        finally:
            fs.delete(part, False)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _partition_folders(self, path: str, depth: int) -> list[str]:
        """Folders ``depth`` levels below, as paths from there: one listing per
        parent, as many entries as the version has partitions."""
        found = [""]
        for _ in range(depth):
            found = [f"{f}/{n}" if f else n for f in found for n, _ in self._folders(f"{path}/{f}" if f else path) if "=" in n]
        return sorted(found)

    def partition_names(self, df: DataFrame, partition_by: list[str]) -> set[str]:
        """The partitions that the rows lie in, named as their folders are."""
        utils = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        rows = df.select(*[F.col(c).cast("string") for c in partition_by]).distinct().collect()  # one per partition
        return {"/".join(utils.getPartitionPathString(c, v) for c, v in zip(partition_by, r)) for r in rows}

    def _catalog_name(self, layer: str, table: str, version: str) -> str:
        tag = hashlib.md5(self.root.encode()).hexdigest()[:8]
        return re.sub(r"[^A-Za-z0-9_]", "_", f"strata_{tag}_{layer}_{table}_v{version}")

    def _commit(self, layer: str, table: str, version: str | None = None) -> Commit | None:
        """The newest commit (of ``version``), or None."""
        path = f"{self.path(layer, table)}/_commits"
        if not self._exists(path):
            return None
        if version:
            row = self.versions(layer, table).filter(F.col("version") == version).orderBy(F.desc("seq")).first()
            return Commit(**{**row.asDict(), "committed_at": str(row["committed_at"])}) if row else None
        fs, p = self._fs(path)
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        numbered = max((n for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=None)
        if numbered is None:
            return None
        stream = fs.open(self._fs(f"{path}/{numbered}")[1])
        try:
            return Commit(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def versions(self, layer: str, table: str) -> DataFrame:
        return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.path(layer, table)}/_commits")

    def is_committed(self, layer: str, table: str, version: str) -> bool:
        return self._commit(layer, table, version) is not None

    def newest(self, layer: str, table: str) -> Commit | None:
        return self._commit(layer, table)

    def changed(self, layer: str, table: str, since: str | None) -> set[str] | None:
        """Partitions whose folder differs between version ``since`` and the
        newest commit; None where that can't be told (no such version, or
        another partitioning)."""
        now = self._commit(layer, table)
        then = self._commit(layer, table, since) if since else None
        if now is None or then is None or not now.partitions or now.partitions != then.partitions:
            return None
        return {p for p in {*now.folders, *then.folders} if now.folders.get(p) != then.folders.get(p)}

    def current_version(self, layer: str, table: str) -> str | None:
        row = self._commit(layer, table)
        return row.version if row else None

    def has_rows_to_read(self, layer: str, table: str) -> bool:
        """False for a missing table and for one whose only content is a
        version folder that was never committed."""
        base = self.path(layer, table)
        if not self._exists(base):
            return False
        if self._exists(f"{base}/_commits"):
            return self._commit(layer, table) is not None
        return self._exists(f"{base}/_schema") or not any(n.startswith("v=") for n, _ in self._folders(base))

    def _folders(self, base: str) -> list[tuple[str, int]]:
        """(name, modification time in ms) of the folders under ``base``."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [(st.getPath().getName(), st.getModificationTime()) for st in fs.listStatus(root) if st.isDirectory()]

    def prune_versions(self, layer: str, table: str, keep: int = 3) -> list[str]:
        """Delete the data of all but the newest ``keep`` committed versions
        (at least the current one is always kept). Uncommitted leftovers of
        failed writes older than the newest kept version go too. The commit
        log itself is append-only and stays."""
        keep = max(1, keep)
        root = self.path(layer, table)
        if not self._exists(f"{root}/_commits"):
            return []
        kept = self.versions(layer, table).orderBy(F.desc("seq")).limit(keep).collect()
        if len(kept) < keep:
            return []
        used = {d for r in kept for d in (r["folders"] or {}).values()}
        oldest = min(r["committed_at"] for r in kept).replace(tzinfo=_dt.timezone.utc).timestamp() * 1000
        removed = []
        for name, changed in self._folders(root):
            if not name.startswith("v=") or name in used:
                continue
            if any(d.startswith(f"{name}/") for d in used):  # some of its partitions are carried over
                depth = next(d.count("/") for d in used if d.startswith(f"{name}/"))
                gone = [p for p in self._partition_folders(f"{root}/{name}", depth) if f"{name}/{p}" not in used]
                for p in gone:
                    self._delete(f"{root}/{name}/{p}")
            elif changed <= oldest:
                self._delete(f"{root}/{name}")
                removed.append(name[2:])
        return sorted(removed)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def folders(self, layer: str, table: str) -> list[tuple[str, int]]:
        path = self.path(layer, table)
        return self._folders(path) if self._exists(path) else []

    def remove(self, layer: str, table: str, folder: str) -> None:
        """Delete one partition folder of a history table."""
        self._delete(f"{self.path(layer, table)}/{folder}")

    def archive(self, layer: str, table: str, folder: str) -> str:
        """Move one partition folder of a history table out of the readers' sight."""
        target = f"{self.root}/archive/{layer}/{table}/{folder}"
        fs, to = self._fs(target)
        fs.mkdirs(to.getParent())
        if not fs.rename(self._fs(f"{self.path(layer, table)}/{folder}")[1], to):
            raise OSError(f"{folder} of {layer}.{table} could not be moved to {target}")
        return target

    def drop_partitions(self, layer: str, table: str, gone: Iterable[str], version: str | None = None) -> str | None:
        """Commit a version without these partitions. No file is read, written
        or deleted; ``prune_versions`` removes folders that no version lists."""
        gone = set(gone)
        for _ in range(5):
            base = self._commit(layer, table)
            if base is None or not base.partitions or not gone & set(base.folders):
                return None
            name = version or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
            commit = Commit(base.seq + 1, name, str(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)), None, None,
                            base.partitions, base.schema, {p: d for p, d in base.folders.items() if p not in gone}, base.inputs)
            if self._create(f"{self.path(layer, table)}/_commits/{commit.seq:012d}.json", json.dumps(asdict(commit))):
                return name
        raise CommitConflict(f"{layer}.{table} kept changing")

    # ---- reads -------------------------------------------------------------
    def read(self, layer: str, table: str, version: str | None = None) -> DataFrame:
        base = self.path(layer, table)
        if not self.has_rows_to_read(layer, table):
            raise ValueError(f"{layer}.{table} has no committed data")
        c = self._commit(layer, table, version)
        if c is None and version:
            raise ValueError(f"version {version} of {layer}.{table} is not committed")
        if c is None:  # a plain (history) table without versions
            schema = self.saved_schema(layer, table)
            r = self.spark.read.format(self.fmt)
            return (r.schema(schema) if schema is not None else r).load(base)
        return self.load(layer, table, c)

    def load(self, layer: str, table: str, commit: Commit, only: Iterable[str] | None = None) -> DataFrame:
        """A committed version, or some of its partitions: their folders are
        all that is listed and read."""
        base = self.path(layer, table)
        if commit.buckets:
            name = self._catalog_name(layer, table, commit.version)
            if not self.spark.catalog.tableExists(name):
                self.spark.sql(f"CREATE TABLE {name} USING {self.fmt} CLUSTERED BY ({commit.bucket_col}) "
                               f"SORTED BY ({commit.bucket_col}) INTO {int(commit.buckets)} BUCKETS "
                               f"LOCATION '{base}/v={commit.version}'")
            return self.spark.table(name)
        schema = StructType.fromJson(json.loads(commit.schema))
        reader = self.spark.read.format(self.fmt).schema(schema)
        if not commit.partitions:
            return reader.load(f"{base}/{commit.folders['']}")
        only = None if only is None else set(only)
        by_version: dict[str, list[str]] = {}
        for partition, folder in commit.folders.items():
            if only is None or partition in only:
                by_version.setdefault(folder.split("/", 1)[0], []).append(f"{base}/{folder}")
        if not by_version:
            return self.spark.createDataFrame([], schema)
        if "v" not in schema.names:  # one scan; the version folder's name reads as a column and is dropped
            df = reader.option("basePath", base).load([f for fs in by_version.values() for f in fs])
            return df.select(*schema.names)
        parts = [reader.option("basePath", f"{base}/{v}").load(fs).select(*schema.names) for v, fs in by_version.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read_if_exists(self, layer: str, table: str, schema: StructType | str) -> DataFrame:
        """The table, or an empty frame of ``schema`` when nothing is committed yet."""
        if not self.has_rows_to_read(layer, table):
            return self.spark.createDataFrame([], schema)
        return self.read(layer, table)

    def register_views(self, tables: dict[str, tuple[str, str]]) -> list[str]:
        """Register ``{view: (layer, table)}`` as temp views; missing ones skipped."""
        done = []
        for view, (layer, table) in tables.items():
            if self.has_rows_to_read(layer, table):
                self.read(layer, table).createOrReplaceTempView(view)
                done.append(view)
        return done


def empty_like(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
