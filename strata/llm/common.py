"""Shared pieces of the training-data operators."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one task holds as Python or numpy objects at a time.
SLICE_BYTES = 4 << 20

#: ASCII upper-case letters and their lower-case forms.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: The white space of the word contracts, [\x20\x09-\x0D].
BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"


#: Repository folder, and the applications that were given the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package where they would not find it: unless
    the JVM's PYTHONPATH or working folder has it, it is added as a py-file."""
    system = spark.sparkContext._jvm.java.lang.System
    known = [*(system.getenv("PYTHONPATH") or "").split(os.pathsep), system.getProperty("user.dir") or ""]
    app = spark.sparkContext.applicationId
    if app in SHIPPED or ROOT in map(os.path.realpath, filter(None, known)):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="strata-package-"), "strata_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "strata")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(archive)
    SHIPPED.add(app)


def shipped(fn):
    """A query or stage whose workers can import this package."""
    @functools.wraps(fn)
    def run(spark, *args):
        ship_package(spark)
        return fn(spark, *args)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def byte_table(lower: bool, blanks: bytes) -> bytes:
    """256-byte translation: ASCII letters lower-cased, ``blanks`` to a space.
    Bytes of multi-byte characters are all over 0x7F and stay."""
    t = bytearray(range(256))
    if lower:
        for a, b in zip(UPPER, LOWER):
            t[a] = b
    for b in blanks:
        t[b] = 0x20
    return bytes(t)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that one slice holds about ``most`` bytes of
    ``column`` (a single longer value makes a slice of its own)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin)
