"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes has its
top ``MASK_BITS`` bits zero, at least ``LEAST`` and at most ``MOST`` bytes after
the previous cut. Cuts depend on content only, so an insertion moves the
chunks around it and no others. Every chunk is identified by a 128-bit digest;
its first occurrence (smallest id, then position) stays, and later ones are
repeats. A repeat is removed when it lies in a run of adjacent repeats of at
least ``RUN`` bytes: single short chunks that happen to recur stay.

The gear hash is h = (h << 1) + G[byte]; over 32 bits it is a sum of the last 32
table values with shifts, built for all positions by doubling. Chunks are
pre-aggregated by digest in each task before the shuffle; digests that occur
once are dropped there, and the others join the chunks (a hot digest's
partition of chunks can be split, its partner is one row).

Null text counts as empty (no chunks). An empty table gives no rows. Rows without
id have no place in the order: they are no source and lose nothing. Rows that
share an id are told apart by a hash of their text, in whose order they come;
rows that repeat id and text are one document, of which each keeps the same.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Bits of the gear hash that are zero at a cut; least and most bytes of a chunk.
MASK_BITS, LEAST, MOST = 4, 16, 256
#: Bytes from which a run of adjacent repeats is removed.
RUN = 96
GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(buf: np.ndarray) -> np.ndarray:
    """Gear hash (32 bits) after each byte, from at most 32 bytes back."""
    h = GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if not n:
        return []
    h = gear_hash(np.frombuffer(data, np.uint8))
    out, last = [], 0
    for c in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): the tag tells rows apart that share an id; it is 0
    when no id occurs twice, and then costs next to nothing in a shuffle."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc")).filter("doc IS NOT NULL")
    shared = not ids.groupBy("doc").count().filter("count > 1").isEmpty()
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc"),
                       (F.xxhash64(text) if shared else F.lit(0).cast("long")).alias("tag"), text.alias("text"))


def chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk of the tagged rows with an id: doc, tag, start, length, digest (d1, d2)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                doc, tags, start, size, digest = [], [], [], [], []
                for i, tag, text in zip(*(c.to_pylist() for c in part.columns)):
                    data = text.encode()
                    a = 0
                    for b in cuts(data):
                        doc.append(i)
                        tags.append(tag)
                        start.append(a)
                        size.append(b - a)
                        digest.append(hashlib.blake2b(data[a:b], digest_size=16).digest())
                        a = b
                d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(tags, pa.int64()), pa.array(start, pa.int32()),
                     pa.array(size, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                    ["doc", "tag", "start", "length", "d1", "d2"])

    return rows.filter("doc IS NOT NULL").mapInArrow(run, "doc long, tag long, start int, length int, d1 long, d2 long")


def repeats(pieces: DataFrame) -> DataFrame:
    """The chunks that occur earlier: same columns without the digest."""
    place = F.struct("doc", "tag", "start")
    first = pieces.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")) \
        .filter("n > 1").select("d1", "d2", "first")
    return pieces.join(first, ["d1", "d2"]).filter(place != F.col("first")).select("doc", "tag", "start", "length")


def removed_spans(repeated: DataFrame, least: int = RUN) -> DataFrame:
    """Per document: array of [start, end) byte spans to remove, from
    runs of adjacent repeats. A document's repeats are bounded by its text."""
    ordered = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))))
    # a run begins where a part does not begin at the end of the one before
    parts = F.col("parts")
    begins = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: (k == 0) | (
        F.get(parts, k)["start"] != F.get(parts, k - 1)["stop"]))
    runs = F.transform(F.col("begins"), lambda k, i: F.struct(
        F.get(parts, k)["start"].alias("start"),
        F.get(parts, F.coalesce(F.get(F.col("begins"), i + 1), F.size(parts)) - 1)["stop"].alias("stop")))
    grouped = repeated.groupBy("doc", "tag").agg(ordered.alias("parts"), F.count("*").alias("n_repeats")) \
        .withColumn("begins", begins)
    return grouped.select("doc", "tag", "n_repeats", F.filter(
        runs, lambda s: s["stop"] - s["start"] >= least).alias("spans"))


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_repeats (repeated chunks),
    n_removed (bytes), n_spans, spans (start:end in bytes, comma-joined)."""
    rows = tagged(docs, id_col, text_col)
    spans = removed_spans(repeats(chunks(rows)))
    out = rows.select("doc", "tag", F.octet_length("text").cast("long").alias("n_bytes")).join(spans, ["doc", "tag"], "left")
    cut = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))
    return out.select(
        F.col("doc").alias("doc_id"), "n_bytes", F.coalesce("n_repeats", F.lit(0)).cast("long").alias("n_repeats"),
        F.aggregate(cut, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.size(cut).cast("long").alias("n_spans"),
        F.array_join(F.transform(cut, lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("spans"))


def keep_bytes(data: bytes, spans: list) -> str:
    """``data`` without the spans; characters cut in half are dropped."""
    at, kept = 0, []
    for s in spans:
        kept.append(data[at:s["start"]])
        at = s["stop"]
    return b"".join([*kept, data[at:]]).decode("utf-8", "ignore")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id, text only) with the repeated runs cut out of the texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                # spans come as structs of start and stop
                texts = [t if not s else keep_bytes(t.encode(), s) for t, s in zip(
                    part.column("text").to_pylist(), part.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(texts, pa.string())], [id_col, text_col])

    rows = tagged(docs, id_col, text_col)
    spans = removed_spans(repeats(chunks(rows))).select("doc", "tag", "spans")
    return rows.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans") \
        .mapInArrow(run, f"`{id_col}` long, `{text_col}` string")
