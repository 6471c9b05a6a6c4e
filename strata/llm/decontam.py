"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become byte strings " w1 w2 ... wn " of lower-cased words; a pattern is
one window of ``window`` consecutive item words in the same form (a shorter
item is one window), so an occurrence always covers whole words. Patterns of
similar length share a table: the *shift table* maps the block of bytes at the
end of the search window to the distance that can be skipped, the
*suffix buckets* (patterns sorted by their last block) give the candidates
where the shift is zero, and a prefix test plus a direct comparison of the
bytes confirm them. Many stretches of the buffer are searched in lock step, so
each step is a handful of numpy calls.

The benchmark is the stated query set. Its distinct rows are read in blocks of
about ``BLOCK_BYTES`` (by a hash of the row; an item longer than that is a block
by itself), each block's tables are broadcast, and the documents are passed once
per block; spans and items add up, so nothing depends on the number of blocks.
One block's tables stand at a time: what a pass has found is written before the
next block is read. Documents are never shuffled.

Null or wordless text: no words, not contaminated. An empty benchmark
contaminates nothing. Repeated items are one pattern with several ids; an item
without id is reported as "null". Repeated document rows are judged each by
itself, and other columns pass through ``drop_contaminated`` untouched.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .common import byte_table, slices, text_or_empty

#: Benchmark bytes whose tables are broadcast at a time.
BLOCK_BYTES = 32 << 20
#: Bytes of the search buffer in one lock-step lane.
LANE = 1 << 13
#: Length classes: patterns of at least so many bytes use blocks of so many.
CLASSES = ((32, 8), (16, 6), (8, 4), (0, 3))
MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that belong to no word: ASCII other than digits and letters.
GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
NORMAL = byte_table(True, GAPS)


def normal(text: str) -> bytes:
    words = text.encode().translate(NORMAL).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(item: bytes, size: int) -> list[bytes]:
    """Windows of a normalised text, each with a blank at both ends."""
    if not item:
        return []
    gap = [i for i, b in enumerate(item) if b == 0x20]
    n = len(gap) - 1
    if n <= size:
        return [item]
    return [item[gap[i]:gap[i + size] + 1] for i in range(n - size + 1)]


def words_at(buf: np.ndarray, width: int) -> np.ndarray:
    """Little-endian integer of the ``width`` bytes from each position (the
    buffer must have 8 spare bytes at its end)."""
    view = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    return view if width == 8 else view & np.uint64((1 << 8 * width) - 1)


class LengthClass:
    """Wu-Manber tables of patterns that use blocks of one width."""

    def __init__(self, patterns: list[bytes], ids: np.ndarray, block: int):
        self.block, self.m = block, min(map(len, patterns))
        self.bits = max(12, min(20, int(np.log2(len(patterns) * (self.m - block + 1))) + 3))
        head = np.frombuffer(b"".join(p[:self.m] + bytes(8) for p in patterns), np.uint8).copy()
        step = self.m + 8
        at = np.arange(len(patterns)) * step
        value = words_at(head, block)
        self.last = self.m - block  # offset of the window's last block
        self.shift = np.full(1 << self.bits, self.last + 1, np.int32)
        for j in range(self.last + 1):
            np.minimum.at(self.shift, self.slot(value[at + j]), self.last - j)
        suffix = value[at + self.last]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.ids = suffix[order], ids[order]
        self.prefix = value[at][order]
        self.patterns = [patterns[i] for i in order]

    def slot(self, value: np.ndarray) -> np.ndarray:
        return (value * MIX) >> np.uint64(64 - self.bits)

    def search(self, buf: np.ndarray, raw: bytes) -> tuple[list[int], list[int]]:
        """(start, pattern id) of every occurrence; ``raw`` is ``buf`` without
        its 8 spare bytes."""
        value = words_at(buf, 8)
        cut = np.uint64((1 << 8 * self.block) - 1)
        stop = len(raw) - self.m + 1
        at = np.arange(0, max(stop, 0), LANE)
        end = np.minimum(at + LANE, stop)
        starts, found = [], []
        while len(at):
            tail = value[at + self.last] & cut
            skip = self.shift[self.slot(tail)]
            zero = np.flatnonzero(skip == 0)
            if len(zero):
                lo = np.searchsorted(self.suffix, tail[zero], "left")
                size = np.searchsorted(self.suffix, tail[zero], "right") - lo
                place = np.repeat(at[zero], size)
                which = np.arange(len(place)) + np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size)
                same = (value[place] & cut) == self.prefix[which]
                for s, k in zip(place[same].tolist(), which[same].tolist()):
                    p = self.patterns[k]
                    if raw[s:s + len(p)] == p:
                        starts.append(s)
                        found.append(int(self.ids[k]))
            at = at + np.maximum(skip, 1)
            going = at < end
            if not going.all():
                at, end = at[going], end[going]
        return starts, found


class Patterns:
    """All windows of a block of items, in length classes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[bytes, set[str]] = {}
        for item_id, text in items:
            for w in windows(normal(text), window):
                owners.setdefault(w, set()).add(item_id)
        self.owners = [sorted(o) for o in owners.values()]
        self.n_words = np.array([p.count(b" ") - 1 for p in owners], np.int64)
        texts, ids, left = list(owners), np.arange(len(owners)), np.arange(len(owners))
        self.classes = []
        for least, block in CLASSES:
            own = np.array([i for i in left if len(texts[i]) >= least], np.int64)
            if len(own):
                self.classes.append(LengthClass([texts[i] for i in own], ids[own], block))
            left = np.setdiff1d(left, own)

    def scan(self, texts: list[str]) -> list[tuple[int, list[int], list[str]]]:
        """Per text: words, disjoint hit spans (flat begin, end words), items."""
        parts = [normal(t) for t in texts]
        out: list[tuple[int, list[int], list[str]]] = [(max(p.count(b" ") - 1, 0), [], []) for p in parts]
        raw = b"".join(parts)  # two blanks meet between texts: no pattern holds that
        buf = np.frombuffer(raw + bytes(8), np.uint8)
        hits = [c.search(buf, raw) for c in self.classes]
        start = np.fromiter(chain.from_iterable(h[0] for h in hits), np.int64)
        which = np.fromiter(chain.from_iterable(h[1] for h in hits), np.int64)
        if not len(start):
            return out
        begins = np.r_[0, np.cumsum([len(p) for p in parts])]
        doc = np.searchsorted(begins, start, "right") - 1
        order = np.lexsort((start, doc))
        start, which, doc = start[order], which[order], doc[order]
        edges = np.flatnonzero(np.r_[True, np.diff(doc) > 0, True])
        for a, b in zip(edges[:-1], edges[1:]):
            d = int(doc[a])
            gap = np.flatnonzero(buf[begins[d]:begins[d + 1]] == 0x20)
            first = np.searchsorted(gap, start[a:b] - begins[d])
            last = np.maximum.accumulate(first + self.n_words[which[a:b]])
            new = np.flatnonzero(np.r_[True, first[1:] > last[:-1]])
            spans = np.c_[first[new], last[np.r_[new[1:], len(last)] - 1]].ravel().tolist()
            items = sorted(set().union(*(self.owners[k] for k in set(which[a:b].tolist()))))
            out[d] = (out[d][0], spans, items)
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in blocks of about BLOCK_BYTES: lists of (id, text)."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
                            text_or_empty(text_col).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in part.toLocalIterator()]


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with three more columns (their names are returned): words,
    hit spans [[begin, end), ...] in words, and ids of the occurring items."""
    words, spans, items = (free_name(docs, f"scan_{x}") for x in ("words", "spans", "items"))
    out = docs.withColumns({words: F.lit(0).cast("long"), spans: F.array().cast("array<int>"),
                            items: F.array().cast("array<string>")})
    spark = docs.sparkSession
    patterns = None
    for block in item_blocks(benchmark, item_id, item_text):
        if patterns is not None:
            out = materialize(out, "scanned")
            patterns.destroy()
        patterns = spark.sparkContext.broadcast(Patterns(block, window))

        def run(batches, patterns=patterns):
            for batch in batches:
                text = batch.column(text_col).cast(pa.string())
                full = pa.RecordBatch.from_arrays([text, *batch.columns], ["", *batch.schema.names])
                for part in slices(full, ""):
                    found = patterns.value.scan([t or "" for t in part.column(0).to_pylist()])
                    cols = dict(zip(batch.schema.names, part.columns[1:]))
                    cols[words] = pa.array([f[0] for f in found], pa.int64())
                    for name, k, kind in ((spans, 1, pa.int32()), (items, 2, pa.string())):
                        if any(f[k] for f in found):
                            cols[name] = pa.array([a + f[k] for a, f in zip(cols[name].to_pylist(), found)],
                                                  pa.list_(kind))
                    yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        out = out.mapInArrow(run, out.schema)
    return out, (words, spans, items)


def hit_words(spans):
    """Words in the union of flat (begin, end) spans."""
    n = (F.size(spans) / 2).cast("int")
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(spans, 2 * i).alias("a"), F.get(spans, 2 * i + 1).alias("b"))))
    total = F.aggregate(
        pairs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], acc["end"]))).alias("n"),
            F.greatest(p["b"], acc["end"]).alias("end")))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(total["n"])


def is_contaminated(n_hit, n_words):
    """The contract's rule: at least one word in 20 is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id",
                    **names) -> DataFrame:
    """One row per document: words, hit words, items, and the verdict."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(names.get("text_col", "text")).alias("text"))
    out, (words, spans, items) = scanned(rows, benchmark, window, **{**names, "text_col": "text"})
    ids = F.array_sort(F.array_distinct(F.col(items)))
    out = out.select("doc_id", F.col(words).alias("n_words"), hit_words(F.col(spans)).alias("n_hit"),
                     F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("items"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"),
                      is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, **names) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    out, (words, spans, _) = scanned(docs, benchmark, window, **names)
    return out.filter(~is_contaminated(hit_words(F.col(spans)), F.col(words))).select(*docs.columns)
