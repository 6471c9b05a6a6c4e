"""Exact substring dedup over range-partitioned, locally sorted suffixes.

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts
earlier (smaller id, or same document and smaller offset). That is decided for
suffixes, each by the fingerprints of its two leading half-strings (its leading
tokens): in sorted order of (tokens, id, offset) a suffix repeats if its
predecessor has the same tokens. Only suffixes that can repeat are sorted:

1. *Anchors.* In every string of LENGTH bytes the least hash of its ``GRAM``-byte
   grams marks an anchor (leftmost of equals). Equal strings have their anchor
   at the same place, so a suffix whose anchor gram occurs nowhere else cannot
   repeat. Anchor grams are range-partitioned by sampled splitters, sorted, and
   those in runs of more than one distinct place stay. A run longer than
   ``HEAVY``, or of a gram so frequent in the sample that its rows were split over
   buckets, is *heavy*.
2. *Light suffixes.* The suffixes of one anchor go as one stretch of text,
   range-partitioned by the anchor's gram; each partition is sorted by gram, id
   and offset, and a bounded number of whole grams at a time is ordered by
   multikey quicksort on the tokens.
3. *Heavy suffixes* are pre-aggregated: of equal ones in a slice of a task only
   the first goes on, the others are repeats. The first ones go one by one,
   range-partitioned by sampled splitters on (tokens, id, offset), so that a
   common passage spreads over partitions. Each compares neighbours; the first row of a partition is compared with the last
   row of the one before it.

Exact copies of a text of LENGTH bytes or more are removed whole by digest; only
the copy with the smallest id takes part in the steps above, as its offsets
come first. Intermediate tables are written under the shared checkpoint folder.

Null text counts as empty (no bytes). Rows that share an id are one document
for "earlier"; rows without id stay whole and are no source. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import delete_on_exit, materialize
from ..session import ensure_checkpoint_dir
from .common import slices, text_or_empty
from .hyperminhash import BYTE_CODE, POWERS, mixed

LENGTH, GRAM = 100, 32
#: Grams in one string; rows of a run from which it is heavy.
SPAN, HEAVY = LENGTH - GRAM + 1, 1 << 15
#: Bytes of text per slice, and of stretches that are sorted at a time.
SLICE, STRETCH = 1 << 20, 1 << 20
#: Below every id and offset.
LEAST = -(1 << 63)
#: Anchors sampled per bucket for the splitters.
SAMPLED = 64
HALF = LENGTH // 2


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        x = pick(x[:-k], x[k:])
        k *= 2
    return x if k == width else pick(x[:len(x) - (width - k)], x[width - k:])


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = POWERS.upto(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[:-1], out=sums[1:])
    return sums, down


def fingerprints(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprint of ``width`` bytes from each start."""
    return mixed((sums[starts + width] - sums[starts]) * down[starts])


def grams(buf: np.ndarray) -> np.ndarray:
    sums, down = prefix_sums(buf)
    n = len(buf) - GRAM + 1
    return mixed((sums[GRAM:] - sums[:n]) * down[:n])


def anchor_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least gram hash of each string, and the places that attain one."""
    least = sliding(h, SPAN, np.minimum)
    wide = np.r_[np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)]
    return least, np.flatnonzero(h == sliding(wide, SPAN, np.maximum))


def anchor_of(h: np.ndarray, least: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The anchor of each string: the leftmost place with its least hash."""
    value = h[places]
    at = np.searchsorted(places, np.arange(len(least)))
    late = np.flatnonzero(value[at] != least)
    while len(late):
        at[late] += 1
        late = late[value[at[late]] != least[late]]
    return places[at]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.r_[0, edge], np.r_[edge, len(x)]


def multikey_order(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the tokens in turn (ties keep their order), and whether each
    item in that order has all tokens equal to the one before. Only items that
    tie in the tokens so far are sorted by the next one."""
    order = np.argsort(tokens[0], kind="stable")
    first = tokens[0][order]
    same = np.r_[False, first[1:] == first[:-1]] if len(order) else np.empty(0, bool)
    for token in tokens[1:]:
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        group = np.cumsum(~same[tied])
        sub = order[tied]
        value = token[sub]
        inner = np.lexsort((value, group))  # stable: by tied group, then by this token
        order[tied] = sub[inner]
        value = value[inner]
        same[tied] = same[tied] & np.r_[False, value[1:] == value[:-1]]
    return order, same


def long_rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in columns.values()], list(columns))


class Splitters:
    """Bucket borders (gram, doc, at) from sampled anchors. The same sample
    gives borders by gram alone. A border decides only where a row is sorted."""

    def __init__(self, sample: list[tuple[int, int, int]], buckets: int, rows: float, heavy: int):
        sample = sorted(sample)
        step = max(1, len(sample) // max(buckets, 1))
        count = Counter(g for g, _, _ in sample)
        # a gram lies in one bucket, unless it is expected to have very many rows
        many = {g for g, n in count.items() if n > 1 and n * rows / len(sample) > heavy / 2}
        borders = {b if b[0] in many else (b[0], LEAST, LEAST) for b in sample[step::step]}
        self.full = sorted(borders)[:buckets - 1] if buckets > 1 else []
        self.split = np.array(sorted({g for g, doc, _ in self.full if doc != LEAST}), np.int64)
        grams = sorted({g for g, _, _ in sample})
        step = max(1, len(grams) // max(buckets, 1))
        self.gram = np.array(grams[step::step][:buckets - 1] if buckets > 1 else [], np.int64)
        self.first = np.array([g for g, _, _ in self.full], np.int64)
        self.buckets = buckets

    def of_gram(self, gram: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.gram, gram, "right")

    def of_place(self, gram: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        bucket = np.searchsorted(self.first, gram, "left")
        for i in np.flatnonzero(np.searchsorted(self.first, gram, "right") > bucket).tolist():  # grams that are borders
            bucket[i] = bisect_right(self.full, (int(gram[i]), int(doc[i]), int(at[i])))
        return bucket


def splitters(docs: DataFrame, n_bytes: int, heavy: int) -> Splitters:
    """From about SAMPLED anchors a bucket, of documents chosen by a hash."""
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = 2 * n_bytes / (SPAN + 1)  # anchors to be expected
    share = min(1 / 8, SAMPLED * buckets / max(total, 1))
    some = docs.filter(F.pmod(F.xxhash64("doc", "t"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = anchor_rows(some).select("gram", "doc", "at").collect()  # about SAMPLED x buckets rows
    return Splitters([tuple(r) for r in rows], buckets, total, heavy)


def anchor_rows(docs: DataFrame, split: Splitters | None = None) -> DataFrame:
    """bucket, gram, doc, t, at: every anchor of every text of LENGTH bytes or more."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out = []
                for doc, t, text in zip(*(part.column(c).to_pylist() for c in ("doc", "t", "text"))):
                    data = text.encode()
                    if len(data) >= LENGTH:
                        h = grams(np.frombuffer(data, np.uint8))
                        at = anchor_places(h)[1]
                        out.append((h[at].view(np.int64), np.full(len(at), doc), np.full(len(at), t), at))
                if out:
                    gram, doc, t, at = (np.concatenate(c) for c in zip(*out))
                    bucket = split.of_place(gram, doc, at) if split else np.zeros(len(at))
                    yield long_rows(bucket=bucket, gram=gram, doc=doc, t=t, at=at)

    return docs.mapInArrow(run, "bucket long, gram long, doc long, t long, at long")


def in_buckets(rows: DataFrame, split: Splitters, *order: str) -> DataFrame:
    """Partition k holds bucket k, sorted."""
    return rows.repartitionById(split.buckets, F.col("bucket").cast("int")).sortWithinPartitions(*order)


def shared_anchors(anchors: DataFrame, split: Splitters, heavy_from: int) -> DataFrame:
    """doc, t, at, heavy: anchors whose gram occurs at two distinct places
    (equal places in equal texts are one)."""

    def judged(gram, doc, t, at):
        a, b = runs(gram)
        size = b - a
        differs = np.r_[False, (t[1:] != t[:-1]) | (at[1:] != at[:-1])] if len(t) else np.empty(0, bool)
        differs[a] = False  # rows come sorted by gram, t, at
        across = np.isin(gram[a], split.split)  # its other rows are in other buckets
        shared = (np.add.reduceat(differs, a) > 0) | across
        heavy = (size > heavy_from) | across
        keep = np.repeat(shared, size)
        return long_rows(doc=doc[keep], t=t[keep], at=at[keep], heavy=np.repeat(heavy, size)[keep])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("gram", "doc", "t", "at")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            open_from = runs(cols[0])[0][-1]  # the last run may go on
            if open_from:
                yield judged(*(c[:open_from] for c in cols))
            held = [c[open_from:] for c in cols]
        if held is not None and len(held[0]):
            yield judged(*held)

    return in_buckets(anchors, split, "gram", "t", "at").mapInArrow(run, "doc long, t long, at long, heavy long")


def stretches(chosen: DataFrame, heavy: bool, split: Splitters) -> DataFrame:
    """bucket, gram, doc, t, start, text: per shared anchor the stretch of text
    whose suffixes (all but its last LENGTH - 1 bytes) have that anchor."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out = []
                for doc, t, text, marks in zip(*(part.column(c).to_pylist() for c in ("doc", "t", "text", "marks"))):
                    own = np.array([m >> 1 for m in marks if bool(m & 1) == heavy], np.int64)
                    if not len(own):
                        continue
                    data = text.encode()
                    h = grams(np.frombuffer(data, np.uint8))
                    anchor = anchor_of(h, *anchor_places(h))
                    a, b = runs(anchor)
                    use = np.isin(anchor[a], own)
                    for p, q, g in zip(a[use].tolist(), b[use].tolist(), h[anchor[a[use]]].view(np.int64).tolist()):
                        out.append((g, doc, t, p, data[p:q - 1 + LENGTH]))
                if out:
                    gram, doc, t, p, text = zip(*out)
                    bucket = split.of_gram(np.array(gram, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x, pa.int64()) for x in (bucket, gram, doc, t, p)), pa.array(text, pa.binary())],
                        ["bucket", "gram", "doc", "t", "start", "text"])

    return chosen.mapInArrow(run, "bucket long, gram long, doc long, t long, start long, text binary")


def suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row and offset of every suffix of the stretches, and its two tokens."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = size - LENGTH + 1
    row = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + offset
    sums, down = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
    return row, offset, [fingerprints(sums, down, at, HALF), fingerprints(sums, down, at + HALF, LENGTH - HALF)]


def light_repeats(rows: DataFrame, split: Splitters) -> DataFrame:
    """doc, t, start, stop: bytes covered by repeats, from whole grams at a time."""

    def repeats(part: pa.Table) -> pa.RecordBatch:
        doc, t, start = (part.column(c).to_numpy() for c in ("doc", "t", "start"))
        row, offset, tokens = suffixes(part.column("text").to_pylist())
        order, same = multikey_order(tokens)
        hit = np.zeros(len(row), bool)
        hit[order[same]] = True
        at = np.flatnonzero(hit)
        new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(row[at]) != 0)]) if len(at) else at
        end = np.r_[new[1:], len(at)] - 1 if len(at) else at
        first, last = at[new], at[end]
        r = row[first]
        return long_rows(doc=doc[r], t=t[r], start=start[r] + offset[first], stop=start[r] + offset[last] + LENGTH)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", STRETCH):
                held.append(part)
                size += part.column("text").nbytes
                if size >= STRETCH:
                    rows = pa.Table.from_batches(held)
                    gram = rows.column("gram").to_numpy()
                    whole = runs(gram)[0][-1]  # the last gram may go on
                    if whole:
                        yield repeats(rows.slice(0, whole))
                    rest = rows.slice(whole).combine_chunks()
                    held, size = rest.to_batches(), rest.column("text").nbytes
        if held:
            yield repeats(pa.Table.from_batches(held))

    return in_buckets(rows, split, "gram", "doc", "start").mapInArrow(run, "doc long, t long, start long, stop long")


def heavy_repeats(rows: DataFrame) -> DataFrame:
    """The same for heavy suffixes, which are spread one by one."""

    def spread(batches):
        """Per slice the first of each suffix (stop 0), to be sorted with those
        of all slices, and as spans those that repeat one of the slice."""
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, t, start = (part.column(c).to_numpy() for c in ("doc", "t", "start"))
                by_place = np.lexsort((start, doc))
                doc, t, start = doc[by_place], t[by_place], start[by_place]
                texts = part.column("text").to_pylist()
                row, offset, tokens = suffixes([texts[i] for i in by_place])
                order, same = multikey_order(tokens)  # ties stay in the order of places
                place, first = start[row] + offset, order[~same]
                t0, t1 = (x[first].view(np.int64) for x in tokens)
                yield long_rows(t0=t0, t1=t1, doc=doc[row[first]], t=t[row[first]], start=place[first],
                                stop=np.zeros(len(first)))
                hit = np.zeros(len(row), bool)
                hit[order[same]] = True
                at = np.flatnonzero(hit)
                if len(at):
                    r, p = row[at], place[at]
                    new = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(doc[r]) != 0) | (np.diff(t[r]) != 0)])
                    last = np.r_[new[1:], len(at)] - 1
                    none = np.zeros(len(new))
                    yield long_rows(t0=none, t1=none, doc=doc[r[new]], t=t[r[new]], start=p[new], stop=p[last] + LENGTH)

    def compare(batches):
        """Repeats (kind 0), and the partition's first and last rows (1, 2)."""
        before, place = None, TaskContext.get().partitionId()
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("t0", "t1", "doc", "t", "start")]
            if not len(cols[0]):
                continue
            t0, t1 = cols[:2]
            same = np.r_[before is not None and before[:2] == (t0[0], t1[0]), (t0[1:] == t0[:-1]) & (t1[1:] == t1[:-1])]
            pick = [(0, c) for c in np.flatnonzero(same)]
            if before is None:
                pick.append((1, 0))
            before = tuple(c[-1] for c in cols)
            kind, at = np.array([k for k, _ in pick], np.int64), np.array([c for _, c in pick], np.int64)
            yield long_rows(kind=kind, place=np.full(len(at), place), **{n: c[at] for n, c in zip(
                ("t0", "t1", "doc", "t", "start"), cols)})
        if before is not None:
            yield long_rows(kind=[2], place=[place], **{n: [v] for n, v in zip(("t0", "t1", "doc", "t", "start"), before)})

    layout = "t0 long, t1 long, doc long, t long, start long"
    dealt = materialize(rows.mapInArrow(spread, layout + ", stop long"), "heavy")
    judged = materialize(dealt.filter("stop = 0").drop("stop").repartitionByRange("t0", "t1", "doc", "start")
                         .sortWithinPartitions("t0", "t1", "doc", "start")
                         .mapInArrow(compare, f"kind long, place long, {layout}"), "judged")
    edges = judged.filter("kind > 0").orderBy("place", "kind").collect()  # two rows a partition
    late = [tuple(b[c] for c in ("doc", "t", "start")) for a, b in zip(edges, edges[1:])
            if (a["kind"], b["kind"]) == (2, 1) and (a["t0"], a["t1"]) == (b["t0"], b["t1"])]
    found = judged.filter("kind = 0").select("doc", "t", "start")
    if late:
        found = found.unionByName(rows.sparkSession.createDataFrame(late, "doc long, t long, start long"))
    return found.withColumn("stop", F.col("start") + LENGTH) \
        .unionByName(dealt.filter("stop > 0").select("doc", "t", "start", "stop"))


def remover(batches):
    """doc, t, text, spans -> what is left of each text."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            rows = []
            for doc, t, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc", "t", "text", "spans"))):
                data, kept, stop, n = text.encode(), [], -1, 0
                for s in spans:  # by start; touching and overlapping ones are one
                    if s["start"] > stop:
                        kept.append(data[max(stop, 0):s["start"]])
                        n += 1
                    stop = max(stop, s["stop"])
                rest = b"".join([*kept, data[max(stop, 0):]])
                rows.append((doc, t, len(data) - len(rest), n, rest))
            doc, t, removed, n, rest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (doc, t, removed, n)), pa.array(rest, pa.binary()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())],
                ["doc", "t", "n_removed", "n_spans", "kept", "kept_sha256"])


def sorted_spans(rows: DataFrame) -> DataFrame:
    """Sorted [start, stop) spans per (doc, t); a text bounds their number."""
    parts = F.array_sort(F.collect_set(F.struct("start", "stop")))
    return rows.groupBy("doc", "t").agg(parts.alias("spans"))


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` written under the checkpoint folder as a table bucketed by
    ``keys``: a later join on them does not shuffle these rows again."""
    spark = df.sparkSession
    name = f"strata_bucketed_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    delete_on_exit(spark, path)
    return spark.table(name)


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(all rows: doc, t, n_bytes, sha, copy; what is left of the texts that
    lose bytes and are no copies: doc, t, n_removed, n_spans, kept, kept_sha256)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text).alias("t"), text.alias("text"))
    listed = materialize(rows.select("doc", "t", F.octet_length("text").cast("long").alias("n_bytes"),
                                     F.sha2("text", 256).alias("sha")), "texts")
    firsts = listed.filter((F.col("n_bytes") >= LENGTH) & F.col("doc").isNotNull()).groupBy("sha") \
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("sha", "first")
    listed = materialize(listed.join(firsts, "sha", "left").select(
        "doc", "t", "n_bytes", "sha", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).alias("copy")), "listed")
    known = rows.filter(F.col("doc").isNotNull())
    split = splitters(known, listed.agg(F.sum("n_bytes")).first()[0] or 0, heavy)
    shared = shared_anchors(anchor_rows(known, split), split, heavy)
    marks = shared.groupBy("doc", "t").agg(F.collect_list(F.col("at") * 2 + F.col("heavy")).alias("marks")) \
        .join(listed.filter("copy").select("doc", "t").distinct(), ["doc", "t"], "left_anti")
    chosen = bucketed(rows.join(marks, ["doc", "t"]), ["doc", "t"])
    found = light_repeats(stretches(chosen, False, split), split) \
        .unionByName(heavy_repeats(stretches(chosen, True, split)))
    left = chosen.select("doc", "t", "text").join(sorted_spans(found), ["doc", "t"]) \
        .mapInArrow(remover, "doc long, t long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return listed, left


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    listed, left = removal(docs, id_col, text_col, heavy)
    left = left.drop("kept").dropDuplicates(["doc", "t"])
    out = listed.join(left, ["doc", "t"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    whole = lambda copy, other: F.when(F.col("copy"), copy).otherwise(other)
    return out.select(
        F.col("doc").alias("doc_id"), "n_bytes",
        whole(F.col("n_bytes"), F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        whole(F.lit(1).cast("long"), F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        whole(F.lit(empty), F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
