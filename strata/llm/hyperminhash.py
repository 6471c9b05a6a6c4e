"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct word shingles, hashed to 64 bits. Its sketch
has ``BUCKETS`` registers; a register keeps, for the least hash in its bucket,
the count of leading zeros and ``MANTISSA`` bits after them (16 bits in all).

1. Documents with equal sets are one class (digest of the set), one node of the
   link graph; its representative is the row with the smallest id. A group of
   copies costs one row.
2. Bands of ``ROWS`` registers are the search keys. An empty register borrows
   from a used one, in an order fixed per register; without that a band of a
   short text would hold one shingle, and any common line would make a key. A
   pair at the similarity threshold misses all bands with a probability of
   about 4e-6, and one at 0.85 with less than 1e-12.
3. Keys with several nodes are stars: every member is paired with the key's
   centre, the member with the most company, and of these pairs each node tries
   the one with most bands in common. A pair is first estimated from the
   sketches, with the chance of equal registers of different hashes taken out;
   unless it is far below the threshold (six standard deviations and six
   registers: fewer than 1e-9 of the pairs at the threshold), it is confirmed on
   the full sets, recomputed from the whole texts.
4. Links are joined to components (hook the larger root to the smaller,
   contract, repeat). Keys whose members are all in one component are done. In
   the others, members of different components are compared in cells: a key's
   members are dealt into blocks, every two blocks make a cell, and a cell has
   the members' sketches and their whole sets. A pair is judged in the cell of
   its first common band only, confirmed there, and the cell's components grow
   as links are found, so it puts out a spanning forest of confirmed links; what
   is rejected leaves no row. A group of m near copies costs m rows per band and
   block, of which there is one for about CELL members, and at most m links a
   cell; pairs that are connected already are never tested, all others are.

Every intermediate table is written under the shared checkpoint folder.
Null, empty and blank texts have an empty set and are linked with nothing.
Rows that share an id are judged each by its own text (their components are
told by id, so a component's name can be the id of several texts, but no text
is dropped for another text's sake); rows without id are linked with nothing and
kept. Rows that repeat both id and text are one document: they stay or go
together. An empty table gives no rows; other columns are ignored, or pass
through ``keep_first`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .common import byte_table, slices, text_or_empty

SHINGLE = 5
#: Similarity in percent from which documents are linked.
THRESHOLD = 75
BUCKETS, ROWS, MANTISSA = 384, 6, 10
BANDS = BUCKETS // ROWS
#: Standard deviations, and registers, below the threshold at which an estimate rules a pair out.
MARGIN, REGISTERS = 6.0, 6
SLICE = 1 << 20
#: Members of a block, and the hashes of their sets; a cell holds two blocks.
CELL, CELL_HASHES = 1024, 1 << 20

LOWERED = byte_table(True, b"")
BASE = 0x9E3779B97F4A7C15
BYTE_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = getattr(self, name)
                setattr(self, name, np.r_[p, p * np.uint64(pow(base, k, 1 << 64))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A shingle's bytes (words
    joined by one blank) are a difference of two prefix sums of the buffer."""
    parts = [b" ".join((t or "").encode().translate(LOWERED).split()) for t in texts]
    raw = b" ".join(parts)
    if not raw:
        return [np.empty(0, np.uint64)] * len(parts)
    buf = np.frombuffer(raw, np.uint8)
    up, down = POWERS.upto(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[:-1], out=sums[1:])
    out, at = [], 0
    for p in parts:
        if not p:
            out.append(np.empty(0, np.uint64))
        else:
            gap = np.flatnonzero(buf[at:at + len(p)] == 0x20) + at
            a, b = np.r_[at, gap + 1], np.r_[gap, at + len(p)]
            if len(a) >= size:
                a, b = a[:len(a) - size + 1], b[size - 1:]
            else:
                a, b = a[:1], b[-1:]
            out.append(np.unique(mixed((sums[b] - sums[a]) * down[a])))
        at += len(p) + 1
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set (sorted hashes): 0 is empty, else leading zeros + 1
    of the bucket's least hash, then its next MANTISSA bits."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)  # ascending like the hashes
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        least = np.minimum.reduceat(mixed(hashes ^ np.uint64(BASE)), first)
        bits = np.maximum(least, np.uint64(1)).astype(np.float64).view(np.uint64)
        exponent = (bits >> np.uint64(52)).astype(np.int64) - 1023
        tail = (bits >> np.uint64(52 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
        out[bucket[first].astype(np.int64)] = (np.maximum(64 - exponent, 1) << MANTISSA) | tail
    return out


#: Registers that an empty register asks in turn.
ASKED = (mixed(np.arange(1, 64 * BUCKETS + 1, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64).reshape(64, BUCKETS)


def densified(registers: np.ndarray) -> np.ndarray:
    """Registers in which empty ones have borrowed (all empty stays so)."""
    out = registers.copy()
    for asked in ASKED:
        empty = np.flatnonzero(out == 0)
        if not len(empty):
            return out
        out[empty] = registers[asked[empty]]
    used = np.flatnonzero(registers)
    if len(used):  # a few left: the next used one to the right
        empty = np.flatnonzero(out == 0)
        out[empty] = registers[used[np.searchsorted(used, empty) % len(used)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key per band; none for the empty set."""
    if not registers.any():
        return np.empty(0, np.int64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(BASE)
    for column in densified(registers).astype(np.uint64).reshape(BANDS, ROWS).T:
        key = mixed(key + column)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of registers, and its standard deviation
    at the threshold; ``sizes`` is the sum of both sets' sizes. Of registers
    that differ in their hashes a share of about 2**-MANTISSA / 3 is equal by
    chance; it is taken out. The used registers are a sample without
    replacement of the union, so for short texts, most of whose shingles have a
    register of their own, the deviation is small."""
    used = np.maximum(((a != 0) | (b != 0)).sum(axis=1), 1)
    same = ((a == b) & (a != 0)).sum(axis=1) / used
    chance = 2.0 ** -MANTISSA / 3
    t = THRESHOLD / 100
    union = np.maximum(sizes / (1 + t), 1)
    left_out = np.clip((union - used) / union, 0, 1)
    return (same - chance) / (1 - chance), np.sqrt(t * (1 - t) / used * left_out) + REGISTERS / (MARGIN * used)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc, mark, text) -> doc, mark, n_shingles, digest of the set, band keys."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                             pa.binary()),
                    pa.array([band_keys(sketch(s)) for s in sets], pa.list_(pa.int64()))],
                    ["doc", "mark", "n_shingles", "digest", "keys"])

    return docs.mapInArrow(run, "doc long, mark string, n_shingles long, digest binary, keys array<long>")


def with_registers(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64())], ["doc", "text", "regs", "size"])

    return docs.mapInArrow(run, "doc long, text string, regs binary, size long")


def side(texts: DataFrame, name: str, *columns: str) -> DataFrame:
    return texts.select(F.col("doc").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))


def possible(a: np.ndarray, b: np.ndarray, size_a, size_b) -> np.ndarray:
    """Pairs that their sizes and their sketches don't rule out."""
    j, deviation = estimate(a, b, size_a + size_b)
    return (100 * np.minimum(size_a, size_b) >= THRESHOLD * np.maximum(size_a, size_b)) \
        & (j >= THRESHOLD / 100 - MARGIN * deviation)


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), np.uint16).reshape(-1, BUCKETS)
                    for c in ("regs_a", "regs_b"))
            ok = possible(a, b, batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b").join(side(texts, "b", "regs", "size"), "b").join(side(texts, "a", "regs", "size"), "a") \
        .select("a", "b", "regs_a", "regs_b", "size_a", "size_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""

    def run(batches):
        last, own = None, None
        for batch in batches:
            for part in slices(batch, "text_b", SLICE):
                sets = shingle_sets(part.column("text_b").to_pylist())
                ok = []
                for a, text, s in zip(part.column("a").to_pylist(), part.column("text_a"), sets):
                    if a != last:  # rows come sorted by a, the centre of many pairs
                        last, own = a, shingle_sets([text.as_py()])[0]
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    ok.append(100 * both >= THRESHOLD * (len(own) + len(s) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(pairs, "likely").join(side(texts, "b", "text"), "b").join(side(texts, "a", "text"), "a") \
        .select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def with_sets(docs: DataFrame) -> DataFrame:
    """(doc, text, regs) -> doc, regs, the sorted hashes of the whole set."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("regs"),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "regs", "hashes"])

    return docs.mapInArrow(run, "doc long, regs binary, hashes binary")


def first_common_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of densified registers (one row against many): the first band in which
    all registers are equal, or BANDS."""
    equal = (a == b).reshape(len(b), BANDS, ROWS).all(axis=2)
    return np.where(equal.any(axis=1), equal.argmax(axis=1), BANDS)


def linked_to(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are linked to ``own``, by their whole sizes."""
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
    both = np.add.reduceat((own[at] == joined).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))
    union = len(own) + np.array([len(o) for o in others]) - both
    return 100 * both >= THRESHOLD * union


def across(rows: pa.Table) -> pa.RecordBatch:
    """A spanning forest of the links between components within one cell of a
    key: among all its rows, or, in a cell of two blocks, between the blocks."""
    doc, label, size, own = (rows.column(c).to_numpy() for c in ("doc", "label", "size", "own"))
    i, j, band = (rows.column(c)[0].as_py() for c in ("i", "j", "band"))
    regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
    dense = np.stack([densified(r) for r in regs])
    sets = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
    label, found = label.copy(), []
    for x in np.flatnonzero(own == i).tolist():
        other = np.flatnonzero((label != label[x]) & ((own == j) if i != j else (doc > doc[x])))
        if len(other):
            other = other[possible(regs[x][None], regs[other], size[x], size[other])]
        if len(other):
            other = other[first_common_band(dense[x][None], dense[other]) == band]
        if len(other):
            for y in other[linked_to(sets[x], [sets[y] for y in other.tolist()])].tolist():
                if label[y] != label[x]:
                    found.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
                    label[label == label[y]] = label[x]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links_across(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between different components that share a key,
    enough to connect what is linked. A key's members are dealt by hash into
    blocks, and every pair of blocks is one cell, so a key with very many
    members is many cells."""

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begins = [0, *edge.tolist()]
            for a, b in zip(begins[:-1], begins[1:]):
                yield across(rows.slice(a, b - a))
            held = rows.slice(begins[-1]).combine_chunks()  # the last cell may go on
        if held is not None and held.num_rows:
            yield across(held)

    many = F.ceil(F.greatest(F.count("*") / CELL, F.sum("size") / CELL_HASHES))
    blocks = members.join(members.groupBy("key").agg(many.alias("blocks")), "key") \
        .withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = materialize(with_sets(texts.join(members.select("doc").distinct(), "doc", "left_semi").select("doc", "text", "regs")), "sets")
    cells = blocks.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                          "own", "doc", "label", "size").join(sets, "doc")
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j") \
        .mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the component's
    least node. Each round hooks every root to its least smaller neighbour,
    flattens the chains, and contracts the edges to roots."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .filter("a < b").distinct(), "edges")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        hook = materialize(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hook")
        while True:  # pointer jumping
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialize(hook.join(up, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jump")
            hook = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        to = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = materialize(roots.join(to, "root", "left")
                            .select("node", F.coalesce("top", "root").alias("root")), "roots")
        for end in ("a", "b"):
            to = hook.select(F.col("node").alias(end), F.col("root").alias("top"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
        edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                            .filter("a < b").distinct(), "edges")
    return roots


def labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("label", F.col("doc"))
    return members.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left") \
        .select("key", "band", "doc", "size", F.coalesce("root", "doc").alias("label"))


def open_members(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members, with labels, of keys that hold more than one component."""
    rows = labelled(members, roots)
    ends = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    return rows.join(ends.select("key"), "key").select("key", "band", "doc", "size", "label")


def linked_roots(members: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components of the link graph over the members of shared keys: first by
    the given pairs, then by all possible links between what they left apart."""
    links = materialize(confirmed(likely(pairs, texts), texts), "links")
    roots = components(links)
    apart = materialize(open_members(members, roots), "open")
    more = materialize(links_across(apart, texts), "links")
    return roots if more.isEmpty() else components(links.unionByName(more))


def first_tries(members: DataFrame) -> DataFrame:
    """One pair per document: with the centre that it meets in most keys. The
    centre of a key is its member with the most company over all keys: the
    original of a group of copies, which is closer to each than they are to
    each other (ties: the smallest id)."""
    company = members.groupBy("doc").agg(F.sum("n").alias("company"))
    central = members.join(company, "doc").groupBy("key") \
        .agg(F.max(F.struct("company", (-F.col("doc")).alias("minus"))).alias("m")) \
        .select("key", (-F.col("m.minus")).alias("centre"))
    met = members.join(central, "key").filter("doc != centre").groupBy("doc", "centre").agg(F.count("*").alias("n"))
    best = met.groupBy("doc").agg(F.max(F.struct("n", (-F.col("centre")).alias("minus"))).alias("m"))
    return best.select((-F.col("m.minus")).alias("a"), F.col("doc").alias("b"))


def judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc, mark (of the text), n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text")) \
        .withColumn("mark", F.md5("text"))
    sets = materialize(sketches(rows), "sketches")
    known = sets.filter(F.col("digest").isNotNull() & F.col("doc").isNotNull())
    # a class of equal sets is a node; its representative is the first row by id. Nodes
    # are numbered where they are written: any number will do, but it must be unique
    classes = materialize(known.groupBy("digest").agg(
        F.min(F.struct("doc", "mark")).alias("r"), F.first("keys").alias("keys"), F.first("n_shingles").alias("size"))
        .select("digest", F.monotonically_increasing_id().alias("node"), "r.doc", "r.mark", "keys", "size"), "classes")
    keyed = classes.select(F.posexplode("keys").alias("band", "key"), F.col("node").alias("doc"), "size")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")) \
        .filter("lo < hi")
    members = materialize(keyed.join(shared.select("key", "n"), "key").select("key", "band", "doc", "size", "n"), "members")
    used = classes.join(members.select(F.col("doc").alias("node")).distinct(), "node", "left_semi").select("node", "doc", "mark")
    found = rows.join(used, ["doc", "mark"]).select(F.col("node").alias("doc"), "text")
    if not sets.groupBy("doc", "mark").count().filter("count > 1").isEmpty():  # rows that repeat id and text
        found = found.groupBy("doc").agg(F.first("text").alias("text"))
    texts = materialize(with_registers(found), "texts")
    tries = first_tries(members)
    roots = linked_roots(members.select("key", "band", "doc", "size"), texts, tries)
    named = classes.join(roots.select("node", "root"), "node", "left") \
        .select("digest", "doc", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    top = named.join(first, "root").select("digest", "component_id")
    return sets.join(top, "digest", "left").select(
        "doc", "mark", "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"),
        F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return judged(docs, id_col, text_col).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of every group, with its columns as they are. What
    goes is told by id and text, so another text under the same id stays."""
    mark = "mark"
    while mark.lower() in {c.lower() for c in docs.columns}:
        mark += "_"
    dropped = judged(docs, id_col, text_col).filter("not kept").select(
        F.col("doc").alias("_dropped"), F.col("mark").alias("_dropped_mark")).distinct()
    rows = docs.withColumn(mark, F.md5(text_or_empty(text_col)))
    return rows.join(dropped, (F.col(id_col) == F.col("_dropped")) & (F.col(mark) == F.col("_dropped_mark")), "left_anti") \
        .select(*docs.columns)
