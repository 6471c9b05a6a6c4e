"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: the digest of its fields. Leaves form one tree per group
(``lang``), in ascending order of their id, and the trees' roots, in bytewise
order of the groups, form one more tree on top. A node's label is (last leaf
below it, level): in label order every child comes before its parent.

* Forward sweep: nodes are visited in label order. A node takes the digests
  that its children have sent it from a priority queue ordered by label, and
  sends its own digest to its parent. The queue holds one path of messages.
* Reversed sweep: nodes are visited in descending order. A node takes its proof
  suffix from the queue and sends each child the sibling's digest and the suffix.

The queue is external: a group of trees is cut into blocks of ``2 ** LEVELS``
leaves by position, the messages between blocks are a table that Spark deals to
the receiving block, and one task sweeps one block at a time. Blocks have equal
sizes whatever the groups are, so a group that holds most rows is many blocks;
n leaves take about log(n) / LEVELS rounds, a few for any corpus.

Positions come from a range partitioning by (group, id, leaf): the rows of a
partition are numbered where they lie and the partitions' counts summed.

Defined results: a null field counts as ``-``; a null group comes first, a null
id before all others of its group; rows that share an id are leaves each, in the
order of their digests (equal ones have the same digests in any order); an empty
table gives no rows; the columns not named as fields are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.materialize import materialize

#: A block has 2 ** LEVELS leaves; a task holds the nodes of one block at a time.
LEVELS = 12
#: Fields of a leaf, in the order in which they are digested.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64

NODE = "tree string, idx long, n long, digest string"
SENT = "tree string, idx long, suffix string, head string, rank long, trees long"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


class Block:
    """One block of a tree of ``n`` leaves: positions ``first`` to ``first + len(leaves)``."""

    def __init__(self, first: int, n: int, leaves: list[str], levels: int):
        self.first, self.n, self.leaves = first, n, leaves
        self.top = min(height(n), levels)

    def label(self, level: int, i: int) -> tuple[int, int]:
        return min((i + 1) << level, self.n) - 1, level

    def forward(self, keep: dict | None = None) -> str:
        """The digest of the block's top node; ``keep`` takes those of all nodes."""
        queue: list = []
        for at, own in enumerate(self.leaves, self.first):
            heapq.heappush(queue, (*self.label(0, at), at, own))
            while queue and queue[0][0] <= at:  # every node up to the label (at, any level) has its messages
                end, level, i, got = heapq.heappop(queue)
                while queue and queue[0][:2] == (end, level):  # the right child's
                    got += heapq.heappop(queue)[3]
                node = (i >> 1 if level else i)
                mine = digest(got) if level else got
                if keep is not None:
                    keep[level, node] = mine
                if level == self.top:
                    return mine
                heapq.heappush(queue, (*self.label(level + 1, node >> 1), node, mine))
        raise ValueError("the block has no leaves")

    def reversed(self, suffix: str):
        """(position, proof) of every leaf, last one first."""
        nodes: dict = {}
        self.forward(nodes)
        top = (self.top, self.first >> self.top)
        end, level = self.label(*top)
        queue = [(-end, -level, top[1], suffix)]
        while queue:
            end, level, i, suffix = heapq.heappop(queue)
            if level == 0:
                yield i, suffix
                continue
            below = -level - 1
            for child in (2 * i, 2 * i + 1):
                if (below, child) in nodes:
                    to = self.label(below, child)
                    heapq.heappush(queue, (-to[0], -to[1], child, nodes.get((below, child ^ 1), "") + suffix))


def folded(start: str, proof: str, *paths: tuple[int, int]) -> str:
    """The root that a leaf digest and its siblings lead to; a path is the
    position in a tree and its number of leaves, from the leaf's tree upwards."""
    at = 0
    for i, n in paths:
        while n > 1:
            if i ^ 1 < n:
                sibling = proof[at:at + HEX]
                at += HEX
                start = digest(sibling, start) if i & 1 else digest(start, sibling)
            else:
                start = digest(start)
            i, n = i >> 1, (n + 1) >> 1
    return start


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (with a ``tree``) and their position ``idx`` among the tree's
    ``n`` rows. Ties are broken by the row's place, so equal rows are dealt out too."""
    columns = rows.columns

    def number(batches):
        part, tree, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for t in batch.column("tree").to_pylist():
                at = at + 1 if t == tree else 0
                tree = t
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())],
                [*columns, "part", "at"])

    keys = [F.col("tree").asc_nulls_first(), *order, F.col("place").asc()]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys) \
        .select(*columns)
    numbered = materialize(dealt.mapInArrow(number, StructType([*dealt.schema, StructField("part", IntegerType()), StructField("at", LongType())])), name)
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("tree").orderBy("part")
    offsets = materialize(counts.select(
        "tree", "part", (F.sum("c").over(before) - F.col("c")).alias("offset"),
        F.sum("c").over(Window.partitionBy("tree")).alias("n")), name)  # a row per partition and tree
    return numbered.join(offsets, ["tree", "part"]).select(*columns, (F.col("offset") + F.col("at")).alias("idx"), "n")


def blocks(nodes: DataFrame, levels: int):
    return nodes.withColumn("block", F.shiftright("idx", levels)).groupBy("tree", "block")


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def up(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The forward sweep of one round: the blocks' top nodes as next leaves."""

    def sweep(key, table):
        tree, block = (k.as_py() for k in key)
        n = table.column("n")[0].as_py()
        top = Block(block << levels, n, in_order(table).column("digest").to_pylist(), levels).forward()
        return pa.table({"tree": pa.array([tree], pa.string()), "idx": pa.array([block], pa.int64()),
                         "n": pa.array([-(-n >> levels)], pa.int64()), "digest": pa.array([top], pa.string())})

    return blocks(nodes.select("tree", "idx", "n", "digest"), levels).applyInArrow(sweep, NODE)


def down(nodes: DataFrame, sent: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The reversed sweep of one round: every node's proof suffix, from those
    of the blocks' top nodes; what else is sent along is passed on."""

    def sweep(key, table, message):
        n = table.column("n")[0].as_py()
        table = in_order(table)
        head = {c: message.column(c)[0].as_py() for c in ("suffix", "head", "rank", "trees")}
        block = Block(key[1].as_py() << levels, n, table.column("digest").to_pylist(), levels)
        suffixes = [s for _, s in sorted(block.reversed(head["suffix"]))]
        many = len(suffixes)
        return pa.table({"tree": table.column("tree"), "idx": table.column("idx"),
                         "suffix": pa.array(suffixes, pa.string()), "head": pa.array([head["head"]] * many, pa.string()),
                         "rank": pa.array([head["rank"]] * many, pa.int64()),
                         "trees": pa.array([head["trees"]] * many, pa.int64())})

    return blocks(nodes.select("tree", "idx", "n", "digest"), levels).cogroup(
        sent.withColumn("block", F.col("idx")).groupBy("tree", "block")).applyInArrow(sweep, SENT)


def rounds(nodes: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """The node tables of all rounds; the last has one node per tree."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        out.append(materialize(up(out[-1], levels), name))
    return out


def leaves(docs: DataFrame, fields=FIELDS, tree: str = "lang", ident: str = "doc_id",
           changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(doc_id, tree, digest, altered): one row per row of ``docs``. ``altered``
    is the digest with the fields of ``changed`` replaced where ``where`` holds,
    else null. The tree's key is empty for null and else ``=`` and the value."""
    row = docs.select(*fields) if ident in fields and tree in fields else docs
    values = [F.col(c) for c in fields]
    altered = F.lit(None).cast("string")
    if changed:
        altered = F.when(where, leaf_digest([changed.get(c, F.col(c)) for c in fields]))
    return row.select(F.col(ident).alias("doc_id"),
                      F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"),
                      leaf_digest(values).alias("digest"), altered.alias("altered"))


def manifest(rows: DataFrame, with_proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """Of the rows of ``leaves``: doc_id, leaf, subroot, root, proof_sha256,
    folded_root (from the altered leaf where there is one) and verified; with
    ``with_proofs`` also the proof itself and the positions (idx of n leaves,
    rank of trees) that a verifier needs."""
    given = materialize(rows, "leaves")
    nodes = materialize(ranked(given, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("altered")], "ranked"), "nodes")
    layers = rounds(nodes, "nodes", levels)
    subroots = layers[-1]
    top = materialize(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"),
                             [F.col("key")], "trees"), "trees")
    top_layers = rounds(top.select("tree", "idx", "n", "digest"), "tops", levels)
    sent = top_layers[-1].select("tree", "idx", F.lit("").alias("suffix"), F.col("digest").alias("head"),
                                 F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("trees"))
    for layer in reversed(top_layers[:-1]):
        sent = down(layer, sent, levels)
    # a tree's message: the suffix of its subroot, subroot and root, its rank
    sent = materialize(top.withColumnRenamed("n", "all").join(
        sent.select("idx", "suffix", "head"), "idx").select(
        F.col("key").alias("tree"), F.lit(0).cast("long").alias("idx"), "suffix",
        F.concat("digest", "head").alias("head"), F.col("idx").alias("rank"), F.col("all").alias("trees")), "sent")
    for layer in reversed(layers[1:-1]):
        sent = down(layer, sent, levels)
    return proofs(nodes, sent, with_proofs, levels)


def proofs(nodes: DataFrame, sent: DataFrame, with_proofs: bool, levels: int = LEVELS) -> DataFrame:
    """The last reversed sweep: proofs of the leaves, folded again to roots."""
    kind = nodes.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, " \
        "folded_root string, verified boolean"
    if with_proofs:
        schema += ", proof string, idx long, n long, rank long, trees long"

    def sweep(key, table, message):
        n = table.column("n")[0].as_py()
        table = in_order(table)
        own = table.column("digest").to_pylist()
        head, rank, trees = (message.column(c)[0].as_py() for c in ("head", "rank", "trees"))
        subroot, root = head[:HEX], head[HEX:]
        block = Block(key[1].as_py() << levels, n, own, levels)
        found = sorted(block.reversed(message.column("suffix")[0].as_py()))
        ends = [folded(a or d, proof, (i, n), (rank, trees))
                for (i, proof), d, a in zip(found, own, table.column("altered").to_pylist())]
        many = len(own)
        out = {"doc_id": table.column("doc_id"), "leaf": table.column("digest"),
               "subroot": pa.array([subroot] * many, pa.string()), "root": pa.array([root] * many, pa.string()),
               "proof_sha256": pa.array([digest(p) for _, p in found], pa.string()),
               "folded_root": pa.array(ends, pa.string()), "verified": pa.array([e == root for e in ends], pa.bool_())}
        if with_proofs:
            out |= {"proof": pa.array([p for _, p in found], pa.string()), "idx": table.column("idx"), "n": table.column("n"),
                    "rank": pa.array([rank] * many, pa.int64()), "trees": pa.array([trees] * many, pa.int64())}
        return pa.table(out)

    return blocks(nodes, levels).cogroup(sent.withColumn("block", F.col("idx")).groupBy("tree", "block")).applyInArrow(sweep, schema)


def dataset_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``documents`` under a trial: of every document whose id's
    crc32 is divisible by 7 a copy with n_chars one higher is verified."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return manifest(leaves(docs, changed={"n_chars": more}, where=tampered), levels=levels)
