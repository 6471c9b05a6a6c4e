"""The Merkle manifest against a tree built level by level."""

import collections
import hashlib
import random
import zlib

import pytest

from strata.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = r["n_chars"]
    return digest(*(field(v) for v in (r["doc_id"], r["source"], r["lang"], n if n is None else n + more, r["text"])))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def expected(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    groups = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([leaf(r) for r in groups[k]]) for k in names}
    top = levels([trees[k][-1][0] for k in names]) if names else None
    out = []
    for rank, name in enumerate(names):
        for at, r in enumerate(groups[name]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            own, proof = leaf(r, int(tampered)), ""
            for tree, i in ((trees[name], at), (top, rank)):
                for level in tree[:-1]:
                    if i ^ 1 < len(level):
                        proof += level[i ^ 1]
                        own = digest(level[i ^ 1], own) if i & 1 else digest(own, level[i ^ 1])
                    else:
                        own = digest(own)
                    i //= 2
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[name][-1][0], root, digest(proof), own, own == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("levels_", [1, 12])
def test_equals_level_by_level_tree(spark, levels_):
    rnd = random.Random(levels_)
    langs = [None, "", "en", "en", "en", "zz", "é", "a=b"]
    rows = [{"doc_id": rnd.choice([None, *range(40)]), "text": rnd.choice([None, "", "x" * 9000, "日本", "a"]),
             "lang": rnd.choice(langs), "source": rnd.choice([None, "s1", "s2"]), "n_chars": rnd.choice([None, 0, 7, 2**63 - 2])}
            for _ in range(75)]
    rows += [rows[0]] * 25  # a row repeated: a quarter of all
    rows += [{"doc_id": 1, "text": "only one", "lang": "single", "source": "s", "n_chars": 8}]
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    assert found(merkle.dataset_manifest(docs.repartition(5), levels_)) == expected(rows)


def test_single_language_and_single_row(spark):
    for n in (2,):
        rows = [{"doc_id": i, "text": str(i), "lang": "en", "source": None, "n_chars": 1} for i in range(n)]
        docs = spark.createDataFrame([(r["doc_id"], r["text"], "en", None, 1) for r in rows], SCHEMA)
        got = found(merkle.dataset_manifest(docs, 2))
        assert got == expected(rows)
    one = merkle.dataset_manifest(spark.createDataFrame([(3, "t", "en", "s", None)], SCHEMA)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["verified"]


def test_empty_table_and_clashing_columns(spark):
    assert merkle.dataset_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [{"doc_id": i, "text": "t", "lang": "en", "source": "s", "n_chars": 1} for i in range(9)]
    docs = spark.createDataFrame([(i, "t", "en", "s", 1, "x", "y", 3, 4, "z") for i in range(9)],
                                 SCHEMA + ", tree string, digest string, idx long, n long, leaf string")
    assert found(merkle.dataset_manifest(docs)) == expected(rows)


def test_proofs_verify_and_do_not_for_another_leaf(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "fr", "s", i) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(merkle.leaves(docs), with_proofs=True, levels=2).collect()
    assert len(got) == 50 and all(r["verified"] for r in got)
    for r in got:
        paths = (r["idx"], r["n"]), (r["rank"], r["trees"])
        assert merkle.folded(r["leaf"], r["proof"], *paths) == r["root"]
        assert merkle.folded(got[0]["leaf"] if r is not got[0] else got[1]["leaf"], r["proof"], *paths) != r["root"]
    some = next(r for r in got if len(r["proof"]) > 64)
    broken = ("0" if some["proof"][0] != "0" else "1") + some["proof"][1:]
    assert merkle.folded(some["leaf"], broken, (some["idx"], some["n"]), (some["rank"], some["trees"])) != some["root"]


def test_same_manifest_whatever_the_partitions(spark, documents):
    first = merkle.dataset_manifest(documents.repartition(7, "text")).select("root").distinct().collect()
    assert first == merkle.dataset_manifest(documents.coalesce(1), 4).select("root").distinct().collect()


def test_queue_holds_one_path(monkeypatch):
    """The forward sweep's queue stays logarithmic in the block."""
    most = 0
    real = merkle.heapq.heappush

    def push(queue, item):
        nonlocal most
        real(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", push)
    merkle.Block(0, 4096, [digest(str(i)) for i in range(4096)], 12).forward()
    assert most <= 14
