"""Token counts and packing against the library and exact round trips."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from .conftest import ODD
from tokenizers import Tokenizer

from strata.llm import packing as P
from strata.llm import token_counts as T


def _odd_texts(rnd):
    pick = ["<|endoftext|>", "<|startoftext|>", "'s", "ab", "  ", "\x1c", "\x85", "\xa0", " ", "　", "​", " ", "\n"]
    return [t or "" for _, t, _ in ODD if len(t or "") < 10_000] + [
        "".join(rnd.choice([*pick, chr(rnd.randrange(1, 0x400)), chr(rnd.randrange(0x2000, 0x2100)),
                            chr(rnd.randrange(0x10000, 0x1F000))]) for _ in range(rnd.randrange(1, 25)))
        for _ in range(1500)]


def test_counts_equal_the_library(rnd, rows_of):
    path = T.tokenizer_path("byte_bpe_50k.json")
    texts = [t for _, t in rows_of] + _odd_texts(rnd) + ["a" * 3000, "abcabcab" * 200]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert T.RankMerger(path).count(texts) == want


def test_units_restart_without_change(monkeypatch, rows_of):
    monkeypatch.setattr(T, "KEEP_UNITS", 50)
    m = T.RankMerger(T.tokenizer_path("byte_bpe_50k.json"))
    texts = [t for _, t in rows_of[:40]]
    assert [m.count([t])[0] for t in texts] == m.count(texts)


def test_units_are_cut_where_the_library_cuts():
    """After a non-blank, a character of the class always begins a pre-token."""
    pre = Tokenizer.from_file(T.tokenizer_path("byte_bpe_50k.json")).pre_tokenizer
    for c in map(chr, [*range(1, 0x3001), 0xFEFF]):
        if T.UNIT.fullmatch(f"{c}x") and len(T.UNIT.findall(f"x{c}x")) == 2:
            for before in "x1!":
                assert any(a == 1 for _, (a, _) in pre.pre_tokenize_str(f"{before}{c}x")), hex(ord(c))


def test_encoder_equals_the_library(rnd, rows_of):
    path = P.tokenizer_path("word_bpe_49k.json")
    texts = [t for _, t in rows_of] + _odd_texts(rnd)
    got = [np.frombuffer(x, "<u4").tolist() for x in P.UnitEncoder(path).encode(texts)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_counts_query_cases(odd_docs, no_docs):
    got = T.token_counts(odd_docs, limit=100).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"], r["n_bytes"]): r for r in got}
    assert by[(1, 0)]["n_tokens"] == 0 and by[(8, 150000)]["over_limit"]
    assert T.token_counts(no_docs).count() == 0


def _check_packing(rows, docs, size):
    """Every id once, sequences gapless from 0 and within the size."""
    tok = Tokenizer.from_file(P.tokenizer_path("word_bpe_49k.json"))
    left = [(d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in docs]
    want = sorted((str(d), len(i), zlib.crc32(i.tobytes())) for d, i in left)
    seqs, parts = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    padding = 0
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]]
        total = sum(n for _, n in s)
        assert total <= size
        padding += 0 if total & (total - 1) == 0 else size - total
    assert sum(r["length"] for r in rows) == sum(n for _, n, _ in want)
    for d, ids in left:
        for a, n, crc in parts[(d, len(ids))]:
            assert zlib.crc32(ids[a:a + n].tobytes()) == crc
    return padding


def test_pack_round_trip(odd_docs, documents, rows_of, no_docs):
    rows = P.pack(documents).collect()
    assert _check_packing(rows, rows_of, P.WINDOW) <= 2 * P.WINDOW
    rows = P.pack(odd_docs).collect()
    _check_packing(rows, [(d, t) for d, t, _ in ODD], P.WINDOW)
    assert P.pack(no_docs).count() == 0


def test_nnls_and_combinations():
    assert P.combinations(4, 3) == ((4,), (1, 3), (1, 1, 2), (2, 2))
    rnd = np.random.default_rng(3)
    for _ in range(20):
        a, x = rnd.random((8, 12)), np.maximum(rnd.standard_normal(12), 0)
        got = P.nnls(a, a @ x)
        assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-6
    b = rnd.standard_normal(8)
    got = P.nnls(a, b)
    grad = a.T @ (b - a @ got)
    assert (grad <= 1e-6).all() and abs(grad @ got) < 1e-6  # optimality


def test_pool_without_matching_blocks():
    length = np.array([64, 64, 1, 63, 2048, 1984])
    seq, offset = P.pack_pool(length, [((1, 31), 5.0)], 1.0, 2048, 64)
    assert len(set(zip(seq, offset))) == 6 and set(seq) == set(range(seq.max() + 1))


def test_pool_does_not_depend_on_the_order_of_arrival(rnd):
    rows = [(rnd.randrange(50), rnd.randrange(9), rnd.choice([64, 128, 640, 1984, 2048, 3, 17, 63]), rnd.randrange(5), 9, 3)
            for _ in range(400)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pool"]
    table = lambda: pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))})
    first = P.pack_group(table(), [((1, 31), 5.0)], 300.0, 2048, 64)
    rnd.shuffle(rows)
    assert P.pack_group(table(), [((1, 31), 5.0)], 300.0, 2048, 64).equals(first)


def test_cut_of_units_equals_the_pattern(rnd):
    encoder = P.encoder_of(P.tokenizer_path("word_bpe_49k.json"))
    units = ["word", "word.", "don't", "'s", "it's.", "a's!?", "x1", "1.5,", "...", "é,", "ñ's", "_a_", "a-b", "word\u2019s", "!a", "a''"]
    units += ["".join(rnd.choice("ab'st1.,-é") for _ in range(rnd.randrange(1, 8))) for _ in range(3000)]
    for u in units:
        assert encoder.cut(u) == encoder.pattern.findall(u), u


def test_a_worker_keeps_a_bounded_store(rnd):
    """Texts of ever new words, as much as an executor's two workers can hold beside its JVM."""
    encoder = P.UnitEncoder(P.tokenizer_path("word_bpe_49k.json"))
    tracemalloc.start()
    try:
        for _ in range(11):
            encoder.encode([" ".join("".join(rnd.choices("abdeinorst", k=8)) for _ in range(800)) for _ in range(100)])
        kept, most = (x / 1e6 for x in tracemalloc.get_traced_memory())
    finally:
        tracemalloc.stop()
    assert kept < 140 and most < 215, (kept, most)


def test_a_worker_keeps_few_long_units(rnd):
    """Scripts without blanks: a unit is a whole line."""
    encoder = P.UnitEncoder(P.tokenizer_path("word_bpe_49k.json"))
    tracemalloc.start()
    try:
        for _ in range(16):
            encoder.encode([" ".join("".join(map(chr, (rnd.randrange(0x4E00, 0x9000) for _ in range(300)))) for _ in range(1100))])
        kept = tracemalloc.get_traced_memory()[0] / 1e6
    finally:
        tracemalloc.stop()
    assert kept < 60, kept


def test_encoder_restarts_without_change(monkeypatch, rnd, rows_of):
    texts = [t for _, t in rows_of[:40]] + _odd_texts(rnd)[:200]
    encoder = P.UnitEncoder(P.tokenizer_path("word_bpe_49k.json"))
    want = encoder.encode(texts)
    monkeypatch.setattr(P, "KEEP_UNITS", 50)
    again = P.UnitEncoder(P.tokenizer_path("word_bpe_49k.json"))
    assert [again.encode([t])[0] for t in texts] == want and len(again.known) < len(encoder.known)
