"""Packing token sequences by non-negative least squares over a histogram.

1. Every document is tokenised in its own task and cut: whole sequences of
   ``size`` tokens, one *block* whose length is a multiple of ``grain``, and a
   *crumb* shorter than ``grain``. Only the pieces' ids, lengths and checksums
   go on (a few dozen bytes each); they are written once under the shared
   checkpoint folder.
2. The histogram of block lengths over all documents (``size / grain`` bins)
   goes to the driver. All shallow combinations (at most ``DEPTH`` lengths that
   sum to exactly ``size``) are enumerated, and repeat counts x >= 0 that
   minimise |A x - histogram| are found by non-negative least squares.
3. Pieces are dealt over pools of about ``POOL_ROWS`` rows by their place in the
   written pieces, so no key decides and no pool is large. Each pool, sorted by
   document and start so that a task that runs again deals the same, applies its share of
   the rounded-down counts, packs the blocks that are left best-fit, and fills
   the remaining gaps with crumbs. Padding is left only where crumbs run out.

Sequence ids are unique, not consecutive. Each id of a document lies in exactly
one piece. Null text counts as empty: such a document is its end id alone.
An empty table gives no rows; repeated rows are packed each by itself; other
columns of the input are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .common import slices, text_or_empty
from .token_counts import PLAIN, WHITE, MergeTable, byte_alphabet, tokenizer_path

WINDOW = 2048
GRAIN = 64
DEPTH = 4
POOL_ROWS = 1 << 17
END_ID = 1

#: Units whose ids one worker keeps (about 130 bytes each; it has them until it
#: ends), and their characters and id bytes, which count where units are long;
#: beyond either the store starts afresh, which costs time but changes no result.
KEEP_UNITS, KEEP_BYTES = 900_000, 32 << 20
#: Text bytes encoded at a time; their units are held besides the stores.
SLICE = 2 << 20
UNIT = re.compile(f"[^{WHITE}]+")
#: ASCII punctuation; a run of it after letters is one pre-token.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SEPARATORS = "\x1c\x1d\x1e\x1f"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class UnitEncoder(MergeTable):
    """Ids of whole texts from ids of their blank-separated units. Nothing in
    the tokenizer file looks across white space, so the concatenation is what
    the library gives for the text (checked in the tests). Units of plain Latin
    text are merged in bulk; all others go through the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        super().__init__(model)
        self.tokenizer = Tokenizer.from_file(path)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        self.bulk = ([n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
                     and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"]
                     and not level["use_regex"])
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        end = model["end_of_word_suffix"] or ""
        self.inner = np.array([model["vocab"][c] for c in byte_alphabet()], np.int64)  # by byte
        self.final = np.array([model["vocab"][c + end] for c in byte_alphabet()], np.int64)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def cut(self, unit: str) -> list[str]:
        """The pre-tokens of a lower-case unit of plain Latin text; letters and
        then punctuation, which most units are, need no pattern."""
        letters = unit.rstrip(PUNCTUATION)
        if letters.isalpha():
            return [letters, unit[len(letters):]] if len(letters) < len(unit) else [unit]
        return self.pattern.findall(unit)

    def words(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        last = np.cumsum(lengths) - 1
        sym = self.inner[flat]
        sym[last] = self.final[flat[last]]
        done: list = []
        size = self.merge(sym, lengths, done)
        seq = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])[np.argsort(seq, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(size)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, units: list[str]) -> None:
        plain, other = [], []
        special = self.special.search("\n".join(units))
        for u in units:
            (plain if self.bulk and (u.isascii() and u.isprintable() or PLAIN.fullmatch(u))
             and not (special and self.special.search(u)) else other).append(u)
        cuts = [self.cut(u.lower()) for u in plain]
        known, made, fresh = self.known, {}, []
        for p in set(chain.from_iterable(cuts)):
            if p in known and p.isalpha():  # a word that was a unit: no other pre-token, no special token
                made[p] = known[p]
            else:
                fresh.append(p)
        if fresh:
            made.update(zip(fresh, self.words(fresh)))
        get = made.__getitem__
        self.known.update((u, get(c[0]) if len(c) == 1 else b"".join(map(get, c))) for u, c in zip(plain, cuts))
        if other:
            self.known.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(
                other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Millions of strings and
        small lists come and go, none of them in a cycle: collection waits."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        # str.split also cuts at the separators 1C to 1F, which are not white space here
        a, b, c, d = SEPARATORS
        units = [UNIT.findall(t) if a in t or b in t or c in t or d in t else t.split() for t in texts]
        if len(self.known) > KEEP_UNITS or self.held > KEEP_BYTES:
            self.known, self.held = {}, 0
        fresh = list(set().union(*units).difference(self.known))
        get = self.known.__getitem__
        if fresh:
            self.learn(fresh)
            self.held += sum(map(len, fresh)) + sum(map(len, map(get, fresh)))
        return [b"".join(map(get, u)) for u in units]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> UnitEncoder:
    """One encoder per worker process: what a task learns, the next ones know."""
    return UnitEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, size: int = WINDOW, grain: int = GRAIN, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids into whole sequences, a block and a crumb."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = encoder_of(tokenizer_path(tokenizer))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    cuts = [*range(0, n - n % size, size), n - n % size, n - n % grain, n]
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        if b > a:
                            rows.append((doc, a, b - a, zlib.crc32(ids[4 * a:4 * b]), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                                                 [pa.array([], pa.int64())] * 5,
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


@lru_cache
def combinations(total: int, depth: int, least: int = 1) -> tuple[tuple[int, ...], ...]:
    """Ascending tuples of at most ``depth`` numbers from ``least`` on that sum to ``total``."""
    if depth == 0:
        return ()
    out = [(total,)] if total >= least else []
    for first in range(least, total // 2 + 1):
        out += [(first, *rest) for rest in combinations(total - first, depth - 1, first)]
    return tuple(out)


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """min |a x - b| with x >= 0 by the active-set method."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    limit = tolerance * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= limit:
            break
        free[j] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                x = s
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > limit * 1e-3
            x[~free] = 0
            if not free.any():
                break
    return x


def solve(histogram: np.ndarray, bins: int, depth: int) -> list[tuple[tuple[int, ...], float]]:
    """(combination of bins, repeats) with positive repeats."""
    combos = combinations(bins, depth)
    a = np.zeros((bins + 1, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k, j] += 1
    x = nnls(a[1:], histogram[1:].astype(float))
    return [(combos[j], float(x[j])) for j in np.flatnonzero(x > 0)]


def pack_pool(length: np.ndarray, plan, share: float, size: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece of one pool."""
    n = len(length)
    seq, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    whole = np.flatnonzero(length == size)
    seq[whole] = np.arange(len(whole))
    made = len(whole)
    block = (length % grain == 0) & (length < size)
    queue = {k: list(np.flatnonzero(block & (length == k * grain))) for k in range(1, size // grain)}

    def apply(combo, times: int) -> None:
        nonlocal made
        at = np.zeros(times, np.int64)
        ids = np.arange(made, made + times)
        for k in combo:
            own = queue[k][-times:]
            del queue[k][-times:]
            seq[own], offset[own] = ids, at
            at += k * grain
        made += times

    for combo, repeats in plan:
        if len(combo) > 1:
            need = {k: combo.count(k) for k in combo}
            times = min(int(repeats * share), *(len(queue[k]) // c for k, c in need.items()))
            if times > 0:
                apply(combo, times)
    # residual blocks: longest first into the fullest sequence that has room
    room: dict[int, list[tuple[int, int]]] = {}  # free grains -> (sequence, used)
    for k in range(size // grain - 1, 0, -1):
        for p in queue[k]:
            free = next((f for f in range(k, size // grain) if room.get(f)), None)
            s, used = room[free].pop() if free else (made, 0)
            made += not free
            seq[p], offset[p] = s, used
            left = size // grain - used // grain - k
            if left:
                room.setdefault(left, []).append((s, used + k * grain))
    # crumbs: the longest that fits, into open sequences and then new ones
    crumbs: list[list[int]] = [[] for _ in range(grain)]
    for p in np.flatnonzero(~block & (length < size)).tolist():
        crumbs[length[p]].append(p)
    left = sum(map(len, crumbs))
    top = grain - 1
    gaps = [x for f in sorted(room) for x in room[f]]
    while left:
        s, used = gaps.pop() if gaps else (made, 0)
        made += s == made
        while used < size and left:
            while top and not crumbs[top]:
                top -= 1
            k = min(top, size - used)
            while k and not crumbs[k]:
                k -= 1
            if not k:
                break
            p = crumbs[k].pop()
            seq[p], offset[p] = s, used
            used += k
            left -= 1
    return seq, offset


def pack_group(group: pa.Table, plan, blocks: float, size: int, grain: int) -> pa.Table:
    """One pool's pieces with sequence and offset, whatever order they come in."""
    group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    length = group.column("length").to_numpy()
    share = ((length % grain == 0) & (length < size)).sum() / max(blocks, 1)
    seq, offset = pack_pool(length, plan, share, size, grain)
    pool = group.column("pool").to_numpy()
    return group.drop_columns(["pool"]).append_column("sequence_id", pa.array(pool * (1 << 32) + seq, pa.int64())) \
        .append_column("offset", pa.array(offset, pa.int64()))


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = WINDOW, grain: int = GRAIN,
         depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and offset."""
    if size % grain:
        raise ValueError("size must be a multiple of grain")
    cut = materialize(pieces(docs, tokenizer, size, grain, id_col=id_col, text_col=text_col), "pieces")
    blocks = cut.filter((F.col("length") % grain == 0) & (F.col("length") < size))
    counts = blocks.groupBy((F.col("length") / grain).cast("int").alias("k")).count().collect()  # size / grain rows at most
    histogram = np.zeros(size // grain + 1)
    for r in counts:
        histogram[r["k"]] = r["count"]
    plan = solve(histogram, size // grain, depth)
    total = cut.count()
    pools = max(1, -(-total // POOL_ROWS))

    def run(group: pa.Table) -> pa.Table:
        return pack_group(group, plan, float(histogram.sum()), size, grain)

    dealt = cut.withColumn("pool", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(pools)))
    return dealt.groupBy("pool").applyInArrow(run, PIECES + ", sequence_id long, offset long")
