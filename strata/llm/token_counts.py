"""Token counts by rank-synchronous array merging (byte-level BPE).

A text is cut after each run of non-blank characters; no pre-token of the
byte-level pattern crosses such a cut, so each unit is counted by itself and
counts of repeated units are kept. New units are split into pre-tokens, and
the pre-tokens of a whole batch are held as one ragged numpy array of symbols.
Each round finds every sequence's lowest-rank adjacent pair and merges all its
occurrences (left to right, not overlapping) in all sequences at once, until
no sequence has a known pair. What survives is the token count. Merging rank
by rank equals the usual one-pair-at-a-time order, because a pair that holds a
merged symbol ranks after the merge that made the symbol.

Null text counts as empty (0 tokens). An empty table gives no rows; repeated
rows are counted each by itself; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: The characters with Unicode's White_Space property.
WHITE = r"\t-\r \x85\xa0  -     　"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

#: The byte-level pre-token pattern.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters on whose classes all Unicode versions agree.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-ɏ]*")

#: Units whose counts one worker keeps (about 100 bytes each); beyond it the
#: store starts afresh, which costs time but changes no result.
KEEP_UNITS = 1_200_000
NONE = np.int64(1) << 40


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in a byte-level file:
    a printable Latin-1 byte for itself, the others from U+0100 on in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Merges of a BPE model, applied to ragged arrays rank by rank."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge(self, sym: np.ndarray, lengths: np.ndarray, done: list | None = None) -> np.ndarray:
        """Number of surviving symbols of each ragged sequence (all lengths
        over 0). ``done`` gets (sequence of each symbol, symbols) in parts."""
        out = lengths.astype(np.int64)
        ids = np.arange(len(lengths))
        seq = np.repeat(ids, lengths)
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            out[seq[starts]] = size
            going = np.repeat(least < NONE, size)
            if not going.all():
                if done is not None:
                    done.append((seq[~going], sym[~going]))
                sym, seq, rank = sym[going], seq[going], rank[going]
                size, least = size[least < NONE], least[least < NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # in a run of overlapping occurrences (a a a) take every second one
            run = np.r_[True, np.diff(hit) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            rank[hit] = rank[hit + 1]  # the pair to the right, taken afresh below
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            at = place[hit]
            look = np.r_[at, at[at > 0] - 1]
            rank[look] = NONE
            look = look[look + 1 < len(sym)]
            look = look[seq[look] == seq[look + 1]]
            rank[look] = self.ranks(sym[look], sym[look + 1])
        return out

class RankMerger(MergeTable):
    """Counts tokens with a byte-level tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        super().__init__(model)
        self.pre_tokenize = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.symbol = np.array([model["vocab"][c] for c in byte_alphabet()], np.int64)  # by byte
        self.counts: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """Pre-tokens: by pattern where it provably agrees with the library
        (plain Latin text), by the library itself otherwise."""
        if PLAIN.fullmatch(text):
            return PRE_TOKEN.findall(text)
        return [text[s:e] for _, (s, e) in self.pre_tokenize(text)]

    def pieces(self, units: list[str]) -> tuple[list[int], list[str], np.ndarray]:
        """Pre-tokens of units with their unit's index, and special tokens per unit."""
        owner, found, fixed = [], [], np.zeros(len(units), np.int64)
        for i, u in enumerate(units):
            if self.special and self.special.search(u):
                for j, part in enumerate(self.special.split(u)):
                    if j % 2:
                        fixed[i] += 1
                    else:
                        cut = self.cut(part)
                        owner += [i] * len(cut)
                        found += cut
            else:
                cut = self.cut(u)
                owner += [i] * len(cut)
                found += cut
        return owner, found, fixed

    def learn(self, units: list[str]) -> None:
        """Count the tokens of units that are not known yet."""
        owner, pieces, fixed = self.pieces(units)
        if pieces:
            index: dict[str, int] = {}
            which = [index.setdefault(p, len(index)) for p in pieces]
            raw = [p.encode() for p in index]
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            each = self.merge(self.symbol[np.frombuffer(b"".join(raw), np.uint8)], lengths)
            fixed += np.bincount(owner, each[which], len(units)).astype(np.int64)
        self.counts.update(zip(units, fixed.tolist()))

    def count(self, texts: list[str]) -> list[int]:
        units = [UNIT.findall(t) for t in texts]
        if len(self.counts) > KEEP_UNITS:
            self.counts = {}
        fresh = {u for t in units for u in t if u not in self.counts}
        if fresh:
            self.learn(list(fresh))
        get = self.counts.__getitem__
        return [sum(map(get, u)) for u in units]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, without begin, end or other added
    special tokens; special strings inside a text are one token each."""

    def run(batches):
        merger = RankMerger(tokenizer_path(tokenizer))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                n = merger.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
