"""Quality classifier: similarity-weighted votes of nearest labelled texts.

Texts become hashed term counts (words, word shapes, and a few counts of
repetition and length), damped by a logarithm and normalised per group of
terms. A latent-semantic basis is the leading singular vectors of the labelled
sample's term matrix. The sample's latent vectors are broadcast (``SAMPLE`` x
``DIMS`` floats, a fixed bound), and every document is compared with all of
them in blocks of exact cosine products; the ``NEIGHBOURS`` most similar (and
all that tie with the last of them) vote with weight max(cosine, 0) ** POWER.

Learning uses only labelled rows whose crc32(id as text) mod 3 is not 1, at
most SAMPLE / 2 of each label, chosen by a hash of the id. Labels, lang, source
and id are no inputs of a score. Repeated rows with one id are learned once
(the least text); null text counts as empty and is scored by its length terms.
Without labelled rows every score is 0.5. An empty table gives no rows; other
columns are ignored, or pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Labelled rows learned at most (half of each label).
SAMPLE = 4096
#: Latent dimensions, neighbours that vote, and the weight's power.
DIMS, NEIGHBOURS, POWER = 64, 25, 4
#: Hashed terms: words and shapes, then the bins of the other terms.
WORDS, SHAPES, BINS = 1024, 512, 16
TERMS = WORDS + SHAPES + 4 * BINS
#: Tokens whose terms one worker keeps; beyond it the store starts afresh.
KEEP_TOKENS = 600_000
#: Characters of a token at most; what is longer is several.
PIECE = 64
BLOCK = 512

UPPER, LOWER_, DIGIT = re.compile(r"[^\W\d_a-zà-öø-ÿ]+"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def shape(token: str) -> str:
    """Runs of capitals, letters and digits as one character each; other
    characters as they are: "Ab3!!" gives "Aa0!!"."""
    token = DIGIT.sub("0", token)
    token = UPPER.sub("\x01", token)
    return LOWER_.sub("a", token).replace("\x01", "A")


def tokens_of(text: str) -> list[str]:
    """Tokens between white space; longer ones in pieces of PIECE characters,
    each a token, so all of a text without blanks is measured."""
    tokens = text.split()
    if max(map(len, tokens), default=0) <= PIECE:
        return tokens
    return [t[i:i + PIECE] for t in tokens for i in range(0, len(t), PIECE)]


class Terms:
    """Hashed term vectors of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def learn(self, token: str) -> int:
        if len(self.known) > KEEP_TOKENS:
            self.known.clear()
        s = zlib.crc32(shape(token).encode()) % SHAPES
        w = zlib.crc32(token.lower().encode()) % WORDS
        code = self.known[token] = s * WORDS + w
        return code

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), TERMS), np.float32)
        get, learn = self.known.get, self.learn
        for row, t in zip(out, texts):
            tokens = tokens_of(t)
            codes = np.array([c if (c := get(x)) is not None else learn(x) for x in tokens], np.int64)
            n = len(codes)
            lines = t.split("\n")
            parts = (np.log1p(np.bincount(codes % WORDS, minlength=WORDS)),
                     np.log1p(np.bincount(codes // WORDS, minlength=SHAPES)))
            at = 0
            for p, weight in zip(parts, (0.5, 1.0)):
                norm = float(np.sqrt(p @ p))
                if norm:
                    row[at:at + len(p)] = p * (weight / norm)
                at += len(p)
            # binned: length, distinct words, words equal to the one before, repeated lines
            same = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
            distinct = len(np.unique(codes)) / n if n else 1.0
            twice = 1 - len(set(lines)) / len(lines)
            for value, weight in ((min(n.bit_length(), BINS - 1), 0.3), (int(distinct * (BINS - 1)), 0.4),
                                  (int(np.ceil(same * (BINS - 1))), 0.7), (int(np.ceil(twice * (BINS - 1))), 0.5)):
                row[at + value] = weight
                at += BINS
        return out


class Voters:
    """Latent vectors and labels of the learned sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.y = y.astype(np.float32)
        if len(x):
            # leading right singular vectors by subspace iteration from a fixed start
            basis = np.random.default_rng(7).standard_normal((x.shape[1], DIMS + 16)).astype(np.float32)
            for _ in range(8):
                basis = np.linalg.qr(x.T @ (x @ basis))[0]
            _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
            self.basis = (basis @ turn.T)[:, :DIMS]
            self.v = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(x), 0.5)
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.y))
        for i in range(0, len(x), BLOCK):
            cos = self.latent(x[i:i + BLOCK]) @ self.v.T
            last = np.partition(cos, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
            w = np.where(cos >= last, np.maximum(cos, 0), 0).astype(np.float64) ** POWER
            total = w.sum(axis=1)
            out[i:i + BLOCK] = np.where(total > 0, w @ self.y / np.maximum(total, 1e-300), 0.5)
        return np.clip(out, 0.0, 1.0)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("long").cast("string")) % 3


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
            text_col: str = "text", sample: int = SAMPLE) -> Voters:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("y").isin(0, 1) & F.col("id").isNotNull()).filter(fold("id") != 1) \
        .groupBy("id").agg(F.min("y").alias("y"))
    order = (F.xxhash64("id"), F.col("id"))
    chosen = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(*order).limit(sample // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")) \
        .join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def run(batches):
        terms = Terms()
        for batch in batches:
            for part in slices(batch, "text"):
                x = terms.vectors(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), part.column("y")],
                    ["id", "x", "y"])

    got = texts.mapInArrow(run, "id long, x binary, y int").orderBy("id").collect()  # SAMPLE rows at most
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), TERMS)
    return Voters(x, np.array([r["y"] for r in got]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **names) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    voters = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, id_col=id_col, text_col=text_col, **names))

    def run(batches):
        terms = Terms()
        for batch in batches:
            for part in slices(batch, "text"):
                s = voters.value.score(terms.vectors(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()),
                     pa.array((s >= 0.5).astype(np.int32), pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"),
                       text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The documents predicted 1, with their columns as they are."""
    voters = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, text_col=text_col, **names))
    at = docs.columns.index(text_col)

    def run(batches):
        terms = Terms()
        for batch in batches:
            text = batch.column(at).cast(pa.string()).fill_null("")
            full = pa.RecordBatch.from_arrays([text, *batch.columns], ["", *batch.schema.names])
            for part in slices(full, ""):
                good = voters.value.score(terms.vectors(part.column(0).to_pylist())) >= 0.5
                yield pa.RecordBatch.from_arrays(part.columns[1:], schema=batch.schema).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
