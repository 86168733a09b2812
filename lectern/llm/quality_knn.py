"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words (lower-cased, hashed to WORDS columns), the shapes of its text
(runs of three byte classes: lower case, upper case, digit, space, line end, kinds of
punctuation, non-ASCII) and counts of repetition; weights are logarithmic and inverse to
document frequency.  A bounded sample of labelled
training rows gives the axes (truncated singular value decomposition) and the labelled
vectors, which are broadcast: SAMPLE x AXES numbers, however large the corpus is.  For every
document exact cosine products with all labelled vectors are computed in blocks of rows, and
the nearest ones vote with weights that grow with similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import WHITE, hashed_words, slices, texts_of

#: labelled rows that the model is fitted on, at most (the bound of what is broadcast)
SAMPLE = 6000
AXES, NEIGHBOURS, POWER, FOLDS = 48, 25, 8.0, 3
BLOCK = 256

_CLASS = np.full(256, 15, np.uint8)  # other ASCII
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "\"'`", "|", "#*$%&<>", "-_/\\:;=+@~^(){}[]")):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = 14
SHAPES, REPEATS, WORDS = 16**3, 8, 1 << 11
TERMS = SHAPES + REPEATS + WORDS


def _repetition(words: np.ndarray) -> np.ndarray:
    """Counts of repetition in a document's word hashes, on the scale of term counts."""
    n = len(words)
    out = np.zeros(REPEATS, np.float32)
    if n < 2:
        return out
    _, counts = np.unique(words, return_counts=True)
    pairs = words[1:] * np.uint64(31) + words[:-1]
    _, pair_counts = np.unique(pairs, return_counts=True)
    share = [(words[1:] == words[:-1]).sum() / n, counts.max() / n, len(counts) / n, pair_counts.max() / n, (pair_counts[pair_counts > 1].sum()) / n, float(n < 10), float(n < 30), np.log1p(n) / 12]
    return np.array(share, np.float32) * 60


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts: rows x TERMS) for blocks of whole texts."""
    data, offsets, _ = texts_of(column)
    hashed = hashed_words(column, WHITE)
    for i, j in slices(offsets):
        _, at, words = next(hashed)
        for lo in range(i, j, BLOCK):
            hi = min(j, lo + BLOCK)
            out = np.zeros((hi - lo, TERMS), np.float32)
            for r in range(lo, hi):
                c = _CLASS[data[offsets[r] : offsets[r + 1]]].astype(np.int32)
                if len(c) > 2:
                    out[r - lo, :SHAPES] = np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=SHAPES)
                own = words[at[r - i] : at[r - i + 1]]
                out[r - lo, SHAPES : SHAPES + REPEATS] = _repetition(own)
                out[r - lo, SHAPES + REPEATS :] = np.bincount((own % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
            yield lo, out


def _unit(x: np.ndarray) -> np.ndarray:
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def _weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    x *= weight
    return _unit(x)


@dataclass
class Model:
    weight: np.ndarray  # of terms
    axes: np.ndarray  # TERMS x AXES
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.weight) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if len(self.labels) == 0:
            return np.full(len(counts), self.prior)
        z = self.embed(counts)
        cosines = z @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.tile(np.arange(k), (len(counts), 1))
        weight = np.clip(np.take_along_axis(cosines, near, 1), 0, None) ** POWER + 1e-6
        score = (weight * self.labels[near]).sum(1) / weight.sum(1)
        score[~counts.any(axis=1)] = self.prior
        return np.clip(score.astype(float), 0, 1)


def fit_model(counts: np.ndarray, labels: np.ndarray, axes: int = AXES) -> Model:
    """Term weights, axes and labelled vectors of the sample; the same for the same rows."""
    if len(labels) == 0:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    weight = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.3).astype(np.float32)
    model = Model(weight, np.zeros(0), np.zeros(0), labels.astype(np.float32), float(labels.mean()))
    x = _weighted(counts, weight)
    rng = np.random.default_rng(3)
    q = rng.standard_normal((TERMS, min(axes + 16, len(counts)))).astype(np.float32)
    for _ in range(4):  # subspace iteration
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    # axes of weak spread matter as much as strong ones for telling rare junk apart
    model.axes = ((q @ vt.T)[:, :axes] / np.maximum(s[:axes], 1e-6) ** 0.5).astype(np.float32)
    model.vectors = _unit(x @ model.axes)
    return model


def fold(doc_id) -> object:
    """crc32 of the doc_id as text, modulo FOLDS; null doc_ids are the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(documents: DataFrame, labels: DataFrame, held_out_fold: int = 1, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, those of the smallest hash.

    Of rows that repeat a doc_id one is taken, the one whose text has the smallest hash.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.where(fold("of") != held_out_fold).orderBy(F.xxhash64("of"), "of").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for _, counts in term_counts(batch["text"]):
                for row in counts:
                    own = np.flatnonzero(row)
                    at.append(own.astype("<i2").tobytes())
                    values.append(row[own].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch["of"], batch["quality"], pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["of", "quality", "terms", "counts"])

    # at most ``sample`` rows of two numbers: a proven bound for the broadcast
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    one = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).groupBy("of", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.mapInArrow(run, "of long, quality int, terms binary, counts binary").collect()
    rows.sort(key=lambda r: r["of"])
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["terms"], "<i2")] = np.frombuffer(r["counts"], "<f4")
    return fit_model(counts, np.array([r["quality"] > 0 for r in rows], np.float32))


def quality_scores(documents: DataFrame, labels: DataFrame, held_out_fold: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``documents``.

    score (0 to 1) is higher the likelier quality is 1; labels, lang, source and doc_id are no
    inputs.  Null and empty texts have no terms and get the share of label 1 in the sample
    (0.5 without labels).  If labels repeat a doc_id, the lowest quality holds; a null doc_id
    has the crc32 of the empty text.  Rows that repeat a doc_id are scored each; empty tables
    are fine.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, held_out_fold, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(model.value.score(counts) for _, counts in term_counts(batch["text"]))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == held_out_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS
