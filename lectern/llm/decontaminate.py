"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].  Of each ``w`` consecutive
hashes of ``k`` words the smallest are fingerprints, in benchmark items and in documents
alike; a shared span of w + k - 1 words holds a whole window in both and so a common
fingerprint.  Each common fingerprint is extended left and right, word by word, and counts
if the run has w + k - 1 words, so every such span is found and nothing shorter.  Items with
fewer words are one window each and looked up by hashes of just that many words.

A benchmark of one block, whose size is measured, is broadcast and met inside the scan of the
documents: no shuffle, and no row of a document leaves its task.  A larger one is met in a
join of fingerprints, documents' with items', dealt by row so that a passage of a third of all
documents is many keys; only documents with a common fingerprint are then extended, block by
block of items.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise
from .textbytes import NOT_ALNUM, U64, hashed_words, shingles

K, WINDOW = 5, 10
#: bytes of benchmark text in one broadcast block
BLOCK_BYTES = 16 << 20
#: keys among which the documents of one fingerprint are dealt
SALTS = 16
_NONE = U64(2**64 - 1)


def _fingerprints(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest hash of some window of ``w`` (all of them, on ties)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : j + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for j in range(w):
        chosen[j : j + n] |= grams[j : j + n] == least
    chosen &= grams != _NONE
    return np.flatnonzero(chosen)


def _apart(at: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of ``k`` words of some documents (offsets ``at``); a run that crosses documents is _NONE."""
    grams = shingles(words, k) if len(words) >= k else words[:0]
    for j in range(1, k):
        edge = at[1:-1] - j
        grams[edge[(edge >= 0) & (edge < len(grams))]] = _NONE
    return grams


class BenchmarkIndex:
    """Fingerprints of the items of one block: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str | None, bytes]], k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        self.names = [name for name, _ in items]
        self.words: list[np.ndarray] = []
        for _, at, words in hashed_words(pa.array([text for _, text in items], pa.binary()), NOT_ALNUM):
            self.words += [words[at[i] : at[i + 1]] for i in range(len(at) - 1)]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, words in enumerate(self.words):
            if len(words) >= window:
                grams = shingles(words, k)
                for q in _fingerprints(grams, window - k + 1).tolist():
                    self.postings[int(grams[q])].append((i, q))
            elif len(words):
                self.short[len(words)][int(shingles(words, len(words))[0])].append(i)
        self.postings, self.short = dict(self.postings), {m: dict(x) for m, x in self.short.items()}
        self.known = np.sort(np.fromiter(self.postings, np.uint64, len(self.postings)))
        self.known_short = {m: np.sort(np.fromiter(x, np.uint64, len(x))) for m, x in self.short.items()}

    def find(self, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of some documents (offsets ``at``) are hit, and the items that occur in each document."""
        hit = np.zeros(len(words), bool)
        items: dict[int, set[int]] = defaultdict(set)
        doc_of = lambda p: np.searchsorted(at, p, side="right") - 1
        if len(self.known) and len(words) >= self.window:
            grams = _apart(at, words, self.k)
            p = _fingerprints(grams, self.window - self.k + 1)
            p = p[_within(grams[p], self.known)]
            done: dict[tuple[int, int], int] = {}
            for pos, d in zip(p.tolist(), doc_of(p).tolist(), strict=True):
                for i, q in self.postings[int(grams[pos])]:
                    if done.get((i, pos - q), -1) > pos:
                        continue
                    own = self.words[i]
                    back, ahead = min(pos - int(at[d]), q), min(int(at[d + 1]) - pos, len(own) - q)
                    differ = np.flatnonzero(words[pos - back : pos][::-1] != own[q - back : q][::-1])
                    lo = pos - (int(differ[0]) if len(differ) else back)
                    differ = np.flatnonzero(words[pos : pos + ahead] != own[q : q + ahead])
                    hi = pos + (int(differ[0]) if len(differ) else ahead)
                    done[i, pos - q] = max(hi, pos + 1)
                    if hi - lo >= self.window:
                        hit[lo:hi] = True
                        items[d].add(i)
        for m, known in self.known_short.items():
            if len(words) >= m:
                grams = shingles(words, m)
                p = np.flatnonzero(_within(grams, known))
                for pos, d in zip(p.tolist(), doc_of(p).tolist(), strict=True):
                    if pos + m <= at[d + 1]:
                        for i in self.short[m][int(grams[pos])]:
                            if np.array_equal(words[pos : pos + m], self.words[i]):
                                hit[pos : pos + m] = True
                                items[d].add(i)
        return hit, {d: {self.names[i] for i in own if self.names[i] is not None} for d, own in items.items()}


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _search(rows: DataFrame, block: list[tuple[str | None, bytes]], found: str, k: int, window: int) -> DataFrame:
    """``rows`` with what ``block`` adds to the column ``found``."""
    sc = rows.sparkSession.sparkContext
    index = sc.broadcast(BenchmarkIndex(block, k, window))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch[found].to_pylist()
            after = []
            for i, at, words in hashed_words(batch["text"].cast(pa.binary()), NOT_ALNUM):
                hit, items = index.value.find(at, words)
                for d in range(len(at) - 1):
                    own, old = hit[at[d] : at[d + 1]], before[i + d]
                    bits = np.packbits(own).tobytes() if own.any() else None
                    if old and old["bits"]:
                        bits = old["bits"] if bits is None else bytes(np.frombuffer(bits, np.uint8) | np.frombuffer(old["bits"], np.uint8))
                    after.append({"n_words": len(own), "n_hit": int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()) if bits else 0, "bits": bits, "items": sorted({*items.get(d, ()), *(old["items"] if old else ())})})
            columns = [pa.array(after, batch.schema.field(found).type) if c == found else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)


def _blocks(items: DataFrame, block_bytes: int) -> list[list[int]]:
    """Hash buckets of items in groups of at most ``block_bytes``, by their measured sizes (a larger bucket is alone)."""
    buckets = items.groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("bucket").collect()
    groups: list[list[int]] = []
    room = 0
    for bucket, n in buckets:
        if not groups or n > room:
            groups.append([])
            room = block_bytes
        groups[-1].append(bucket)
        room -= n
    return groups


def _rows_with_common_fingerprints(rows: DataFrame, row: str, items: DataFrame, k: int, window: int) -> DataFrame:
    """``row`` of all rows that share a fingerprint, or a whole short window, with some item; one shuffle of hashes."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, words in hashed_words(batch["text"], NOT_ALNUM):
                for i in range(len(at) - 1):
                    own = words[at[i] : at[i + 1]]
                    m = 0 if len(own) >= window else len(own)
                    hashes = shingles(own, m or k)
                    hashes = hashes if m else hashes[_fingerprints(hashes, window - k + 1)]
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), m, np.int32)), pa.array(hashes.view(np.int64))], ["m", "hash"])

    wanted = materialise(items.select("text").mapInArrow(of_items, "m int, hash long").distinct())
    lengths = sorted(r[0] for r in wanted.where("m > 0").select("m").distinct().collect())  # below ``window``

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at, words in hashed_words(batch["text"].cast(pa.binary()), NOT_ALNUM):
                ids = batch[row].slice(i, len(at) - 1).to_numpy()
                for m in (0, *lengths):
                    grams = _apart(at, words, m or k)
                    p = np.flatnonzero(grams != _NONE) if m else _fingerprints(grams, window - k + 1)
                    p = p[p + (m or k) <= len(words)]
                    if len(p):
                        doc = np.searchsorted(at, p, side="right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(np.full(len(p), m, np.int32)), pa.array(grams[p].view(np.int64))], [row, "m", "hash"])

    of_docs = rows.select(row, "text").mapInArrow(of_documents, f"{row} long, m int, hash long").withColumn("salt", F.pmod(row, F.lit(SALTS)).cast("int"))
    dealt = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return of_docs.join(dealt, ["m", "hash", "salt"], "left_semi").select(row).distinct()


def find_overlaps(documents: DataFrame, benchmark: DataFrame, found: str = "found", k: int = K, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with a struct column ``found``: n_words, n_hit, bits (of hit words), items (their ids).

    All columns stay.  The benchmark is measured first.  Up to ``block_bytes`` it is broadcast
    and nothing is shuffled; beyond, hashes are joined, and the few rows that meet an item are
    searched for one block of items after another, written to the shared folder in between.
    ``found`` must not be a column already.
    """
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = documents.withColumn(found, F.lit(None).cast(kind))
    if total <= block_bytes:
        return _search(rows, [(r[0], bytes(r[1])) for r in items.toLocalIterator()], found, k, window)
    items = materialise(items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(64 * -(-total // block_bytes)))))
    row = "_row" + "_" * max(map(len, documents.columns))  # longer than any column's name
    rows = materialise(rows.withColumn(row, F.monotonically_increasing_id()))
    met = materialise(_rows_with_common_fingerprints(rows, row, items, k, window))
    near = rows.join(met, row, "left_semi")
    for group in _blocks(items, block_bytes):
        block = [(r[0], bytes(r[1])) for r in items.where(F.col("bucket").isin(group)).select("item_id", "text").toLocalIterator()]
        near = materialise(_search(near, block, found, k, window))
    far = _search(rows.join(met, row, "left_anti"), [], found, k, window)
    return near.unionByName(far).drop(row)


def decontamination(documents: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``documents``.

    A null text has no words; null and empty items have no window.  Hits of an item without
    item_id count, but it is neither counted nor listed among the items.  Rows that repeat a
    doc_id or an item_id are read each; an item_id counts once.  Columns besides doc_id,
    item_id and text are not read; empty tables are fine on either side.
    """
    rows = find_overlaps(documents.select("doc_id", "text"), benchmark, "found", k, window, block_bytes)
    return rows.select("doc_id", F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "found.items").cast("binary"), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


def digest(items: list[str]) -> str:
    """What ``items_sha256`` holds for these item_ids."""
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
