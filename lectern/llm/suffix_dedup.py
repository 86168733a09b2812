"""Removal of repeated byte strings, by bucket-pointer refinement over sampled suffixes.

Every start of a 100-byte string has a bucket identifier that is refined as in bucket-pointer
refinement: first the identifier of its 25-byte prefix, then the pair of identifiers at offsets 0
and 25 gives one for 50 bytes, and these, used again at offsets 0 and 50, one for 100 bytes.
Identifiers are 64-bit values of the bytes alone, so they need no rank over the corpus and every
task computes the same ones.

A start is filed in the bucket of the smallest 25-byte identifier in its string.  Equal strings
share that bucket, and neighbouring starts that take it from the same place form a run of
76 starts at most; a run, about one for 40 bytes, is one row of the shuffle.  Buckets are sorted by
the identifiers of their runs: of equal runs only the first has first occurrences.  Only buckets
that still hold different runs are refined further, start by start, by the 100-byte identifiers.
Two strings count as equal if bucket and 100-byte identifier agree, 128 bits.

A document is told by its doc_id and a 64-bit hash of its text.  Equal runs are combined before
each shuffle, and a bucket of very many different runs is refined by a combined aggregate, so no
bucket has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, materialise, release
from .textbytes import U64, mix, texts_of

_rng = np.random.Generator(np.random.PCG64(20250613))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_FACTOR = _rng.integers(1, 2**63, 80, dtype=np.uint64) * U64(2) + U64(1)
_RADIX = int(_rng.integers(2**40, 2**60)) * 8 + 5
_SLICE = 1 << 17

ORDER = ["no_id", "doc", "tie"]
_KEY = "no_id boolean, doc long, tie long"
_KEY_FIELDS = [("no_id", pa.bool_()), ("doc", pa.int64()), ("tie", pa.int64())]


def prefix_identifiers(data: np.ndarray, q: int) -> np.ndarray:
    """Identifier of the ``q`` bytes from each start, by doubling over lengths 1, 2, 4, ..."""
    part, length, radix = _BYTE[data], 1, U64(_RADIX)
    out, done, left = None, 0, q
    while True:
        if left & 1:
            if out is None:
                out = part
            else:
                n = max(0, len(data) - done - length + 1)
                out = out[:n] * radix + part[done : done + n]
            done += length
        left >>= 1
        if not left:
            return mix(out.copy())
        n = max(0, len(part) - length)
        part = part[:n] * radix + part[length : length + n]
        length, radix = 2 * length, U64(int(radix) ** 2 % 2**64)


def refined(identifiers: np.ndarray, offset: int, level: int) -> np.ndarray:
    """Identifiers for twice the length: of the pair of identifiers at a start and ``offset`` later."""
    n = max(0, len(identifiers) - offset)
    return mix(identifiers[:n] * _FACTOR[2 * level] + identifiers[offset : offset + n] * _FACTOR[2 * level + 1])


def string_identifiers(data: np.ndarray, length: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the quarter strings and of the whole strings at each start; ``length`` is a multiple of 4."""
    quarter = prefix_identifiers(data, length // 4)
    half = refined(quarter, length // 4, 0)
    return quarter, refined(half, length // 2, 1)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = 100) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, count, bucket, run identifier) of the runs of starts, slice by slice; no string crosses a text."""
    width = length - length // 4 + 1
    for lo in range(0, len(data) - length + 1, _SLICE):
        hi = min(lo + _SLICE, len(data) - length + 1)
        quarter, whole = string_identifiers(data[lo : hi + length - 1], length)
        bucket = _smallest(quarter, width)
        n = hi - lo
        inside = np.ones(n, bool)
        first, last = np.searchsorted(offsets, [lo, hi + length])
        for end in np.unique(offsets[first:last]):  # starts whose string would cross this end
            inside[max(0, end - length + 1 - lo) : max(0, min(n, end - lo))] = False
        new = np.ones(n, bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (quarter[: n - 1] == bucket[:-1]) | ~inside[:-1]
        new |= ~inside
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, n))
        weights = _FACTOR[np.arange(n) - np.repeat(at, count)]
        run = mix(np.add.reduceat(whole * weights, at))
        keep = inside[at]
        yield at[keep] + lo, count[keep], bucket[at[keep]], run[keep]


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    tie = F.xxhash64(text)
    doc = F.col("doc_id").cast("long")
    return documents.select(doc.isNull().alias("no_id"), F.coalesce(doc, tie).alias("doc"), tie.alias("tie"), text.cast("binary").alias("text"))


def document_runs(rows: DataFrame, length: int) -> DataFrame:
    """bucket, run, no_id, doc, tie, start, count: each run once for a batch of documents, where it comes first."""
    schema = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), *_KEY_FIELDS, ("start", pa.int64()), ("count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.lexsort([batch[c].to_numpy(zero_copy_only=False) for c in reversed(ORDER)])
            for some in _portions(order, batch["text"]):
                own = batch.take(pa.array(some))
                data, offsets, _ = texts_of(own["text"])
                parts = list(runs_of(data, offsets, length))
                if not parts:
                    continue
                start, count, bucket, ident = (np.concatenate(x) for x in zip(*parts, strict=True))
                _, first, back = np.unique(bucket ^ (ident * _FACTOR[7]), return_index=True, return_inverse=True)
                keep = (bucket != bucket[first[back]]) | (ident != ident[first[back]])
                keep[first] = True
                at = np.flatnonzero(keep)
                row = np.searchsorted(offsets, start[at], side="right") - 1
                keys = [own[c].take(pa.array(row)) for c in ORDER]
                values = [pa.array(bucket[at].view(np.int64)), pa.array(ident[at].view(np.int64)), *keys, pa.array(start[at] - offsets[row]), pa.array(count[at].astype(np.int32))]
                yield from pa.Table.from_arrays(values, schema=schema).to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(run, f"bucket long, run long, {_KEY}, start long, count int")


def _portions(order: np.ndarray, texts: pa.Array, most: int = 32 << 20) -> Iterator[np.ndarray]:
    """``order`` cut where its texts reach ``most`` bytes."""
    sizes = np.diff(texts_of(texts)[1])[order]
    part = np.cumsum(sizes) // most
    for cut in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        if len(cut):
            yield cut


def first_runs(runs: DataFrame) -> DataFrame:
    """bucket, no_id, doc, tie, start, count, mixed: the first of equal runs; ``mixed`` where its bucket holds others too.

    The rows of a task come sorted by bucket, identifier and place and are walked once.
    """
    fields = ["bucket", *ORDER, "start", "count"]
    schema = pa.schema([("bucket", pa.int64()), *_KEY_FIELDS, ("start", pa.int64()), ("count", pa.int32()), ("mixed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # (bucket, run) of the row before; the last first run, whose bucket may go on
        for batch in batches:
            bucket, ident = batch["bucket"].to_numpy(), batch["run"].to_numpy()
            if not len(bucket):
                continue
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (ident[1:] != ident[:-1])
            new[0] = (bucket[0], ident[0]) != last
            last = (bucket[-1], ident[-1])
            own = pa.Table.from_batches([batch.select(fields).filter(pa.array(new))])
            before = held is not None and held[1]
            table = pa.concat_tables([held[0], own]) if held else own
            if not len(table):
                continue
            b = table["bucket"].to_numpy()
            same = b[1:] == b[:-1]
            mixed = np.zeros(len(b), bool)
            mixed[1:] |= same
            mixed[:-1] |= same
            mixed[0] |= before
            held = (table.slice(len(b) - 1), bool(mixed[-1]))
            done = table.slice(0, len(b) - 1).append_column("mixed", pa.array(mixed[:-1]))
            yield from done.cast(schema).combine_chunks().to_batches()
        if held:
            yield from held[0].append_column("mixed", pa.array([held[1]])).cast(schema).combine_chunks().to_batches()

    ordered = runs.repartition("bucket").sortWithinPartitions("bucket", "run", *ORDER, "start")
    return ordered.mapInArrow(run, f"bucket long, {_KEY}, start long, count int, mixed boolean")


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, int, list[pa.Table]]]:
    """(key, text, rows with this text, other rows) of each document, from rows sorted by key with texts first."""
    key, text, copies, others = None, b"", 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in ORDER]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            here = tuple(c[a].item() for c in cols)
            if here != key:
                if copies:
                    yield key, text, copies, others
                key, text, copies, others = here, b"", 0, []
            texts = int(np.count_nonzero(batch["is_text"].to_numpy(zero_copy_only=False)[a:b]))
            if texts and not copies:
                text = batch["text"][int(a)].as_py()
            copies += texts
            if b - a > texts:
                others.append(table.slice(a + texts, b - a - texts))
    if copies:
        yield key, text, copies, others


def _meet(rows: DataFrame, others: DataFrame, *extra: str) -> DataFrame:
    """Texts and the rows of their document, each document's together, its texts first."""
    none = [F.lit(None).cast(others.schema[c].dataType).alias(c) for c in extra]
    texts = rows.select(*ORDER, F.lit(True).alias("is_text"), "text", *none)
    rest = others.select(*ORDER, F.lit(False).alias("is_text"), F.lit(None).cast("binary").alias("text"), *extra)
    return texts.unionByName(rest).repartition(*ORDER).sortWithinPartitions(*ORDER, F.desc("is_text"))


def _mixed_bytes(rows: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """bucket, no_id, doc, tie, start, many, bytes: the strings of the runs in mixed buckets."""
    schema = pa.schema([("bucket", pa.int64()), *_KEY_FIELDS, ("start", pa.int64()), ("many", pa.bool_()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, text, _, others in _by_document(batches):
            for part in others:
                for b, s, c, m in zip(*(part[x].to_pylist() for x in ("bucket", "start", "count", "many")), strict=True):
                    out.append((b, *key, s, m, text[s : s + c + length - 1]))
            size += 1
            if len(out) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _meet(rows, mixed, "bucket", "start", "count", "many").mapInArrow(run, f"bucket long, {_KEY}, start long, many boolean, bytes binary")


def _starts(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in the row, 100-byte identifier) of each start of the ``bytes`` of a batch."""
    data, offsets, _ = texts_of(batch["bytes"])
    counts = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, at, string_identifiers(data, length)[1][offsets[row] + at]


def _first_starts(mixed: DataFrame, length: int) -> DataFrame:
    """no_id, doc, tie, start, count: stretches of first occurrences in buckets of a bounded number of runs."""
    schema = pa.schema([*_KEY_FIELDS, ("start", pa.int64()), ("count", pa.int32())])

    def firsts(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        row, at, ident = _starts(batch, length)
        bucket = batch["bucket"].to_numpy()[row]
        order = np.lexsort((np.arange(len(row)), ident, bucket))  # rows come in the order of documents
        first = np.ones(len(row), bool)
        first[1:] = (bucket[order][1:] != bucket[order][:-1]) | (ident[order][1:] != ident[order][:-1])
        kept = np.sort(order[first])
        cut = np.ones(len(kept), bool)
        cut[1:] = (row[kept][1:] != row[kept][:-1]) | (at[kept][1:] != at[kept][:-1] + 1)
        begin = np.flatnonzero(cut)
        own = row[kept[begin]]
        counts = np.diff(np.append(begin, len(kept))).astype(np.int32)
        start = batch["start"].to_numpy()[own] + at[kept[begin]]
        return pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(own)) for c in ORDER), pa.array(start), pa.array(counts)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            b = table["bucket"].to_numpy()
            cut = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
            held = table.slice(cut)
            if cut:
                yield firsts(table.slice(0, cut))
        if held is not None:
            yield firsts(held)

    ordered = mixed.select("bucket", *ORDER, "start", "bytes").repartition("bucket").sortWithinPartitions("bucket", *ORDER, "start")
    return ordered.mapInArrow(run, f"{_KEY}, start long, count int")


def _first_starts_of_many(mixed: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any number of runs: one row for each start, combined before the shuffle."""
    schema = pa.schema([("bucket", pa.int64()), ("ident", pa.int64()), *_KEY_FIELDS, ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at, ident = _starts(batch, length)
            took = batch.take(pa.array(row))
            made = [took["bucket"], pa.array(ident.view(np.int64)), *(took[c] for c in ORDER), pa.array(took["start"].to_numpy() + at)]
            yield from pa.Table.from_arrays(made, schema=schema).to_batches(max_chunksize=1 << 16)

    starts = mixed.mapInArrow(run, f"bucket long, ident long, {_KEY}, start long")
    first = starts.groupBy("bucket", "ident").agg(F.min(F.struct(*ORDER, "start")).alias("f"))
    return first.select("f.*", F.lit(1).alias("count"))


def first_occurrences(documents: DataFrame, length: int = 100, bucket_runs: int = 4096) -> DataFrame:
    """no_id, doc, tie, start, count: stretches of starts whose ``length``-byte string occurs nowhere earlier.

    Order: documents with doc_id by doc_id, then those without; of equal doc_ids by the hash of the text.
    Buckets of more than ``bucket_runs`` different runs are refined in an aggregate, others in their task.
    """
    rows = _rows(documents)
    runs = materialise(first_runs(document_runs(rows, length)))
    release(documents.sparkSession)
    mixed = runs.where("mixed")
    sizes = mixed.groupBy("bucket").agg((F.count("*") > bucket_runs).alias("many"))
    strings = materialise(_mixed_bytes(rows, mixed.join(sizes, "bucket"), length))
    release(documents.sparkSession)
    settled = materialise(_first_starts(strings.where("not many"), length).unionByName(_first_starts_of_many(strings.where("many"), length)))
    drop_scratch(strings)
    release(documents.sparkSession)
    return runs.where("not mixed").select(*ORDER, "start", "count").unionByName(settled)


def remove_repeats(documents: DataFrame, length: int = 100, bucket_runs: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of ``documents``.

    Each byte covered by a ``length``-byte string that also starts earlier (smaller doc_id, or the
    same document, earlier start) goes, judged on the texts as they are; strings never cross
    documents and overlapping occurrences count.  A null text is empty; a text shorter than
    ``length`` bytes keeps all.  Rows without doc_id come after all others, by the hash of their
    text; rows that share a doc_id and have different texts are documents in the order of that
    hash; rows equal in doc_id and text are one document and get its result each.  Empty tables
    are fine; other columns are not read.  ``length`` is a multiple of 4.
    """
    first = first_occurrences(documents, length, bucket_runs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (no_id, doc, _), text, copies, others in _by_document(batches):
            begins, counts = (np.concatenate([p[c].to_numpy() for p in others]) if others else np.zeros(0, np.int64) for c in ("start", "count"))
            kept, removed, spans = text, 0, 0
            starts = len(text) - length + 1
            if starts > 0:
                edge = np.zeros(len(text) + 1, np.int32)
                new = np.zeros(starts + 1, np.int32)  # starts that are first occurrences
                np.add.at(new, begins, 1)
                np.add.at(new, begins + counts, -1)
                again = np.flatnonzero(np.cumsum(new[:-1]) == 0)
                if len(again):
                    np.add.at(edge, again, 1)
                    np.add.at(edge, again + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, spans = int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for _ in range(copies):
                out.append((None if no_id else doc, len(text), removed, spans, kept))
                size += len(kept)
                if size > 8 << 20 or len(out) >= 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _meet(_rows(documents), first, "start", "count").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeated_bytes(documents: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    return remove_repeats(documents, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

