"""Token ids in binary shards: one zstandard frame for each document and a seek table.

A shard holds, in ascending doc_id order:

* one independent zstandard frame for each document (content checksum on): its ids as
  little-endian unsigned integers of ``width`` bytes, end id included;
* a skippable frame (0x184D2A5C) with an index: magic, width, count, doc_ids (int64),
  a byte each that says whether doc_id is null, token counts (int64);
* the seek table of the zstandard seekable format: a skippable frame (0x184D2A5E) with
  compressed size, decompressed size and checksum (low 32 bits of XXH64) of every frame
  and a footer, so a reader finds any document from the end of the file.

Any zstandard decoder reads a shard as one stream.  Texts are shuffled once, by ranges of
(doc_id, text, row), so a doc_id of a third of all rows is in many ranges too.  A task encodes
its sorted rows as a stream and closes a shard at a bound of bytes, so its memory does not
depend on the size of its range.  Each shard is one file of Spark's own writer and commit
protocol, so a lost task is run again and leaves nothing behind; file names ascend with doc_id.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .scratch import materialise, scratch_dir
from .textbytes import slices, texts_of, word_hashes

INDEX_FRAME, SEEK_FRAME, SEEK_MAGIC, INDEX_MAGIC = 0x184D2A5C, 0x184D2A5E, 0x8F92EAB1, b"LTI1"
#: distinct chunks remembered in a worker, at about 40 bytes each
REMEMBERED = 2_000_000
#: chunks that the library encodes at once
ENCODED_AT_ONCE = 2048
#: a shard is closed when its frames reach this
SHARD_BYTES = 32 << 20
#: text of one range of documents; beyond MOST_RANGES ranges grow instead, with more shards in each
RANGE_BYTES, MOST_RANGES = 32 << 20, 50_000

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: second bytes of the two-byte letters of Latin-1, after 0xC2 and after 0xC3
_C2_LETTER, _C3_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_C2_LETTER[[0xAA, 0xB5, 0xBA]] = True
_C3_LETTER[0x80:0xC0] = True
_C3_LETTER[[0x97, 0xB7]] = False
#: white space but space and line feed, by any reading: one byte, or the bytes of a character
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_ODD_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _rows_with(at: np.ndarray, positions: np.ndarray) -> np.ndarray:
    rows = np.zeros(len(at) - 1, bool)
    rows[np.searchsorted(at, positions, side="right") - 1] = True
    return rows


def chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where pre-tokens of the byte-level pattern surely part, in texts given by offsets ``at``.

    White space after another character begins a pre-token; the last space of a run goes with
    what follows it, a line feed never does, and the rest of the run stands alone; no pattern
    goes on from a letter to another character that is no letter.  Letters are those of
    Latin-1; texts with characters beyond it part at white space only.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    white = (data == 32) | (data == 10)
    letter = _ASCII_LETTER[data]
    for lead, second in ((0xC2, _C2_LETTER), (0xC3, _C3_LETTER)):
        p = np.flatnonzero(data[:-1] == lead)
        p = p[second[data[p + 1]]]
        letter[p] = letter[p + 1] = True
    beyond = np.flatnonzero(data >= 0xC4)
    if len(beyond):
        for i in np.flatnonzero(_rows_with(at, beyond)):
            letter[at[i] : at[i + 1]] = False
    first = np.zeros(n + 1, bool)
    first[at] = True
    start = first[:n].copy()
    after_white = np.concatenate([[False], white[:-1]])
    last_of_run = white & np.concatenate([~white[1:], [False]]) & ~first[1:]
    start[1:] |= white[1:] & ~white[:-1]  # white space after another character
    start |= last_of_run & after_white  # the last of a longer run
    start[1:] |= ~white[1:] & (data[:-1] == 10)  # after a line feed
    start[1:] |= ~white[1:] & ~letter[1:] & letter[:-1] & ((data[1:] & 0xC0) != 0x80)
    return np.flatnonzero(start)


class ChunkIds:
    """Ids of texts from ids of their chunks; each distinct chunk is encoded once while remembered.

    Chunks are told apart by 64-bit hashes, of which a worker holds REMEMBERED at most, so two
    chunks are taken for one with a chance below 1e-12 for each new chunk.  New chunks go to
    the library many at once, in lines of one text: a line feed is a token of its own there.
    Texts with other white space or with special strings go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        in_lines = self.tokenizer.encode("\n a\n'b", add_special_tokens=False).ids
        apart = [x for t in (" a", "'b") for x in (*feed, *self.tokenizer.encode(t, add_special_tokens=False).ids)]
        self.feed = feed[0] if len(feed) == 1 and in_lines == apart else None
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        """Remember chunks, none of them known yet."""
        made: list[np.ndarray] = []
        for i in range(0, len(chunks), ENCODED_AT_ONCE):
            some = chunks[i : i + ENCODED_AT_ONCE]
            alone = [self.feed is None or "\n" in c or not c.strip(" ") for c in some]
            lines = [c for c, a in zip(some, alone, strict=True) if not a]
            split: list[np.ndarray] = []
            if lines:
                ids = np.asarray(self.tokenizer.encode("\n" + "\n".join(lines), add_special_tokens=False).ids, self.kind)
                split = np.split(ids, np.flatnonzero(ids == self.feed))[1:]
                if len(split) != len(lines):
                    raise ValueError("a line feed is not a token of its own")
            parts = iter([x[1:] for x in split])
            rest = iter(self.direct([c for c, a in zip(some, alone, strict=True) if a]))
            made += [next(rest) if a else next(parts) for a in alone]
        size = np.array([len(x) for x in made], np.int64)
        begin = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, *made])
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys, self.begin, self.size = every[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each whole text of UTF-8 ``data`` with offsets ``at``."""
        raw = data.tobytes()
        whole = _rows_with(at, np.flatnonzero(_ODD_BYTE[data])) if len(data) else np.zeros(len(at) - 1, bool)
        for pattern in (_ODD_SPACE, self.special):
            if pattern and (hits := [m.start() for m in pattern.finditer(raw)]):
                whole |= _rows_with(at, np.array(hits))
        starts = chunk_starts(data, at)
        ends = np.append(starts[1:], len(data))
        if whole.any():
            split = ~whole[np.searchsorted(at, starts, side="right") - 1]
            starts, ends = starts[split], ends[split]
        keys, first, chunk = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(keys[new], [raw[starts[k] : ends[k]].decode() for k in first[new]])
            place = np.searchsorted(self.keys, keys)
        size, begin = self.size[place][chunk], self.begin[place][chunk]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        edge = upto[np.searchsorted(starts, at)]
        rest = iter(self.direct([raw[at[i] : at[i + 1]].decode() for i in np.flatnonzero(whole)]))
        return [next(rest) if whole[i] else ids[edge[i] : edge[i + 1]] for i in range(len(at) - 1)]


@lru_cache(maxsize=1)
def _chunk_ids(path: str) -> ChunkIds:
    """One for a worker: what it remembers serves all tasks that the worker runs."""
    return ChunkIds(path)


class ShardWriter:
    """Builds the bytes of one shard from frames in order."""

    def __init__(self, width: int):
        self.width, self.frames, self.table, self.ids, self.counts, self.n_bytes = width, [], [], [], [], 0

    def add(self, doc_id: int | None, n_tokens: int, checksum: int, frame: bytes) -> None:
        self.frames.append(frame)
        self.table.append(struct.pack("<III", len(frame), n_tokens * self.width, checksum))
        self.ids.append(doc_id)
        self.counts.append(n_tokens)
        self.n_bytes += len(frame)

    def content(self) -> bytes:
        known = bytes(i is not None for i in self.ids)
        index = INDEX_MAGIC + struct.pack("<IQ", self.width, len(self.ids)) + np.array([i or 0 for i in self.ids], "<i8").tobytes() + known + np.array(self.counts, "<i8").tobytes()
        table = [*self.table, struct.pack("<III", len(index) + 8, 0, 0)]
        footer = struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC)
        seek = b"".join(table) + footer
        return b"".join([*self.frames, struct.pack("<II", INDEX_FRAME, len(index)), index, struct.pack("<II", SEEK_FRAME, len(seek)), seek])


class ShardReader:
    """Random access to the documents of one shard: its bytes, or an open file that can seek.

    Of a file, the footer, the seek table, the index and the frames asked for are read, and
    nothing else; only frames asked for are decompressed.
    """

    def __init__(self, shard):
        self.file = shard if hasattr(shard, "seek") else pa.BufferReader(shard)
        size = self.file.seek(0, os.SEEK_END)
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        ends = np.cumsum(table[:, 0], dtype=np.int64)
        start = int(ends[-2]) + 8 if n > 1 else 8
        index = self._read(start, int(ends[-1]) - start)
        if index[:4] != INDEX_MAGIC:
            raise ValueError("no index")
        self.width, count = struct.unpack("<IQ", index[4:16])
        known = np.frombuffer(index[16 + 8 * count : 16 + 9 * count], np.uint8)
        self.doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(index[16 : 16 + 8 * count], "<i8"), known, strict=True)]
        self.n_tokens = np.frombuffer(index[16 + 9 * count :], "<i8")
        self.ends, self.table, self.reader = ends, table, zstandard.ZstdDecompressor()

    def _read(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, after a check of its checksum."""
        start = self.ends[i - 1] if i else 0
        raw = self.reader.decompress(self._read(int(start), int(self.ends[i] - start)), max_output_size=int(self.table[i, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"checksum of document {i}")
        return np.frombuffer(raw, f"<u{self.width}")


def _ranges(documents: DataFrame) -> int:
    """Ranges of documents to write: enough for all cores, RANGE_BYTES of text each, MOST_RANGES at most."""
    total = documents.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, min(MOST_RANGES, -(-total // RANGE_BYTES)), min(documents.sparkSession.sparkContext.defaultParallelism, total >> 20))


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES, ranges: int | None = None) -> None:
    """Write the shards of ``documents`` as files below ``path`` (any file system that Spark writes).

    Files by name, and documents in a file, ascend by doc_id, nulls first; rows that repeat a
    doc_id are all written, ordered by a hash of their texts.  A shard holds ``shard_bytes`` of
    frames and what its last document has beyond.  A null text is an empty text.  An empty
    table writes no shard.
    """
    place = [F.col("doc_id").asc_nulls_first(), F.col("_text_hash"), F.col("_row")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_text_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(ranges or _ranges(documents), *place).sortWithinPartitions(*place).select("doc_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        chunk_ids = _chunk_ids(tokenizer_path)
        end = np.array([end_id], chunk_ids.kind)
        packer = zstandard.ZstdCompressor(level=1, write_checksum=True)
        writer = ShardWriter(chunk_ids.width)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([writer.content()[:-1]], pa.binary())], ["content"])
        for batch in batches:
            data, offsets, _ = texts_of(batch["text"])
            doc_ids = batch["doc_id"].to_pylist()
            for i, j in slices(offsets, 1 << 20):
                for doc_id, ids in zip(doc_ids[i:j], chunk_ids.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True):
                    raw = np.append(ids, end).tobytes()
                    writer.add(doc_id, len(raw) // chunk_ids.width, xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF, packer.compress(raw))
                    if writer.n_bytes >= shard_bytes:
                        yield done()
                        writer = ShardWriter(chunk_ids.width)
        if writer.ids:
            yield done()

    # A text row is its bytes and the separator: here the last byte of the seek table's magic number.  One row a file.
    last = struct.pack("<I", SEEK_MAGIC)[-1:].decode("latin-1")
    blobs = ordered.mapInArrow(build, "content binary").select(F.expr("cast(content as string)").alias("value"))
    blobs.write.option("encoding", "ISO-8859-1").option("lineSep", last).option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """shard, at, doc_id, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"], strict=True):
                shard_file = ShardReader(content.as_buffer())
                n = len(shard_file)
                sums = [crc32(shard_file.ids(i).astype("<u4").tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(shard_file.doc_ids, pa.int64()), pa.array(shard_file.n_tokens, pa.int64()), pa.array(sums, pa.int64())], ["shard", "at", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).where("length > 0")
    number = lambda i: F.regexp_extract("path", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", i).cast("long")
    return files.select((F.shiftleft(number(1), 32) + number(2)).alias("shard"), "content").mapInArrow(run, "shard long, at long, doc_id long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write shards of ``documents``, read them back: doc_id, start, n_tokens, ids_crc32.

    start is the number of ids of all documents before, in doc_id order (nulls first).  A null
    text is an empty text: only the end id.  Rows that repeat a doc_id are documents of their
    own, in the order of a hash of their texts; other columns are not read; an empty table gives an
    empty table.  ``path``: where the shards stay; by default a new folder in the shared one.
    """
    spark = documents.sparkSession
    path = path or scratch_dir(spark)
    write_token_files(documents, path, tokenizer_path, end_id)
    found = materialise(read_token_files(spark, path))
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("at")) - F.col("n_tokens")
    return found.withColumn("inside", inside).join(before, "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
