"""Books and sounds by format name: ``spark.read.format("lectern-epub").load(folder)``.

A partition is one large file or a run of small ones; files are opened by pyarrow's file systems
inside the tasks.  A schema given to the reader prunes: what it doesn't name isn't worked out.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .books import _epub, page_text, page_title, wav_bytes, wav_samples

PARTITION_BYTES = 128 << 20
BATCH_BYTES = 16 << 20


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: Sequence[str]


@dataclass
class Written(WriterCommitMessage):
    names: Sequence[str]


def dealt(sizes: Sequence[tuple[str, int]], bound: int) -> list[list[str]]:
    """Paths in order, in runs of at most ``bound`` bytes; a larger file is a run of its own."""
    runs, held = [], 0
    for path, size in sizes:
        if not runs or held + size > bound:
            runs.append([])
            held = 0
        runs[-1].append(path)
        held += size
    return runs


class _Reader(DataSourceReader):
    def __init__(self, source: _Format, schema: StructType) -> None:
        self.options, self.schema, self.rows, self.pattern = source.options, schema, source.rows, source.pattern

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = _system(self.options["path"])
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
        pattern = self.options.get("pathGlobFilter", self.pattern)
        below = lambda f: f.path[len(base) :].split("/")  # noqa: E731  folders of unfinished writes start with _ or .
        sizes = sorted((f.path, f.size) for f in found if f.is_file and (info.is_file or (fnmatch.fnmatchcase(f.base_name, pattern) and not any(p.startswith(("_", ".")) for p in below(f)))))
        return [Files(run) for run in dealt(sizes, int(self.options.get("partitionBytes", PARTITION_BYTES)))] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _system(self.options["path"])
        kind, names = to_arrow_schema(self.schema), set(self.schema.names)
        held, size = [], 0
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                content = f.read()
            size += len(content)
            held += ({n: row.get(n) for n in kind.names} for row in self.rows(path, content, names, self.options))
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)


class _Format(DataSource):
    """What all formats share; a bad file is an error, or with option badFiles=skip no rows."""

    columns, pattern = "", "*"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        known = {c.split()[0]: c.split()[1] for c in self.columns.split(", ")}
        for f in schema.fields:
            if known.get(f.name) != f.dataType.simpleString():
                raise ValueError(f"no column {f.name} {f.dataType.simpleString()} in {self.name()}")
        return _Reader(self, schema)

    @classmethod
    def rows(cls, path: str, content: bytes, names: set[str], options: dict) -> list[dict]:
        try:
            return cls.parsed(path, content, names, options)
        except Exception:
            if options.get("badFiles") == "skip":
                return []
            raise


class TextBook(_Format):
    """path, text: UTF-8 with bad bytes replaced, every line end a \\n."""

    columns, pattern = "path string, text string", "*.txt"

    @classmethod
    def name(cls) -> str:
        return "lectern-txt"

    @staticmethod
    def parsed(path: str, content: bytes, names: set[str], options: dict) -> list[dict]:
        text = content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") if "text" in names else None
        return [{"path": path, "text": text}]


class EpubBook(_Format):
    """path, book_title, author, language, item, title, text of each document with at least ``least`` (50) characters."""

    columns, pattern = "path string, book_title string, author string, language string, item int, title string, text string", "*.epub"

    @classmethod
    def name(cls) -> str:
        return "lectern-epub"

    @staticmethod
    def parsed(path: str, content: bytes, names: set[str], options: dict) -> list[dict]:
        about, html = _epub(content)
        texts = ((i, page, page_text(page)) for i, page in enumerate(html))
        common = {"path": path, "book_title": about["title"], "author": about["author"], "language": about["language"]}
        return [{**common, "item": i, "title": page_title(page) if "title" in names else None, "text": text} for i, page, text in texts if len(text.strip()) >= int(options.get("least", 50))]


class Sound(_Format):
    """path, rate, samples of 16-bit WAV files, mono; writes rows of (name, samples) at the option ``rate`` (24000)."""

    columns, pattern = "path string, rate int, samples array<double>", "*.wav"

    @classmethod
    def name(cls) -> str:
        return "lectern-wav"

    @staticmethod
    def parsed(path: str, content: bytes, names: set[str], options: dict) -> list[dict]:
        samples, rate = wav_samples(content)
        return [{"path": path, "rate": rate, "samples": samples if "samples" in names else None}]

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"name", "samples"} <= set(schema.names):
            raise ValueError("sounds are written from the columns name and samples")
        return _SoundWriter(self.options, overwrite)


class _SoundWriter(DataSourceWriter):
    """Files go to a folder of the write's own and move to their names when every task has ended; a failed write leaves none.

    The name of a file is the row's ``name`` and .wav; two rows of one name, or a null name, end the
    write.  With overwrite the .wav files that were there go first, without they stay, unless named again.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.rate, self.overwrite = options["path"].rstrip("/"), int(options.get("rate", 24000)), overwrite
        self.own = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, base = _system(self.path)
        attempt, names = uuid.uuid4().hex, []
        store.create_dir(f"{base}/{self.own}/{attempt}", recursive=True)
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"no name of a file: {name!r}")
            with store.open_output_stream(f"{base}/{self.own}/{attempt}/{name}.wav") as out:
                out.write(wav_bytes(row["samples"] or [], self.rate))
            names.append(f"{attempt}/{name}.wav")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = _system(self.path)
        made = [n for m in messages if m for n in m.names]
        finals = [n.split("/", 1)[1] for n in made]
        if len(set(finals)) < len(finals):
            self.abort(messages)
            raise ValueError("two sounds have the same name")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.is_file and f.extension == "wav":
                    store.delete_file(f.path)
        for n, final in zip(made, finals, strict=True):
            store.move(f"{base}/{self.own}/{n}", f"{base}/{final}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = _system(self.path)
        if store.get_file_info(f"{base}/{self.own}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.own}")


def register(spark: SparkSession) -> None:
    """Make the three formats known to a session."""
    for source in (TextBook, EpubBook, Sound):
        spark.dataSource.register(source)
