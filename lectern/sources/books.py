"""Readers and writers: text and EPUB books, HTML pages, WAV audio, uploads, configuration.

Files are read by Spark (``binaryFile``), so any file system it knows will do; a book or a
sound is opened inside the task that holds its bytes.
"""

from __future__ import annotations

import io
import json
import re
import wave
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.chapters import split_chapters

BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6")
DROPPED = ("script", "style", "nav")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Page(HTMLParser):
    """Collects the text of every open block, so that nested blocks give their text twice."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag and place in blocks, or -1
        self.blocks: list[tuple[str, list[str]]] = []
        self.all: list[str] = []
        self.dropped = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            return
        if tag == "p":  # a paragraph ends where the next begins
            while any(t == "p" for t, _ in self.open) and self.open[-1][0] in ("p", "a", "b", "i", "em", "span", "strong"):
                if self.open.pop()[0] == "p":
                    break
        self.dropped += tag in DROPPED
        at = -1
        if tag in BLOCKS and not self.dropped:
            at = len(self.blocks)
            self.blocks.append((tag, []))
        self.open.append((tag, at))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, _ = self.open.pop()
                self.dropped -= t in DROPPED
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if data.strip() and not self.dropped:
            self.all.append(data.strip())
            for _, at in self.open:
                if at >= 0:
                    self.blocks[at][1].append(data.strip())


def page_text(html: str) -> str:
    """Texts of p, div and h1 to h6 in document order, parted by blank lines; without any, all text."""
    page = _Page()
    page.feed(html or "")
    page.close()
    tidy = lambda parts: " ".join(" ".join(parts).split())
    found = [t for _, parts in page.blocks if (t := tidy(parts))]
    return "\n\n".join(found) if found else tidy(page.all)


def page_title(html: str) -> str | None:
    """The first h1, else h2, else h3 with 1 to 199 characters; else a chapter heading in the opening."""
    page = _Page()
    page.feed(html or "")
    page.close()
    for level in ("h1", "h2", "h3"):
        first = next((parts for tag, parts in page.blocks if tag == level), None)
        if first is not None and 0 < len(t := "".join(first)) < 200:
            return t
    m = re.search(r"(?i)chapter\s+(?:\d+|[ivxlc]+)(?:\s*[:\-.]\s*(.+))?", "".join(page.all)[:500])
    return m.group().strip() if m else None


def html_pages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, title, text of each page by a real parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch["html"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([page_title(d) for d in docs], pa.string()), pa.array([page_text(d) for d in docs], pa.string())], ["key", "title", "text"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, title string, text string").withColumnRenamed("key", key)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of the files below ``path``; the scan for uploads and folders of sounds."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def txt_documents(files: DataFrame) -> DataFrame:
    """path, text of files (path, content): UTF-8 with bad bytes replaced, every line end a \\n."""
    return files.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n").alias("text"))


def read_txt(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, text of whole text files."""
    return txt_documents(read_files(spark, path, pattern))


def _epub(content: bytes) -> tuple[dict[str, str | None], list[str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_name = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        opf = ElementTree.fromstring(z.read(opf_name))
        base = opf_name.rpartition("/")[0]
        first = lambda name: next((e.text for e in opf.iter() if e.tag == f"{{http://purl.org/dc/elements/1.1/}}{name}"), None)
        items = [e.attrib["href"] for e in opf.iter() if e.tag.endswith("}item") and e.attrib.get("media-type") == "application/xhtml+xml"]
        html = [z.read(f"{base}/{h}" if base else h).decode("utf-8", "replace") for h in items]
    return {"title": first("title"), "author": first("creator"), "language": first("language")}, html


def epub_documents(files: DataFrame, least: int = 50) -> DataFrame:
    """path, book_title, author, language, item, title, text of each document of EPUB files (path, content).

    Items whose text has fewer than ``least`` characters are left out; a file that is no EPUB
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    about, html = _epub(content)
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    continue
                for i, page in enumerate(html):
                    if len((text := page_text(page)).strip()) >= least:
                        out.append({"path": path, "book_title": about["title"], "author": about["author"], "language": about["language"], "item": i, "title": page_title(page), "text": text})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    names = ["path", "book_title", "author", "language", "item", "title", "text"]
    kind = pa.schema([(n, pa.int32() if n == "item" else pa.string()) for n in names])
    return files.select("path", "content").mapInArrow(run, "path string, book_title string, author string, language string, item int, title string, text string")


def read_epub(spark: SparkSession, path: str, pattern: str = "*.epub", least: int = 50) -> DataFrame:
    """``epub_documents`` of the files below ``path``."""
    return epub_documents(read_files(spark, path, pattern), least)


def _txt_chapters(files: DataFrame) -> DataFrame:
    return split_chapters(txt_documents(files), "path")


def _epub_chapters(files: DataFrame) -> DataFrame:
    return epub_documents(files).selectExpr("path", "cast(row_number() over (partition by path order by item) as int) as number", "title", "text")


#: format -> parser from files (path, content) to chapters (path, number, title, text); more can be added
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"txt": _txt_chapters, "epub": _epub_chapters}


def parse_files(files: DataFrame, kind: str) -> DataFrame:
    """path, number, title, text, word_count, is_boilerplate of every chapter; ``kind`` is a key of PARSERS."""
    if kind not in PARSERS:
        raise ValueError(f"no parser for {kind}")
    chapters = PARSERS[kind](files)
    return chapters.select("path", "number", "title", "text", X.word_count(F.col("text")).alias("word_count"), X.is_boilerplate_chapter(F.col("title"), F.col("text")).alias("is_boilerplate"))


def parse_books(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``parse_files`` of the files below ``path`` whose names end in the format."""
    return parse_files(read_files(spark, path, f"*.{kind}"), kind)


def register_uploads(files: DataFrame) -> DataFrame:
    """Rows for uploaded files: stored name with an 8-character prefix, format, size, title from the name."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(
        "path", F.concat(F.left(F.sha2(F.col("path").cast("binary"), 256), F.lit(8)), F.lit("_"), name).alias("stored_as"), name.alias("original_filename"),
        F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("format"), F.col("length").alias("file_size_bytes"), X.title_from_file_name(F.col("path")).alias("title"),
    )


def store_uploads(files: DataFrame, folder: str) -> DataFrame:
    """The rows of ``register_uploads`` with file_path, after each file's bytes were written below ``folder``.

    ``folder`` is a path or URI of a file system that pyarrow knows and all executors share.  A
    file is written whole under its final name, so a task that runs again writes the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            places = [f"{base.rstrip('/')}/{name}" for name in batch["stored_as"].to_pylist()]
            for place, content in zip(places, batch["content"].to_pylist(), strict=True):
                with store.open_output_stream(place) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(places, pa.string())], ["path", "file_path"])

    rows = register_uploads(files)
    stored = rows.select("path", "stored_as").join(files.select("path", "content"), "path").mapInArrow(run, "path string, file_path string")
    return rows.join(stored, "path")


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1 and the rate of a 16-bit WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return raw.mean(axis=1) / 32768.0, w.getframerate()


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, float), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def wav_sounds(files: DataFrame) -> DataFrame:
    """path, rate, samples (array<double>) of WAV files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sounds = [wav_samples(c) for c in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([r for _, r in sounds], pa.int32()), pa.array([s for s, _ in sounds], pa.list_(pa.float64()))], ["path", "rate", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, rate int, samples array<double>")


def read_wav(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """``wav_sounds`` of the files below ``path``."""
    return wav_sounds(read_files(spark, path, pattern))


def to_wav(sounds: DataFrame, name: str, samples: str, rate: int) -> DataFrame:
    """name, content: each signal as the bytes of a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array([wav_bytes(np.array(x or [], float), rate) for x in batch["samples"].to_pylist()], pa.binary())], ["name", "content"])

    return sounds.select(F.col(name).cast("string").alias("name"), F.col(samples).alias("samples")).mapInArrow(run, "name string, content binary")


def sound_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files of segments (*seg*.wav) in order, or all WAV files if there are none; the first ``limit``.

    Which of the two holds is one row, joined to the files, and no job of its own.
    """
    sounds = files.where(F.col("path").endswith(".wav")).withColumn("_segment", F.col("path").rlike(r"seg[^/]*\.wav$"))
    some = sounds.agg(F.coalesce(F.bool_or("_segment"), F.lit(False)).alias("_any"))
    ordered = sounds.crossJoin(F.broadcast(some)).where("_segment or not _any").drop("_segment", "_any").orderBy("path")
    return ordered.limit(limit) if limit else ordered


@dataclass
class Server:
    host: str = "0.0.0.0"
    port: int = 8000
    reload: bool = True
    timeout_keep_alive: int = 300


@dataclass
class Speech:
    engine: str = "synthetic"
    model_name: str = ""
    default_temperature: float = 0.7
    default_top_k: int = 50
    default_top_p: float = 1.0
    repetition_penalty: float = 1.05
    max_new_tokens: int = 2048
    chunk_max_seconds: int = 12
    voice_sample_seconds: int = 20


@dataclass
class Audio:
    sample_rate: int = 24000
    output_sample_rate: int = 44100
    crossfade_ms: int = 150
    paragraph_silence_ms: int = 500
    chapter_silence_ms: int = 2000
    normalization_target_db: int = -16
    output_formats: list = field(default_factory=lambda: ["mp3", "m4b", "wav"])


@dataclass
class Chunking:
    target_chunk_seconds: float = 10.0
    max_chunk_seconds: float = 12.0
    sentence_silence_ms: int = 200
    paragraph_silence_ms: int = 500
    crossfade_ms: int = 100
    words_per_second_estimate: float = 2.5


@dataclass
class Quality:
    enabled: bool = True
    use_whisper: bool = True
    whisper_model: str = "base"
    min_words_for_whisper: int = 5
    max_retries: int = 2
    retry_log_level: str = "WARNING"
    failure_log_level: str = "ERROR"
    text_similarity_fail: float = 0.6
    text_similarity_warn: float = 0.75
    duration_ratio_fail: float = 2.5
    duration_ratio_warn: float = 1.8
    max_silence_s_fail: float = 3.0
    max_silence_s_warn: float = 1.5
    clipping_ratio_fail: float = 0.01
    repetition_score_fail: float = 0.7


@dataclass
class Resources:
    batch_size: str = "auto"
    memory_headroom_percent: float = 20.0
    per_segment_cost_gb: float = 1.5
    max_batch_size: int = 12
    min_batch_size: int = 1
    engine_pool_size: str = "auto"

    def override(self, name: str) -> int | None:
        """``batch_size`` or ``engine_pool_size`` as a number; None for auto and for what is no number."""
        try:
            return int(getattr(self, name))
        except ValueError:
            return None


@dataclass
class Language:
    spacy_model: str = ""
    llm_enabled: bool = True
    llm_model: str = ""
    llm_context_window: int = 12
    llm_context_overlap: int = 3
    emotion_detection: bool = True
    speaker_attribution: bool = True
    auto_voice_traits: bool = True


@dataclass
class Logging:
    level: str = "INFO"
    format: str = "detailed"
    file_output: bool = True
    log_dir: str = "logs"


@dataclass
class Config:
    """Sections with defaults; a mapping or a YAML text and three variables override them."""

    server: Server = field(default_factory=Server)
    tts: Speech = field(default_factory=Speech)
    audio: Audio = field(default_factory=Audio)
    chunking: Chunking = field(default_factory=Chunking)
    quality: Quality = field(default_factory=Quality)
    resources: Resources = field(default_factory=Resources)
    nlp: Language = field(default_factory=Language)
    logging: Logging = field(default_factory=Logging)


def load_config(values: dict | str | None = None, environment: dict[str, str] | None = None) -> Config:
    """``values``: a mapping, or the text of a JSON or YAML file.  Unknown sections and keys are ignored.

    Values take the type of the default.  Settings of a speech model may stand in a section of
    their own inside tts.  SERVER_PORT, LOG_LEVEL and TTS_ENGINE of ``environment`` win.
    """
    if isinstance(values, str):
        try:
            values = json.loads(values)
        except ValueError:
            import yaml  # only where such a file is read: not part of the fixed environment

            values = yaml.safe_load(values)
    config, env, given = Config(), environment or {}, values or {}
    for section in fields(config):
        own, read = getattr(config, section.name), given.get(section.name) or {}
        if section.name == "tts":
            read = {**{k: v for x in read.values() if isinstance(x, dict) for k, v in x.items()}, **read}
        for f in fields(own):
            if f.name in read:
                setattr(own, f.name, type(getattr(own, f.name))(read[f.name]))
    if env.get("SERVER_PORT"):
        config.server.port = int(env["SERVER_PORT"])
    config.logging.level = env.get("LOG_LEVEL") or config.logging.level
    config.tts.engine = env.get("TTS_ENGINE") or config.tts.engine
    return config


def configurations(files: DataFrame, key: str, text: str, environment: dict[str, str] | None = None) -> DataFrame:
    """key, section, setting, value (as text) of every setting of each configuration file; a null text gives the defaults."""
    kind = pa.list_(pa.struct([("section", pa.string()), ("setting", pa.string()), ("value", pa.string())]))

    def settings(config: Config) -> list[dict]:
        return [{"section": s.name, "setting": f.name, "value": str(getattr(getattr(config, s.name), f.name))} for s in fields(config) for f in fields(getattr(config, s.name))]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([settings(load_config(t, environment)) for t in texts.to_pylist()], kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    read = F.arrow_udf(run, "array<struct<section:string,setting:string,value:string>>")(F.col(text))
    return files.select(key, F.explode_outer(read).alias("x")).select(key, "x.*")
