"""Model-backed steps, pluggable: a back-end is a function over batches that is loaded once for each partition.

The defaults need no model: annotation by keywords, speech as a tone, transcription as given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import common_items

#: samples that speech holds before it passes them on, 32 MB
HELD_SAMPLES = 1 << 22

Speak = Callable[[str, str, int], np.ndarray]
Annotate = Callable[[Sequence[dict], str, Sequence[str]], list[dict]]


def tone(rate: int = 24000, words_per_second: float = 2.5) -> Callable[[], Speak]:
    """A back-end that hums as long as the text would take; the same for the same text, voice and seed."""

    def load() -> Speak:
        def speak(text: str, voice: str, seed: int) -> np.ndarray:
            n = int(rate * max(0.3, len(text.split()) / words_per_second))
            pitch = 110 + (sum(voice.encode()) + seed) % 220
            return 0.3 * np.sin(2 * np.pi * pitch * np.arange(n) / rate)

        return speak

    return load


def synthesise(segments: DataFrame, text: str, voice: str, seed: str, load: Callable[[], Speak] | None = None) -> DataFrame:
    """``segments`` with samples; a text that fails or is empty has none."""
    load = load or tone()
    names = segments.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speak = load()
        for batch in batches:
            out, held, start = [], 0, 0

            def ready(end: int) -> pa.RecordBatch:
                rows = batch.slice(start, end - start)  # noqa: B023
                return pa.RecordBatch.from_arrays([*(rows[c] for c in names), pa.array(out, pa.list_(pa.float64()))], [*names, "samples"])  # noqa: B023

            for i, (t, v, s) in enumerate(zip(batch[text].to_pylist(), batch[voice].to_pylist(), batch[seed].to_pylist(), strict=True)):
                try:
                    out.append(speak(t, v or "", s or 0) if t and t.strip() else None)
                except (ValueError, RuntimeError):
                    out.append(None)
                held += 0 if out[-1] is None else len(out[-1])
                if held >= HELD_SAMPLES:
                    yield ready(i + 1)
                    out, held, start = [], 0, i + 1
            if out:
                yield ready(batch.num_rows)

    return segments.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema) + ", samples array<double>")


def similarity(expected: str | None, heard: str | None) -> float:
    """Ratio of matching word runs; 1 if nothing was expected."""
    tidy = lambda t: re.sub(r"[^\w\s']", " ", (t or "").lower()).split()
    want, got = tidy(expected), tidy(heard)
    return 2.0 * common_items(want, got) / (len(want) + len(got)) if want else 1.0


def with_similarity(rows: DataFrame, expected: str, heard: str, out: str = "similarity") -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [similarity(a, b) for a, b in zip(batch[expected].to_pylist(), batch[heard].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(s, pa.float64())], [*names, out])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out} double")


def context_windows(sentences: DataFrame, key: str, index: str, text: str, size: int = 12, overlap: int = 3, before: int = 5) -> DataFrame:
    """key, win, at, text, context: overlapping windows; the first row of each has the sentences before it."""
    step = size - overlap
    w = Window.partitionBy(key).orderBy(index)
    rows = sentences.select(key, F.col(index).alias("at"), F.col(text).alias("text"), F.array_join(F.collect_list(text).over(w.rowsBetween(-before, -1)), " ").alias("context"))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - overlap) / step)).cast("int")
    placed = rows.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("at") / step).cast("int")))).where((F.col("at") >= F.col("win") * step) & (F.col("at") < F.col("win") * step + size))
    return placed.withColumn("context", F.when(F.col("at") == F.col("win") * step, F.col("context")))


def first_window_wins(sentences: DataFrame, annotations: DataFrame, key: str, index: str, defaults: dict[str, str], then: Sequence[str] = ()) -> DataFrame:
    """Each sentence with the fields of its earliest window; missing fields, and sentences without any, take the defaults.

    If a sentence can be in a window more than once, the columns ``then`` say which comes first;
    without them any of these does.  Annotations without a window are none.
    """
    fields = F.struct(*defaults)
    order = F.when(F.col("win").isNotNull(), F.struct("win", *then)) if then else F.col("win")
    first = annotations.groupBy(F.col(key).alias("_k"), F.col(index).alias("_i")).agg(F.min_by(fields, order).alias("_f"))
    rows = sentences.join(first, (F.col(key) == F.col("_k")) & (F.col(index) == F.col("_i")), "left")
    return rows.select(*sentences.columns, *(F.coalesce(F.col("_f")[c], F.lit(v)).alias(c) for c, v in defaults.items()))


def annotate(sentences: DataFrame, key: str, index: str, load: Callable[[], Annotate], names: Sequence[str] = (), size: int = 12, overlap: int = 3, defaults: dict[str, str] | None = None) -> DataFrame:
    """Sentences (key, index, text) with the fields of ``defaults`` from a pluggable annotator, window by window.

    The annotator is loaded once for each task and gets a window's sentences, the context
    before it and the characters' names.  A window that fails is neutral and steady; of
    overlapping windows the earliest counts.
    """
    defaults = defaults or {"speaker": "Narrator", "emotion": "neutral", "emphasis": "normal", "pacing": "normal", "vocal_direction": ""}
    failed = dict(defaults) | ({"vocal_direction": "clear, steady narration"} if "vocal_direction" in defaults else {})
    placed = context_windows(sentences, key, index, "text", size, overlap)
    listed = placed.groupBy(key, "win").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("s"), F.max("context").alias("context"))
    item = pa.struct([("at", pa.int64()), *((c, pa.string()) for c in defaults)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = load()
        for batch in batches:
            out = []
            for own, context in zip(batch["s"].to_pylist(), batch["context"].to_pylist(), strict=True):
                try:
                    notes = ask(own, context or "", names)
                except (ValueError, RuntimeError):
                    notes = [failed] * len(own)
                out.append([{"at": s["at"], **{c: (notes[i] or {}).get(c) if i < len(notes) else None for c in defaults}} for i, s in enumerate(own)])
            yield pa.RecordBatch.from_arrays([batch["key"], batch["win"], pa.array(out, pa.list_(item))], ["key", "win", "notes"])

    kind = sentences.schema[key].dataType.simpleString()
    rows = listed.select(F.col(key).alias("key"), "win", "s", "context").mapInArrow(run, f"key {kind}, win int, notes array<struct<at:long,{','.join(f'{c}:string' for c in defaults)}>>")
    notes = rows.select(F.col("key").alias(key), "win", F.explode("notes").alias("n")).select(key, "win", F.col("n.at").alias(index), *(F.col(f"n.{c}").alias(c) for c in defaults))
    return first_window_wins(sentences, notes, key, index, defaults)


def retried(attempts: DataFrame, key: Sequence[str], passed: Column, order: str, best: Column | None = None) -> DataFrame:
    """One attempt for each key: the first that passed, else the last (or the best)."""
    rank = F.struct(F.when(passed, 0).otherwise(1), F.when(passed, F.col(order)).otherwise(-best if best is not None else -F.col(order)))
    return attempts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(rank))).where("_n = 1").drop("_n")


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear resampling from ``rate`` to ``to`` samples a second."""
    if rate == to or len(x) == 0:
        return x
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)


def chapter_parts(chapters: DataFrame, book: str, order: str, samples: str, rate: str | int = 24000, to: int = 24000, silence_ms: int = 2000, fade_ms: int = 150, piece: int = 1 << 20) -> DataFrame:
    """book, start, samples: the sound of ``concatenate_chapters`` as parts of at most ``piece`` samples; by ``start`` they join without gaps.

    Where each chapter begins is a running sum of lengths; only these meet for a book, so its
    sound has no bound.  The fade reaches into the silence alone, which must be as long.
    ``order`` is unique within a book; a book without any chapter's sound has no parts.
    """
    fade, silence = int(to * fade_ms / 1000), int(to * silence_ms / 1000)
    if silence < fade:
        raise ValueError("the silence between chapters must be as long as the fade")
    own_rate = F.col(rate) if isinstance(rate, str) else F.lit(rate)
    rows = chapters.select(F.col(book).alias("book"), F.col(order).alias("at"), F.col(samples).alias("samples"), own_rate.cast("int").alias("rate")).where(F.size("samples") > 0)
    length = F.when(F.col("rate") == to, F.size("samples")).otherwise(F.greatest(F.lit(1), F.rint(F.size("samples") * to / F.col("rate")))).cast("long")
    by_book = Window.partitionBy("book").orderBy("at")
    before = by_book.rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.select("book", "at", length.alias("n")).withColumn("nth", F.row_number().over(by_book) - 1)
    faded = sized.withColumn("fades", (F.col("nth") > 0) & (F.col("n") >= fade) & F.lit(fade > 0))
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) + silence * F.col("nth") - fade * F.sum(F.col("fades").cast("long")).over(by_book)
    quiet = F.when(F.col("nth") == 0, 0).otherwise(silence - F.when(F.col("fades"), fade).otherwise(0))
    placed = faded.select(F.col("book").alias("_b"), F.col("at").alias("_a"), "fades", start.alias("start"), quiet.cast("long").alias("quiet"))
    schema = pa.schema([("start", pa.int64()), ("samples", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = resampled(np.asarray(batch["samples"][i].values.to_numpy(zero_copy_only=False), float), batch["rate"][i].as_py(), to)
                if batch["fades"][i].as_py():
                    x = np.concatenate([x[:fade] * np.linspace(0, 1, fade), x[fade:]])
                begin, gap = batch["start"][i].as_py(), batch["quiet"][i].as_py()
                parts = [(begin - gap + a, np.zeros(min(piece, gap - a))) for a in range(0, gap, piece)] + [(begin + a, x[a : a + piece]) for a in range(0, len(x), piece)]
                for a, part in parts:
                    made = pa.RecordBatch.from_arrays([pa.array([a]), pa.array([part], schema.field("samples").type)], schema=schema)
                    yield pa.RecordBatch.from_arrays([batch["book"].slice(i, 1), *made.columns], ["book", "start", "samples"])

    both = rows.join(placed, F.col("book").eqNullSafe(F.col("_b")) & (F.col("at") == F.col("_a"))).select("book", "samples", "rate", "fades", "start", "quiet")
    out = both.mapInArrow(run, f"book {both.schema['book'].dataType.simpleString()}, start long, samples array<double>")
    return out.withColumnRenamed("book", book)


def concatenate_chapters(chapters: DataFrame, book: str, order: str, samples: str, rate: str | int = 24000, to: int = 24000, silence_ms: int = 2000, fade_ms: int = 150) -> DataFrame:
    """book, samples, error: chapters in order with silence and a linear fade between; missing ones are skipped.

    ``rate``: a number, or the column with each chapter's rate; other rates than ``to`` are
    resampled.  A book without any chapter's sound has no samples and an error.  A book's sound
    is one value of one row, so one task holds one book.
    """
    n = int(to * fade_ms / 1000)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out: list[np.ndarray] = []
        for x, r in zip(*(part.sort_values(order)[c] for c in ("samples", "rate")), strict=True):
            if x is None or len(x) == 0:
                continue
            x = resampled(np.asarray(x, float), int(r), to)
            if out:
                out.append(np.zeros(int(to * silence_ms / 1000)))
                before = np.concatenate(out[-2:]) if len(out[-1]) < n else out[-1]
                if n and len(before) >= n and len(x) >= n:
                    out[-2:] = [before] if len(out[-1]) < n else out[-2:]
                    t = np.linspace(0, 1, n)
                    mixed = out[-1][-n:] * (1 - t) + x[:n] * t
                    out[-1] = out[-1][:-n]
                    out += [mixed, x[n:]]
                    continue
            out.append(x)
        return pd.DataFrame({book: [key[0]], "samples": [np.concatenate(out).tolist() if out else None], "error": [None if out else "no chapter has sound"]})

    rows = chapters.select(book, order, F.col(samples).alias("samples"), (F.col(rate) if isinstance(rate, str) else F.lit(rate)).alias("rate"))
    return rows.groupBy(book).applyInPandas(run, f"{book} {chapters.schema[book].dataType.simpleString()}, samples array<double>, error string")
