"""Order-dependent folds as Arrow functions: numbers and flags go to Python, texts stay in the JVM.

A fold inside ``aggregate`` that collects its results copies them at every step; here a row's
items are walked once, and what comes back is one number or flag for each item.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(items: Column, walk: Callable[[Sequence], list], returns: str, kind: pa.DataType) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if row is None else walk(row) for row in column.to_pylist()], kind)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)(items)


def pack_numbers(sentences: Column, limit: float, least: float) -> Column:
    """Chunk number of each struct(seconds, is_end): one more where the sum would pass ``limit``, or after an end with ``least``."""

    def walk(row: Sequence[dict]) -> list[int]:
        out, chunk, seconds, is_open = [], -1, 0.0, False
        for s in row:
            fits = is_open and seconds + s["seconds"] <= limit
            chunk, seconds = (chunk, seconds + s["seconds"]) if fits else (chunk + 1, s["seconds"])
            out.append(chunk)
            is_open = not (s["is_end"] and seconds >= least)
        return out

    return _fold(F.transform(sentences, lambda s: F.struct(s["seconds"].alias("seconds"), s["is_end"].alias("is_end"))), walk, "array<int>", pa.list_(pa.int32()))


def part_numbers(seconds: Column, cap: float) -> Column:
    """For arrays of arrays of seconds: number of each item, one more where its array's sum would pass ``cap``."""

    def walk(row: Sequence[Sequence[float]]) -> list[list[int]]:
        out = []
        for own in row:
            numbers, total, n = [], 0.0, 0
            for i, x in enumerate(own):
                if i and total + x > cap:
                    total, n = 0.0, n + 1
                total += x
                numbers.append(n)
            out.append(numbers)
        return out

    return _fold(seconds, walk, "array<array<int>>", pa.list_(pa.list_(pa.int32())))


def apart_flags(starts: Column, gap: int) -> Column:
    """True for the first of sorted numbers and for each one more than ``gap`` after the last true one."""

    def walk(row: Sequence[int]) -> list[bool]:
        out, last = [], None
        for x in row:
            out.append(last is None or x - last > gap)
            last = x if out[-1] else last
        return out

    return _fold(starts, walk, "array<boolean>", pa.list_(pa.bool_()))


def segment_numbers(sentences: Column, soft: int, slack: int, most: int) -> Column:
    """Segment number of each struct(words, is_dialogue, speaker, emotion, emphasis, starts); see ``group_segments``."""

    def walk(row: Sequence[dict]) -> list[int]:
        out, before, g, n, words, absorbed = [], None, 0, 0, 0, False
        for s in row:
            cut = absorb = False
            if before is not None:
                if s["is_dialogue"] != before["is_dialogue"]:
                    cut = True
                elif s["is_dialogue"]:
                    cut = s["speaker"] != before["speaker"]
                elif s["emotion"] != before["emotion"] or s["emphasis"] != before["emphasis"]:
                    absorb = not absorbed and words + s["words"] <= soft + slack
                    cut = not absorb
                else:
                    cut = s["starts"] or n >= most or words + s["words"] > soft
            if cut:
                g, n, words, absorbed = g + 1, 0, 0, False
            n, words, absorbed, before = n + 1, words + s["words"], absorbed or absorb, s
            out.append(g)
        return out

    return _fold(sentences, walk, "array<int>", pa.list_(pa.int32()))
