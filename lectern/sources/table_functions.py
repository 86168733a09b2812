"""Table functions for SQL: called by lateral join, each row of a table on its own, nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chapters import HEADINGS


def heading_function(patterns: Sequence[str] = HEADINGS, gap: int = 200):
    """A table function of a text: start (code points) and title of each chapter's heading, none within ``gap`` of the last kept.

    A null text has no headings; of headings with one start the earlier pattern counts.
    """
    compiled = [re.compile(p) for p in patterns]

    class ChapterHeadings:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            last = None
            for start, _, title in sorted((m.start(), o, m.group().strip()) for o, p in enumerate(compiled) for m in p.finditer(text or "")):
                if last is None or start - last > gap:
                    last = start
                    yield start, title

    return udtf(ChapterHeadings, returnType="start long, title string")


def register(spark: SparkSession, patterns: Sequence[str] = HEADINGS, gap: int = 200, name: str = "chapter_headings") -> None:
    """Make the function known to SQL: ``select d.doc_id, h.* from documents d, lateral chapter_headings(d.text) h``."""
    spark.udtf.register(name, heading_function(patterns, gap))
