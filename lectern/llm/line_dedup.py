"""Line deduplication over all documents; DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased.  Keys are hashed
to 128 bits, range-partitioned by (hash, document) and sorted by (hash, document, position),
so a key in a third of all documents spreads over many partitions, and a window over the
sorted rows streams the first occurrence of every (key, document).  Only those first
occurrences are counted; a frequent key meets its lines again by (hash, partition), so no
task ever holds more of it than one range.  The result is not text but, for each document
that loses lines, a keep bitmap compressed by runs: lines that stay, lines that go, in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_WHITE))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def first_occurrences(documents: DataFrame, min_chars: int = 20) -> DataFrame:
    """h1, h2, doc_id, text_hash, at, part, first: keyed lines in (hash, document, position) order within ranges.

    ``first`` marks the first line of each (key, document); ``part`` is the range that holds it.
    """
    lines = _rows(documents).where("doc_id is not null").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keyed = lines.select("doc_id", "text_hash", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    # written once: the ranges are found by a pass of their own, which must not split texts again
    hashed = materialise(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "text_hash", "at"))
    ranged = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "at")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("at"))
    return ranged.select("*", F.spark_partition_id().alias("part"), (nth == 1).alias("first"))


def keep_bitmaps(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_hash, n_dropped, runs of each document that loses lines.

    runs: numbers of lines that stay and that go, in turn, the first that stay (it can be 0);
    lines beyond the last run stay.
    """
    placed = materialise(first_occurrences(documents, min_chars))
    counted = placed.where("first").groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("stays"), F.collect_set("part").alias("parts"))
    often = materialise(counted.where(F.col("docs") >= min_docs).select("h1", "h2", "stays", F.explode("parts").alias("part")))
    gone = placed.join(often, ["h1", "h2", "part"]).where("doc_id <> stays")
    by_text = gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    starts = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))
    ends = F.transform(F.filter("gone", lambda x, i: F.coalesce(F.get("gone", i + 1) != x + 1, F.lit(True))), lambda x: x + 1)
    edges = by_text.select("doc_id", "text_hash", F.size("gone").alias("n_dropped"), starts.alias("starts"), ends.alias("ends"))
    runs = F.flatten(F.zip_with(F.zip_with("starts", F.concat(F.array(F.lit(0)), "ends"), lambda s, e: F.struct(s.alias("s"), (s - e).alias("stay"))), "ends", lambda x, e: F.array(x["stay"], e - x["s"])))
    return edges.select("doc_id", "text_hash", "n_dropped", F.filter(runs, lambda n: n.isNotNull()).alias("runs"))


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, kept_text for each row of ``documents``.

    Texts are split at \\n; a null or empty text is one empty line.  Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents (different doc_ids) lose all
    their lines but those of the largest doc_id; other lines stay, joined by \\n.  A row
    without doc_id is no document: its lines neither count nor go.  Rows that repeat a doc_id
    are one document of several texts.  Empty tables are fine; other columns are not read.
    """
    rows = _rows(documents)
    maps = keep_bitmaps(documents, min_chars, min_docs).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    both = rows.join(maps, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    stays = F.flatten(F.transform("runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    lines = F.zip_with(F.split("text", "\n"), stays, lambda line, stay: F.when(F.coalesce(stay, F.lit(True)), line))
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return both.select("doc_id", "text_hash", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.array_compact(lines), "\n")).alias("kept_text"))
