"""Tables of books kept as one Parquet partition a book, so that parsing a book again rewrites that book alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_scratch, materialise
from .books import parse_files


def _drop_partitions(spark: SparkSession, folder: str, key: str, values: list) -> None:
    jvm = spark.sparkContext._jvm
    for v in values:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{key}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def replace_books(rows: DataFrame, books: DataFrame, folder: str, key: str) -> None:
    """Make ``rows`` what ``folder`` holds of ``books``; every other book's files stay as they are.

    ``key`` is an integer column of both; rows of books that ``books`` doesn't list are left out, and
    a listed book without rows loses its partition.  A book's rows may be spread over tasks and
    files, so a book that holds most rows is no task of its own.  The first write creates the folder.
    Books that lost all rows, and only their keys, come to the driver.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c != key]
    if dict(rows.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer column")
    listed = books.select(key).distinct()
    same = F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}"))
    kept = materialise(rows.alias("r").join(listed.alias("b"), same, "left_semi").select(*names, key))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)
    bare = listed.alias("b").join(kept.select(key).distinct().alias("r"), same, "left_anti")
    _drop_partitions(spark, folder, key, [r[0] for r in bare.collect()])
    drop_scratch(kept)


def parse_again(files: DataFrame, books: DataFrame, folder: str, kind: str, key: str = "book_id") -> None:
    """Chapters of ``books`` (key, path), from their files (path, content), in place of those that ``folder`` held of them."""
    chapters = parse_files(files, kind).join(books.select(key, "path"), "path")
    replace_books(chapters.select(key, "number", "title", "text", "word_count", "is_boilerplate"), books, folder, key)
