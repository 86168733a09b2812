"""Books stored by partition: replacing one leaves the others' files byte for byte as they were."""

import hashlib
import os

import pytest

from lectern.sources import stored


def prints(folder):
    found = [os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet")]
    return {os.path.relpath(p, folder): hashlib.sha256(open(p, "rb").read()).hexdigest() for p in found}


def test_parsing_one_book_again(spark, tmp_path):
    folder = str(tmp_path / "chapters")
    texts = {b: f"Chapter 1: One\n{'word ' * 60}{b}\nChapter 2: Two\n{'more ' * 60}" for b in (1, 2, 3)}
    files = lambda t: spark.createDataFrame([(f"/in/{b}.txt", x.encode()) for b, x in t.items()], "path string, content binary")
    books = lambda *ids: spark.createDataFrame([(b, f"/in/{b}.txt") for b in ids], "book_id int, path string")
    rows = lambda: sorted((r["book_id"], r["number"], r["title"], r["word_count"]) for r in spark.read.parquet(folder).collect())
    stored.parse_again(files(texts), books(1, 2, 3), folder, "txt")
    first, before = rows(), prints(folder)
    assert [r[0] for r in first] == [1, 1, 2, 2, 3, 3]
    stored.parse_again(files({2: "Chapter 1: Only\n" + "new " * 80, 3: "not asked for"}), books(2), folder, "txt")
    after = prints(folder)
    other = lambda p: {k: v for k, v in p.items() if "book_id=2" not in k}
    assert other(after) == other(before) and after != before
    assert [r for r in rows() if r[0] != 2] == [r for r in first if r[0] != 2] and [r[2] for r in rows() if r[0] == 2] == ["Chapter 1: Only"]


def test_books_without_rows_null_keys_and_other_columns(spark, tmp_path):
    folder = str(tmp_path / "t")
    kind = "k int, x string"
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    read = lambda: sorted(map(tuple, spark.read.parquet(folder).select("k", "x").collect()), key=repr)
    stored.replace_books(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "n"), (7, "left out")], kind), keys(1, 2, None, 9), folder, "k")
    assert read() == [(1, "a"), (1, "a"), (2, "b"), (None, "n")]
    stored.replace_books(spark.createDataFrame([], kind), keys(2, None), folder, "k")
    assert read() == [(1, "a"), (1, "a")]
    stored.replace_books(spark.createDataFrame([(1, "c")], kind), keys(1, 1), folder, "k")
    assert read() == [(1, "c")]
    with pytest.raises(ValueError):
        stored.replace_books(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a",)], "k string"), folder, "k")
