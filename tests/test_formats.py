"""Books and sounds by format name: same rows as the readers over bytes, pruned columns, whole or no writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.plans import source_queries as Q
from lectern.sources import books as K
from lectern.sources import formats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def stored(files, folder, ending):
    os.makedirs(folder)
    for i, r in enumerate(files.collect()):
        with open(f"{folder}/{i:05d}{ending}", "wb") as f:
            f.write(bytes(r["content"]))
    return str(folder)


def test_txt(known, tmp_path):
    folder = stored(Q._txt(known.read.parquet(f"{SF}/documents.parquet")), tmp_path / "t", ".txt")
    with open(f"{folder}/bad.txt", "wb") as f:
        f.write(b"a\r\nb\rc\xff")
    open(f"{folder}/other.dat", "wb").close()
    bare = lambda df: sorted((r["path"].removeprefix("file:"), r["text"]) for r in df.collect())
    read = known.read.format("lectern-txt").option("partitionBytes", 20000).load(folder)
    assert bare(read) == bare(K.read_txt(known, folder)) and read.rdd.getNumPartitions() > 2
    open(f"{folder}/empty.txt", "wb").close()  # a row here, while Spark's own reader of bytes leaves empty files out
    assert known.read.format("lectern-txt").load(f"{folder}/empty.txt").first()["text"] == ""
    assert known.read.format("lectern-txt").load(f"{folder}/bad.txt").first()["text"] == "a\nb\nc�"
    assert known.read.format("lectern-txt").schema("path string").load(folder).columns == ["path"]
    os.makedirs(tmp_path / "none")
    assert known.read.format("lectern-txt").load(str(tmp_path / "none")).count() == 0


def test_epub(known, tmp_path):
    folder = stored(Q._epubs(known.read.parquet(f"{SF}/conversations.parquet")), tmp_path / "e", ".epub")
    bare = lambda df: sorted(tuple(r)[1:] + (os.path.basename(r["path"]),) for r in df.select("path", "item", "title", "text", "book_title", F.coalesce("author", F.lit("")).alias("author")).collect())
    assert bare(known.read.format("lectern-epub").load(folder)) == bare(K.read_epub(known, folder)) != []
    few = known.read.format("lectern-epub").schema("item int, text string").option("least", 0).load(folder)
    assert few.columns == ["item", "text"] and few.count() >= known.read.format("lectern-epub").load(folder).count()
    with open(f"{folder}/no.epub", "wb") as f:
        f.write(b"no archive")
    assert known.read.format("lectern-epub").option("badFiles", "skip").load(folder).count() == K.read_epub(known, folder).count()
    with pytest.raises(Exception, match="zip"):
        known.read.format("lectern-epub").load(folder).count()
    with pytest.raises(Exception, match="no column"):
        known.read.format("lectern-epub").schema("item string").load(folder).count()


def test_wav_round_trip(known, tmp_path):
    folder = str(tmp_path / "w")
    e = known.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("samples")).limit(40)
    e = known.createDataFrame([*[tuple(r) for r in e.collect()], ("none", None), ("empty", [])], "name string, samples array<double>").repartition(3)
    write = e.write.format("lectern-wav").option("rate", 8000)
    write.mode("append").save(folder)
    read = {os.path.basename(r["path"])[:-4]: r for r in known.read.format("lectern-wav").load(folder).collect()}
    assert set(read) == {r["name"] for r in e.collect()} and {r["rate"] for r in read.values()} == {8000}
    for r in e.collect():
        assert np.allclose(read[r["name"]]["samples"], np.clip(np.array(r["samples"] or [], float), -1, 1), atol=2e-4)
    assert known.read.format("lectern-wav").schema("rate int").load(folder).distinct().count() == 1
    e.limit(2).write.format("lectern-wav").mode("overwrite").save(folder)
    assert len(os.listdir(folder)) == 2


def test_a_failed_write_leaves_nothing(known, tmp_path):
    folder = str(tmp_path / "f")
    good = known.range(6).selectExpr("cast(id as string) as name", "array(0.5D) as samples").repartition(3)
    for bad in (good.selectExpr("if(name = '4', null, name) as name", "samples"), good.selectExpr("'same' as name", "samples"), good.selectExpr("name", "if(name = '5', cast(raise_error('lost') as array<double>), samples) as samples")):
        with pytest.raises(Exception):  # noqa: B017
            bad.write.format("lectern-wav").mode("append").save(folder)
        assert not os.path.exists(folder) or os.listdir(folder) == []
    good.write.format("lectern-wav").mode("append").save(folder)
    assert len(os.listdir(folder)) == 6


def test_files_are_dealt_in_runs():
    assert formats.dealt([("a", 5), ("b", 5), ("c", 20), ("d", 1), ("e", 9), ("f", 1)], 10) == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    assert formats.dealt([], 10) == []
