"""Merkle manifest of a table of documents, by supersteps of messages over RDDs.

Leaves are hashes of whole rows, made and put in order by Spark (ranges of source and doc_id, so a
hot source is many ranges).  Up: every node sends its digest to its parent; a parent that has all
its children hashes them and sends on, and a tree that is down to one node hands its subroot to the
tree of sources.  Down: every node sends each child the path above it, which is the runs of
digests that the child's own path continues; the nodes above the leaves keep that message once for
their 16 leaves, so a proof is never shuffled for each leaf.  Each upward level is a written table:
a lost executor costs a step and not the whole climb.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

FAN = 16
#: number of (tree, node), digest of each child in a row, and how many nodes the tree has on the level below
_LEVEL = "tree long, node long, n long, children binary"
_SIZE = 32
Path = tuple[tuple[int, bytes], ...]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)).cast("binary"), 256))


def _lowered(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def leaves(documents: DataFrame, every: int = 5) -> DataFrame:
    """source, doc_id, leaf, tampered (null where nothing is tampered with): 32-byte digests of each row."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return documents.select("source", F.col("doc_id").cast("long").alias("doc_id"), _leaf(F.col("text")).alias("leaf"), F.when(hit, _leaf(_lowered(F.col("text")))).alias("tampered"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with _at (from 0 within ``group``), _n (rows of the group) and _first (a number that orders groups).

    Ranges are sorted and counted; only one row for each range and group meets others.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    ranges = placed.groupBy(part, group).agg(F.min("_place").alias("_from"), F.count("*").alias("_count"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_count").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = ranges.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_from", before.alias("_before"), F.sum("_count").over(own).alias("_n"), F.min("_from").over(own).alias("_first"))
    both = placed.withColumn("_part", part).join(counted, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return both.select(*rows.columns, (F.col("_place") - F.col("_from") + F.col("_before")).alias("_at"), "_n", "_first")


def digest(children: bytes) -> bytes:
    """Hash of digests as hexadecimal text, one after the other."""
    return hashlib.sha256(children.hex().encode()).digest()


def climb(spark: SparkSession, nodes: RDD, partitions: int, most: int) -> tuple[list[RDD], RDD]:
    """Upward supersteps from ((tree, at), (n, digest)): the levels of ((tree, node), children), and (tree, subroot).

    ``most``: the nodes of the largest tree, which says how many supersteps there are.
    """
    levels, done = [], [nodes.filter(lambda x: x[1][0] == 1).map(lambda x: (x[0][0], x[1][1]))]
    active = nodes.filter(lambda x: x[1][0] > 1)
    while most > 1:
        sent = active.map(lambda x: ((x[0][0], x[0][1] // FAN), (x[0][1] % FAN, x[1][0], x[1][1])))

        def complete(item: tuple) -> tuple:
            (tree, node), got = item
            got = sorted(got)
            n = got[0][1]
            if len(got) != min(FAN, n - FAN * node):
                raise ValueError(f"tree {tree}, node {node}: {len(got)} children of {min(FAN, n - FAN * node)}")
            return tree, node, n, bytearray(b"".join(d for _, _, d in got))

        made = materialise(spark.createDataFrame(sent.groupByKey(partitions).map(complete), _LEVEL, verifySchema=False))
        level = made.rdd.map(lambda r: ((r.tree, r.node), (-(-r.n // FAN), bytes(r.children))))
        levels.append(level.mapValues(lambda v: v[1]))
        parents = level.mapValues(lambda v: (v[0], digest(v[1])))
        done.append(parents.filter(lambda x: x[1][0] == 1).map(lambda x: (x[0][0], x[1][1])))
        active = parents.filter(lambda x: x[1][0] > 1)
        most = -(-most // FAN)
    return levels, spark.sparkContext.union(done)


def depth(n: int) -> int:
    """Supersteps until ``n`` nodes are one."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def descend(levels: list[RDD], tops: RDD, partitions: int) -> RDD:
    """Downward supersteps: ((tree, node above leaves), (note, path, children)); a tree of one leaf has children b"".

    ``tops``: (tree, (depth, note, path above its root)).
    """
    def to_children(item: tuple) -> Iterator[tuple]:
        (tree, node), ((note, path), children) = item
        for i in range(len(children) // _SIZE):
            yield (tree, node * FAN + i), (note, ((i, children), *path))

    sent = None
    for k in range(len(levels), 0, -1):
        entering = tops.filter(lambda x, k=k: x[1][0] == k).map(lambda x: ((x[0], 0), x[1][1:]))
        met = (entering if sent is None else sent.union(entering)).join(levels[k - 1], partitions)
        if k == 1:
            lone = tops.filter(lambda x: x[1][0] == 0).map(lambda x: ((x[0], 0), (*x[1][1:], b"")))
            return met.mapValues(lambda v: (*v[0], v[1])).union(lone)
        sent = met.flatMap(to_children)
    return tops.map(lambda x: ((x[0], 0), (*x[1][1:], b"")))


def proof(path: Path) -> str:
    """Hash of the siblings along a path, from the leaf up."""
    return hashlib.sha256(b"".join(run[: i * _SIZE] + run[(i + 1) * _SIZE :] for i, run in path).hex().encode()).hexdigest()


def fold(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and its siblings give."""
    for i, run in path:
        leaf = digest(run[: i * _SIZE] + leaf + run[(i + 1) * _SIZE :])
    return leaf


def merkle_manifest(documents: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``documents``.

    A leaf hashes doc_id, source, lang, n_chars and text, each by its UTF-8 length and value, or
    ``-`` if null.  The leaves of a source ascend by doc_id (null first, ties by leaf, so equal rows
    are leaves of their own), the sources by their UTF-8 bytes (null first); runs of 16 nodes
    become their hash until one is left.  Where crc32 of doc_id is a multiple of ``every`` the leaf
    is hashed again with A-Z lower-cased before it is folded with the siblings it had; a text
    without A-Z, a null text and a row without doc_id stay as they are and verify.  An empty table
    gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(numbered(leaves(documents, every), "source", "doc_id", "leaf"))
    sources = materialise(numbered(placed.groupBy(F.col("_first").alias("tree")).agg(F.max("_n").alias("n")).withColumn("_all", F.lit(0)), "_all", "tree"))
    trees = sources.select("tree", "n", F.col("_at").alias("rank"), F.col("_n").alias("n_sources"))
    sizes = trees.agg(F.max("n"), F.max("n_sources")).first()
    rows = placed.select("_first", "_at", "_n", "doc_id", "leaf", "tampered").rdd

    nodes = rows.map(lambda r: ((r._first, r._at), (r._n, bytes(r.leaf))))
    levels, subroots = climb(spark, nodes, partitions, sizes[0] or 0)
    about = trees.rdd.map(lambda r: (r.tree, (r.n, r.rank, r.n_sources)))
    joined = about.join(subroots, partitions)  # (tree, ((n, rank, n_sources), subroot))
    tops = materialise(spark.createDataFrame(joined.map(lambda x: (x[0], *x[1][0], bytearray(x[1][1]))), "tree long, n long, rank long, n_sources long, subroot binary", verifySchema=False)).rdd

    above, roots = climb(spark, tops.map(lambda r: ((0, r["rank"]), (r.n_sources, bytes(r.subroot)))), partitions, sizes[1] or 0)
    root_path = roots.map(lambda x: (0, (depth(sizes[1]), x[1], ())))
    source_paths = descend(above, root_path, partitions).flatMap(_each_source)  # (rank, (root, path))
    by_rank = tops.map(lambda r: (r["rank"], (r.tree, depth(r.n), bytes(r.subroot)))).join(source_paths, partitions)
    starts = by_rank.map(lambda x: (x[1][0][0], (x[1][0][1], (x[1][0][2], x[1][1][0]), x[1][1][1])))

    runs = rows.map(lambda r: ((r._first, r._at // FAN), (r._at % FAN, r.doc_id, bytes(r.leaf), r.tampered and bytes(r.tampered))))
    met = runs.groupByKey(partitions).join(descend(levels, starts, partitions), partitions)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(met.flatMap(_verified), schema, verifySchema=False)


def _each_source(item: tuple) -> Iterator[tuple]:
    """(rank, (root, path)) of the sources below a node of the tree of sources."""
    (_, node), (root, path, children) = item
    if not children:
        yield 0, (root, path)
    for i in range(len(children) // _SIZE):
        yield node * FAN + i, (root, ((i, children), *path))


def _verified(item: tuple) -> Iterable[tuple]:
    _, (own, ((subroot, root), path, children)) = item
    for i, doc_id, leaf, tampered in own:
        full = ((i, children), *path) if children else path
        folded = fold(tampered or leaf, full)
        yield doc_id, leaf.hex(), subroot.hex(), root.hex(), proof(full), folded.hex(), folded == root
