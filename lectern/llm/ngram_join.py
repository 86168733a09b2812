"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct runs of ``k`` words.  Two documents
link when 100 * intersection >= percent * union.  A linked partner shares at least
need(n) = ceil(percent * n / 100) of a document's n shingles, so under any common order
of shingles both prefixes of n - need(n) + m shingles share m of them or more.

1.  One pass writes each document's size, a 128-bit set fingerprint and its prefix in
    hash order with m = a tenth of the size.  Equal sets become one class.
2.  A shingle that one class alone has can have no partner.  Classes with fewer than m
    other shingles in their prefix are done; the rest (few) pay for the longest prefix,
    their whole set, and must then share need(n) shingles.
3.  Their shingles are ordered by frequency; classes that share one of the rarest
    n - need(n) + 1 form families.  Copies of one text fall into one family, whatever
    common passages they quote.
4.  A family is joined exactly inside one task, each document choosing its own prefix
    length by the cost of its posting lists; pairs already connected are skipped.  A
    family above a bound is dealt into chunks in which copies mostly meet; what still joins
    different components after that is compared in blocks.  No pair of documents is ever
    emitted, only links between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .scratch import materialise, release
from .textbytes import WHITE, U64, hashed_words, mix, shingles

FIRST_MATCHES = 0.1
CHUNK_DOCS = 1024
CHUNK_SHINGLES = 1 << 21


def need(n: int, percent: int) -> int:
    """Shingles that any linked partner shares, at least."""
    return -(-percent * n // 100)


def first_matches(n: int, percent: int) -> int:
    return max(1, min(int(FIRST_MATCHES * n), need(n, percent)))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set of shingles."""
    n = U64(len(s))
    lo = mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + n
    hi = mix(s * U64(0x9E3779B97F4A7C15) + n).sum(dtype=np.uint64)
    return int(hi.view(np.int64)), int(mix(lo.reshape(1))[0].view(np.int64))


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, at, words in hashed_words(texts, WHITE):
        for i in range(len(at) - 1):
            yield np.unique(shingles(words[at[i] : at[i + 1]], k))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*parts, np.zeros(0, U64)]).view(np.int64))


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *fingerprint(s), s[: len(s) - need(len(s), percent) + first_matches(len(s), percent)]) for s in _sets(batch["text"], k)]
            n, hi, lo, head = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), _lists(list(head))], ["doc_id", "text_hash", "n_shingles", "hi", "lo", "head"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, hi long, lo long, head array<long>")


def _whole_sets(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = batch["hi"].to_pylist(), batch["lo"].to_pylist()
            sets = list(_sets(batch["text"], k))
            own = [i for i, s in enumerate(sets) if hi[i] is None or fingerprint(s) == (hi[i], lo[i])]
            hi, lo = zip(*(fingerprint(sets[i]) if hi[i] is None else (hi[i], lo[i]) for i in own), strict=True) if own else ([], [])
            yield pa.RecordBatch.from_arrays([batch["rep"].take(pa.array(own, pa.int64())), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), _lists([sets[i] for i in own])], ["rep", "hi", "lo", "shingles"])

    schema = "rep long, hi long, lo long, shingles array<long>"
    named = classes.where("rep is not null").select("rep", "hi", "lo")
    with_text = docs.join(named.hint("shuffle_hash"), docs["doc_id"] == F.col("rep")).select("rep", "hi", "lo", "text").mapInArrow(run, schema)
    # classes whose rows all lack doc_id: their texts are found by the fingerprint itself
    none = F.lit(None).cast("long")
    unnamed = docs.where("doc_id is null").select(none.alias("rep"), none.alias("hi"), none.alias("lo"), "text").mapInArrow(run, schema)
    unnamed = unnamed.join(classes.where("rep is null").select("hi", "lo"), ["hi", "lo"], "left_semi").select("rep", "hi", "lo", "shingles")
    return with_text.unionByName(unnamed).dropDuplicates(["hi", "lo"])


class _Forest:
    def __init__(self, labels: np.ndarray):
        self.root = np.unique(labels, return_inverse=True)[1].astype(np.int64)

    def link(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)


def link_sets(sets: list[np.ndarray], labels: np.ndarray, percent: int, queries: np.ndarray | None = None) -> np.ndarray:
    """Component numbers of sets that start in components ``labels``; exact.

    Every query (a row number; default: all rows) finds all rows it shares enough
    prefix shingles with; those in another component are verified one by one.
    """
    n = np.array([len(s) for s in sets], np.int64)
    forest = _Forest(labels)
    if n.sum() == 0:
        return forest.root
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((token, df[token], owner))
    token, at = token[order], np.concatenate([[0], np.cumsum(n)])
    rank = np.arange(len(token)) - at[owner]
    least = -(-percent * n // 100)
    level = rank - (n - least)[owner]  # the token is in the prefixes of more matches than this
    by_token = np.argsort(token, kind="stable")
    starts = np.concatenate([[0], np.cumsum(df)])
    posting, posting_level = owner[by_token], level[by_token]
    seen = np.zeros(len(df), bool)
    for i in range(len(sets)) if queries is None else queries:
        own = token[at[i] : at[i + 1]]
        cost = np.cumsum(df[own])
        choices = np.unique(np.minimum(1 << np.arange(12), max(1, least[i])))
        lengths = n[i] - least[i] + choices
        m = choices[np.argmin(cost[lengths - 1] * (1 + n[i] / choices))]
        head = own[: n[i] - least[i] + m]
        head = head[df[head] > 1]
        if len(head) < m:
            continue
        spans = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in head])
        spans = spans[posting_level[spans] < m]
        shared = np.bincount(posting[spans], minlength=len(sets))
        rivals = np.flatnonzero((shared >= m) & (forest.root != forest.root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if len(rivals):
            seen[own] = True
            for j in rivals[np.argsort(-shared[rivals], kind="stable")]:
                if forest.root[j] != forest.root[i]:
                    both = int(seen[token[at[j] : at[j + 1]]].sum())
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        forest.link(i, j)
            seen[own] = False
    return forest.root


def _link_round(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components found inside each (family, task) of ``dealt``: node, comp, asks, shingles."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, np.int64).view(U64) for s in part["shingles"]]
        comp = part["comp"].to_numpy()
        root = link_sets(sets, comp, percent, np.flatnonzero(part["asks"].to_numpy()))
        low = pd.Series(comp).groupby(root).transform("min").to_numpy()
        return pd.DataFrame({"a": comp, "b": low}).query("a != b").drop_duplicates()

    return dealt.groupBy("family", "task").applyInPandas(run, "a long, b long")


def _merge(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the components that ``links`` join."""
    merged = connected_components(links).withColumnRenamed("label", "low")
    return materialise(nodes.join(merged, nodes["comp"] == merged["node"], "left").select("rep", "hi", "lo", F.coalesce("low", "comp").alias("comp")))


def _families(rarest: DataFrame) -> DataFrame:
    """lo, family: classes joined by any shingle of ``rarest`` (lo, shingle)."""
    stars = rarest.join(rarest.groupBy("shingle").agg(F.min("lo").alias("b")), "shingle").select(F.col("lo").alias("a"), "b").where("a != b").distinct()
    return connected_components(stars).select(F.col("node").alias("lo"), F.col("label").alias("family"))


def _tasks() -> Column:
    """Tasks that a group of documents needs, by their number and their shingles (total)."""
    return F.ceil(F.greatest(F.count("*") / CHUNK_DOCS, F.sum("total") / CHUNK_SHINGLES)).cast("int")


def _chunks_by_block(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Tasks in which every pair of components of a large family meets.

    A pair of different components has a document outside the family's largest one: those
    ask, in blocks, and each block meets each chunk of the family's documents.
    """
    main = placed.groupBy("family", "comp").count().groupBy("family").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    outside = placed.join(main, "family").where("comp != main")
    blocks = outside.groupBy("family").agg(_tasks().alias("blocks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    ask = outside.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("lo", F.lit(-1)), F.col("blocks"))).withColumn("chunk", upto("chunks")).withColumn("asks", F.lit(True))
    told = placed.join(blocks, "family").withColumn("chunk", F.pmod(F.xxhash64("lo", F.lit(-2)), F.col("chunks"))).withColumn("block", upto("blocks")).withColumn("asks", F.lit(False))
    columns = ["rep", "hi", "lo", "comp", "family", "asks", (F.col("block").cast("long") * F.col("chunks") + F.col("chunk")).alias("task")]
    return ask.select(*columns).unionByName(told.select(*columns)).join(sets.drop("rep"), ["hi", "lo"])


def _bounded(dealt: DataFrame, seed: int) -> DataFrame:
    """``dealt`` with every (family, task) above the bound split by a hash of the document.

    task stays below chunks before it, so task + chunks * part is a task of its own.
    """
    parts = dealt.groupBy("family", "task").agg(_tasks().alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("lo", F.lit(seed)), F.col("parts").cast("long")), F.lit(0))
    return dealt.join(parts, ["family", "task"], "left").withColumn("task", F.col("task") + F.col("chunks") * part).drop("parts")


def _join_families(sets: DataFrame, rarest: DataFrame, percent: int) -> DataFrame:
    """(rep, hi, lo, comp): exact components of ``sets``; ``rarest`` holds each one's prefix (lo, shingle).

    A family that fits one task is done after it.  A larger one is dealt by the smallest, then
    by the largest of its members' shingles, where copies of one text mostly meet; what one
    shingle brings together beyond the bound is dealt further by a hash of the document, another
    one in each round.  After each round only shingles between different components stay, and
    what they join are the next families.  What is still too large after that is compared in
    blocks.
    """
    nodes = materialise(sets.select("rep", "hi", "lo", F.xxhash64("hi", "lo").alias("comp")))
    ends = ("least", "most")
    sizes = materialise(sets.select("lo", F.size("shingles").alias("total"), F.array_min("shingles").alias(ends[0]), F.array_max("shingles").alias(ends[1])))
    for r in range(len(ends) + 1):
        families = materialise(_families(rarest))
        room = sizes.join(families, "lo").groupBy("family").agg(_tasks().alias("chunks"))
        placed = materialise(nodes.join(families, "lo").join(room, "family").join(sizes, "lo").select("rep", "hi", "lo", "comp", "family", "chunks", "total", *ends))
        large = placed.where("chunks > 1")
        if r < len(ends):
            whole = _bounded(placed.withColumn("task", F.pmod(F.xxhash64(ends[r]), F.col("chunks").cast("long"))), r).withColumn("asks", F.lit(True)).join(sets.drop("rep"), ["hi", "lo"])
        else:
            whole = placed.where("chunks = 1").select("rep", "hi", "lo", "comp", "family", F.lit(True).alias("asks"), F.lit(0).cast("long").alias("task")).join(sets.drop("rep"), ["hi", "lo"]).unionByName(_chunks_by_block(large, sets))
        nodes = _merge(nodes, _link_round(whole.select("family", "task", "comp", "asks", "shingles"), percent))
        if r == len(ends) or not large.limit(1).count():
            return nodes
        between = rarest.join(large.select("lo"), "lo", "left_semi").join(nodes.select("lo", "comp"), "lo")
        split = between.groupBy("shingle").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one != other").select("shingle")
        rarest = materialise(between.join(split, "shingle", "left_semi").select("lo", "shingle").distinct())
    return nodes


def ngram_jaccard_join(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_shingles, component_id, group_id, text_hash.

    Words are lower-cased (A-Z) runs of [^\\x20\\x09-\\x0D].  component_id is the smallest
    doc_id that links reach.  A text with fewer than ``k`` words has its word sequence as
    its only shingle.  Null, empty and blank texts have no shingles, link with nothing and
    keep their own doc_id.  Rows with equal texts are linked; rows that repeat a doc_id are
    separate documents.  A null doc_id links like others but never names a component.
    group_id is the same for all rows of a component, named or not, and null without shingles;
    text_hash (xxhash64, of a null text that of the empty one) tells rows of one doc_id apart.
    An empty table gives an empty table; columns besides doc_id and text are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    heads = materialise(_prefixes(docs, k, percent))
    classes = materialise(heads.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")))

    in_heads = heads.select("lo", F.explode("head").alias("shingle"))
    common = materialise(in_heads.groupBy("shingle").agg(F.min("lo").alias("one"), F.max("lo").alias("other")).where("one != other").select("shingle"))
    matches = in_heads.join(common, "shingle", "left_semi").groupBy("lo").agg(F.count("*").alias("found"))
    smallest = F.ceil(F.lit(percent) * F.col("n") / 100)
    asked = F.greatest(F.lit(1), F.least(F.floor(FIRST_MATCHES * smallest), F.ceil(F.lit(percent) * smallest / 100)))
    alive = materialise(classes.join(matches, "lo").where(F.col("found") >= F.col("copies") * asked))
    release(documents.sparkSession)

    sets = materialise(_whole_sets(docs, alive, k))
    release(documents.sparkSession)
    whole = sets.select("rep", "hi", "lo", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = materialise(whole.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    of_doc = Window.partitionBy("hi", "lo")
    ranked = whole.join(often, "shingle").select("rep", "hi", "lo", "shingle", F.count("*").over(of_doc).alias("shared"), (F.count("*").over(of_doc) - F.ceil(F.lit(percent) * F.col("n") / 100)).alias("spare"), F.row_number().over(of_doc.orderBy("df", "shingle")).alias("rank"))
    rarest = materialise(ranked.where("rank <= spare + 1").select("lo", "shingle"))
    release(documents.sparkSession)
    comps = _join_families(sets, rarest, percent)
    named = comps.join(comps.groupBy("comp").agg(F.min("rep").alias("component")), "comp").select("hi", "lo", "comp", "component")
    of_class = materialise(classes.join(named, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"), F.coalesce("comp", F.xxhash64("hi", "lo")).alias("group_id")))
    rows = heads.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "hi", "lo").join(of_class, ["hi", "lo"])
    apart = heads.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_id"), "text_hash")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "group_id", "text_hash").unionByName(apart)
