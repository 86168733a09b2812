"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words; target / size of the source is the expected
number of copies of each of its documents: whole copies, and a fraction that is an
inclusion probability.  The cube method moves the probabilities through the null space of
the constraints, so that the words and the documents taken from a source stay at their
expected totals, until all are 0 or 1 but for two for each block: the landing problem.

Blocks of a bounded number of documents fly apart from each other; what is left of each
meets in new blocks, until one block of a source is left.  That block keeps LANDING units of
spread sizes back; the rest flies, and the landing problem (these and the two units that the
flight leaves) is solved exactly: of all its subsets the one that misses the words least, or,
of those within NEAR of them, the one that misses the number of documents least.  Only the
landing's units give up their probabilities.  A hot source is only more blocks.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

BLOCK = 2048
_EPS = 1e-9
#: units that the last block of a source keeps back for its landing
LANDING = 14
#: share of the expected words by which a landing may miss them in favour of the number of documents
NEAR = 0.0005
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _move(p: list[float], u: list[float], rng: random.Random) -> None:
    """Move ``p`` along ``u`` or against it to the next face of the cube, keeping expectations."""
    ahead = min(((1 - x) / d if d > 0 else -x / d for x, d in zip(p, u, strict=True) if d), default=0.0)
    back = min((x / d if d > 0 else (x - 1) / d for x, d in zip(p, u, strict=True) if d), default=0.0)
    step = ahead if rng.random() * (ahead + back) < back else -back
    for i, d in enumerate(u):
        p[i] += step * d
        p[i] = 0.0 if p[i] < _EPS else 1.0 if p[i] > 1 - _EPS else p[i]


def _null_vector(sizes: list[float]) -> list[float] | None:
    """A direction that keeps both the number and the summed sizes of the units."""
    if len(sizes) == 3:
        a, b, c = sizes
        return [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
    if len(sizes) == 2 and sizes[0] == sizes[1]:
        return [1.0, -1.0]
    return None


def _kept_back(sizes: list[float], active: list[int]) -> list[int]:
    """Units for the landing: evenly spread over the sizes, the largest and the smallest among them."""
    order = sorted(active, key=lambda i: (-sizes[i], i))
    if len(order) <= LANDING:
        return order
    return [order[round(k * (len(order) - 1) / (LANDING - 1))] for k in range(LANDING)]


def land(sizes: list[float], p: list[float], expected: float) -> list[float]:
    """0 or 1 for each unit of a small landing problem: the subset nearest to the expected words and documents.

    ``expected``: the words that the whole source is to take of fractional units.
    """
    words, docs = np.zeros(1), np.zeros(1)
    for s in sizes:
        words, docs = np.concatenate([words, words + s]), np.concatenate([docs, docs + 1])
    off = np.abs(words - float(np.dot(sizes, p)))
    near = off <= max(off.min(), NEAR * expected)
    miss = np.where(near, np.abs(docs - sum(p)), np.inf)
    best = min(np.flatnonzero(miss == miss.min()).tolist(), key=lambda k: (off[k], k))
    return [float(best >> i & 1) for i in range(len(sizes))]


def fly(sizes: list[float], p: list[float], rng: random.Random, last: bool) -> list[float]:
    """Probabilities after the flight through one block, in the given order; the ``last`` block of a source lands too.

    Without a landing at most two stay between 0 and 1.
    """
    p = [0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x for x in p]
    expected = sum(s * x for s, x in zip(sizes, p, strict=True))
    back = _kept_back(sizes, [i for i, x in enumerate(p) if 0.0 < x < 1.0]) if last else []
    held = set(back)
    active: list[int] = []
    waiting = iter(i for i, x in enumerate(p) if 0.0 < x < 1.0 and i not in held)
    while True:
        active = [i for i in active if 0.0 < p[i] < 1.0]
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        u = _null_vector([sizes[i] for i in active])
        if u is None:
            break
        own = [p[i] for i in active]
        _move(own, u, rng)
        for i, x in zip(active, own, strict=True):
            p[i] = x
    if last:
        rest = [*active, *back]
        for i, x in zip(rest, land([sizes[i] for i in rest], [p[i] for i in rest], expected), strict=True):
            p[i] = x
    return p


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with _nth (from 0, in ``order``) and, for each out -> column, the sum of the rows before.

    Rows are ranged and summed within ranges; what meets in one task is a row for each range.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{o}") for o, c in sums.items()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("_part").alias("_p"), *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_before{c}") for c in ("_n", *(f"_{o}" for o in sums))))
    both = ranged.join(offsets, F.col("_part") == F.col("_p"))
    upto = lambda c, o: (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_before_{o}")).alias(o)
    return both.select(*rows.columns, (F.count(F.lit(1)).over(inside) + F.col("_before_n")).alias("_nth"), *(upto(c, o) for o, c in sums.items()))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes by repeating ``weights``, at most ``most`` times a source's size.

    What a capped source cannot take is shared again by weight, until none is above: targets
    are min(cap, level * weight) for the one level at which they sum to the whole.  Works on
    one row for each source; ranks and running sums go by ranges, so sources may be many.
    """
    by_source = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_nth") % len(weights) + 1).cast("int"))
    rows = _running(by_source, [F.col("source").asc_nulls_last()], {}).select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    totals = rows.agg(F.sum("weight").alias("all_weights"), (share * F.sum("source_size")).alias("whole"))
    by_cap = _running(rows, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"capped": "cap", "passed": "weight"}).crossJoin(F.broadcast(totals))
    # the first source, by cap / weight, that its share of what is left does not fill: its level holds for it and all after it
    level = by_cap.withColumn("level", (F.col("whole") - F.col("capped")) / (F.col("all_weights") - F.col("passed"))).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", "_nth").alias("level"))
    return rows.crossJoin(F.broadcast(level)).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``documents``.

    size: words [^\\x20\\x09-\\x0D]+ of the text, 0 for a null or empty text.  copies is 0 to
    ``most`` rounded up; taken = size * copies.  A null source is a source of its own, last in
    order; a null doc_id is allowed.  Rows that repeat a doc_id are units of their own.  Units
    in a block are ordered by size and doc_id, so reruns agree; equal units are
    interchangeable.  A source's taken words miss its target by what the landing could not
    place: next to nothing where it has documents of many sizes, up to half of its smallest
    document where it has few.  An empty table gives an empty table; other columns are not read.
    """
    sizes = materialise(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of("text").alias("size")))
    targets = materialise(source_targets(sizes, weights, share, most))
    t = targets.withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    units = sizes.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("whole", F.floor(ratio).cast("int")).withColumn("p", ratio - F.floor(ratio))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="first")
        name = part["source"].iloc[0]
        key = f"{seed}|{part['level'].iloc[0]}|{part['block'].iloc[0]}|{'' if name is None else 's' + str(name)}"
        last = part["blocks"].iloc[0] == 1
        part["p"] = fly(part["size"].astype(float).tolist(), part["p"].tolist(), random.Random(zlib.crc32(key.encode())), last)
        return part.drop(columns=["level", "block", "blocks"])

    settled, level = [], 0
    while True:
        blocks = units.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("source", "of")
        dealt = units.join(blocks, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), F.col("blocks")).cast("int")).withColumn("level", F.lit(level))
        flown = materialise(dealt.groupBy("source", "block").applyInPandas(block, units.schema))
        settled.append(flown.where("p = 0 or p = 1"))
        units, level = flown.where("p > 0 and p < 1"), level + 1
        if not units.limit(1).count():
            break
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
