"""Whitening, the Merkle manifest and byte-string removal against plain versions and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import suffix_dedup
from lectern.llm.merkle import digest, fold, merkle_manifest, proof
from lectern.llm.whitening import exact_gram, limbs_of, whiten

from .brute import LOWER


def by_nulls(row):
    return tuple((v is not None, v) for v in row)


# ---- byte strings ----------------------------------------------------------------------


def plain_removal(rows, length):
    """Results by (doc_id, text), with the operator's order of rows that share a doc_id left to a set of one."""
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, t] = (d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return sorted((out[r] for r in rows), key=by_nulls)


def removed(df, **how):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, **how).collect()), key=by_nulls)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["ab", "cde", "fé", "gh", "ij", "klm", "n"]) for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(100):
        t = ""
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 500)
            t += rng.choice(base)[a : a + rng.randint(20, 400)] + rng.choice(["", "x", "yy", " "])
        rows.append((i, t))
    return rows + [(200, "a" * 5000), (201, "a" * 99), (202, "ab" * 3000), (203, None), (204, ""), (205, "a" * 100), (7, rows[7][1]), (None, base[1] + "z"), (300, base[2] * 3)]


@pytest.mark.parametrize("length,bucket_runs", [(100, 4096), (20, 4096), (100, 1)])
def test_repeated_strings_go_as_in_the_plain_version(spark, passages, length, bucket_runs):
    df = spark.createDataFrame(passages, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)
    assert removed(df, length=length, bucket_runs=bucket_runs) == plain_removal(passages, length)


def test_slices_and_batches_change_nothing(spark, passages, monkeypatch):
    df = spark.createDataFrame(passages, "doc_id long, text string").coalesce(1)
    data = np.frombuffer("".join(t or "" for _, t in passages).encode(), np.uint8)
    offsets = np.cumsum([0, *(len((t or "").encode()) for _, t in passages)])
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.runs_of(data, offsets), strict=True)]
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1000)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.runs_of(data, offsets), strict=True)]
    assert whole[1].sum() == parts[1].sum() == sum(max(0, int(n) - 99) for n in np.diff(offsets))
    assert whole[1].max() <= 76  # one place gives the bucket of a run, so a run holds no string twice
    assert removed(df) == plain_removal(passages, 100)


def test_removal_of_copies_without_id_of_one_id_and_of_nothing(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(None, t), (None, t), (4, t), (4, t), (4, t + "!"), (9, t)]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[:3] for r in got if r[0] is None] == [(None, 400, 400)] * 2
    assert [r[2] for r in got if r[0] == 9] == [400]
    kept = [r[4].decode() for r in got if r[0] == 4]
    assert sorted(kept) in (sorted([t, t, "!"]), sorted(["", "", t + "!"]))  # which text of a doc_id is first goes by its hash
    assert removed(spark.createDataFrame([], "doc_id long, text string")) == []


# ---- Merkle manifest -------------------------------------------------------------------


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(field(r[0]) + field(r[3]) + field(r[2]) + field(r[4]) + field(t))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by[s], key=lambda x: x[:3]) for s in sources}
    trees = {s: plain_tree([x[2] for x in ordered[s]]) for s in sources}
    top = plain_tree([trees[s][-1][0] for s in sources])
    out = []
    for si, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(ordered[s]):
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            cur, siblings = leaf(r, r[1].translate(LOWER) if hit else r[1]), ""
            for levels, j in ((trees[s], i), (top, si)):
                for level in levels[:-1]:
                    run, k = level[j // 16 * 16 : j // 16 * 16 + 16], j % 16
                    siblings += "".join(run[:k] + run[k + 1 :])
                    cur = H("".join([*run[:k], cur, *run[k + 1 :]]))
                    j //= 16
            out.append((r[0], own, trees[s][-1][0], top[-1][0], H(siblings), cur, cur == top[-1][0]))
    return sorted(out, key=by_nulls)


@pytest.mark.parametrize("n,sources", [(700, 3), (60, 40), (1, 1)])
def test_manifest_equals_plain_trees(spark, n, sources):
    rng = random.Random(n)
    rows = [(rng.choice([None, 3, 4]) if rng.random() < 0.1 else i, rng.choice([None, "", "Abc É", "low", f"T{i}"]), rng.choice(["en", None]), rng.choice([None, "é", *(f"s{k}" for k in range(sources))]), rng.choice([None, i])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit(1)).repartition(4)
    assert sorted((tuple(r) for r in merkle_manifest(df).collect()), key=by_nulls) == plain_manifest(rows)


def test_manifest_of_an_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).collect() == []


def test_a_proof_folds_to_the_root_and_a_changed_leaf_does_not():
    leaves = [bytes([i]) * 32 for i in range(20)]
    low, high = b"".join(leaves[:16]), b"".join(leaves[16:])
    top = digest(low) + digest(high)
    path = ((2, high), (1, top))
    assert fold(leaves[18], path) == digest(top) and fold(leaves[17], path) != digest(top)
    assert proof(path) == H("".join(x.hex() for x in (leaves[16], leaves[17], leaves[19])) + digest(low).hex())


# ---- whitening -------------------------------------------------------------------------


def test_digit_slices_multiply_exactly():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**61), 2**61, (5000, 3))
    big = x.astype(object)
    assert (exact_gram(x) == big.T @ big).all()
    limbs = limbs_of(x)
    assert len(limbs) == 4 and sum((limb.astype(np.int64).astype(object) << 20 * i) for i, limb in enumerate(limbs)).tolist() == big.tolist()


def test_whitening_equals_exact_sums_and_whitens(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=20) * np.linspace(5, 0.5, 20)]) for i in range(2000)]
    rows += [(5000, rows[0][1]), (5001, None), (5002, [1.0, None] + [0.0] * 18), (5003, [float("nan")] * 20), (5004, [float("-inf")] * 20), (5005, [1.0]), (None, rows[1][1]), (3, rows[3][1])]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash"))).toPandas()
    whole = {i: [int(np.floor(64 * c)) + 1000000 for c in v] for i, v in rows[:2000]}
    fit = np.array(sorted(set(map(tuple, whole.values()))), object)
    n, s = len(fit), fit.sum(axis=0)
    assert set(out.n) == {n} and len(out) == 2003 * 16 and out.vec_id.isna().sum() == 16
    assert all(int(((n * np.array(whole[i], object) - s) ** 2).sum()) == d for i, d in zip(out.vec_id, out.deviation, strict=True) if i in whole)
    centred = np.array([[int(v) / n for v in r] for r in n * fit - s])
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    explained = out.groupby("component").explained.first()
    assert np.allclose(explained, (values / values.sum())[:16], rtol=1e-9)
    assert out.identity_error.max() < 1e-10
    w = out[out.vec_id.isin(range(2000))].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / n - np.eye(16)).max() < 1e-9 and np.abs(w.mean(axis=0)).max() < 1e-9


def test_whitening_without_variance_with_huge_entries_and_of_nothing(spark):
    kind = "vec_id long, embedding array<double>"
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error == 0 for r in one)
    huge = whiten(spark.createDataFrame([(1, [1e30, 2.0]), (2, [-1e30, 2.0]), (3, [0.0, 1.0])], kind)).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and max(r.identity_error for r in huge) < 1e-4
    assert whiten(spark.createDataFrame([], kind)).collect() == [] and whiten(spark.createDataFrame([(1, [])], kind)).collect() == []
