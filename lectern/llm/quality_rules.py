"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Each learned rule rejects a document whose ratio is above a cutoff from a fixed grid.  The
labelled documents of each stratum are split by a hash of doc_id.  On a quarter of them every
rule gets its usable cutoffs, those that reject some bad document and at most TOLERATED of the
good ones; step j of a stratum takes of every rule the j-th of these, from the most lenient
on, so each step rejects all that the one before it does.  On the other three quarters, the
holdout, the steps are tested in that order and only while they pass: a step passes if the
exact (Clopper-Pearson) upper bound of the good documents that its rules together reject stays
below ``risk``.  Testing nested steps in a fixed order up to the first failure spends the error
once; it is divided by the number of strata (Bonferroni).  So with probability 1 - ``delta`` no
stratum loses more than ``risk`` of its good documents (those that pass the base rule) to the
learned rules.  Of the steps that passed the one that rejects most bad documents is used; of
equal ones, the most lenient.  A stratum whose holdout has too few good documents for any proof
(144 at 3 % and four strata) rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
RISK, DELTA = 0.03, 0.05
#: share of the good documents that a usable cutoff may reject where cutoffs are chosen
TOLERATED = 0.002
#: of so many parts of the labels one chooses cutoffs and the others certify them
PARTS = 4
#: Rule -> (ratio of feature columns, grid of cutoffs).  Fixed values.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "duplicate_lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeated_words": ("n_repeat_words / n_words", (0.02, 0.05, 0.08, 0.1, 0.15)),
    "capitals": ("n_capitals / word_chars", (0.08, 0.12, 0.2, 0.3, 0.5)),
    "exclamations": ("n_exclaims / n_words", (0.02, 0.05, 0.1, 0.2, 0.4)),
    "long_words": ("word_chars / n_words", (8.0, 10.0, 12.0, 16.0, 24.0)),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def with_features(documents: DataFrame, text: Column) -> DataFrame:
    """``documents`` with the columns FEATURES of ``text``; no shuffle, no Python.

    A word of a 5-word window that occurs twice or more in the text counts once, wherever
    windows overlap: the windows' positions are sorted and each adds the words up to the
    next one, five at most.
    """
    kept = documents.columns
    a = documents.select(*kept, text.alias("_text"), F.array_remove(F.split(text, SPACES), "").alias("_words"), F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"))
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get("_words", i + j) for j in range(5))))
    b = a.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - _without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.char_length("_text") - _without(F.col("_text"), "[A-Z]+")).cast("long").alias("n_capitals"),
        (F.char_length("_text") - _without(F.col("_text"), "!+")).cast("long").alias("n_exclaims"),
        F.when(n >= 5, windows).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = b.withColumn("_placed", F.when(repeats, placed))
    again = F.filter("_placed", lambda x, k: (x["h"] == F.get("_placed", k - 1)["h"]) | (x["h"] == F.get("_placed", k + 1)["h"]))
    d = c.withColumn("_at", F.when(F.col("_placed").isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"]))))
    covered = F.aggregate("_at", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("sum")), lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(5), i - s["last"])).alias("sum")))
    return d.withColumn("n_repeat_words", F.coalesce(covered["sum"], F.lit(0)).cast("long")).select(*kept, *FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def exact_upper_bound_holds(rejected: int, n: int, rate: float, error: float) -> bool:
    """True if P(Binomial(n, rate) <= rejected) <= error: the exact upper bound is at most ``rate``."""
    if n == 0 or rejected >= n:
        return False
    log_p, log_q = math.log(rate), math.log1p(-rate)
    total = 0.0
    for k in range(rejected + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * log_p + (n - k) * log_q)
        if total > error:
            return False
    return True


def _ratio(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def choose_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and rule from rows with FEATURES, doc_id, stratum and good (boolean).

    Only documents that pass the base rules count.  What comes to the driver is one row of
    counts for each stratum and part.
    """
    judged = labelled.where(~base_failed()).withColumn("holdout", F.crc32(F.col("doc_id").cast("string").cast("binary")) % PARTS != 0)
    tests = [(rule, c) for rule, (_, grid) in RULES.items() for c in grid]
    sums = [F.count_if((_ratio(rule) > c) & (F.col("good") == good)).alias(f"{int(good)}_{i}") for i, (rule, c) in enumerate(tests) for good in (True, False)]
    usable: dict[str | None, dict[str, list[float]]] = {}
    for row in judged.where("not holdout").groupBy("stratum").agg(F.count_if("good").alias("n"), *sums).collect():
        own = usable.setdefault(row["stratum"], {})
        for i, (rule, c) in reversed(list(enumerate(tests))):  # from lenient to strict
            if row[f"0_{i}"] and row[f"1_{i}"] <= TOLERATED * row["n"]:
                own.setdefault(rule, []).append(c)
    n_steps = max(len(grid) for _, grid in RULES.values())
    steps = [{s: {rule: cs[min(j, len(cs) - 1)] for rule, cs in own.items()} for s, own in usable.items()} for j in range(n_steps)]
    hits = [rejected_by(cutoffs, F.col("stratum")) for cutoffs in steps]
    sums = [F.count_if(hit & (F.col("good") == good)).alias(f"{int(good)}_{j}") for j, hit in enumerate(hits) for good in (True, False)]
    counts = judged.where("holdout").groupBy("stratum").agg(F.count_if("good").alias("n"), *sums).collect()
    chosen: dict[str | None, dict[str, float]] = {}
    for row in counts:
        passed: list[tuple[int, int]] = []
        for j in range(n_steps):
            if not exact_upper_bound_holds(row[f"1_{j}"], row["n"], risk, delta / len(counts)):
                break
            passed.append((row[f"0_{j}"], -j))
        if passed:
            chosen[row["stratum"]] = steps[-max(passed)[1]].get(row["stratum"], {})
    return chosen


def rejected_by(cutoffs: dict[str | None, dict[str, float]], stratum: Column) -> Column:
    """True for rows with FEATURES that a cutoff of their stratum rejects."""
    verdict = F.lit(False)
    for name, own in cutoffs.items():
        for rule, c in own.items():
            verdict = verdict | (stratum.eqNullSafe(F.lit(name)) & (_ratio(rule) > c))
    return verdict


def fitted_cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """Cutoffs from rows with doc_id, stratum and FEATURES that ``labels`` (doc_id, quality) cover."""
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg((F.min("quality") > 0).alias("good"))
    return choose_cutoffs(features.join(quality, F.col("doc_id") == F.col("of")), risk, delta)


def kept_documents(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``documents`` that ``quality_rules`` keeps, with its columns.

    Features depend on their row alone, so the second pass is a filter in the scan: no text is
    shuffled and no verdict is joined.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), text.alias("text"))
    cutoffs = fitted_cutoffs(materialise(with_features(rows, F.col("text")).drop("text")), labels, risk, delta)
    judged = with_features(documents.select(F.struct(*documents.columns).alias("_row"), F.col("lang").cast("string").alias("stratum"), text.alias("text")), F.col("text"))
    stays = ~base_failed() & ~rejected_by(cutoffs, F.col("stratum"))
    # an outer explode, as a filter would be pushed below the features and repeat them for each rule
    marked = judged.select("_row", F.posexplode_outer(F.when(stays, F.array(F.lit(True)))).alias("_at", "_stays"))
    return marked.where("_at is not null").select("_row.*")


def quality_rules(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Words are runs of [^\\x20\\x09-\\x0D]; the stratum is lang.  A null text has no words and
    fails the base rule, as do empty ones; a null lang is a stratum of its own; a null doc_id
    has no label.  If labels repeat a doc_id, the lowest quality holds; a null quality is no
    label.  Rows that repeat a doc_id are judged each.  Empty labels: only the base rules.
    ``text_hash`` tells rows of one doc_id apart.  Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    features = materialise(with_features(rows, F.col("text")).drop("text"))
    cutoffs = fitted_cutoffs(features, labels, risk, delta)
    failed = base_failed()
    return features.select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected_by(cutoffs, F.col("stratum"))).alias("kept"))
