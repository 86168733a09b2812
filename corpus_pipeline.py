"""A training-data pipeline over ``documents``: each stage applies one operator of ``lectern.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns
the columns of ``documents``; the last one writes token files and returns what it reads back.
Verdicts, one for each row, meet texts in sort-merge joins at every size: neither side has to
fit a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.decontaminate import find_overlaps
from lectern.llm.mixing import mix_sources, words_of
from lectern.llm.ngram_join import ngram_jaccard_join
from lectern.llm.quality_rules import kept_documents
from lectern.llm.queries import tokenizer_path
from lectern.llm.scratch import materialise, release
from lectern.llm.token_files import token_files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same_row(doc_id: str, text_hash: str) -> Column:
    """Joins documents with verdicts on rows, which doc_id and a hash of the text tell apart."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text_hash))


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, by a filter in the scan; rows of one doc_id are judged each."""
    return kept_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (five words, 0.8): of the smallest doc_id, then of the smallest text hash.

    Rows without doc_id come last and stay only if no row of their group has one.  Texts
    without words are in no group and stay.  Of rows with equal doc_id and text one stays.
    """
    joined = materialise(ngram_jaccard_join(docs, k=5, percent=80).select("group_id", "doc_id", "text_hash"))
    release(spark)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    of_groups = joined.where("group_id is not null").groupBy("group_id").agg(first.alias("first")).select("first.doc_id", "first.text_hash")
    stay = of_groups.unionByName(joined.where("group_id is null").select("doc_id", "text_hash").distinct()).toDF("_of", "_hash")
    kept = docs.select(*COLUMNS).join(stay.hint("merge"), _same_row("_of", "_hash"), "left_semi")
    if joined.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        # combined before the shuffle, so very many equal rows are few
        one = kept.groupBy("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash")).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_row"))
        kept = one.select("doc_id", "_row.*").select(*COLUMNS)
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; nothing is shuffled."""
    found = find_overlaps(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_found")
    return found.where("_found.n_hit = 0").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0, 1 or 2.

    Rows that share a doc_id, or have none, are units of their own: the nth row of a doc_id,
    source and size comes as often as the mix takes the nth such unit (equal units are
    interchangeable).
    """
    docs = docs.select(*COLUMNS)
    mixed = materialise(mix_sources(docs).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_m"), "copies"))
    same = F.col("doc_id").eqNullSafe(F.col("_d"))
    if mixed.groupBy("_d").count().where("count > 1").limit(1).count():
        mixed = mixed.withColumn("_j", F.row_number().over(Window.partitionBy("_d", "_s", "_m").orderBy("copies")))
        docs = docs.withColumn("_n", words_of("text")).withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "source", "_n").orderBy(F.xxhash64("text"))))
        same = same & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_n") == F.col("_m")) & (F.col("_k") == F.col("_j"))
    both = docs.join(mixed.where("copies > 0").hint("merge"), same)
    return both.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents left; doc_id, start, n_tokens, ids_crc32 as read back."""
    return token_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality rules", keep_by_rules),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix),
    ("token-ID output", write_tokens),
]

#: binomial bounds and random walks of probabilities are not SQL; tests hold it against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        release(spark)
    return docs
