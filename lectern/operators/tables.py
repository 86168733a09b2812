"""Lookups, joins, changes and roll-ups over the stored tables, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialise


def lookup(rows: DataFrame, column: str, value) -> DataFrame:
    """The row of a unique key; empty if there is none."""
    return rows.where(F.col(column) == F.lit(value)).limit(1)


def newest_first(rows: DataFrame, time: str, tie: str, **equal) -> DataFrame:
    """Rows by falling time; filters with an empty, zero or null value are left out."""
    for column, value in equal.items():
        if value:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(F.desc(time), tie)


def with_names(rows: DataFrame, names: DataFrame, id_column: str, name: str, links: Mapping[str, str]) -> DataFrame:
    """Left joins to one table of names, once for each (link column -> output column)."""
    for i, (link, out) in enumerate(links.items()):
        side = names.select(F.col(id_column).alias(f"_id{i}"), F.col(name).alias(out))
        rows = rows.join(side, F.col(link) == F.col(f"_id{i}"), "left").drop(f"_id{i}")
    return rows


def children_of(parents: DataFrame, children: DataFrame, parent_id: str, link: str, fields: Sequence[str], out: str) -> DataFrame:
    """Parents with an ordered array of their children; one shuffle on the link."""
    nested = children.groupBy(F.col(link).alias("_p")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))
    return parents.join(nested, F.col(parent_id) == F.col("_p"), "left").drop("_p")


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the fields that a patch names: ``patches`` has key and changes (map<string,string>).

    A field set to null becomes null; a field that is not in the map keeps its value.
    """
    side = patches.select(F.col(key).alias("_k"), "changes")
    both = rows.join(side, F.col(key) == F.col("_k"), "left")
    new = {c: F.when(F.coalesce(F.map_contains_key("changes", F.lit(c)), F.lit(False)), F.try_element_at("changes", F.lit(c)).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return both.withColumns(new).drop("_k", "changes")


def cascade_delete(tables: Mapping[str, DataFrame], root: str, doomed: DataFrame, links: Mapping[str, tuple[str, str, str]], keys: Mapping[str, str]) -> dict[str, DataFrame]:
    """What is left of each table after ``doomed`` (the root's key) and all that hangs on it go.

    links: child -> (parent, link column, parent key), parents before children.
    """
    gone, left = {root: doomed.select(keys[root]).distinct()}, {root: tables[root].join(doomed, keys[root], "left_anti")}
    for child, (parent, link, parent_key) in links.items():
        dead = gone[parent].select(F.col(parent_key).alias("_p"))
        left[child] = tables[child].join(dead, F.col(link) == F.col("_p"), "left_anti")
        if child in keys:
            gone[child] = tables[child].join(dead, F.col(link) == F.col("_p"), "left_semi").select(keys[child])
    return left


def recovered(jobs: DataFrame, status: str = "status", running: str = "generating", failed: str = "failed", message: str = "interrupted") -> DataFrame:
    """Jobs that were running when the process died are failed, with a message."""
    hit = F.col(status) == running
    return jobs.withColumn("error_message", F.when(hit, message)).withColumn(status, F.when(hit, failed).otherwise(F.col(status)))


def or_default(rows: DataFrame, profiles: DataFrame, link: str, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Left join to profiles; a missing profile takes the default fields."""
    side = profiles.select(F.col(key).alias("_k"), *defaults)
    both = rows.join(side, F.col(link) == F.col("_k"), "left")
    missing = F.col("_k").isNull()
    return both.withColumns({c: F.when(missing, F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()}).drop("_k")


def numbered(rows: DataFrame, part: Sequence[str], order: Sequence[Column | str], out: str, first: int = 1) -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1 + first)


def generated_keys(rows: DataFrame, order: Sequence[Column | str], out: str, first: int = 1) -> DataFrame:
    """``rows`` numbered over the whole table in ``order``, without one task for all of them.

    Rows are ranged, written to the shared folder, numbered within ranges, and each range starts
    after the rows of those before: what meets in one task is one count for each range.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(offsets, F.col("_part") == F.col("_p")).withColumn(out, F.col("_before") + inside - 1 + first).drop("_part", "_p", "_before")


def zipped(rows: DataFrame, notes: DataFrame, key: str, order: Sequence[Column | str], note_order: Sequence[Column | str], fields: Sequence[str]) -> DataFrame:
    """``rows`` with ``fields`` of the note at the same place within their key; rows beyond the notes go."""
    side = numbered(notes, [key], note_order, "_j").select(F.col(key).alias("_k"), "_j", *fields)
    return numbered(rows, [key], order, "_i").join(side, (F.col(key) == F.col("_k")) & (F.col("_i") == F.col("_j"))).drop("_i", "_j", "_k")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def expected_texts(files: DataFrame, path: str, texts: DataFrame, text_path: str, text: str, order: str, out: str = "expected") -> DataFrame:
    """``files`` with the text stored for a file of the same name, the last by ``order``; '' where there is none."""
    side = texts.groupBy(file_name(F.col(text_path)).alias("_f")).agg(F.max_by(text, order).alias(out))
    return files.join(side, file_name(F.col(path)) == F.col("_f"), "left").withColumn(out, F.coalesce(out, F.lit(""))).drop("_f")


def acted(jobs: DataFrame, action: Column, mine: Column, now: Column) -> DataFrame:
    """``jobs`` after an action on those that are ``mine``; one that is not allowed changes nothing.

    A resumed job counts it, takes ``now`` as resumed_at and loses its error and completed_at; a
    finished, failed or cancelled one takes ``now`` as completed_at.
    """
    to = F.when(mine, status_transition(F.col("status"), action)).otherwise(F.col("status"))
    moved = to != F.col("status")
    resumed, ended = moved & (action == "resume"), moved & to.isin("completed", "failed", "cancelled")
    return jobs.withColumns({
        "status": to, "resume_count": F.col("resume_count") + F.when(resumed, 1).otherwise(0), "error_message": F.when(resumed, F.lit(None)).otherwise(F.col("error_message")),
        "resumed_at": F.when(resumed, now).otherwise(F.col("resumed_at")), "completed_at": F.when(resumed, F.lit(None)).when(ended, now).otherwise(F.col("completed_at")),
    })


def remaining(chapters: DataFrame, segments: DataFrame, chapter_id: str, link: str) -> DataFrame:
    """Segments still to make: not made, and of no chapter that is made and has its sound."""
    done = chapters.where("is_generated and audio_path is not null").select(F.col(chapter_id).alias("_c"))
    return segments.where("not is_generated").join(done, F.col(link) == F.col("_c"), "left_anti")


def until_cancelled(work: DataFrame, job: str, order: Sequence[str], cancels: Column, batch: int = 16) -> DataFrame:
    """Work that is done although a job is cancelled: the flag is looked at once for each batch, before the next one."""
    at = F.floor((F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1) / batch)
    placed = work.withColumn("_b", at).withColumn("_stop", F.min(F.when(cancels, at)).over(Window.partitionBy(job)))
    return placed.where("_stop is null or _b <= _stop").drop("_b", "_stop")


def memory_guard(available_gb: Column, flush: float = 16, fail: float = 8) -> Column:
    return F.when(available_gb < fail, "fail").when(available_gb < flush, "flush").otherwise("ok")


def slow_requests(requests: DataFrame, milliseconds: Column, polling: Column, limit: float = 500) -> DataFrame:
    """Logged requests with slow; polls of a job's state are not logged."""
    return requests.where(~polling).withColumn("slow", milliseconds > limit)


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(progress, rate, eta): per cent, units a second, and time left as 'Xm Ys'."""
    rate = done / F.greatest(seconds, F.lit(1.0))
    left = (total - done) / F.greatest(rate, F.lit(0.001))
    whole = F.floor(left).cast("long")
    return F.struct((done / total * 100).alias("progress"), rate.alias("rate"), F.concat(F.floor(whole / 60), F.lit("m "), whole % 60, F.lit("s")).alias("eta"))


def status_transition(state: Column, action: Column) -> Column:
    """The state after an action, or the same state where the action is not allowed."""
    running = ("pending", "parsing", "analyzing", "generating", "processing")
    stopped = ("paused", "failed", "cancelled")
    ended = ("completed", "failed", "cancelled")
    return (
        F.when((action == "start") & (state == "pending"), "generating")
        .when((action == "finish") & (state == "generating"), "completed")
        .when((action == "fail") & ~state.isin(*ended), "failed")
        .when((action == "pause") & state.isin(*running), "paused")
        .when((action == "resume") & state.isin(*stopped), "generating")
        .when((action == "cancel") & ~state.isin(*ended), "cancelled")
        .otherwise(state)
    )


def replay(actions: DataFrame, job: str, order: Sequence[str], action: str) -> DataFrame:
    """job, status, resume_count, rejected: the ordered fold of each job's actions from pending."""
    listed = actions.groupBy(job).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(action).alias("_a")))).alias("acts"))
    state = F.struct(F.lit("pending").alias("s"), F.lit(0).alias("r"), F.lit(0).alias("x"))

    def step(st: Column, a: Column) -> Column:
        to = status_transition(st["s"], a["_a"])
        moved = to != st["s"]
        return F.struct(to.alias("s"), (st["r"] + F.when(moved & (a["_a"] == "resume"), 1).otherwise(0)).alias("r"), (st["x"] + F.when(moved, 0).otherwise(1)).alias("x"))

    return listed.select(job, F.aggregate("acts", state, step).alias("f")).select(job, F.col("f.s").alias("status"), F.col("f.r").alias("resume_count"), F.col("f.x").alias("rejected"))


def batch_size(available: Column, total: Column, model: float = 6.8, cost: float = 1.5, headroom: float = 0.2, least: int = 1, most: int = 12) -> Column:
    room = available - model - headroom * total
    return F.when(room <= 0, F.lit(least)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), (room / cost).cast("int"))))


def pool_size(available: Column, headroom: float = 20, engine: float = 8, most: int = 8) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), ((available - headroom) / engine).cast("int")))


def resource_profile(dtype: Column, available: Column, total: Column, override: Column) -> Column:
    """struct(model_gb, batch, jobs): by data type; a positive override is clamped instead of computed."""
    model = F.when(dtype.isin("bfloat16", "float16"), 3.4).otherwise(6.8)
    room = available - model - 0.2 * total
    auto = F.when(room <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(12), (room / 1.5).cast("int"))))
    batch = F.when(override > 0, F.greatest(F.lit(1), F.least(F.lit(12), override))).otherwise(auto)
    return F.struct(model.alias("model_gb"), batch.alias("batch"), F.when(total < 64, 1).otherwise(2).alias("jobs"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
