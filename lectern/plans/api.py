"""The service's endpoints as functions from stored tables to DataFrames.

``db`` maps books, chapters, segments, characters, voice_profiles and generation_jobs to
DataFrames.  What changes a table returns the new table; nothing is written here.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import backends as B
from ..operators import chapters as C
from ..operators import characters as P
from ..operators import tables as T
from ..operators.backends import synthesise
from ..operators.chapters import chunk_sentences, exploded, pack_chunks
from ..sources import books as K

Db = Mapping[str, DataFrame]


def root(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("lectern").alias("name"), F.lit("ok").alias("status"))


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("healthy").alias("status"), F.version().alias("version"))


def upload_books(db: Db, files: DataFrame, folder: str) -> DataFrame:
    """books with a row for each uploaded file (path, length, content), whose bytes are stored below ``folder``.

    Formats other than epub, pdf and txt are left out.  An EPUB's own title, author and language
    win over what its name says.
    """
    allowed = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin("epub", "pdf", "txt"))
    stored = K.store_uploads(allowed, folder)
    about = K.epub_documents(allowed.where(F.lower("path").endswith(".epub")), 0).groupBy(F.col("path").alias("_p")).agg(F.first("book_title").alias("_t"), F.first("author").alias("author"), F.first("language").alias("language"))
    rows = stored.join(about, F.col("path") == F.col("_p"), "left").select(F.coalesce("_t", "title").alias("title"), "author", "language", "file_path", "original_filename", "format", "file_size_bytes", F.lit(False).alias("is_parsed"), F.lit(False).alias("is_analyzed"))
    return _appended(db["books"], rows, ["original_filename", "file_path"])


def _appended(old: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """``old`` with ``rows``, whose ids follow the largest one."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = T.generated_keys(rows, order, "id").crossJoin(F.broadcast(top)).withColumn("id", (F.col("id") + F.col("_top")).cast(old.schema["id"].dataType)).drop("_top")
    return old.unionByName(new, allowMissingColumns=True)


def parse_book(db: Db, book_id: int, files: DataFrame) -> dict[str, DataFrame]:
    """books and chapters after a book's file (path, content) was parsed; its old chapters are replaced.

    Boilerplate chapters are marked to be skipped; the book takes its numbers of chapters and words.
    """
    book = T.lookup(db["books"], "id", book_id)
    kind = book.select("format").first()
    if kind is None:
        raise LookupError(f"no book {book_id}")
    parsed = K.parse_files(files, kind["format"])
    rows = parsed.select(F.lit(book_id).cast(db["chapters"].schema["book_id"].dataType).alias("book_id"), "number", "title", F.col("text").alias("raw_text"), "word_count", "is_boilerplate", F.col("is_boilerplate").alias("skip_generation"), F.lit(False).alias("is_generated"))
    totals = rows.agg(F.count("*").alias("_c"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("_w"))
    mine = F.col("id") == book_id
    books = db["books"].crossJoin(F.broadcast(totals)).withColumns({
        "is_parsed": F.col("is_parsed") | mine, "total_chapters": F.when(mine, F.col("_c")).otherwise(F.col("total_chapters")), "total_words": F.when(mine, F.col("_w")).otherwise(F.col("total_words")),
    }).drop("_c", "_w")
    return {"books": books, "chapters": _appended(db["chapters"].where(F.col("book_id") != book_id), rows, ["number"])}


def analyze_book(db: Db, book_id: int, delimiter: str = r"\n\n+", load=None, annotator=None, non_persons: DataFrame | None = None, **limits) -> dict[str, DataFrame]:
    """characters, segments and books after a parsed book's analysis; what it had before is replaced.

    Characters (with voices) are found first; chapters become sentences, sentences are
    annotated, by keywords unless an ``annotator`` back-end is given, grouped into segments,
    and each segment's speaker is resolved to a character.  ``load``: an entity recogniser.
    ``limits``: k, least and verbs of the character table.
    """
    chapters = db["chapters"].where(F.col("book_id") == book_id).select("id", "book_id", "number", F.col("raw_text").alias("text"))
    people = P.voice_profiles(P.character_table(chapters, "book_id", "number", load=load, non_persons=non_persons, **limits), "book_id", "rank")
    found = people.select("book_id", F.col("rank").alias("_rank"), "name", "aliases", "role", F.col("gender").alias("inferred_gender"), F.col("dialogue").alias("dialogue_count"), F.col("first_chapter").alias("first_appearance_chapter"), "seed", "temperature", "speaking_rate", "pitch_shift")
    kept = db["characters"].where(F.col("book_id") != book_id)
    characters = _appended(kept, found, ["_rank"])
    sentences = C.sentence_records(chapters, "id", "text", delimiter).select(F.col("id").alias("chapter_id"), F.col("index").alias("at"), "text", "is_dialogue", "is_paragraph_start")
    if annotator is None:
        noted = sentences.select("*", F.lit("Narrator").alias("speaker"), X.emotion(F.col("text")).alias("emotion"), X.emphasis(F.col("text")).alias("emphasis"), X.pacing(F.col("text")).alias("pacing"), F.lit("").alias("vocal_direction"))
    else:
        names = [r["name"] for r in people.select("name", "rank").orderBy("rank").collect()]  # at most k of them
        noted = B.annotate(sentences, "chapter_id", "at", annotator, names)
    told = F.struct("at", "text", X.word_count(F.col("text")).alias("words"), "is_dialogue", "speaker", "emotion", "emphasis", "pacing", "vocal_direction", F.col("is_paragraph_start").alias("starts"))
    by_chapter = noted.groupBy("chapter_id").agg(F.sort_array(F.collect_list(told)).alias("s"))
    numbered = by_chapter.select("chapter_id", "s", C.group_segments(F.transform("s", lambda x: x.dropFields("at", "text", "pacing", "vocal_direction"))).alias("n"))
    rows = numbered.select("chapter_id", F.explode_outer(F.arrays_zip("s", "n")).alias("z")).where("z is not null").select("chapter_id", F.col("z.n").alias("sequence_number"), "z.s.*")
    last = F.struct("speaker", "emotion", "emphasis", "pacing", "vocal_direction", "is_dialogue")
    groups = rows.groupBy("chapter_id", "sequence_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"), F.max_by(last, "at").alias("l")).select("chapter_id", "sequence_number", "text", "l.*")
    mine = characters.where(F.col("book_id") == book_id).select("book_id", "id", F.col("id").alias("ord"), "name", "aliases")
    spoken = P.resolve(groups.withColumn("book_id", F.lit(book_id).cast(mine.schema["book_id"].dataType)), mine, ["book_id"])
    who = F.when(F.col("speaker") != "Narrator", F.col("character"))
    made = spoken.select("chapter_id", "sequence_number", "text", F.when(F.col("is_dialogue"), "dialogue").otherwise("narration").alias("segment_type"), who.alias("character_id"), who.alias("detected_character_id"), "emotion", "emphasis", "pacing", F.nullif("vocal_direction", F.lit("")).alias("vocal_direction"), F.lit(False).alias("is_generated"))
    others = db["segments"].join(chapters.select(F.col("id").alias("_c")), F.col("chapter_id") == F.col("_c"), "left_anti")
    books = db["books"].withColumn("is_analyzed", F.col("is_analyzed") | (F.col("id") == book_id))
    return {"characters": characters.drop("_rank"), "segments": _appended(others, made, ["chapter_id", "sequence_number"]), "books": books}


def list_books(db: Db) -> DataFrame:
    return T.newest_first(db["books"], "created_at", "id")


def get_book(db: Db, book_id: int) -> DataFrame:
    return T.children_of(T.lookup(db["books"], "id", book_id), db["chapters"].where(F.col("book_id") == book_id), "id", "book_id", ["number", "id", "title", "word_count"], "chapters")


def delete_book(db: Db, book_id: int) -> dict[str, DataFrame]:
    links = {"chapters": ("books", "book_id", "id"), "segments": ("chapters", "chapter_id", "id"), "characters": ("books", "book_id", "id"), "generation_jobs": ("books", "book_id", "id")}
    return T.cascade_delete(db, "books", db["books"].where(F.col("id") == book_id).select("id"), links, {"books": "id", "chapters": "id"})


def dramatis_personae(db: Db, book_id: int) -> DataFrame:
    return T.children_of(T.lookup(db["books"], "id", book_id).select("id", "title"), db["characters"], "id", "book_id", ["name", "role", "dialogue_count"], "characters").withColumn("total", F.coalesce(F.size("characters"), F.lit(0)))


def list_characters(db: Db, book_id: int) -> DataFrame:
    return db["characters"].where(F.col("book_id") == book_id).orderBy(F.desc("dialogue_count"), "id")


def get_character(db: Db, character_id: int) -> DataFrame:
    return T.lookup(db["characters"], "id", character_id)


def update_character(db: Db, patches: DataFrame) -> DataFrame:
    return T.patched(db["characters"], patches, "id", ["name", "description", "role", "voice_profile_id"])


def create_voice_profile(db: Db, rows: DataFrame) -> DataFrame:
    """New profiles with ids after the largest one."""
    return _appended(db["voice_profiles"], rows, ["name"])


def reference_audio(db: Db, profile_id: int, files: DataFrame, folder: str) -> DataFrame:
    """voice_profiles with the path of a reference sound (path, length, content) that is stored below ``folder``."""
    stored = K.store_uploads(files, f"{folder.rstrip('/')}/ref_{profile_id}").agg(F.max("file_path").alias("_f"))
    return db["voice_profiles"].crossJoin(F.broadcast(stored)).withColumn("reference_audio_path", F.when(F.col("id") == profile_id, F.col("_f")).otherwise(F.col("reference_audio_path"))).drop("_f")


def list_voice_profiles(db: Db) -> DataFrame:
    return db["voice_profiles"].orderBy("name")


def get_voice_profile(db: Db, profile_id: int) -> DataFrame:
    return T.lookup(db["voice_profiles"], "id", profile_id)


def update_voice_profile(db: Db, patches: DataFrame) -> DataFrame:
    return T.patched(db["voice_profiles"], patches, "id", ["name", "gender", "temperature", "speaking_rate", "pitch_shift"])


def delete_voice_profile(db: Db, profile_id: int) -> dict[str, DataFrame]:
    """The profile goes; characters that used it keep none."""
    unlinked = F.when(F.col("voice_profile_id") == profile_id, F.lit(None)).otherwise(F.col("voice_profile_id"))
    return {"voice_profiles": db["voice_profiles"].where(F.col("id") != profile_id), "characters": db["characters"].withColumn("voice_profile_id", unlinked)}


def list_jobs(db: Db, book_id: int | None = None) -> DataFrame:
    return T.newest_first(db["generation_jobs"], "created_at", "job_id", book_id=book_id)


def get_job(db: Db, job_id: str) -> DataFrame:
    return T.lookup(db["generation_jobs"], "job_id", job_id)


def create_job(db: Db, book_id: int, job_id: str, output_format: str = "wav", is_auto_mode: bool = True, config: Mapping | None = None) -> DataFrame:
    """generation_jobs with a new pending job; an unknown book or one that is not parsed is an error."""
    book = T.lookup(db["books"], "id", book_id).select("is_parsed").first()
    if book is None:
        raise LookupError(f"no book {book_id}")
    if not book["is_parsed"]:
        raise ValueError("a book must be parsed before generation")
    jobs = db["generation_jobs"]
    values = {"job_id": job_id, "book_id": book_id, "status": "pending", "progress": 0.0, "resume_count": 0, "is_auto_mode": is_auto_mode, "output_format": output_format, "config_json": json.dumps(config) if config else None}
    new = jobs.sparkSession.range(1).select(*(F.lit(v).cast(jobs.schema[c].dataType).alias(c) if c in jobs.columns else F.lit(v).alias(c) for c, v in values.items()), F.current_timestamp().alias("created_at"))
    return jobs.unionByName(new, allowMissingColumns=True)


def act_on_job(db: Db, job_id: str, action: str) -> DataFrame:
    """pause, resume or cancel: an action that is not allowed changes nothing; see ``acted``."""
    return T.acted(db["generation_jobs"], F.lit(action), F.col("job_id") == job_id, F.current_timestamp())


def download(db: Db, job_id: str) -> DataFrame:
    return get_job(db, job_id).where("status = 'completed' and output_path is not null").select("job_id", "output_path")


def list_segments(db: Db, chapter_id: int) -> DataFrame:
    rows = db["segments"].where(F.col("chapter_id") == chapter_id)
    return T.with_names(rows, db["characters"], "id", "name", {"character_id": "character_name", "detected_character_id": "detected_character_name"}).orderBy("sequence_number")


def update_segment(db: Db, patches: DataFrame) -> DataFrame:
    return T.patched(db["segments"], patches, "id", ["text", "emotion", "emphasis", "pacing", "character_id"])


def regenerate_segment(db: Db, segment_id: int, load=None) -> dict[str, DataFrame]:
    """segments with one marked as not generated, and that one's sound anew, in chunks like a preview's."""
    waiting = db["segments"].withColumn("is_generated", F.col("is_generated") & (F.col("id") != segment_id))
    return {"segments": waiting, "sound": preview_segment(db, segment_id, load)}


def segment_audio(db: Db, segment_id: int) -> DataFrame:
    return T.lookup(db["segments"], "id", segment_id).where("is_generated and audio_path is not null").select("id", "audio_path")


def preview_segment(db: Db, segment_id: int, load=None) -> DataFrame:
    """Chunks of one segment with their sound."""
    timed = T.lookup(db["segments"], "id", segment_id).select("id", chunk_sentences(F.col("text")).alias("s"))
    rows = exploded(timed, "id", pack_chunks(F.col("s")), "chunk", "c")
    return synthesise(rows.select("id", "chunk", F.col("c.text").alias("text"), F.lit("Ryan").alias("voice"), (F.lit(42) + F.col("chunk")).alias("seed")), "text", "voice", "seed", load)


def resume_progress(db: Db, book_id: int) -> DataFrame:
    """total and done segments of a book, and the chapters that need no work."""
    chapters = db["chapters"].where(F.col("book_id") == book_id)
    mine = db["segments"].join(chapters.select(F.col("id").alias("_c")), F.col("chapter_id") == F.col("_c"), "left_semi")
    skip = chapters.where("is_generated and audio_path is not null").agg(F.sort_array(F.collect_list("number")).alias("skippable"))
    return mine.agg(F.count("*").alias("total"), F.count_if("is_generated").alias("done")).crossJoin(skip)
