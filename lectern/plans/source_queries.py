"""Registered queries of readers, writers and configuration, over files made from the tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio as S
from ..operators import chapters as C
from ..scratch import scratch_dir
from ..sources import books as K
from ..sources import formats, stored
from .common import pieces, query, words

_CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'


def _epub(title: str, author: str | None, texts: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", _CONTAINER)
        items = "".join(f'<item href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(texts)))
        creator = f"<dc:creator>{escape(author)}</dc:creator>" if author else ""
        z.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{escape(title)}</dc:title>{creator}</metadata><manifest>{items}<item href="s.css" media-type="text/css"/></manifest></package>')
        for i, t in enumerate(texts):
            z.writestr(f"OEBPS/c{i}.xhtml", f"<html><head><style>p {{}}</style></head><body><nav>menu</nav><h1>Part {i}</h1><p>{escape(t)}</p><script>x</script></body></html>")
    return out.getvalue()


def _epubs(conv: DataFrame) -> DataFrame:
    """One EPUB for each conversation, a document for each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_epub(f"Talk & {c}", f"Author {c}" if c % 2 else None, [t["text"] for t in turns]) for c, turns in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(made, pa.binary())], ["path", "content"])

    by = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return by.select(F.concat(F.lit("/in/"), "conv_id", F.lit(".epub")).alias("path"), "conv_id", "turns").mapInArrow(run, "path string, content binary")


def _txt(docs: DataFrame) -> DataFrame:
    """Files of two chapters with line ends of all kinds: text before the first heading, then the text twice."""
    body = F.concat(F.lit("before\r\nChapter 1: First\r"), "text", F.lit("\n\r\nChapter II\r\n"), "text")
    return docs.select(F.concat(F.lit("/in/"), "doc_id", F.lit(".txt")).alias("path"), body.cast("binary").alias("content"))


_TURNS = "select conv_id, turn, (row_number() over (partition by conv_id order by turn, text) - 1)::int as item, trim(regexp_replace(text, '\\s+', ' ', 'g')) as body from conversations"


@query(
    "a1_dispatch", "conversations",
    sql=f"""select 'epub' as kind, '/in/' || conv_id || '.epub' as path, count(*) as chapters, sum(len({words('body')}) + 2)::bigint as words from ({_TURNS}) where length('Part ' || item || body) + 2 >= 50 group by conv_id
      union all select 'txt', '/in/' || conv_id || '-' || turn || '.txt', 1, len({words("text")}) from conversations""",
)
def _(conv):
    txt = conv.select(F.concat(F.lit("/in/"), "conv_id", F.lit("-"), "turn", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    count = lambda kind, files: K.parse_files(files, kind).groupBy("path").agg(F.count("*").alias("chapters"), F.sum("word_count").cast("long").alias("words")).select(F.lit(kind).alias("kind"), "path", "chapters", "words")
    return count("epub", _epubs(conv)).unionByName(count("txt", txt))


@query("a2_txt_scan", "documents", sql="select '/in/' || doc_id || '.txt' as path, 'before' || chr(10) || 'Chapter 1: First' || chr(10) || text || chr(10) || chr(10) || 'Chapter II' || chr(10) || text as text from documents")
def _(docs):
    return K.txt_documents(_txt(docs))


@query("a5_epub_scan", "conversations", sql=f"select '/in/' || conv_id || '.epub' as path, item, 'Part ' || item as title, 'Part ' || item || chr(10) || chr(10) || body as text from ({_TURNS}) where length('Part ' || item || body) + 2 >= 50")
def _(conv):
    return K.epub_documents(_epubs(conv)).select("path", "item", "title", "text")


@query("a6_epub_metadata", "conversations", sql=f"select distinct '/in/' || conv_id || '.epub' as path, 'Talk & ' || conv_id as book_title, case when conv_id % 2 = 1 then 'Author ' || conv_id end as author, null::varchar as language from ({_TURNS}) where length('Part ' || item || body) + 2 >= 50")
def _(conv):
    return K.epub_documents(_epubs(conv)).select("path", "book_title", "author", "language").distinct()


@query(
    "a10_uploads", "pages",
    sql=r"""select url as path, left(sha256(url), 8) || '_' || regexp_extract(url, '([^/]*)$', 1) as stored_as, regexp_extract(url, '([^/]*)$', 1) as original_filename, lower(regexp_extract(url, '\.([^./]*)$', 1)) as format, strlen(html)::bigint as file_size_bytes from pages""",
)
def _(pages):
    files = pages.select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    return K.register_uploads(files).select("path", "stored_as", "original_filename", "format", "file_size_bytes")


@query(
    "a12_wav_round_trip", "embeddings",
    sql="""select vec_id::varchar as path, 24000 as rate, len(x)::int as n, round(list_sum(list_transform(x, lambda v: round_even(v * 32767, 0) / 32768)), 6) as total from (select vec_id, list_transform(embedding::double[], lambda v: greatest(-1.0, least(1.0, v))) as x from embeddings)""",
)
def _(e):
    files = K.to_wav(e.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "vec_id", "x", 24000).withColumnRenamed("name", "path")
    return K.wav_sounds(files).select("path", "rate", F.size("samples").alias("n"), F.round(S.total(F.col("samples")), 6).alias("total"))


@query("a13_sound_files", "events", sql="select path from (select 'out/job_ch' || (user_id % 9) || case when event_id % 3 = 0 then '_seg' || event_id || '.wav' when event_id % 3 = 1 then '_' || event_id || '.wav' else '_seg' || event_id || '.txt' end as path from events) where regexp_matches(path, 'seg[^/]*\\.wav$')")
def _(events):
    third = F.col("event_id") % 3
    name = F.when(third == 0, F.concat(F.lit("_seg"), "event_id", F.lit(".wav"))).when(third == 1, F.concat(F.lit("_"), "event_id", F.lit(".wav"))).otherwise(F.concat(F.lit("_seg"), "event_id", F.lit(".txt")))
    return K.sound_files(events.select(F.concat(F.lit("out/job_ch"), F.col("user_id") % 9, name).alias("path")))


@query(
    "a14_config", "nation",
    sql="""select * from (select n_nationkey, unnest(['server', 'chunking', 'tts', 'tts', 'quality', 'logging', 'audio']) as section, unnest(['port', 'max_chunk_seconds', 'engine', 'default_top_k', 'max_retries', 'level', 'sample_rate']) as setting,
      unnest([(8000 + n_nationkey)::varchar, (10 + n_regionkey)::double::varchar, case when n_nationkey % 3 = 0 then 'b' else n_name end, (20 + n_regionkey)::varchar, '3', 'ERROR', '24000']) as value from nation)""",
)
def _(nation):
    """A configuration file of each nation, with one setting as text, one in a section of its own, and two from the environment."""
    engine = F.when(F.col("n_nationkey") % 3 == 0, "b").otherwise(F.col("n_name"))
    sections = F.struct(
        F.struct((F.col("n_nationkey") + 8000).cast("string").alias("port")).alias("server"), F.struct((F.col("n_regionkey") + 10).alias("max_chunk_seconds")).alias("chunking"),
        F.struct(engine.alias("engine"), F.struct((F.col("n_regionkey") + 20).alias("default_top_k")).alias("own")).alias("tts"), F.struct(F.lit("3").alias("max_retries")).alias("quality"), F.struct(F.lit("x").alias("base_path")).alias("storage"),
    )
    read = K.configurations(nation.select("n_nationkey", F.to_json(sections).alias("text")), "n_nationkey", "text", {"LOG_LEVEL": "ERROR"})
    return read.where("(section, setting) in (('server', 'port'), ('chunking', 'max_chunk_seconds'), ('tts', 'engine'), ('tts', 'default_top_k'), ('quality', 'max_retries'), ('logging', 'level'), ('audio', 'sample_rate'))")


@query("a4_txt_chapters", "documents", sql=f"""select '/in/' || doc_id || '.txt' as path, number, title, len({words('body')})::int as word_count from (select doc_id, 1 as number, 'Chapter 1: First' as title, text as body, length(text) > 200 - 18 as both from documents union all select doc_id, 2, 'Chapter II', text, length(text) > 200 - 18 from documents) where length(trim(body)) > 20 and doc_id in (select doc_id from documents where length(text) > 182 and not regexp_matches(text, '(?m)^(\\d+\\.\\s+.|={{3,}}$|\\*{{3,}}$)'))""")
def _(docs):
    plain = docs.where((F.char_length("text") > 182) & ~F.col("text").rlike(r"(?m)^(\d+\.\s+.|={3,}$|\*{3,}$)"))
    return K.parse_files(_txt(plain), "txt").select("path", "number", "title", "word_count")


def _line_splitter():
    """A sentence model back-end that takes each line as a sentence."""
    return lambda text: re.split("\n", text)


@query("t4_model_sentences", "documents", sql=f'select doc_id, unnest(range(len(s)))::int as "index", unnest(s) as text from (select doc_id, {pieces("text", chr(92) + "n")} as s from documents)')
def _(docs):
    return C.model_sentences(docs, "doc_id", _line_splitter)


@query(
    "a12_wav_source", "embeddings",
    sql="""select vec_id, 24000 as rate, len(x)::int as n, round(list_sum(list_transform(x, lambda v: round_even(v * 32767, 0) / 32768)), 6) as total from (select vec_id, list_transform(embedding::double[], lambda v: greatest(-1.0, least(1.0, v))) as x from embeddings)""",
)
def _(e):
    """Every vector as a WAV file, written and read by format name."""
    spark, folder = e.sparkSession, scratch_dir(e.sparkSession)
    formats.register(spark)
    e.select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("samples")).write.format("lectern-wav").mode("append").save(folder)
    read = spark.read.format("lectern-wav").load(folder)
    return read.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).cast("long").alias("vec_id"), "rate", F.size("samples").alias("n"), F.round(S.total(F.col("samples")), 6).alias("total"))


@query("a11_replaced_books", "documents", sql="select book, doc_id, case when book % 4 = 1 then 'again ' || text else text end as text from (select (doc_id % 32)::int as book, * from documents) where book % 4 <> 2")
def _(docs):
    """Documents kept as 32 books; a quarter of the books is then replaced, and a quarter loses all rows."""
    folder = scratch_dir(docs.sparkSession)
    rows = docs.select("doc_id", "text", (F.col("doc_id") % 32).cast("int").alias("book"))
    stored.replace_books(rows, rows, folder, "book")
    again = rows.where("book % 4 in (1, 2)")
    stored.replace_books(again.where("book % 4 = 1").withColumn("text", F.concat(F.lit("again "), "text")), again, folder, "book")
    return docs.sparkSession.read.parquet(folder).select("book", "doc_id", "text")
