"""Chapters, paragraphs, sentences, dialogue, chunks and segments: the ordered dataflow of a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import folds
from ..functions import text as X
from ..functions import vocab
from ..functions.audio import let

# Lines that begin a chapter.
HEADINGS = (
    r"(?m)^(?:Chapter|CHAPTER)\s+(?:\d+|[IVXLC]+)(?:\s*[:\-.]\s*.+)?$",
    r"(?m)^(?:Part|PART)\s+(?:\d+|[IVXLC]+)(?:\s*[:\-.]\s*.+)?$",
    r"(?m)^\d+\.\s+.+$",
    r"(?m)^={3,}$",
    r"(?m)^\*{3,}$",
)


def headings(texts: DataFrame, key: str, text: str = "text", patterns: Sequence[str] = HEADINGS) -> DataFrame:
    """key, start (code points), title of every heading match; patterns in order on equal starts."""
    compiled = [re.compile(p) for p in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": m.start(), "o": o, "title": m.group().strip()} for o, p in enumerate(compiled) for m in p.finditer(t or "")] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(found, kind)], ["key", "found"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("o", pa.int32()), ("title", pa.string())]))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, found array<struct<start:long,o:int,title:string>>")
    return out.select(F.col("key").alias(key), F.sort_array("found").alias("found"))


def exploded(rows: DataFrame, key: str, items: Column, at: str, item: str) -> DataFrame:
    """key, at, item for each of ``items``, from a fold in Python.

    The outer explode keeps the optimiser from computing the fold once more for a filter on its size.
    """
    return rows.select(key, F.posexplode_outer(items).alias(at, item)).where(F.col(at).isNotNull())


def keep_apart(found: Column, gap: int = 200) -> Column:
    """Of sorted structs with ``start``, those more than ``gap`` after the last one kept."""
    flags = folds.apart_flags(F.transform(found, lambda x: x["start"].cast("long")), gap)
    both = F.zip_with(found, flags, lambda x, keep: F.struct(x.alias("x"), keep.alias("keep")))
    return F.transform(F.filter(both, lambda b: b["keep"]), lambda b: b["x"])


def split_chapters(texts: DataFrame, key: str, text: str = "text", patterns: Sequence[str] = HEADINGS) -> DataFrame:
    """key, number (from 1), title, text: slices between headings without the heading, over 20 characters.

    Text before the first heading is no chapter; a text without headings is one chapter
    without title, of any length.
    """
    found = headings(texts, key, text, patterns).withColumn("kept", keep_apart(F.col("found"))).drop("found")
    rows = texts.select(key, F.col(text).alias("_text")).join(found, key)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), X.strip(F.col("_text")).alias("text")))
    ends = lambda i: F.coalesce(F.get("kept", i + 1)["start"], F.char_length("_text").cast("long"))

    def body(h: Column, i: Column) -> Column:
        part = X.strip(F.substring("_text", (h["start"] + 1).cast("int"), (ends(i) - h["start"]).cast("int")))
        return F.struct(h["title"].alias("title"), X.strip(F.substring(part, F.char_length(h["title"]) + 1, F.char_length(part))).alias("text"))

    parts = F.filter(F.transform("kept", body), lambda c: F.char_length(c["text"]) > 20)
    return exploded(rows, key, F.when(F.size("kept") > 0, parts).otherwise(whole), "at", "c").select(key, (F.col("at") + 1).alias("number"), "c.title", "c.text")


def sentence_array(text: Column, delimiter: str = r"\n\n+", split=X.sentences_by_capital) -> Column:
    """array of struct(paragraph_index, text, is_dialogue, is_paragraph_start, is_paragraph_end), in order.

    A sentence is dialogue if its first occurrence in the paragraph overlaps a quoted span; a
    paragraph's spans are found once.
    """

    def record(p: Column, at: Column, own: Column, spans: Column, s: Column, j: Column) -> Column:
        overlaps = let(F.call_function("instr", p, s) - 1, lambda a: (a >= 0) & F.exists(spans, lambda q: (a < q["e"]) & (a + F.char_length(s) > q["s"])))
        inside = F.when(F.size(spans) == 0, F.lit(False)).otherwise(overlaps)
        return F.struct(at.alias("paragraph_index"), s.alias("text"), inside.alias("is_dialogue"), (j == 0).alias("is_paragraph_start"), (j == F.size(own) - 1).alias("is_paragraph_end"))

    of = lambda p, at: let(split(p), lambda own: let(quote_spans(p), lambda spans: F.transform(own, lambda s, j: record(p, at, own, spans, s, j))))
    return F.flatten(F.transform(X.paragraphs(text, delimiter), of))


def sentence_records(chapters: DataFrame, key: str, text: str = "text", delimiter: str = r"\n\n+", split=X.sentences_by_capital) -> DataFrame:
    """key, paragraph_index, index, text, is_dialogue, is_paragraph_start, is_paragraph_end of each sentence.

    index counts over the chapter.  ``split`` is the sentence splitter, a function of a column.
    Nothing is shuffled.
    """
    rows = chapters.select(key, F.posexplode(sentence_array(F.col(text), delimiter, split)).alias("index", "s"))
    return rows.select(key, "s.paragraph_index", "index", "s.text", "s.is_dialogue", "s.is_paragraph_start", "s.is_paragraph_end")


def model_sentences(chapters: DataFrame, key: str, load: Callable[[], Callable[[str], Sequence[str]]], text: str = "text", most: int = 1_000_000) -> DataFrame:
    """key, index, text: sentences by a pluggable model, loaded once for each task; blank ones are left out.

    A text is given to the model in slices of ``most`` characters, as such models have a limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = load()
        for batch in batches:
            every = [[s.strip() for i in range(0, len(t or ""), most) for s in split(t[i : i + most]) if s.strip()] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(every, pa.list_(pa.string()))], ["key", "sentences"])

    rows = chapters.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, sentences array<string>")
    return out.select(F.col("key").alias(key), F.posexplode("sentences").alias("index", "text"))


# A quote, straight or curly, with its marks.
QUOTE = r"[\"“][^\"”“]+[\"”]"


def quote_spans(paragraph: Column) -> Column:
    """array of struct(s, e): quoted spans with their quotes, from the lengths of what lies between them."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    lengths = F.zip_with(F.split(paragraph, QUOTE, -1), F.regexp_extract_all(paragraph, F.lit(QUOTE), 0), lambda a, q: F.struct(F.char_length(a).alias("a"), F.char_length(q).alias("q")))

    def step(s: Column, n: Column) -> Column:
        start = s["at"] + n["a"]
        return F.struct((start + F.coalesce(n["q"], F.lit(0))).alias("at"), F.when(n["q"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(start.alias("s"), (start + n["q"]).alias("e"))))).alias("out"))

    return F.when(paragraph.rlike("[\"“]"), F.aggregate(lengths, state, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _alternating(text: Column, pattern: str, reach: int) -> Column:
    """struct(all, heads, tails): what lies between the matches of ``pattern`` and the matches in turn, and ``reach`` characters of each.

    Item 2k is what comes before match k, which is item 2k + 1; an empty one ends the list.
    """
    items = F.flatten(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda a, m: F.array(a, F.coalesce(m, F.lit("")))))
    return let(items, lambda x: F.struct(x.alias("all"), F.transform(x, lambda t: F.left(t, F.lit(reach))).alias("heads"), F.transform(x, lambda t: F.right(t, F.lit(reach))).alias("tails")))


def _from(parts: Column, i: Column, reach: int) -> Column:
    """The first ``reach`` characters from item ``i`` on; a match and what precedes it have three at least."""
    few = 2 * (reach // 3 + 2)
    own = F.coalesce(F.get(parts["heads"], i), F.lit(""))
    return F.when(F.char_length(own) >= reach, own).otherwise(F.left(F.array_join(F.slice(parts["heads"], i + 1, F.lit(few)), ""), F.lit(reach)))


def _up_to(parts: Column, i: Column, reach: int) -> Column:
    """The last ``reach`` characters up to item ``i``, itself included; none for -1."""
    few = 2 * (reach // 3 + 2)
    own = F.coalesce(F.when(i >= 0, F.get(parts["tails"], i)), F.lit(""))
    before = F.slice(parts["tails"], F.greatest(F.lit(1), i + 2 - few), F.greatest(F.lit(0), F.least(F.lit(few), i + 1)))
    return F.when(F.char_length(own) >= reach, own).otherwise(F.right(F.array_join(before, ""), F.lit(reach)))


def dialogue_segments(chapters: DataFrame, key: str, text: str = "text", delimiter: str = r"\n\n+", verbs: Sequence[str] = vocab.SPEECH_VERBS) -> DataFrame:
    """key, paragraph, at, type, text, speaker: narration and quotes of each paragraph, in order.

    A paragraph is split once; what surrounds a quote is put together from its neighbours, so
    the work is linear in the text however many quotes it has.
    """
    nobody = F.lit(None).cast("string")

    def pieces(parts: Column, k: Column) -> Column:
        marked = F.get(parts["all"], 2 * k + 1)
        quote = X.strip(F.substring(marked, F.lit(2), F.char_length(marked) - 2))
        who = F.when(quote != "", X.speaker_in(_from(parts, 2 * k + 2, 150), _up_to(parts, 2 * k, 150), verbs))
        return F.array(
            F.struct((k * 2).alias("at"), F.lit("narration").alias("type"), X.strip(F.get(parts["all"], 2 * k)).alias("text"), nobody.alias("speaker")),
            F.struct((k * 2 + 1).alias("at"), F.lit("dialogue").alias("type"), quote.alias("text"), who.alias("speaker")),
        )

    of = lambda p: let(_alternating(p, QUOTE, 150), lambda parts: F.flatten(F.transform(F.sequence(F.lit(0), (F.size(parts["all"]) / 2).cast("int") - 1), lambda k: pieces(parts, k))))
    rows = chapters.select(key, F.posexplode(X.paragraphs(F.col(text), delimiter)).alias("paragraph", "p"))
    return rows.select(key, "paragraph", F.explode(of(F.col("p"))).alias("x")).where("x.text <> ''").select(key, "paragraph", "x.*")


def merge_short_narration(segments: DataFrame, key: str, order: Sequence[str], least: int = 3) -> DataFrame:
    """Narration of fewer than ``least`` words joins narration right before it."""
    w = Window.partitionBy(key).orderBy(*order)
    starts = ~((F.col("type") == "narration") & (F.lag("type").over(w) == "narration") & (X.word_count(F.col("text")) < least))
    grouped = segments.withColumn("_g", F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w)).withColumn("_o", F.struct(*order))
    return grouped.groupBy(key, "_g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "text"))), lambda x: x["text"]), " ").alias("text"), F.min_by("type", "_o").alias("type"), F.min_by("speaker", "_o").alias("speaker")).withColumnRenamed("_g", "number")


def _runs(items: Column, numbers: Column) -> Column:
    """array of struct(at, own): the parts of ``items`` with one number, and where each begins."""

    def cut(b: Column) -> Column:
        starts = F.filter(F.transform(b["n"], lambda n, i: F.when((i == 0) | (n != F.get(b["n"], i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda st: F.transform(st, lambda i, k: F.struct(i.alias("at"), F.slice(b["x"], i + 1, F.coalesce(F.get(st, k + 1), F.size(b["x"])) - i).alias("own"))))

    return let(F.struct(items.alias("x"), numbers.alias("n")), cut)


def _seconds(own: Column) -> Column:
    return F.aggregate(own, F.lit(0.0), lambda t, s: t + s["seconds"])


def pack_chunks(sentences: Column, target: float = 10.0, cap: float = 12.0) -> Column:
    """Greedy packing of array<struct(text, seconds, is_end)>: array<struct(text, seconds, indices, is_end)>.

    A sentence joins while the sum stays within the larger of ``target`` and ``cap``; a
    paragraph's end closes a chunk of at least 0.3 * target.  Give it a column: an expression
    would be computed once for the fold and once for the texts.
    """
    runs = _runs(sentences, folds.pack_numbers(sentences, max(target, cap), target * 0.3))
    text = lambda own: F.array_join(F.transform(own, lambda s: s["text"]), " ")
    return F.transform(runs, lambda r: F.struct(text(r["own"]).alias("text"), _seconds(r["own"]).alias("seconds"), F.sequence(r["at"], r["at"] + F.size(r["own"]) - 1).alias("indices"), F.element_at(r["own"], -1)["is_end"].alias("is_end")))


def split_oversize(chunks: Column, cap: float = 12.0, rate: float = 2.5) -> Column:
    """Chunks over 1.2 * cap are cut at clauses and packed again up to ``cap``; the last keeps the flag."""
    timed = lambda t: F.transform(X._pieces(t, r"(?<=[,;:—\-])\s+"), lambda p: F.struct(p.alias("text"), X.duration(p, rate).alias("seconds")))
    parts = F.transform(chunks, lambda c: F.when(c["seconds"] > cap * 1.2, timed(c["text"])).otherwise(F.array().cast("array<struct<text:string,seconds:double>>")))
    numbers = folds.part_numbers(F.transform(parts, lambda ps: F.transform(ps, lambda p: p["seconds"])), cap)

    def one(c: Column, ps: Column, ns: Column) -> Column:
        made = lambda r, k, n: F.struct(F.array_join(F.transform(r["own"], lambda p: p["text"]), " ").alias("text"), _seconds(r["own"]).alias("seconds"), c["indices"].alias("indices"), (c["is_end"] & (k == n - 1)).alias("is_end"))
        return F.when(F.size(ps) > 1, let(_runs(ps, ns), lambda runs: F.transform(runs, lambda r, k: made(r, k, F.size(runs))))).otherwise(F.array(c))

    cut = F.zip_with(F.zip_with(chunks, parts, lambda c, ps: F.struct(c.alias("c"), ps.alias("ps"))), numbers, lambda x, ns: one(x["c"], x["ps"], ns))
    return F.flatten(cut)


def chunk_sentences(text: Column, rate: float = 2.5, delimiter: str = r"\n\n+") -> Column:
    """array<struct(text, seconds, is_end)> of a text, for ``pack_chunks``."""
    timed = lambda own: F.transform(own, lambda s, i: F.struct(s.alias("text"), X.duration(s, rate).alias("seconds"), (i == F.size(own) - 1).alias("is_end")))
    return F.flatten(F.transform(X.paragraphs(text, delimiter), lambda p: let(X.sentences(p), timed)))


def group_segments(sentences: Column, soft: int = 80, slack: int = 30, most: int = 4) -> Column:
    """Segments of array<struct(words, is_dialogue, speaker, emotion, emphasis, starts)>: each sentence's segment number.

    A change of dialogue, of speaker inside dialogue, a paragraph's start, ``most`` sentences or
    ``soft`` words end a segment.  The first change of emotion or emphasis in narration is
    absorbed while the words stay within soft + slack; an absorbed sentence skips other checks.
    """
    return folds.segment_numbers(sentences, soft, slack, most)


# Where a legacy dialogue's speaker is named, after a quote and before it.
LEGACY_AFTER = (r"(?i)[,.]?\s*said\s+(\w+)", r"(?i)[,.]?\s*(\w+)\s+said", rf"(?i)[,.]?\s*(\w+)\s+(?:{'|'.join(vocab.SHORT_VERBS)})", rf"(?i)[,.]?\s*(?:{'|'.join(vocab.SHORT_VERBS)})\s+(\w+)")
LEGACY_BEFORE = (r"(?i)(\w+)\s+said[,:]?\s*$", rf"(?i)(\w+)\s+(?:{'|'.join(vocab.SHORT_VERBS)})[,:]?\s*$")


def legacy_speaker(after: Column, before: Column) -> Column:
    """One-word speaker by the first pattern that fits, in 100 characters on either side."""
    a, b = F.left(after, F.lit(100)), F.right(before, F.lit(100))
    return F.coalesce(*(F.nullif(F.regexp_extract(a, p, 1), F.lit("")) for p in LEGACY_AFTER), *(F.nullif(F.regexp_extract(b, p, 1), F.lit("")) for p in LEGACY_BEFORE))


def legacy_dialogue(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, at, type, text, speaker by straight quotes over the whole text.

    A match runs from the end of the one before, over a quote, up to the next quote: what
    surrounds a quote belongs to its match and is no narration.  Narration is what no match
    reaches: text skipped by an empty quote, an unpaired quote at the end, or a text without quotes.
    A text is split once and is linear work.
    """
    t = F.col("_t")
    item = lambda kind, x, who: F.struct(F.lit(kind).alias("type"), x.alias("text"), who.alias("speaker"))
    nobody = F.lit(None).cast("string")

    def told(parts: Column, k: Column) -> Column:
        gap, match = F.get(parts["all"], 2 * k), F.get(parts["all"], 2 * k + 1)
        lost = F.regexp_extract(gap, '(?s)^(.*")', 1)  # up to the last quote that no match has
        said = X.strip(F.regexp_extract(match, '"([^"]+)"', 1))
        who = legacy_speaker(_from(parts, 2 * k + 2, 100), F.concat(_up_to(parts, 2 * k - 1, 100), lost))
        is_last = k == (F.size(parts["all"]) / 2).cast("int") - 1
        return F.when(is_last, F.array(item("narration", X.strip(gap), nobody))).otherwise(F.array(item("narration", X.strip(lost), nobody), item("dialogue", said, who)))

    def every(parts: Column) -> Column:
        found = F.flatten(F.transform(F.sequence(F.lit(0), (F.size(parts["all"]) / 2).cast("int") - 1), lambda k: told(parts, k)))
        return F.filter(found, lambda x: x["text"] != "")

    segments = let(_alternating(t, '"[^"]+"[^"]*', 100), every)
    whole = F.array(item("narration", X.strip(t), nobody))
    numbered = let(F.when(t.isNotNull(), segments), lambda x: F.transform(F.when(F.size(x) > 0, x).otherwise(whole), lambda y, i: F.struct(i.alias("at"), y["type"].alias("type"), y["text"].alias("text"), y["speaker"].alias("speaker"))))
    return texts.select(key, F.col(text).alias("_t")).where("_t is not null").select(key, F.explode(numbered).alias("x")).select(key, "x.*")
