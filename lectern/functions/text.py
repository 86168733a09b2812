"""Text operators as Column expressions: each stays inside the JVM and needs no shuffle."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab

SPACE = r"(?U)\s+"


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between white space, none empty."""
    return F.array_remove(F.split(text, SPACE), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def paragraphs(text: Column, delimiter: str = r"\n\n+") -> Column:
    return _pieces(text, delimiter)


def sentences_by_capital(text: Column) -> Column:
    """Cuts after . ! ? where white space and a capital or an opening quote follow."""
    return _pieces(text, r"(?<=[.!?])(?U:\s+)(?=[A-Z\"“])")


def sentences(text: Column) -> Column:
    """Cuts after . ! ? or an ellipsis; a closing quote before the space belongs to the cut."""
    return _pieces(text, r"(?<=[.!?…])(?:(?U:\s*)[\"'”’])?(?U:\s+)")


def quoted(text: Column) -> Column:
    """Texts inside double quotes, straight or curly."""
    return F.regexp_extract_all(text, F.lit(r"[\"“]([^\"”“]+)[\"”]"), 1)


def duration(text: Column, words_per_second: Column | float = 2.5, least: float = 0.3) -> Column:
    per = words_per_second if isinstance(words_per_second, Column) else F.lit(float(words_per_second))
    return F.greatest(F.lit(least), word_count(text) / per)


def pace(pacing: Column, emphasis: Column, direction: Column) -> Column:
    """Words a second from pacing, emphasis and the wording of a direction; the first rule that fits."""
    d = F.lower(F.coalesce(direction, F.lit("")))
    has = lambda *w: _any([d.contains(x) for x in w])
    return (
        F.when(pacing.isin("slow", "deliberate") | (emphasis == "whispered"), 1.8)
        .when(pacing.isin("fast", "urgent"), 3.2)
        .when(has("slow", "deliberate", "measured"), 1.8)
        .when(has("fast", "urgent", "rapid"), 3.2)
        .otherwise(2.5)
    )


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return _any([F.coalesce(text.rlike(p), F.lit(False)) for p in patterns])


def is_boilerplate_chapter(title: Column, text: Column, titles: Sequence[str] = vocab.BOILERPLATE_TITLES, bodies: Sequence[str] = vocab.BOILERPLATE_TEXT, sample: int = 2000) -> Column:
    """By title, by two patterns in the opening, or by an opening of mostly short lines."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(sample))
    hits = sum((F.coalesce(head.rlike(p), F.lit(False)).cast("int") for p in bodies), F.lit(0))
    lines = _pieces(head, "\n")
    short = F.size(F.filter(lines, lambda x: F.char_length(x) < 40))
    return matches_any(title, titles) | (hits >= 2) | ((F.size(lines) > 5) & (short / F.size(lines) > 0.7))


def is_boilerplate_segment(text: Column, bodies: Sequence[str] = vocab.BOILERPLATE_TEXT, titles: Sequence[str] = vocab.METADATA_TITLES) -> Column:
    return matches_any(strip(text), [*bodies, *titles])


def emotion(text: Column, table: Mapping[str, Sequence[str]] = vocab.EMOTION_WORDS) -> Column:
    """The emotion with most of its words somewhere in the text; the first of equals; else neutral."""
    low = F.lower(text)
    scored = [F.struct(sum((low.contains(w).cast("int") for w in own), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, own) in enumerate(table.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise("neutral")


def emphasis(text: Column, table: Mapping[str, Sequence[str]] = vocab.EMPHASIS_WORDS) -> Column:
    """Whole words first, then more than two words in capitals, then *marks* or _marks_."""
    out = None
    for name, own in table.items():
        hit = text.rlike(rf"(?i)\b(?:{'|'.join(own)})\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(F.size(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}\b"), 0)) > 2, "shouted").when(text.rlike(r"\*[^*]+\*|_[^_]+_"), "emphasized").otherwise("normal")


def pacing(text: Column) -> Column:
    """From the mean number of words between sentence ends, then from exclamation marks."""
    # a part is a run without . ! ? that holds more than spaces; its words are runs without spaces too
    parts = F.regexp_count(text, F.lit(r"(?U)[^.!?\s][^.!?]*+"))
    mean = F.regexp_count(text, F.lit(r"(?U)[^.!?\s]++")) / F.nullif(parts, F.lit(0))
    marks = F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))
    return F.when(mean.isNull(), "normal").when(mean < 5, "fast").when(mean > 20, "slow").when(marks > 2, "urgent").otherwise("normal")


def instruction(emotion: Column, emphasis: Column, pacing: Column) -> Column:
    def phrase(key: Column, table: Mapping[str, str]) -> Column:
        out = None
        for name, text in table.items():
            if text:
                out = F.when(key == name, text) if out is None else out.when(key == name, text)
        return out

    return F.concat_ws(" ", phrase(emotion, vocab.EMOTION_PHRASES), phrase(emphasis, vocab.EMPHASIS_PHRASES), phrase(pacing, vocab.PACING_PHRASES))


def clean_name(raw: Column) -> Column:
    """A name without junk at its ends, or null if it cannot be one."""
    name = strip(F.regexp_replace(F.regexp_replace(raw, r"^[^a-zA-Z]+", ""), r"[^a-zA-Z.\s'-]+$", ""))
    titled = name.rlike(r"^(?:Mr|Mrs|Ms|Dr|St|Jr|Sr)\.\s")
    pointed = name.rlike("[.!?;:—–]") & ~titled
    bad = (F.char_length(name) < 2) | name.rlike(r"^\p{Ll}") | ((F.char_length(name) <= 2) & F.lower(name).isin(*vocab.SHORT_WORDS))
    broken = pointed & (name.rlike(r"[.!?][\s\-—–]*[A-Z]") | name.rlike("[—–]|--"))
    final = F.when(pointed, F.regexp_replace(name, r"\.+$", "")).otherwise(name)
    stopped = F.arrays_overlap(F.transform(words(F.lower(final)), lambda w: F.regexp_replace(w, r"\.+$", "")), F.array(*map(F.lit, vocab.STOP_NAMES)))
    return F.when(~bad & ~broken & (F.char_length(final) >= 2) & ~stopped, final)


def strip_honorifics(name: Column, honorifics: Sequence[str] = vocab.HONORIFICS) -> Column:
    own = words(name)
    rest = F.filter(own, lambda w: ~F.regexp_replace(F.lower(w), r"\.+$", "").isin(*honorifics))
    return F.when(F.size(rest) > 0, F.array_join(rest, " ")).otherwise(name)


def is_non_character(name: Column, known: Sequence[str] = vocab.KNOWN_NON_CHARACTERS) -> Column:
    low = F.lower(name)
    return low.isin(*known) | F.arrays_overlap(words(low), F.array(*map(F.lit, known)))


def role(mentions: Column, dialogue: Column) -> Column:
    score = mentions + 2 * dialogue
    return F.when(score > 50, "protagonist").when(score > 20, "supporting").otherwise("minor")


def speaker_in(after: Column, before: Column, verbs: Sequence[str] = vocab.SPEECH_VERBS) -> Column:
    """The speaker named right after a quote, else at the end of what precedes it."""
    v, name = "|".join(verbs), vocab.NAME_PATTERN
    near = F.left(after, F.lit(150))
    pattern = rf"[,.]?\s*(?:(?:{v})\s+{name}|{name}\s+(?:{v}))"
    first = F.coalesce(F.nullif(F.regexp_extract(near, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(near, pattern, 2), F.lit("")))
    return F.coalesce(first, F.nullif(F.regexp_extract(F.right(before, F.lit(150)), rf"{name}\s+(?:{v})[,:]?\s*$", 1), F.lit("")))


def gender_by_name(name: Column, male: Sequence[str] = vocab.MALE_NAMES, female: Sequence[str] = vocab.FEMALE_NAMES) -> Column:
    first = F.lower(F.split_part(strip(name), F.lit(" "), F.lit(1)))
    return F.when(first.isin(*male), "male").when(first.isin(*female), "female")


def gender_by_pronouns(male_hits: Column, female_hits: Column) -> Column:
    total = male_hits + female_hits
    return F.when((total >= 2) & (male_hits / total > 0.6), "male").when((total >= 2) & (female_hits / total > 0.6), "female")


def title_from_html(html: Column, text: Column) -> Column:
    """First h1, else h2, else h3 with 1 to 199 characters; else a chapter heading in the opening."""

    def heading(tag: str) -> Column:
        inner = strip(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))
        return F.when((inner != "") & (F.char_length(inner) < 200), inner)

    chapter = strip(F.regexp_extract(F.left(text, F.lit(500)), r"(?i)chapter\s+(?:\d+|[ivxlc]+)(?:\s*[:\-.]\s*(.+))?", 0))
    return F.coalesce(heading("h1"), heading("h2"), heading("h3"), F.nullif(chapter, F.lit("")))


def plain_text(html: Column) -> Column:
    """Text of an HTML page by patterns: scripts, styles and navigation go, then all tags; spaces collapse."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b[^>]*>.*?</\1>", " ")
    return strip(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), SPACE, " "))


def title_from_file_name(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def safe_title(title: Column, job: Column) -> Column:
    """Letters, digits, space, - and _ only, 50 characters, then the job's first 8."""
    return F.concat(strip(F.left(F.regexp_replace(title, r"(?U)[^\p{L}\p{N} _-]", ""), F.lit(50))), F.lit("_"), F.left(job, F.lit(8)))


def segment_file(job: Column, chapter: Column, segment: Column) -> Column:
    return F.format_string("job_%s_ch%03d_seg%04d.wav", job, chapter, segment)


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def preview(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def json_array(response: Column) -> Column:
    """The JSON array in a model's answer: without a code fence, whole or its widest bracketed part; else null."""
    text = strip(response)
    fenced = F.regexp_replace(text, r"(?s)^```[^\n]*(?:\n|$)", "")
    text = F.when(text.startswith("```"), strip(F.regexp_replace(fenced, "```$", ""))).otherwise(text)
    inner = F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))
    is_list = lambda t: F.get_json_object(F.concat(F.lit('{"a":'), t, F.lit("}")), "$.a").startswith("[")
    whole = F.when(text.startswith("[") & F.json_array_length(text).isNotNull(), text)
    return F.coalesce(whole, F.when(F.json_array_length(inner).isNotNull() & is_list(inner), inner))


def prompt(names: Column, context: Column, sentences: Column) -> Column:
    """A question to a model about ``sentences`` (array of struct: text, is_dialogue)."""
    lines = F.transform(sentences, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.when(s["is_dialogue"], F.lit('] [DIALOGUE] "')).otherwise(F.lit('] [NARRATION] "')), s["text"], F.lit('"')))
    return F.concat_ws(
        "\n",
        F.when(F.size(names) > 0, F.concat(F.lit("Characters in this book: "), F.array_join(names, ", "))),
        F.when(context != "", F.concat(F.lit("Preceding context (for continuity, do NOT annotate these):\n"), context)),
        F.lit("Sentences to analyze:"),
        F.array_join(lines, "\n"),
        F.lit("\nRespond with a JSON array of objects, one per sentence. Each object must have keys: index, speaker, emotion, emphasis, pacing, vocal_direction."),
    )


def char_census(texts: DataFrame, text: str = "text", sample: int = 3000) -> DataFrame:
    """ch, code, name, n of the characters beyond ASCII in the opening of each text; names are looked up once a character."""

    @F.arrow_udf("string")
    def named(column: pa.Array) -> pa.Array:
        return pa.array([None if c is None else unicodedata.name(c, "UNKNOWN") for c in column.to_pylist()], pa.string())

    chars = texts.select(F.explode(F.split(F.left(text, F.lit(sample)), "")).alias("ch")).where("ch <> '' and octet_length(ch) > 1")
    code = F.conv(F.right(F.hex(F.encode("ch", "UTF-32")), F.lit(8)), 16, 10).cast("int")
    return chars.groupBy("ch").agg(F.count("*").alias("n")).select("ch", code.alias("code"), named("ch").alias("name"), "n")


def samples_of(text: Column, pattern: str = r"[\"“][^\"”“]+[\"”]", most: int = 5, sample: int = 3000) -> Column:
    """The first ``most`` matches in the opening of a text: a look at what dialogue is like there."""
    return F.slice(F.regexp_extract_all(F.left(text, F.lit(sample)), F.lit(pattern), 0), 1, most)


def or_else(a: Column, b: Column | str) -> Column:
    """``a`` unless it is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b if isinstance(b, Column) else F.lit(b))
