"""Fixtures of the text operators, on inline rows with the default vocabularies."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chapters as C
from lectern.operators import characters as P
from lectern.operators import tables as T


def value(spark, column, **fields):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items())) if fields else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def chunks(spark, text, target, cap, rate=2.5):
    timed = spark.createDataFrame([(1, text)], "k int, t string").select("k", C.chunk_sentences(F.col("t"), rate).alias("s"))
    packed = timed.select("k", C.pack_chunks(F.col("s"), target, cap).alias("c"))
    return [r["x"] for r in C.exploded(packed, "k", C.split_oversize(F.col("c"), cap, rate), "at", "x").orderBy("at").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hello world. How are you? I am fine!", ["Hello world.", "How are you?", "I am fine!"]),
        ("Hello world", ["Hello world"]),
        ("Wait for it... And then it happened.", ["Wait for it...", "And then it happened."]),
        ('"I am." He left.', ['"I am.', "He left."]),
        ("", []),
        ("   ", []),
    ],
)
def test_sentences(spark, text, want):
    assert value(spark, X.sentences(F.col("t")), t=text) == want


def test_paragraphs_and_words(spark):
    assert value(spark, X.paragraphs(F.col("t")), t="First.\n\n\n Second.\n\n") == ["First.", "Second."]
    assert value(spark, X.word_count(F.col("t")), t=" a  b\nc ") == 3
    assert value(spark, X.duration(F.col("t")), t="a b c d e f g h i j") == 4.0
    assert value(spark, X.duration(F.col("t")), t="Hello") == 0.4
    assert value(spark, X.duration(F.col("t")), t="") == 0.3


def test_chunks(spark):
    one = chunks(spark, "This is a short sentence.", 12, 15)
    assert [c["text"] for c in one] == ["This is a short sentence."]
    many = chunks(spark, "Short. " * 50, 5, 8)
    assert all(c["text"].endswith(".") and c["seconds"] <= 8 + 1e-9 for c in many)
    long = chunks(spark, " ".join(f"One two three four five six seven eight{i}." for i in range(20)), 8, 10)
    assert len(long) >= 4 and sorted({i for c in long for i in c["indices"]}) == list(range(20))
    assert any(c["is_end"] for c in chunks(spark, "First paragraph is here now.\n\nSecond paragraph is here now.", 5, 8))
    assert chunks(spark, "", 12, 15) == []
    assert len(chunks(spark, " ".join(["a " * 16 + "b.", "c " * 16 + "d."]), 12, 15)) == 1


@pytest.mark.parametrize("text, want", [("The garage was quiet.", "angry"), ("tears of joy", "sad"), ("nothing", "neutral")])
def test_emotion(spark, text, want):
    assert value(spark, X.emotion(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("ABC DEF GHI now", "shouted"), ("ABC DEF now", "normal"), ("he Whispered it", "whispered"), ("a *bold* word", "emphasized")])
def test_emphasis(spark, text, want):
    assert value(spark, X.emphasis(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("Go! Now! Run!", "fast"), ("We must all go now please! Yes we must go right now! It is time to go now!", "urgent"), ("", "normal"), ("word " * 30, "slow")])
def test_pacing(spark, text, want):
    assert value(spark, X.pacing(F.col("t")), t=text) == want


def test_pace_first_rule_wins(spark):
    assert value(spark, X.pace(F.lit("slow"), F.lit("normal"), F.lit("fast"))) == 1.8
    assert value(spark, X.pace(F.lit("normal"), F.lit("normal"), F.lit("a rapid voice"))) == 3.2


def test_boilerplate(spark):
    b = lambda title, text: value(spark, X.is_boilerplate_chapter(F.col("a").cast("string"), F.col("t")), a=title, t=text)
    assert b("Contents", "x") and b(None, "produced by me; release date: now") and b(None, "\n".join(["short"] * 6))
    assert not b("Chapter 1", "A story.") and not b(None, "")
    assert value(spark, X.is_boilerplate_segment(F.col("t")), t=" by Someone ")


@pytest.mark.parametrize("raw, want", [("'Victor\"", "Victor"), ("he", None), ("Mr. Smith", "Mr. Smith"), ("accusations.--Poor William", None), ("Accused.--Poor William", None), ("Chapter", None), ("It", None), ("Anna.", "Anna")])
def test_clean_name(spark, raw, want):
    assert value(spark, X.clean_name(F.col("t")), t=raw) == want


def test_honorifics_and_speaker(spark):
    assert value(spark, X.strip_honorifics(F.col("t")), t="Dear old Mr. Frank") == "Frank"
    assert value(spark, X.strip_honorifics(F.col("t")), t="Sir") == "Sir"
    assert value(spark, X.speaker_in(F.lit(', said Victor Stone. "'), F.lit(""))) == "Victor Stone"
    assert value(spark, X.speaker_in(F.lit(" then left"), F.lit("and Anna replied, "))) == "Anna"


def test_json_array(spark):
    for text, want in (("```json\n[1, 2]\n```", "[1, 2]"), ("so: [3] ok", "[3]"), ("none", None), ('{"a": 1}', None)):
        assert value(spark, X.json_array(F.col("t")), t=text) == want


def test_titles(spark):
    assert value(spark, X.title_from_html(F.lit("<h1></h1><h2>T</h2>"), F.lit(""))) == "T"
    assert value(spark, X.title_from_html(F.lit("<p>x</p>"), F.lit("CHAPTER IV: Home"))) == "CHAPTER IV: Home"
    assert value(spark, X.title_from_file_name(F.lit("a/b/my_great-book.txt"))) == "My Great Book"


def test_chapters(spark):
    text = "Front matter\nChapter 1: One\n" + "a b c d e " * 60 + "\nChapter 2\n" + "f g h i j " * 60 + "\n***\nshort"
    rows = C.split_chapters(spark.createDataFrame([(1, text), (2, " no heads ")], "id int, text string"), "id").orderBy("id", "number").collect()
    assert [(r["id"], r["number"], r["title"]) for r in rows] == [(1, 1, "Chapter 1: One"), (1, 2, "Chapter 2"), (2, 1, None)] or [r["title"] for r in rows][:2] == ["Chapter 1: One", "Chapter 2"]
    assert rows[0]["text"].startswith("a b c") and rows[-1]["text"] == "no heads"


def test_dialogue(spark):
    text = '"Come in," said Anna. He came. “Sit down.” Bob replied.\n\nNo quotes here.'
    rows = C.dialogue_segments(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("paragraph", "at").collect()
    assert [(r["type"], r["text"], r["speaker"]) for r in rows] == [
        ("dialogue", "Come in,", "Anna"), ("narration", "said Anna. He came.", None), ("dialogue", "Sit down.", "Bob"), ("narration", "Bob replied.", None), ("narration", "No quotes here.", None),
    ]


def test_legacy_dialogue(spark):
    rows = C.legacy_dialogue(spark.createDataFrame([(1, 'He: "Hi" said Bob. "Yo" end "open'), (2, " plain ")], "id int, text string"), "id").orderBy("id", "at").collect()
    assert [(r["id"], r["type"], r["text"]) for r in rows] == [(1, "dialogue", "Hi"), (1, "dialogue", "Yo"), (1, "narration", '"open'), (2, "narration", "plain")]


def test_segments_absorb_first_turn(spark):
    def groups(rows):
        s = F.array(*(F.struct(F.lit(w).alias("words"), F.lit(d).alias("is_dialogue"), F.lit(who).alias("speaker"), F.lit(e).alias("emotion"), F.lit("normal").alias("emphasis"), F.lit(st).alias("starts")) for w, d, who, e, st in rows))
        return value(spark, C.group_segments(s))

    n = lambda e, st=False: (5, False, "Narrator", e, st)
    assert groups([n("neutral"), n("neutral"), n("sad"), n("sad")]) == [0, 0, 0, 0]
    assert groups([n("neutral"), n("sad"), n("happy")]) == [0, 0, 1]
    assert groups([n("neutral"), n("neutral", True)]) == [0, 1]
    assert groups([(3, True, "A", "x", False), (3, True, "A", "y", False), (3, True, "B", "y", False), n("neutral")]) == [0, 0, 1, 2]
    assert groups([n("neutral")] * 5) == [0, 0, 0, 0, 1]


def test_merge_cores():
    cores = [("victor", 9), ("victor stone", 5), ("stone", 4), ("alphonse stone", 3)]
    assert P.merge_cores(cores) == [0, 0, 0, 3]


def test_voices(spark):
    rows = spark.createDataFrame([(1, i, g) for i, g in enumerate(["male", "female", None, "male"])], "book int, id int, gender string")
    assert [r["voice"] for r in P.speakers(rows, "book", "id").orderBy("id").collect()] == ["Ryan", "Vivian", "Vivian", "Ryan"]


@pytest.mark.parametrize("available, total, kw, want", [(6, 8, {}, 1), (12, 16, {}, 1), (26, 32, {}, 8), (55, 64, {}, 12), (110, 128, {}, 12), (1, 4, {"least": 2}, 2), (200, 256, {"most": 6}, 6), (0, 16, {}, 1), (24, 24, {"model": 3.4}, 10)])
def test_batch_size(spark, available, total, kw, want):
    assert value(spark, T.batch_size(F.lit(float(available)), F.lit(float(total)), **kw)) == want


def test_jobs(spark):
    acts = [(1, i, a) for i, a in enumerate(["start", "finish", "pause"])] + [(2, i, a) for i, a in enumerate(["pause", "resume", "fail", "resume", "finish"])]
    rows = {r["job"]: (r["status"], r["resume_count"], r["rejected"]) for r in T.replay(spark.createDataFrame(acts, "job int, i int, a string"), "job", ["i"], "a").collect()}
    assert rows == {1: ("completed", 0, 1), 2: ("completed", 2, 0)}


def plain_dialogue(p, near, pattern):
    """(at, type, text, after, before) of a paragraph by matches over the whole of it."""
    import re

    out, end, k = [], 0, 0
    for k, m in enumerate(re.finditer(pattern, p)):
        out += [(2 * k, "narration", p[end : m.start()].strip()), (2 * k + 1, "dialogue", m.group()[1:-1].strip())]
        end = m.end()
    return [x for x in [*out, (2 * (k + 1) if out else 0, "narration", p[end:].strip())] if x[2]]


def test_dialogue_of_long_texts_equals_plain_matches_and_is_linear(spark):
    import random
    import time

    rng = random.Random(8)
    texts = ["".join(rng.choice(['"', "“", "”", "a", "Tom said ", " said Ann", ". ", '"b"', "x" * 160, ""]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in C.dialogue_segments(df, "k").orderBy("k", "paragraph", "at").collect():
        got.setdefault(r["k"], []).append((r["at"], r["type"], r["text"]))
    for k, t in enumerate(texts):
        assert got.get(k, []) == (plain_dialogue(t.strip(), 150, C.QUOTE) if t.strip() else []), t

    def seconds(n, run):
        one = spark.createDataFrame([(1, '"Yes." said Ann. ' * n)], "k int, text string")
        began = time.perf_counter()
        rows = run(one, "k").count()
        return rows, time.perf_counter() - began

    for run in (C.dialogue_segments, C.legacy_dialogue):
        seconds(100, run)
        rows, small = seconds(15_000, run)
        more, large = seconds(60_000, run)  # 1 MB
        assert more == 4 * rows and large < 10 * small + 2


def test_speakers_are_looked_for_across_neighbouring_quotes(spark):
    """The name stands after a short quote that follows, or before one that precedes, within 150 characters."""
    text = '"One" "a" "b" said Ann Bell. ' + "y" * 200 + ' Carl Stone said "c" "Two".'
    rows = C.dialogue_segments(spark.createDataFrame([(1, text)], "k int, text string"), "k").where("type = 'dialogue'").orderBy("at").collect()
    by = {r["text"]: r["speaker"] for r in rows}
    assert by["b"] == "Ann Bell" and by["c"] == "Carl Stone"
    old = C.legacy_dialogue(spark.createDataFrame([(1, '"" x "One" said Tom. "Two" "Three" open " end'), (2, "no quotes"), (3, None), (4, "")], "k int, text string"), "k").orderBy("k", "at").collect()
    # the first quote opens nothing that a match can close: it is told; matches run to the next quote
    assert [(r["at"], r["type"], r["text"]) for r in old if r["k"] == 1] == [(0, "narration", '"'), (1, "dialogue", "x"), (2, "dialogue", "said Tom."), (3, "dialogue", "open")]
    assert [r["text"] for r in old if r["k"] == 2] == ["no quotes"] and not [r for r in old if r["k"] == 3]
