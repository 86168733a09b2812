"""Characters: hand-worked rows, and plain versions of the order-dependent rules on random and on table rows."""

import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import vocab
from lectern.operators import backends as B
from lectern.operators import characters as P
from lectern.plans import api, registry, table_queries
from lectern.scratch import materialise
from lectern.sources import books as K

from . import oracle

SF = "/root/testdata/sf0.001"


def plain_groups(cores):
    """Seeds in order; each absorbs, pass after pass over all cores, until a pass absorbs none."""
    words = [set(c.split()) for c in cores]
    group = [-1] * len(cores)
    for seed in range(len(cores)):
        if group[seed] >= 0:
            continue
        group[seed], own, changed = seed, set(words[seed]), True
        while changed:
            changed = False
            for i, other in enumerate(words):
                if group[i] < 0 and any(len(w) >= 3 for w in own & other) and (len(other) == 1 or other <= own or own <= other):
                    group[i], changed = seed, True
                    own |= other
    return group


def test_merge_cores_is_greedy():
    cores = ["victor frankenstein", "clerval", "victor", "frankenstein", "henry clerval", "alphonse frankenstein", "alphonse", "ab"]
    # frankenstein goes to victor's group; alphonse frankenstein shares a word with it but neither word set holds the other
    assert P.merge_cores([(c, 1) for c in cores]) == [0, 1, 0, 0, 1, 5, 5, 7] == plain_groups(cores)
    rng = random.Random(5)
    for _ in range(400):
        cores = list(dict.fromkeys(" ".join(rng.sample(["ann", "bob", "carl", "dora", "eve", "fay", "of", "x"], rng.randrange(1, 4))) for _ in range(rng.randrange(1, 14))))
        assert P.merge_cores([(c, 1) for c in cores]) == plain_groups(cores), cores


def test_merge_cores_of_many_names():
    """Candidates are found by their words: thousands of names take no time."""
    import time

    rng = random.Random(2)
    cores = [(f"first{rng.randrange(3000)} last{i}", 1) for i in range(20_000)]
    began = time.perf_counter()
    P.merge_cores(cores)
    assert time.perf_counter() - began < 5


def plain_characters(counts, titles):
    """canonical -> (n, first chapter, aliases) by the rules, names in the order they were first seen."""
    bare = lambda name: " ".join(r) if (r := [w for w in name.split() if w.lower().rstrip(".") not in titles]) else name
    cores = {}
    for name, n, _ in counts:
        cores.setdefault(bare(name).lower(), []).append(name)
    by = {name: (n, ch) for name, n, ch in counts}
    order = sorted(cores, key=lambda c: -sum(by[x][0] for x in cores[c]))
    group = plain_groups(order)
    seen = {name: i for i, (name, _, _) in enumerate(counts)}
    out, names = {}, {}
    for seed in dict.fromkeys(group):
        forms = [x for i, c in enumerate(order) if group[i] == seed for x in cores[c]]
        best = min(forms, key=lambda x: (-len(bare(x)), -by[x][0], seen[x]))
        out[bare(best)] = (sum(by[x][0] for x in forms), min(by[x][1] for x in forms), sorted(set(forms) - {bare(best)}))
        names |= {x: order[seed] for x in forms}
    return out, names


@pytest.fixture(scope="module")
def mentioned(spark):
    """source -> (name, count, first chapter) in the order of first mention, for sf0.001."""
    found = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        for raw in re.findall(vocab.NAME_PATTERN, r["text"], re.ASCII):
            low = raw.lower()
            if not (len(raw) <= 2 and low in vocab.SHORT_WORDS) and not set(low.split()) & set(vocab.STOP_NAMES):
                n, ch = found.setdefault(r["source"], {}).get(raw, (0, r["doc_id"]))
                found[r["source"]][raw] = (n + 1, ch)
    return {s: [(name, *v) for name, v in own.items()] for s, own in found.items()}


def test_name_groups_of_the_tables(spark, mentioned):
    got = {(r["source"], r["name"]): r["grp"] for r in registry.queries()["n4_name_groups"](spark, SF).collect()}
    want = {(s, name): g for s, own in mentioned.items() for name, g in plain_characters(own, table_queries._TITLES)[1].items()}
    assert got == want and len(set(want.values())) < len(want)


def test_characters_of_the_tables(spark, mentioned):
    got = {(r["source"], r["canonical"]): (r["n"], r["first_chapter"], r["aliases"]) for r in registry.queries()["n5_characters"](spark, SF).collect()}
    want = {(s, c): (n, ch, ",".join(a)) for s, own in mentioned.items() for c, (n, ch, a) in plain_characters(own, table_queries._TITLES)[0].items()}
    assert got == want


def test_character_table_of_the_tables(spark, mentioned):
    """Non-persons first, then merging, then the top 30 and three mentions; no quotes with speakers in these tables."""
    rows = registry.queries()["n6_character_table"](spark, SF).collect()
    got = {(r["source"], r["name"]): (r["rank"], r["n"], r["dialogue"], r["role"], r["first_chapter"]) for r in rows}
    want = {}
    for s, own in mentioned.items():
        places = {name.lower() for name, _, _ in own if name in table_queries._PLACES}
        people = [x for x in own if x[0] not in table_queries._PLACES and not (x[1] < 20 and x[0].lower() in places) and not set(x[0].lower().split()) & set(vocab.KNOWN_NON_CHARACTERS)]
        merged = plain_characters(people, vocab.HONORIFICS)[0]
        for rank, (name, (n, ch, _)) in enumerate(sorted(merged.items(), key=lambda x: -x[1][0])[:30], 1):
            if n >= 3:
                want[s, name] = (rank, n, 0, "protagonist" if n > 50 else "supporting" if n > 20 else "minor", ch)
    assert got == want and all(r["voice"] in ("Ryan", "Aiden", "Vivian", "Serena") for r in rows)


BOOK = [
    (1, 1, "Victor Frankenstein met Clerval. “Good day,” said Clerval. He smiled. “Are you well?” asked Dearest Clerval.\n\nVictor said, “I am.” Victor laughed. Mr. Stranger nodded."),
    (1, 2, "Henry Clerval wrote. Justine Moritz wept; she was sad. Justine Moritz said: “I am innocent.” Alphonse Frankenstein came. Paris was far. Victor Frankenstein left. Justine Moritz slept."),
    (1, 3, "Clerval and Victor spoke. “No,” Nobody said. “Yes,” said Victor Frankenstein."),
]


def recogniser():
    names = ["Dearest Clerval", "Victor Frankenstein", "Alphonse Frankenstein", "Henry Clerval", "Justine Moritz", "Clerval", "Victor", "Paris", "Geneva"]
    pattern = re.compile("|".join(names))
    return lambda text: [(m.group(), "GPE" if m.group() in ("Paris", "Geneva") else "PERSON") for m in pattern.finditer(text)]


def test_character_table(spark):
    """Worked by hand: forms merge before the count of three, honorifics go, quotes are counted once."""
    rows = P.character_table(spark.createDataFrame(BOOK, "book int, chapter int, text string"), "book", "chapter", load=recogniser).orderBy("rank").collect()
    got = [(r["name"], r["n"], r["dialogue"], r["gender"], r["first_chapter"], r["aliases"]) for r in rows]
    assert got == [
        ("Victor Frankenstein", 6, 3, "male", 1, ["Victor"]),
        ("Henry Clerval", 5, 2, "male", 1, ["Clerval", "Dearest Clerval"]),
        ("Justine Moritz", 3, 1, "female", 2, []),
    ]
    assert [r["role"] for r in rows] == ["minor"] * 3


def test_attribution_falls_to_a_later_pattern(spark):
    """At one start the first pattern names nobody known; the second does, and counts."""
    text = '"Go," said Unknown Fellow. "Stay," Anna Bell said.'
    texts = spark.createDataFrame([(1, text)], "k int, text string")
    names = spark.createDataFrame([(1, "Anna Bell", 0, "Anna Bell", None)], "k int, id string, ord int, name string, aliases array<string>")
    found = P.attributions(texts, "k")
    assert {(r["start"], r["pattern"], r["speaker"]) for r in found.collect()} >= {(0, 0, "Unknown Fellow"), (27, 1, "Anna Bell")}
    both = found.unionByName(spark.createDataFrame([(1, 0, 1, "Anna")], found.schema))
    assert P.dialogue_counts(both, names, ["k"], ["k"]).collect()[0]["dialogue"] == 2


def test_resolve(spark):
    names = spark.createDataFrame([(1, 10, 0, "Victor Hugo", ["Vic"]), (1, 11, 1, "Hugo Boss", ["Hugo"]), (1, 12, 2, "Al Li", None)], "b int, id int, ord int, name string, aliases array<string>")
    said = [("Victor", 10), ("Mr. Hugo", 11), ("vic", 10), ("old Boss", 11), ("Al", None), ("Al Li", 12), ("Nobody Hugo", 11), (None, None)]
    got = P.resolve(spark.createDataFrame([(1, s) for s, _ in said], "b int, speaker string"), names, ["b"]).collect()
    assert {r["speaker"]: r["character"] for r in got} == dict(said)


def test_gender_needs_two_hits(spark):
    rows = spark.createDataFrame([("Zed", "Zed ran and he fell. He saw Zed."), ("Zed", "Zed ran."), ("Zed", "she saw Zed and she left Zed; her Zed"), ("Mary", "Mary he he")], "n string, t string")
    assert [r["g"] for r in rows.select(P.gender(F.col("n"), F.col("t")).alias("g")).collect()] == ["male", None, "female", "female"]


def test_opening_of_a_book(spark):
    """Pronouns beyond the opening of the whole book are not counted, wherever chapters end."""
    chapters = spark.createDataFrame([(1, 1, "Zed he. " + "x" * 92), (1, 2, "Zed he. " * 5), (1, 3, "he " * 1000)], "b int, c int, text string")
    names = spark.createDataFrame([(1, "Zed")], "b int, canonical string")
    count = lambda n: P.near_pronouns(chapters, names, "b", "c", sample=n).first()["male"]
    assert count(100) == 1 and count(110) == 2


def test_profiles(spark):
    rows = spark.createDataFrame([(1, 1, "protagonist", "male", None, None), (1, 2, "supporting", "female", "child", 5), (1, 3, "minor", None, "elderly", None)], "b int, o int, role string, gender string, age string, voice_profile_id int")
    new = P.voice_profiles(rows, "b", "o").orderBy("o").collect()
    assert [(r["seed"], r["temperature"], r["speaking_rate"], r["pitch_shift"]) for r in new] == [(42, 0.6, 1.0, -2.0), (43, 0.7, 1.0, 2.0), (44, 0.7, 1.0, 0.0)]
    trait = P.trait_profiles(rows, "b", "o").orderBy("o").collect()
    assert [(r["o"], r["seed"], r["temperature"], r["speaking_rate"]) for r in trait] == [(1, 42, 0.6, 1.0), (3, 44, 0.7, 0.9)]


def test_similarity(spark):
    rows = [("One, two three!", "one two three"), ("a b c d", "a x c d"), (None, "x"), ("it's so", "its so"), ("w " * 300, "w " * 300)]
    got = B.with_similarity(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    tidy = lambda t: re.sub(r"[^\w\s']", " ", (t or "").lower()).split()
    assert [r["similarity"] for r in got] == [SequenceMatcher(None, tidy(a), tidy(b)).ratio() if tidy(a) else 1.0 for a, b in rows]
    assert [r["similarity"] for r in got][:4] == [1.0, 0.75, 1.0, 0.5]


def test_similarity_of_the_tables(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn", "text").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    want = sorted((c, t, round(B.similarity(x, own[i - 1][1] if i else None), 9)) for c, own in turns.items() for i, (t, x) in enumerate(own))
    assert sorted(map(tuple, registry.queries()["t27_similarity"](spark, SF).collect())) == want


def test_pages_of_the_tables(spark):
    """The parser in tasks gives what it gives alone; every block's text is in the page, nested blocks' twice."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = registry.queries()["a7_html_parsed"](spark, SF).collect()
    assert {r["page_id"]: (r["title"], r["text"]) for r in rows} == {i: (K.page_title(h), K.page_text(h)) for i, h in pages.items()}
    for r in rows:
        first = re.search(r"(?s)<p\b[^>]*>([^<&]+)</p>", pages[r["page_id"]])
        assert first is None or " ".join(first.group(1).split()) in r["text"]
        assert "<script" not in r["text"]
    nested = K.html_pages(spark.createDataFrame([(1, "<div><p>one  two</p><script>no</script><h2>T</h2></div>")], "k int, html string"), "k").first()
    assert (nested["title"], nested["text"]) == ("T", "one two T\n\none two\n\nT")


def test_annotator(spark):
    """Windows of 4 with an overlap of 1; one fails, and what an earlier window said stays."""
    rows = spark.createDataFrame([(1, i, f"s{i}") for i in range(9)], "ch int, i int, text string")

    def load():
        def ask(window, context, names):
            if window[0]["at"] == 3:
                raise RuntimeError("no answer")
            return [{"speaker": names[0], "emotion": f"{context or '-'}|{s['text']}"} for s in window[:3]]

        return ask

    got = B.annotate(rows, "ch", "i", load, ["Anna"], 4, 1).orderBy("i").collect()
    assert [r["speaker"] for r in got] == ["Anna"] * 3 + ["Narrator"] * 3 + ["Narrator"] + ["Anna"] * 2
    assert got[0]["emotion"] == "-|s0" and got[3]["emotion"] == "neutral" and got[4]["vocal_direction"] == "clear, steady narration"
    assert got[8]["emotion"] == "s1 s2 s3 s4 s5|s8" and got[0]["pacing"] == "normal"


def test_cancelled_work(spark):
    from lectern.operators import tables as T

    rows = spark.createDataFrame([(1, i, i == 5) for i in range(40)] + [(2, i, False) for i in range(3)], "j int, i int, stop boolean")
    done = T.until_cancelled(rows, "j", ["i"], F.col("stop"), 4).groupBy("j").count().collect()
    assert {r["j"]: r["count"] for r in done} == {1: 8, 2: 3}


def test_cancel_tagged(spark):
    """A tagged job that runs for long is stopped; others go on."""
    import threading
    import time

    from lectern.streaming import jobs as J

    sc, ended = spark.sparkContext, []

    def work():
        sc.addJobTag("job-1")
        try:
            sc.range(0, 4, numSlices=4).map(lambda _: time.sleep(60)).count()
        except Exception as e:  # noqa: BLE001
            ended.append(e)

    t = threading.Thread(target=work)
    t.start()
    began = time.time()
    while not ended and time.time() - began < 20:
        time.sleep(0.5)
        J.cancel_tagged(spark, "job-1")
    t.join(20)
    assert ended and spark.range(3).count() == 3


@pytest.fixture(scope="module")
def db(spark):
    return {
        "books": spark.createDataFrame([(1, "A", None, None, None, "a.txt", "txt", 9, False, False, 0, 0), (2, "B", None, None, None, "b.txt", "txt", 9, True, False, 1, 2)], "id int, title string, author string, language string, file_path string, original_filename string, format string, file_size_bytes long, is_parsed boolean, is_analyzed boolean, total_chapters long, total_words long"),
        "chapters": spark.createDataFrame([(1, 2, 1, "old", "Old text.", 2, False, False, False, None)], "id int, book_id int, number int, title string, raw_text string, word_count int, is_boilerplate boolean, skip_generation boolean, is_generated boolean, audio_path string"),
        "characters": spark.createDataFrame([(7, 2, "Zoe", [], "minor", None, 1, 1)], "id int, book_id int, name string, aliases array<string>, role string, inferred_gender string, dialogue_count long, first_appearance_chapter int"),
        "segments": spark.createDataFrame([(1, 1, 0, "Old text.", "narration", 7, 7, True)], "id int, chapter_id int, sequence_number int, text string, segment_type string, character_id int, detected_character_id int, is_generated boolean"),
        "generation_jobs": spark.createDataFrame([("j1", 2, "failed", 0.0, 1, True, "wav", None, "broken", None, None, None)], "job_id string, book_id int, status string, progress double, resume_count int, is_auto_mode boolean, output_format string, config_json string, error_message string, created_at timestamp, resumed_at timestamp, completed_at timestamp"),
        "voice_profiles": spark.createDataFrame([(5, "v", None), (6, "w", None)], "id int, name string, reference_audio_path string"),
    }


def test_upload_parse_analyze(spark, db, tmp_path):
    """A book from its bytes to its segments, and again: nothing doubles."""
    body = "\n\n".join(t for _, _, t in BOOK)
    content = ("Chapter 1\n\n" + body + "\n\nChapter 2\n\n" + body + "\n\nChapter 3: License\n\n" + "short line\n" * 30).encode()
    files = spark.createDataFrame([("/up/my_new-book.txt", len(content), content), ("/up/x.exe", 1, b"x")], "path string, length long, content binary")
    books = api.upload_books(db, files, str(tmp_path / "store"))
    new = books.where("id = 3").first()
    assert books.count() == 3 and (new["title"], new["format"], new["file_size_bytes"], new["is_parsed"]) == ("My New Book", "txt", len(content), False)
    assert open(new["file_path"], "rb").read() == content
    now = db | {"books": books}
    stored = K.read_files(spark, new["file_path"])
    for _ in range(2):
        now |= api.parse_book(now, 3, stored)
    parsed = now["chapters"].where("book_id = 3").orderBy("number").collect()
    assert [(r["title"], r["skip_generation"]) for r in parsed] == [("Chapter 1", False), ("Chapter 2", False), ("Chapter 3: License", True)] and len({r["id"] for r in parsed}) == 3
    book = now["books"].where("id = 3").first()
    assert (book["is_parsed"], book["total_chapters"], book["total_words"]) == (True, 3, sum(r["word_count"] for r in parsed)) and now["chapters"].count() == 4
    now = {k: materialise(v) for k, v in now.items()}
    now |= {k: materialise(v) for k, v in api.analyze_book(now, 3, load=recogniser).items()}
    people = {r["name"]: r for r in now["characters"].where("book_id = 3").collect()}
    assert sorted(people) == ["Henry Clerval", "Justine Moritz", "Victor Frankenstein"]
    assert people["Victor Frankenstein"]["dialogue_count"] == 6 and now["characters"].where("book_id = 2").count() == 1
    segments = now["segments"].join(now["chapters"].where("book_id = 3").select(F.col("id").alias("chapter_id"), "raw_text"), "chapter_id").orderBy("chapter_id", "sequence_number").collect()
    text = {}
    for r in segments:
        text.setdefault((r["chapter_id"], r["raw_text"]), []).append((r["sequence_number"], r["text"]))
    for (_, raw), own in text.items():
        assert [n for n, _ in own] == list(range(len(own))) and "".join(" ".join(t for _, t in own).split()) == "".join(raw.split())
    assert {r["segment_type"] for r in segments} == {"dialogue", "narration"} and now["segments"].where("text = 'Old text.'").count() == 1
    assert now["books"].where("id = 3").first()["is_analyzed"]

    def annotator():
        return lambda window, context, names: [{"speaker": "Dearest Clerval" if "Good day" in s["text"] else None} for s in window]

    spoken = {k: materialise(v) for k, v in api.analyze_book(now, 3, load=recogniser, annotator=annotator).items()}
    assert spoken["characters"].count() == now["characters"].count() and spoken["segments"].where("text = 'Old text.'").count() == 1
    ids = {r["id"] for r in spoken["characters"].where("name = 'Henry Clerval' and book_id = 3").collect()}
    assert {r["character_id"] for r in spoken["segments"].where("character_id is not null and text like '%Good day%'").collect()} == ids
    with pytest.raises(ValueError):
        api.parse_book({**db, "books": db["books"].withColumn("format", F.lit("pdf"))}, 1, stored)
    with pytest.raises(LookupError):
        api.parse_book(db, 99, stored)


def test_jobs_and_sounds(spark, db, tmp_path):
    jobs = api.create_job(db, 2, "j9", config={"speed": 1})
    new = jobs.where("job_id = 'j9'").first()
    assert (new["status"], new["resume_count"], json.loads(new["config_json"])) == ("pending", 0, {"speed": 1}) and new["created_at"] is not None
    with pytest.raises(ValueError):
        api.create_job(db, 1, "j9")
    with pytest.raises(LookupError):
        api.create_job(db, 99, "j9")
    again = api.act_on_job(db, "j1", "resume").first()
    assert (again["status"], again["resume_count"], again["error_message"]) == ("generating", 2, None) and again["resumed_at"] is not None and again["completed_at"] is None
    stopped = api.act_on_job({"generation_jobs": jobs}, "j9", "cancel").where("job_id = 'j9'").first()
    assert stopped["status"] == "cancelled" and stopped["completed_at"] is not None
    files = spark.createDataFrame([("/up/v.wav", 3, b"abc")], "path string, length long, content binary")
    voices = {r["id"]: r["reference_audio_path"] for r in api.reference_audio(db, 5, files, str(tmp_path)).collect()}
    assert voices[6] is None and open(voices[5], "rb").read() == b"abc"
    made = api.regenerate_segment(db, 1)
    assert not made["segments"].first()["is_generated"] and made["sound"].count() == 1


def test_long_chapter_sound(spark):
    """Other rates are resampled, missing chapters skipped, silence stands between, a book without sound is an error."""
    rows = [(1, 1, [1.0] * 10, 10), (1, 2, None, 10), (1, 3, [0.5] * 20, 20), (2, 1, None, 10)]
    got = {r["b"]: r for r in B.concatenate_chapters(spark.createDataFrame(rows, "b int, o int, s array<double>, r int"), "b", "o", "s", rate="r", to=10, silence_ms=1000, fade_ms=500).collect()}
    assert got[1]["samples"] == pytest.approx([1.0] * 10 + [0.0] * 5 + [0.0, 0.125, 0.25, 0.375, 0.5] + [0.5] * 5) and got[1]["error"] is None
    assert got[2]["samples"] is None and got[2]["error"] == "no chapter has sound"


def test_census(spark):
    got = {r["ch"]: (r["code"], r["name"], r["n"]) for r in X.char_census(spark.createDataFrame([("é“a”é",), (None,)], "text string")).collect()}
    assert got == {"é": (233, "LATIN SMALL LETTER E WITH ACUTE", 2), "“": (8220, "LEFT DOUBLE QUOTATION MARK", 1), "”": (8221, "RIGHT DOUBLE QUOTATION MARK", 1)}


def test_pronouns_near_names_equal_patterns():
    """Positions that meet give what four patterns with windows find."""
    rng = random.Random(11)
    for case in range(300):
        words = [rng.choice(["Ann", "Annan", "he", "Him", "his", "she", "her", "hers", "the", "x" * rng.randint(1, 40), "\n", "there", "é"]) for _ in range(rng.randint(0, 60))]
        text = rng.choice([" ", "", "-"]).join(words)
        names, window = ["Ann", "ann an", "Annan", "é"], rng.choice([0, 5, 30, 300])
        want = []
        for n in map(re.escape, names):
            want.append([sum(len(re.findall(p, text, re.I | re.S)) for p in (rf"{n}.{{0,{window}}}\b(?:{own})\b", rf"\b(?:{own})\b.{{0,{window}}}{n}")) for own in ("he|him|his", "she|her|hers")])
        assert P.near_counts(names, text, P.PRONOUNS, window) == want, (case, text)


def test_pronouns_in_long_texts_take_no_time():
    import time

    text = "the man said he saw the hers " * 17_000
    began = time.perf_counter()
    P.near_counts(["the", "man", "nobody"], text, P.PRONOUNS)
    assert time.perf_counter() - began < 3


def test_related_names_are_components(spark):
    """Cores meet through words of three letters only, within their book, over any number of steps."""
    from lectern.operators.graphs import components

    cores = [(1, f"n{i:03} n{i + 1:03}") for i in range(40)] + [(1, "al li"), (1, "li al x"), (2, "n000 zed"), (2, "zed"), (2, "al")]
    got = {}
    for r in P.related(spark.createDataFrame(cores, "book int, core string").repartition(7), "book").collect():
        got.setdefault(r["part"], set()).add((r["book"], r["core"]))
    assert sorted(map(len, got.values())) == [1, 1, 1, 2, 40]
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    plain = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(plain[a], plain[b])
            changed |= plain[a] != low or plain[b] != low
            plain[a] = plain[b] = low
    assert labels == plain
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_common_items_equal_the_sequence_matcher():
    from lectern.functions.sequences import common_items

    rng = random.Random(9)
    for case in range(600):
        letters = "ab" if case % 3 else "abcdefghij"
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 30 if case % 5 else 320))] for _ in range(2))
        if case % 7 == 0:
            b = a[: len(a) // 2] + b + a[len(a) // 2 :]
        want = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert common_items(a, b) == want, (a, b)


def test_common_items_of_long_sequences_take_no_time():
    import time

    from lectern.functions.sequences import common_items

    rng = random.Random(3)
    a = [rng.randrange(3000) for _ in range(20_000)]
    b = [x if rng.random() > 0.05 else rng.randrange(3000) for x in a]
    began = time.process_time()
    n = common_items(a, b)
    assert n > 17_000 and time.process_time() - began < 20
    began = time.process_time()
    assert common_items(["a", "b"] * 90, ["b", "a"] * 90) == 179
    assert common_items(list(range(20_000)), list(range(20_000))) == 20_000 and time.process_time() - began < 5


def test_parts_of_a_book_join_to_its_sound(spark):
    """Running sums place chapters where the one array has them; no part is longer than a piece."""
    rng = random.Random(6)
    rows = [(b, i, None if rng.random() < 0.2 else [rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 3, 40, 95]))], rng.choice([10, 20, 7])) for b in range(6) for i in range(8)] + [(9, 1, None, 10)]
    df = spark.createDataFrame(rows, "b int, i int, x array<double>, r int")
    for fade, piece in ((500, 7), (0, 1000), (1000, 13)):
        parts = {}
        for r in B.chapter_parts(df, "b", "i", "x", "r", 10, 1000, fade, piece).orderBy("b", "start").collect():
            own = parts.setdefault(r["b"], [])
            assert r["start"] == len(own) and 0 < len(r["samples"]) <= piece
            own.extend(r["samples"])
        whole = {r["b"]: r["samples"] for r in B.concatenate_chapters(df, "b", "i", "x", "r", 10, 1000, fade).collect() if r["samples"]}
        assert parts.keys() == whole.keys() and all(parts[b] == pytest.approx(whole[b], abs=1e-12) for b in whole)
    with pytest.raises(ValueError, match="silence"):
        B.chapter_parts(df, "b", "i", "x", "r", 10, 100, 500)


def test_tagged_names_as_the_sql_drops_them(spark, tmp_path):
    """Known places are dropped by the operator, and by n2_persons; the SQL of j3_non_persons leaves them."""
    import duckdb

    texts = [(1, "s", "We saw Thonon and Mont Blanc. The end. Victor slept."), (2, "s", "Victor met Turk Ali. That was all."), (3, "t", "The Rhine. " + "And so. " * 20)]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/region.parquet").write.parquet(f"{tmp_path}/region.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("j3_non_persons", "n2_persons"):
        assert oracle.compare(spark, con, str(tmp_path), registry.queries()[name], registry.oracles()[name]) == ""
    kept = {r["name"] for r in registry.queries()["j3_non_persons"](spark, str(tmp_path)).collect()}
    assert {"Thonon", "Mont Blanc", "Turk Ali", "The Rhine", "And"} <= kept and not kept & {"The", "That"}
    counts = table_queries._names(docs)
    assert {r["name"] for r in P.drop_non_persons(counts, spark.createDataFrame([("we",)], "name_lower string")).collect()} == {"Victor", "The", "That", "And"}


def test_first_of_equal_windows_is_the_first_of_the_files(spark, tmp_path):
    import duckdb

    rows = [(1, k, 1, "ANR"[(k + i) % 3], "OF"[i // 3]) for i in range(5) for k in range(40)] + [(None, k, 1, "R", "O") for k in (3, 50, 51)] + [(9, 60, n, None, None) for n in (2, 1)]
    kind = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    for n, own in enumerate((rows[:110], rows[110:])):
        spark.createDataFrame(own[::-1], kind).coalesce(1).write.mode("append" if n else "overwrite").parquet(f"{tmp_path}/parts/{n}")
    (tmp_path / "lineitem.parquet").mkdir()
    for n in (1, 0):  # the later rows lie in the first file
        next((tmp_path / f"parts/{1 - n}").glob("*.parquet")).rename(tmp_path / f"lineitem.parquet/part-{n}.parquet")
    spark.createDataFrame([(k,) for k in range(70)], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect(config={"threads": 1})
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    query, sql = registry.queries()["w3_first_window_wins"], registry.oracles()["w3_first_window_wins"]
    assert oracle.compare(spark, con, str(tmp_path), query, sql) == ""
