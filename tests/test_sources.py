"""Readers, back-ends, streams and endpoint functions on small inputs."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import audio as S
from lectern.operators import backends as B
from lectern.plans import api
from lectern.sources import books as K
from lectern.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def epub(path, title="A Book"):
    page = "<html><body><nav>menu</nav><div><h1>Chapter 1</h1><p>First paragraph of text &amp; more words.</p><p>Second one, long enough to stay.</p></div><script>x()</script></body></html>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>Me</dc:creator></metadata><manifest><item href="a.xhtml" media-type="application/xhtml+xml"/><item href="b.xhtml" media-type="application/xhtml+xml"/></manifest></package>')
        z.writestr("OEBPS/a.xhtml", page)
        z.writestr("OEBPS/b.xhtml", "<p>short</p>")


def test_epub_and_txt(spark, tmp_path):
    epub(tmp_path / "one.epub")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "t.txt").write_bytes("Chapter 1\r\n".encode() + b"word \xff " * 60)
    rows = K.read_epub(spark, str(tmp_path)).collect()
    assert [(r["book_title"], r["author"], r["language"], r["item"], r["title"]) for r in rows] == [("A Book", "Me", None, 0, "Chapter 1")]
    # the div that holds the paragraphs gives their text first, then each gives its own
    assert rows[0]["text"].split("\n\n")[1:] == ["Chapter 1", "First paragraph of text & more words.", "Second one, long enough to stay."]
    txt = K.parse_books(spark, str(tmp_path), "txt").collect()
    assert [(r["number"], r["title"]) for r in txt] == [(1, "Chapter 1")] and "\r" not in txt[0]["text"]
    assert K.parse_books(spark, str(tmp_path), "epub").count() == 1
    with pytest.raises(ValueError):
        K.parse_books(spark, str(tmp_path), "pdf")
    assert K.register_uploads(K.read_files(spark, str(tmp_path), "*.epub")).where("format = 'epub'").count() == 2


def test_html():
    assert K.page_text("<p>a<p>b") == "a\n\nb"
    assert K.page_text("plain <b>text</b>") == "plain text"
    assert K.page_title("<h1></h1><h2>Two</h2>") == "Two"


def test_wav(spark, tmp_path):
    x = 0.5 * np.sin(np.arange(2400) / 10)
    df = spark.createDataFrame([("a_seg1.wav", x.tolist())], "name string, samples array<double>")
    content = K.to_wav(df, "name", "samples", 24000).first()["content"]
    (tmp_path / "a_seg1.wav").write_bytes(bytes(content))
    (tmp_path / "b.wav").write_bytes(bytes(content))
    back = K.read_wav(spark, str(tmp_path)).first()
    assert back["rate"] == 24000 and np.allclose(back["samples"], x, atol=1e-4)
    assert K.sound_files(K.read_files(spark, str(tmp_path))).count() == 1


def test_config():
    c = K.load_config({"chunking": {"max_chunk_seconds": "15"}, "other": {}}, {"SERVER_PORT": "9"})
    assert c.chunking.max_chunk_seconds == 15.0 and c.server.port == 9 and c.audio.sample_rate == 24000
    pytest.importorskip("yaml")
    c = K.load_config("server:\n  port: 81\ntts:\n  engine: x\n  y:\n    default_top_k: 7\nresources:\n  batch_size: 4\nlogging:\n  level: DEBUG\nother: 1\n", {"LOG_LEVEL": "ERROR", "TTS_ENGINE": ""})
    assert (c.server.port, c.tts.engine, c.tts.default_top_k, c.resources.override("batch_size"), c.resources.override("engine_pool_size"), c.logging.level) == (81, "x", 7, 4, None, "ERROR")


def test_splice_matches_plain(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.1, 60), rng.normal(0, 0.2, 80)

    def loud(x):
        r = np.sqrt(np.mean(x**2))
        return np.clip(x * 10 ** ((-16 - 20 * np.log10(r + 1e-10)) / 20), -1, 1)

    t = np.linspace(0, np.pi / 2, 10)
    left, right = np.concatenate([loud(a), np.zeros(50)]), loud(b)
    want = np.concatenate([left[:-10], left[-10:] * np.cos(t) ** 2 + right[:10] * np.sin(t) ** 2, right[10:]])
    part = lambda x, end: F.struct(F.array(*map(F.lit, x.tolist())).alias("samples"), F.lit(end).alias("is_end"), F.lit(100).alias("fade_ms"))
    got = spark.range(1).select(S.splice(F.array(part(a, True), part(b, False)), 100).alias("x")).first()["x"]
    assert np.allclose(got, want)
    none = spark.range(1).select(S.splice(F.array().cast("array<struct<samples:array<double>,is_end:boolean,fade_ms:int>>"), 100).alias("x")).first()["x"]
    assert none == []


def test_quality_checks(spark):
    quiet = [0.0] * 4000
    loud = [0.5, -0.5] * 1000
    row = spark.createDataFrame([(quiet, loud + quiet)], "a array<double>, b array<double>").select(S.silence_report(F.col("a"), 1000).alias("ra"), S.silence_report(F.col("b"), 1000).alias("rb"), S.rms_normalise(F.col("a"), 0.5).alias("n")).first()
    assert row["ra"]["silent"] and row["ra"]["ratio"] == 1.0
    assert abs(row["rb"]["longest_s"] - 4.0) < 1e-9 and not row["rb"]["silent"] and row["n"] == quiet


def test_backends(spark):
    assert B.similarity("", "x") == 1.0 and B.similarity("a b c", "a b c!") == 1.0
    df = spark.createDataFrame([(1, "five words are in here", "Ryan", 42), (2, "", "Ryan", 42)], "id int, text string, voice string, seed int")
    sizes = {r["id"]: r["samples"] and len(r["samples"]) for r in B.synthesise(df, "text", "voice", "seed").collect()}
    assert sizes == {1: 48000, 2: None}
    rows = spark.createDataFrame([(1, i, f"s{i}") for i in range(20)], "k int, i int, t string")
    wins = B.context_windows(rows, "k", "i", "t").groupBy("win").agg(F.min("at").alias("a"), F.count("*").alias("n")).orderBy("win").collect()
    assert [(r["a"], r["n"]) for r in wins] == [(0, 12), (9, 11), (18, 2)]
    tries = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, False), (2, 1, False)], "k int, i int, ok boolean")
    assert {r["k"]: r["i"] for r in B.retried(tries, ["k"], F.col("ok"), "i").collect()} == {1: 1, 2: 1}
    parts = spark.createDataFrame([(1, 1, [1.0] * 10), (1, 2, []), (1, 3, [1.0] * 10)], "b int, o int, s array<double>")
    assert len(B.concatenate_chapters(parts, "b", "o", "s", rate=10, to=10, silence_ms=1000, fade_ms=500).first()["samples"]) == 25


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = J.events_stream(spark, str(tmp_path / "in"), events.schema, 10)
    q = J.sampled_peaks(stream).writeStream.outputMode("complete").format("memory").queryName("peaks").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.max("value").alias("p")).count()
    assert spark.table("peaks").count() == want
    acts = J.events_stream(spark, str(tmp_path / "in"), events.schema, 10).withColumn("action", F.when(F.col("event_type") == "view", "start").otherwise("pause"))
    q = J.job_states(acts, "user_id", "ts", "action").writeStream.outputMode("update").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("states").select("job").distinct().count() == events.select("user_id").distinct().count()


def test_next_status_agrees(spark):
    pairs = [(s, a) for s in ("pending", "generating", "paused", "failed", "cancelled", "completed") for a in ("start", "finish", "fail", "pause", "resume", "cancel")]
    rows = spark.createDataFrame(pairs, "s string, a string").select("s", "a", J.status_transition(F.col("s"), F.col("a")).alias("to")).collect()
    assert all(J.next_status(r["s"], r["a"]) == r["to"] for r in rows)


@pytest.fixture(scope="module")
def db(spark):
    return {
        "books": spark.createDataFrame([(1, "A", 1), (2, "B", 2)], "id int, title string, created_at int"),
        "chapters": spark.createDataFrame([(1, 1, 1, "c1", 50, True, "x.wav"), (2, 1, 2, "c2", 50, True, None), (3, 2, 1, "c3", 50, False, None)], "id int, book_id int, number int, title string, word_count int, is_generated boolean, audio_path string"),
        "segments": spark.createDataFrame([(i, 1 + i // 4, f"Text {i}. More.", i, i < 5, None, 7, 8) for i in range(12)], "id int, chapter_id int, text string, sequence_number int, is_generated boolean, audio_path string, character_id int, detected_character_id int"),
        "characters": spark.createDataFrame([(7, 1, "Anna", "minor", 3, 5), (8, 1, "Bob", "minor", 9, None)], "id int, book_id int, name string, role string, dialogue_count int, voice_profile_id int"),
        "voice_profiles": spark.createDataFrame([(5, "v", 0.7)], "id int, name string, temperature double"),
        "generation_jobs": spark.createDataFrame([("j1", 1, "generating", 0, None, 1, None, None, None), ("j2", 1, "completed", 0, None, 2, "o.wav", None, None)], "job_id string, book_id int, status string, resume_count int, error_message string, created_at int, output_path string, resumed_at timestamp, completed_at timestamp"),
    }


def test_endpoints(spark, db):
    assert [r["id"] for r in api.list_books(db).collect()] == [2, 1]
    assert [c["number"] for c in api.get_book(db, 1).first()["chapters"]] == [1, 2]
    left = api.delete_book(db, 1)
    assert {k: v.count() for k, v in left.items()} == {"books": 1, "chapters": 1, "segments": 4, "characters": 0, "generation_jobs": 0}
    assert [r["name"] for r in api.list_characters(db, 1).collect()] == ["Bob", "Anna"]
    assert api.dramatis_personae(db, 1).first()["total"] == 2
    paused = {r["job_id"]: r["status"] for r in api.act_on_job(db, "j1", "pause").collect()}
    assert paused == {"j1": "paused", "j2": "completed"}
    assert api.act_on_job(db, "j2", "pause").where("job_id = 'j2'").first()["status"] == "completed"
    assert api.download(db, "j2").count() == 1 and api.download(db, "j1").count() == 0
    seg = api.list_segments(db, 1).first()
    assert (seg["character_name"], seg["detected_character_name"]) == ("Anna", "Bob")
    p = api.resume_progress(db, 1).first()
    assert (p["total"], p["done"], p["skippable"]) == (8, 5, [1])
    gone = api.delete_voice_profile(db, 5)
    assert gone["voice_profiles"].count() == 0 and gone["characters"].where("voice_profile_id is not null").count() == 0
    new = api.create_voice_profile(db, spark.createDataFrame([("w", 0.6)], "name string, temperature double"))
    assert sorted(r["id"] for r in new.collect()) == [5, 6]
    patch = spark.createDataFrame([(7, {"name": "Ann", "voice_profile_id": None})], "id int, changes map<string,string>")
    changed = api.update_character(db | {"characters": db["characters"].withColumn("description", F.lit("d"))}, patch).where("id = 7").first()
    assert (changed["name"], changed["voice_profile_id"], changed["description"]) == ("Ann", None, "d")
    assert api.preview_segment(db, 3).count() >= 1
    assert len(api.list_jobs(db, 0).collect()) == 2


def test_headings_by_a_table_function(spark):
    from lectern.operators import chapters as C
    from lectern.sources import table_functions

    texts = [(1, "Chapter 1: One\n" + "a " * 150 + "\nPART II\nx\n3. Three\n" + "b " * 120 + "\n***\n"), (2, None), (3, ""), (4, "no heading"), (5, "é\nChapter V\n")]
    df = spark.createDataFrame(texts, "k int, text string")
    table_functions.register(spark)
    df.createOrReplaceTempView("books_of_headings")
    got = sorted(map(tuple, spark.sql("select k, h.start, h.title from books_of_headings, lateral chapter_headings(text) h").collect()))
    kept = C.exploded(C.headings(df, "k"), "k", C.keep_apart(F.col("found")), "at", "h").select("k", "h.start", "h.title")
    assert got == sorted(map(tuple, kept.collect())) and {k for k, _, _ in got} == {1, 5}
