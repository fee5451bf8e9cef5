from __future__ import annotations

import asyncio
import http.server
import io
import json
import re
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from textloom.logs import task_logger
from textloom.operators import remote
from textloom.plans import pipelines
from textloom.sinks import epub as epub_sink
from textloom.sinks import text as text_sink
from textloom.sources import epub, srt, transcripts
from textloom.streaming.srt_stream import stream_subtitles, write_stream

SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere.\r\n\r\nbroken\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000 X1:5\r\nWorld 3.5.\r\n\r\n3\r\nno time\r\nx\r\n"
VTT = "WEBVTT\n\nNOTE a note\n\n00:01.000 --> 00:02.000 align:start\nOne\n\ncue-2\n01:00:03.000 --> 01:00:04.000\nTwo\n"


def test_read_subtitles(spark, tmp_path):
    (tmp_path / "a b.srt").write_text(SRT, encoding="utf-8")
    (tmp_path / "empty.srt").write_text("")
    (tmp_path / "c.vtt").write_text(VTT)
    (tmp_path / "d.txt").write_text(SRT)
    got = rows(srt.read_subtitles(spark, str(tmp_path)), "title", "source_type", "pos", "start_s", "end_s", "text")
    assert got == sorted([("a b", "local_srt_file", 0, 1.0, 2.5, "Hello\nthere."), ("a b", "local_srt_file", 1, 3.0, 4.0, "World 3.5."), ("c", "local_srt_file", 0, 1.0, 2.0, "One"), ("c", "local_srt_file", 1, 3603.0, 3604.0, "Two")], key=repr)
    merged = rows(srt.read_merged_subtitles(spark, str(tmp_path)).where(F.col("track").contains("a%20b") | F.col("track").contains("a b")), "text")
    assert merged == [("Hello\nthere.",), ("World 3.5.",)]


def test_srt_is_stable(spark):
    df = spark.createDataFrame([("t", 0, 1.0, 2.5, "Hello\nthere."), ("t", 1, None, 3.0, "x"), ("t", 2, 3.0, 4.0, None), (None, 0, 1.0, 2.0, "x"), ("t", 3, 5.0, 6.0, "World.")], "t string, p long, s double, e double, x string")
    text = text_sink.srt_texts(df, "t", "p", "s", "e", "x").first().text
    assert text == "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere.\n\n3\n00:00:03,000 --> 00:00:04,000\n\n\n4\n00:00:05,000 --> 00:00:06,000\nWorld.\n"
    cues = spark.createDataFrame([(text,)], "x string").select(F.explode(srt.parse_srt(F.col("x"))).alias("c")).select("c.*")
    assert [r.text for r in cues.collect()][-1] == "World."
    assert rows(text_sink.srt_texts(df.limit(0), "t", "p", "s", "e", "x")) == []


def test_blocks_of_entries(spark, monkeypatch):
    monkeypatch.setattr(text_sink, "BLOCK", 3)
    df = spark.createDataFrame([("t", i * 2, float(i), i + 0.5, f"x{i}") for i in range(11)], "t string, p long, s double, e double, x string")
    text = text_sink.srt_texts(df, "t", "p", "s", "e", "x").first().text
    assert [b.split("\n")[0] for b in text.strip().split("\n\n")] == [str(i + 1) for i in range(11)] and text.strip().endswith("x10")


def test_markdown(spark):
    df = spark.createDataFrame([("t", 0, 1.0, 0.5, 1.5, "a\\nb", "c ")], "t string, p long, s double, d double, e double, x string, y string")
    tracks = spark.createDataFrame([("t", "en", "manual", "de"), ("u", None, None, "de")], "t string, l string, k string, g string")
    assert text_sink.transcript_markdown(df, tracks, "t", "p", "s", "d", "x", "l", "k").first().text.endswith("## 00:00:01,000 --> 00:00:01,500\na\\nb\n")
    got = {r.track: r.text for r in text_sink.bilingual_markdown(df, tracks, "t", "p", "s", "e", "x", "y", "l", "k", "g").collect()}
    assert "原文: a b\n译文: c\n" in got["t"] and "未找到" in got["u"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("Ä title", "x"), (None, "y")], "title string, text string").withColumn("path", text_sink.subtitle_path(F.col("title"), F.lit("de")))
    text_sink.write_files(df, str(tmp_path))
    assert (tmp_path / "title" / "subtitle" / "title_de.srt").read_text() == "x" and (tmp_path / "untitled" / "subtitle" / "untitled_de.srt").exists()
    logs = spark.createDataFrame([('{"a": 1}',), (None,)], "log string")
    text_sink.write_logs(logs, str(tmp_path / "logs"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "logs")).collect()] == [{"a": 1}]


def book():
    chapters = [
        {"chapter_id": "text/c1.xhtml", "title": "One", "title_target": "Eins", "css": "p {}", "content": json.dumps([{"type": "heading", "level": 1, "content_source": "One"}, {"type": "paragraph", "content_rich_source": ["a & b"]}])},
        {"chapter_id": "text/c2.xhtml", "title": None, "content": None},
    ]
    resources = [{"href": "css/s.css", "media_type": "text/css", "content": b"p {}"}, {"href": "img/c.png", "media_type": "image/png", "content": b"\x89PNG"}]
    meta = {"title": "T <1>", "title_target": "[de] T", "authors": ["A", "B"], "language": "en", "language_target": "de", "publisher": "P", "isbn": "123", "cover": "img/c.png", "key": "k"}
    return meta, chapters, resources


def test_epub_round_trip():
    data = epub_sink.build_epub(*book())
    assert data == epub_sink.build_epub(*book())
    first = zipfile.ZipFile(io.BytesIO(data)).infolist()[0]
    assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
    got = epub.parse_epub(data, "k")
    assert got.metadata["title"] == "[de] T" and got.metadata["authors"] == ["A", "B"] and got.metadata["isbn"] == "123" and got.metadata["cover"] == "images/c.png" and got.metadata["language"] == "de"
    assert [(c["title"], c["css"]) for c in got.chapters] == [("Eins", "p {}"), (None, None)]
    blocks = json.loads(got.chapters[0]["content"])
    assert [b["type"] for b in blocks] == ["heading", "paragraph"] and blocks[1]["content_source"] == "a & b"
    assert {r["href"] for r in got.resources} == {"styles/s.css", "images/c.png"}


def test_epub_ncx_and_broken():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", epub_sink.container_xml("O/p.opf"))
        z.writestr("O/p.opf", '<package xmlns:dc="d"><metadata><dc:title> T </dc:title><dc:identifier>urn:isbn:99</dc:identifier></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.html" media-type="application/xhtml+xml"/><item id="gone" href="gone.html" media-type="x"/><item id="bad"/></manifest><spine><itemref idref="a"/><itemref idref="gone"/></spine></package>')
        z.writestr("O/toc.ncx", '<ncx><navMap><navPoint><navLabel><text>First</text></navLabel><content src="a.html#x"/></navPoint><navPoint><navLabel><text>Last</text></navLabel><content src="a.html"/></navPoint></navMap></ncx>')
        z.writestr("O/a.html", "<html><body><div><p>x<p>y</div></body></html>")
    got = epub.parse_epub(out.getvalue())
    assert got.metadata["isbn"] == "99" and got.metadata["title"] == "T" and [c["title"] for c in got.chapters] == ["Last"]
    assert epub.parse_epub(b"no zip").chapters == [] and epub.parse_epub(b"").metadata == {}


def test_epub_frames(spark, tmp_path):
    meta, chapters, resources = book()
    (tmp_path / "b.epub").write_bytes(epub_sink.build_epub(meta, chapters, resources))
    (tmp_path / "x.epub").write_bytes(b"broken")
    assert {r.title for r in epub.read_epubs(spark, str(tmp_path), "books").collect()} == {"[de] T", None}
    assert rows(epub.read_epubs(spark, str(tmp_path), "chapters"), "chapter_pos", "title") == [(0, "Eins"), (1, None)]
    assert rows(epub.read_epubs(spark, str(tmp_path), "resources"), "href") == [("images/c.png",), ("styles/s.css",)]
    books = spark.createDataFrame([(1, "T", ["A"], "en"), (2, None, None, None)], "id long, title string, authors array<string>, language string")
    ch = spark.createDataFrame([(1, 1, "b.html", None, "[]"), (1, 0, "a.html", "A", None)], "id long, chapter_pos int, chapter_id string, title string, content string")
    files = {r.id: epub.parse_epub(bytes(r.epub)) for r in epub_sink.build_epubs(books, ch, None, "id").collect()}
    assert [c["chapter_id"] for c in files[1].chapters] == ["text/a.html", "text/b.html"] and files[2].chapters == []
    path = books.limit(1).select(epub_sink.epub_path(F.col("title"), F.lit("zh-CN"))).first()[0]
    assert path == "epub_translated/T_zh_CN.epub"


def test_transcripts(spark, tmp_path):
    cand = spark.createDataFrame([("v", "de", False, 1), ("v", "en", True, 2), ("v", "en", False, 3), ("w", "fr", True, 1), ("w", "de", False, 2), ("w", "es", False, 3), ("x", None, None, 1), (None, "en", False, 1)], "v string, l string, g boolean, o int")
    assert rows(transcripts.best_transcripts(cand, "v", "l", "g", "o")) == [("v", "en", "manual"), ("w", "de", "manual"), ("x", None, "generated")]
    (tmp_path / "a.json").write_text(json.dumps([{"text": "hi", "start": 1.0, "duration": 0.5}]))
    spark.dataSource.register(transcripts.TranscriptSource)
    got = spark.read.format("transcripts").option("videos", "a,missing").option("folder", str(tmp_path)).load()
    assert rows(got) == [("a", 0, 1.0, 0.5, "hi")]
    tries = []

    def failing(video):
        tries.append(video)
        raise OSError

    assert transcripts.fetch(failing, "v", delay=0.0) == [] and len(tries) == 3


def test_pipelines(spark):
    data = [("t", i, i * 2.0, i * 2.0 + 2, None, f"Sentence number {i} has a lantern.") for i in range(12)] + [("t", 3, 6.0, 8.0, None, "Sentence number 3 has a lantern."), ("u", 0, 0.0, 1.0, None, "One.")]
    df = spark.createDataFrame(data, "track_id string, pos long, start_s double, end_s double, duration_s double, text string")
    run = pipelines.run_subtitles(df, remote.provider("substituting", glossary={"lantern": "Laterne"}), "en", "de", limit=100, backoff=0.0)
    assert run.segments.count() == 13 and run.errors.count() == 0 and run.rounds == [{"hard": 0, "soft": 0}]
    files = {r.track: r.text for r in run.files.collect()}
    assert set(files) == {"t", "u"} and "Laterne" in files["t"] and "lantern" not in files["t"]
    bad = pipelines.run_subtitles(df, remote.provider("faulty"), "en", "de", limit=100, rounds=1, attempts=1, backoff=0.0)
    assert len(bad.rounds) >= 1 and bad.errors.count() == bad.rounds[-1]["soft"] + bad.rounds[-1]["hard"]
    merged = pipelines.run_subtitles(df, remote.provider("identity"), "en", "de", merge_rows=True, rounds=1, backoff=0.0)
    assert merged.segments.count() == 13
    none = pipelines.run_subtitles(df.limit(0), remote.provider("identity"), "en", "de", rounds=1)
    assert none.segments.count() == 0 and rows(none.files) == []
    assert rows(pipelines.run_stages(df, lambda d: d.where("pos = 0"), lambda d: d.select("track_id"))) == [("t",), ("u",)]


def test_book_pipeline(spark):
    p = lambda x: {"type": "paragraph", "content_rich_source": [x]}
    data = [(1, 0, "a.html", "Title A", json.dumps([p("lantern " * 5)])), (1, 1, "b.html", None, json.dumps([p("word " * 60), p("lantern " * 60)])), (1, 2, "c.html", "C", None)]
    df = spark.createDataFrame(data, "book_id long, chapter_pos int, chapter_id string, title string, content string")
    got = {r.chapter_id: r for r in pipelines.run_books(df, remote.provider("substituting", glossary={"lantern": "Laterne"}), "en", "de", limit=100, backoff=0.0).collect()}
    assert got["a.html"].title_target == "Title A" and "Laterne" in got["a.html"].html and "<h1>" not in got["a.html"].html
    assert got["b.html"].html.count("<p>") == 2 and "Laterne" in got["b.html"].html and set(got) == {"a.html", "b.html"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text(SRT, encoding="utf-8")
    for _ in range(2):
        q = write_stream(stream_subtitles(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        (tmp_path / "in" / "b.srt").write_text(SRT, encoding="utf-8")
    assert rows(spark.read.parquet(str(tmp_path / "out")), "track_id", "pos") == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_merged_positions_of_long_runs(spark):
    """A run of more than 4,096 sentences, then more runs: each sentence has a position of its own, in order."""
    words = "word " * 48
    data = [("t", i, 20.0 * i, 20.0 * i + 19.0, 19.0, f"{words}n{i}") for i in range(4200)]
    data += [("t", i, 20.0 * i, 20.0 * i + 1.0, 1.0, f"Sentence {i}.") for i in range(4200, 4203)]
    data += [("u", i, 20.0 * i, 20.0 * i + 1.0, 1.0, f"Sentence {i}.") for i in range(2100)]
    df = spark.createDataFrame(data, "track_id string, pos long, start_s double, end_s double, duration_s double, text string")
    got = pipelines.model_segments(df, merge_rows=True).where("track_id = 't'").orderBy("start_s").collect()
    assert len(got) > 4150 and [r.pos for r in got] == list(range(len(got))) and [r.source_text for r in got[-2:]] == ["Sentence 4201.", "Sentence 4202."]
    other = pipelines.model_segments(df, merge_rows=True).where("track_id = 'u'").orderBy("pos").collect()
    assert [(r.pos, r.source_text) for r in other] == [(i, f"Sentence {i}.") for i in range(2100)]
    assert sorted(r.id for r in got)[:2] == ["seg_0000", "seg_0001"] and len({r.id for r in got}) == len(got)


def test_contents(spark):
    df = spark.createDataFrame([("nav.xhtml", "toc", None), ("c1.xhtml", "toc", "One"), ("c1.xhtml", None, "Contents"), (None, None, None)], "c string, n string, t string")
    assert [r[0] for r in df.select(epub.is_contents(F.col("c"), F.col("n"), F.col("t"))).collect()] == [True, False, True, False]


def test_ass(spark):
    text = "[Events]\nFormat: Layer, Start\nDialogue: 0,0:00:05.00,0:00:06.50,Default,,0,0,0,,{\\i1}Two, really\\Nlines\nDialogue: 0,0:00:01.20,0:00:02.00,Default,,0,0,0,,One\nDialogue: broken\nComment: 0,0:00:01.20,0:00:02.00,Default,,0,0,0,,No\n"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(srt.parse_ass(F.col("t")).alias("c")).collect()
    assert [tuple(c) for c in got[0].c] == [(1.2, 2.0, "One"), (5.0, 6.5, "Two, really\nlines")] and not got[1].c and got[2].c == []


class Marking:
    """Leaves out the second block of the first chapter of a batch; knows the terms of a glossary."""

    def __init__(self, mends=True):
        self.mends = mends

    async def complete(self, prompt, task_id):
        text = remote.payload_of(prompt).replace("lantern", "Laterne")
        if not task_id.startswith("fix::"):
            return re.sub(r'(data-mmg-id=\\?"chp0-blk1\\?">)[^<]*<', r"\1[TRANSLATION_FAILED: chp0-blk1]<", text), None
        return (text if self.mends else "[TRANSLATION_FAILED: chp0-blk1]"), None


class Never:
    async def complete(self, prompt, task_id):
        raise AssertionError("a paid call")


def page_of(*paragraphs, title=None):
    blocks = [{"type": "heading", "level": 1, "content_source": title}] if title else []
    return json.dumps(blocks + [{"type": "paragraph", "content_rich_source": p if isinstance(p, list) else [p]} for p in paragraphs])


def test_books_from_file_to_file(spark, tmp_path):
    link = {"type": "hyperlink", "href": "c1.xhtml", "content": [{"type": "text", "content": "1 Old"}]}
    chapters = [
        {"chapter_id": "c1.xhtml", "title": "The lantern", "content": page_of("A lantern.", "No lantern.", title="The lantern"), "css": None},
        {"chapter_id": "c2.xhtml", "title": "Second", "content": page_of("Some words.", "A lantern " * 200), "css": None},
        {"chapter_id": "toc.xhtml", "title": "Contents", "content": page_of([link]), "css": None},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(epub_sink.build_epub({"title": "My Book", "authors": ["A"], "language": "en"}, chapters, [{"href": "s.css", "media_type": "text/css", "content": b"p {}"}]))
    options = {"limit": 300, "backoff": 0.0, "results": str(tmp_path / "results")}

    def read():
        return epub.parse_epub((tmp_path / "out" / "epub_translated" / "My_Book_de.epub".replace("My_Book", "My Book")).read_bytes())

    run = pipelines.translate_path(spark, str(tmp_path / "in" / "b.epub"), str(tmp_path / "out"), Marking, "en", "de", **options)
    got = read()
    assert got.metadata["title"] == "[de] My Book" and got.metadata["language"] == "de" and len(got.resources) == 1 and run.errors.count() == 0
    assert [c["title"] for c in got.chapters] == ["The Laterne", "Second", "Contents"]
    texts = [json.dumps(json.loads(c["content"]), ensure_ascii=False) for c in got.chapters]
    assert "No Laterne." in texts[0] and "FAILED" not in texts[0] and texts[1].count("Laterne") >= 200 and "lantern" not in texts[1]
    assert "1 The Laterne" in texts[2] and "Old" not in texts[2]
    pipelines.translate_path(spark, str(tmp_path / "in" / "b.epub"), str(tmp_path / "out"), Never, "en", "de", **options)
    assert [c["content"] for c in read().chapters] == [c["content"] for c in got.chapters]


def test_blocks_that_still_fail_are_errors(spark):
    blocks = spark.createDataFrame([("1/0", 0, "chp0-blk0", "good"), ("1/0", 1, "chp0-blk1", "[TRANSLATION_FAILED: chp0-blk1]"), ("2/0", 0, "chp0-blk1", "other")], "k_ string, block_no int, mmg_id string, block string")
    sources = spark.createDataFrame([(k, f"chp0-blk{n}", f"<p>lantern {k}</p>") for k in ("1/0", "2/0") for n in (0, 1)], "k_ string, mmg_id string, html string")
    for make, kept, wrong in ((Marking, ["good", "Laterne 1/0", "other"], 0), (lambda: Marking(False), ["good", "[TRANSLATION_FAILED", "other"], 1)):
        fixed, errors = pipelines._repaired(blocks, sources, make, "en", "de", None, None, backoff=0.0)
        assert errors.count() == wrong
        assert all(k in b for k, b in zip(kept, [r.block for r in fixed.orderBy("k_", "block_no").collect()], strict=True))


def test_subtitles_from_file_to_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a film.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nA lantern\n\n2\n00:00:02,000 --> 00:00:03,000\nstands here.\n", encoding="utf-8")
    options = {"backoff": 0.0, "results": str(tmp_path / "results")}
    make = remote.provider("substituting", glossary={"lantern": "Laterne"})
    for own in (make, Never):
        pipelines.translate_path(spark, str(tmp_path / "in" / "a film.srt"), str(tmp_path / "out"), own, "en", "de", **options)
        text = (tmp_path / "out" / "a film" / "subtitle" / "a film_de.srt").read_text(encoding="utf-8")
        assert text == "1\n00:00:01,000 --> 00:00:02,917\nA Laterne stands here.\n"
    (tmp_path / "v1.json").write_text(json.dumps([{"text": "A lantern", "start": 0.0, "duration": 1.0}, {"text": "stands here.", "start": 1.0, "duration": 1.0}]))
    pipelines.translate_path(spark, "https://youtu.be/v1", str(tmp_path / "out"), make, "en", "de", transcripts=str(tmp_path), backoff=0.0)
    assert "A Laterne stands here." in (tmp_path / "out" / "v1" / "subtitle" / "v1_de.srt").read_text(encoding="utf-8")
    for path in ("x.txt", "https://youtu.be/v1"):
        with pytest.raises(ValueError):
            pipelines.translate_path(spark, path, str(tmp_path / "out"), make, "en", "de")


def test_http_provider(spark, monkeypatch):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body["messages"][0]["content"]))
            status = 503 if len(seen) == 1 else 400 if "bad" in seen[-1][1] else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"text": body["messages"][0]["content"].upper()}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("A_KEY", "k")
    make = remote.provider("http", url=f"http://127.0.0.1:{server.server_port}/", body={"messages": [{"role": "user", "content": "{prompt}"}]}, answer="choices/0/text", key_variable="A_KEY", timeout=5.0)
    gate = asyncio.run(_calls(make(), ["one", "bad"]))
    assert gate[0][0] == "ONE" and gate[1][0].startswith("[TRANSLATION_FAILED]") and seen[0] == ("Bearer k", "one") and len(seen) == 3
    server.shutdown()
    server.server_close()
    assert asyncio.run(_calls(make(), ["one"]))[0][0].startswith("[TRANSLATION_FAILED]")
    with pytest.raises(ValueError):
        remote.Http("http://x", {}, "a", "NO_SUCH_KEY")


async def _calls(model, prompts):
    return [await remote._call(model, asyncio.Semaphore(1), p, "t", 2, 0.0, 5.0) for p in prompts]


def test_logger(tmp_path):
    for _ in range(2):
        logger = task_logger("x.y", str(tmp_path / "a" / "log.txt"), console_level=50)
        logger.debug("said")
    assert (tmp_path / "a" / "log.txt").read_text().count("said") == 2 and len(logger.handlers) == 2
