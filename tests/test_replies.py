from __future__ import annotations

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from textloom.operators import prompts, remote, replies


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_repaired_items(spark):
    cut = '[{"id": "id": "seg_0000", "text": "x"}, {"id": "seg_0001", "text": "y"}, {"id": "se'
    values = [cut, '[{"id": "a", "text": "b"}]', 'Here: [{"id": "a", "text": "b"},] done', "no json", "", None, '{"id": "a"}', "[]", '[{"id": "a"}]']
    got = [None if r is None else [(x.id, x.text) for x in r] for r in one(spark, values, replies.repaired_items)]
    assert got == [[("seg_0000", "x"), ("seg_0001", "y")], [("a", "b")], [("a", "b")], None, None, None, None, [], [("a", None)]]


def test_apply_replies(spark):
    seg = spark.createDataFrame([("t", "a", "old"), ("t", "b", "old"), ("t", "c", "old"), ("u", "a", "old")], "t string, id string, x string").selectExpr("*", "1 AS part_n")
    rep = spark.createDataFrame([("t", 1, '[{"id": "a", "text": "1"}, {"id": "zz", "text": "?"}]'), ("t", 2, '[{"id": "a", "text": "2"}, {"id": "b"}]'), ("u", 1, None)], "t string, o int, r string")
    got = rows(replies.apply_replies(seg, rep, "t", "id", "x", "r", "o"), "t", "id", "x")
    assert got == sorted([("t", "a", "2"), ("t", "b", None), ("t", "c", "old"), ("u", "a", "old")], key=repr)


def test_book_items_and_titles(spark):
    body = json.dumps([{"id": "c1", "html_content": '<h1 class="x">T <b>t</b></h1><p>a</p>', "injected_heading": True}])
    values = [f"text\n```json\n{body}\n```", f"so: {body}", body, "{broken", None]
    assert [None if r is None else [x.id for x in r] for r in one(spark, values, replies.book_items)] == [["c1"], ["c1"], ["c1"], None, None]
    df = spark.createDataFrame([(1, values[0])], "o int, r string")
    got = replies.chapter_replies(df, "r", "o").select("*", replies.take_injected_title(F.col("html"), F.col("injected")).alias("x")).first()
    assert got.x.title == "T t" and got.x.html == "<p>a</p>"
    heads = spark.createDataFrame([("b", 2, "late"), ("b", 1, "first"), ("c", 1, " ")], "chapter_id string, pos int, text string")
    ch = spark.createDataFrame([("a", "tt", "s"), ("b", "", "s"), ("c", None, "s"), ("d", None, None)], "id string, t string, s string")
    assert rows(replies.final_titles(ch, heads, "id", "t", "s")) == [("a", "tt"), ("b", "first"), ("c", "s"), ("d", None)]


def test_reassemble_patch_toc(spark):
    parts = spark.createDataFrame([("c", 10, "z"), ("c", 2, "b"), ("c", 0, "a"), ("c", 1, "[TRANSLATION_FAILED] x"), ("d", 0, None)], "c string, n int, x string")
    assert rows(replies.reassemble(parts, "c", "n", "x")) == [("c", 3, "abz")]
    blocks = spark.createDataFrame([("i", "old"), ("j", "old"), (None, "old")], "id string, c string")
    fixes = spark.createDataFrame([("i", "new"), ("k", "x"), (None, "y"), ("j", None)], "id string, c string")
    assert rows(replies.patch_blocks(blocks, fixes, "id", "c")) == sorted([("i", "new"), ("j", "old"), (None, "old")], key=repr)
    links = spark.createDataFrame([(1, "text/c1.html#x", "12 Old"), (1, "OEBPS/text/c2.html", "旧"), (1, "c9.html", "keep"), (2, "text/c1.html", "A Old"), (None, "c1.html", "other")], "book_id int, href string, text string")
    titles = spark.createDataFrame([(1, "text/c1.html", "Neu"), (1, "text/c2.html", "Zwei"), (1, "c9.html", None), (2, "c1.html", "Nova")], "book_id int, chapter_id string, title string")
    assert rows(replies.patch_toc(links, titles), "text") == [("12 Neu",), ("A Nova",), ("Zwei",), ("keep",), ("other",)]
    assert one(spark, ["zh-CN", "ja", "de"], lambda c: replies.target_title(F.lit("T"), c)) == ["【中文翻译】T", "【日本語訳】T", "[de] T"]


def test_error_classes(spark):
    values = ["aaaaa", "a" * 10, "我认为，" * 3, "我认为，" * 4, "[cannot translate]", "[short]", "", None, " 　", "[TRANSLATION_FAILED] no answer", "A good sentence."]
    assert one(spark, values, replies.is_repeated) == [False, True, False, True, True, False, False, False, False, False, False]
    assert one(spark, values, replies.error_class) == [None, "hard", None, "hard", "hard", None, "soft", "soft", "soft", "soft", None]


def test_fixes(spark):
    rep = spark.createDataFrame([("x [TRANSLATION_FAILED: chp1-blk2] y [TRANSLATION_FAILED: chp1-blk2][TRANSLATION_FAILED: chp9-blk9]",), (None,), ("good",)], "r string")
    blocks = spark.createDataFrame([("chp1-blk2", "a"), ("chp1-blk3", "b")], "mmg_id string, c string")
    assert rows(replies.fix_tasks(blocks, replies.failed_block_ids(rep, "r"))) == [("chp1-blk2", "a", "fix::chp1-blk2")]


def test_prompts(spark, tmp_path):
    df = spark.createDataFrame([("json_subtitle_batch", '[{"id": "{x}"}]'), ("other", "y"), ("fix_batch", None)], "k string, p string")
    got = {r[0]: r[1] for r in df.select("k", prompts.build_prompt(F.col("k"), F.col("p"), F.lit("en"), F.lit("de"), {"a": "b"})).collect()}
    assert got["json_subtitle_batch"].endswith('INPUT:\n[{"id": "{x}"}]') and '* "a": "b"' in got["json_subtitle_batch"] and '{"id": "seg_1"' in got["json_subtitle_batch"]
    assert got["other"] is None and got["fix_batch"].endswith("INPUT:")
    (tmp_path / "p.json").write_text(json.dumps({"json_batch_system_prompt": {"role": "system", "content": "S {source_lang}"}}))
    (tmp_path / "g.json").write_text(json.dumps({"a": "b", "c": 1}))
    assert prompts.load_templates(str(tmp_path / "p.json"))["json_batch_system_prompt"] == "S {source_lang}" and prompts.load_glossary(str(tmp_path / "g.json")) == {"a": "b"}
    assert prompts.glossary_section({}) == "" and df.select(prompts.role_messages(F.lit("s"), F.lit("u"), F.col("p"))).first()[0][1].content.startswith("u\n\n")
    assert df.select(prompts.messages(F.lit("x"))).first()[0][0].parts == ["x"]
    assert json.loads(df.select(prompts.segment_request(F.lit("[1]"), F.lit("en"), F.lit("de"))).first()[0])["segments"] == [1]
    values = {k: F.lit(k) for k in ("book_title", "source_lang", "target_lang", "tone_style", "writing_style", "task_list_json")}
    assert df.select(prompts.book_prompt(values)).first()[0].endswith("task_list_json")


class Counting:
    """Notes how many calls are open at once, in its log."""

    open = most = 0

    async def complete(self, prompt, task_id):
        import asyncio

        Counting.open += 1
        Counting.most = max(Counting.most, Counting.open)
        await asyncio.sleep(0.01)
        Counting.open -= 1
        if task_id == "bad":
            raise ValueError("no")
        return (None if task_id == "none" else prompt), str(Counting.most)


def test_map_remote(spark, tmp_path):
    tasks = spark.createDataFrame([(f"t{i}", f"p{i}") for i in range(30)] + [("bad", "p"), ("none", "p"), ("null", None), (None, "p")], "task_id string, prompt string")
    got = {r.task_id: r for r in remote.map_remote(tasks, Counting, concurrency=3, attempts=2, backoff=0.0, partitions=1).collect()}
    assert len(got) == 33 and all(got[f"t{i}"].translated_text == f"p{i}" for i in range(30)) and max(int(got[f"t{i}"].log) for i in range(30)) == 3
    assert all(got[k].translated_text.startswith(replies.FAILED) for k in ("bad", "none", "null"))
    with pytest.raises(ValueError):
        remote.provider("unknown")
    path = str(tmp_path / "results")
    first = rows(remote.map_once(tasks.limit(10), remote.provider("identity"), path))
    again = rows(remote.map_once(tasks.where("task_id LIKE 't%'"), remote.provider("identity"), path))
    assert len(first) == 10 and len(again) == 30 and spark.read.parquet(path).count() == 30


def test_providers():
    import asyncio

    run = lambda p, i="x": asyncio.run(p.complete('rules\nINPUT:\n[{"id": "a", "text": "lantern"}]', i))[0]
    assert run(remote.Identity()) == '[{"id": "a", "text": "lantern"}]' and "Laterne" in run(remote.Substituting({"lantern": "Laterne"}))
    kinds = set()
    for i in range(20):
        try:
            kinds.add(run(remote.Faulty(), chr(97 + i)))
        except remote.Transient:
            kinds.add("failing")
    assert len(kinds) == 6


def test_retry_rounds(spark):
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(["good one here", "", None, "a" * 20, "[TRANSLATION_FAILED] x"])], "t string, p int, x string")
    calls = []

    def fix(bad):
        calls.append({r.p: r.error_class for r in bad.collect()})
        return bad.where("p <> 3").select("t", "p", F.when(F.col("p") == 1, F.lit("")).otherwise("fixed").alias("x"))

    done, log = replies.retry_rounds(df, fix, ["t", "p"], "x", rounds=2)
    assert calls[0] == {1: "soft", 2: "soft", 3: "hard", 4: "soft"} and calls[1] == {1: "soft", 3: "hard"}
    assert log == [{"hard": 1, "soft": 3}, {"hard": 1, "soft": 1}, {"hard": 1, "soft": 1}]
    assert [r[2] for r in rows(done)] == ["good one here", "", "fixed", "a" * 20, "fixed"]
    same, log = replies.retry_rounds(df.where("p = 0"), fix, ["t", "p"], "x")
    assert log == [{"hard": 0, "soft": 0}] and same.count() == 1


def test_repetition_agrees_with_python():
    pattern = re.compile(r"(.{2,}?)\1{3,}", re.DOTALL)
    began = time.time()
    assert not pattern.search("The quick brown fox jumps over it. " * 2) and time.time() - began < 1
