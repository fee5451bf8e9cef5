from __future__ import annotations

import random

from tests.conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import batching, display, merge


def test_merge_run_golden():
    one = lambda t: [x[0] for x in merge.merge_run([(t, 0.0, 5.0)])]
    assert one("Pi is 3.14. Dr. Who left! Why") == ["Pi is 3.14.", "Dr. Who left!", "Why"]
    assert one("Wait ... what?? Ok.") == ["Wait... what?? Ok."]
    assert one('He said "Hi." Then left.') == ['He said "Hi.', "Then left."]
    assert one("好。。。再见。") == ["好...再见。"]
    assert merge.merge_run([]) == []


def test_merge_exact_times_are_inside_their_rows():
    out = merge.merge_run([("Costs 3.5 now.", 0.0, 14.0), ("Then more.", 20.0, 30.0)])
    assert [t for t, _, _ in out] == ["Costs 3.5 now.", "Then more."]
    assert out[0][1] == 0.0 and out[0][2] == 13.0 and out[1][1] == 20.0


def test_merge_splits_long_text():
    out = merge.merge_run([("word, " * 80, 0.0, 10.0)])
    assert all(len(t) <= 250 for t, _, _ in out) and "".join(t.replace(" ", "") for t, _, _ in out) == "word," * 80


def test_merge_frame_equals_one_run(spark):
    rnd = random.Random(3)
    data = []
    for track in ("a", "b"):
        t = 0.0
        for pos in range(60):
            text = " ".join(rnd.choice(["one", "two", "3.5", "Dr. Who", "end.", "what?", "so,", "wait..."]) for _ in range(rnd.randrange(0, 7)))
            data.append((track, pos, t, t + 1.0, None, text or None))
            t += 1.5
    df = spark.createDataFrame(data, "t string, p long, s double, e double, d double, x string")
    got = merge.merge_sentences(df, "t", "p", "x", "s", "e", "d").orderBy("track", "run", "no").collect()
    for track in ("a", "b"):
        whole = merge.merge_run([(x, s, e) for t, _, s, e, _, x in data if t == track and x])
        own = [(r.text, r.start_s, r.end_s) for r in got if r.track == track]
        assert [w[0] for w in whole] == [o[0] for o in own]
        assert all(abs(w[1] - o[1]) < 1e-6 and abs(w[2] - o[2]) < 1e-6 for w, o in zip(whole, own, strict=True))
    assert rows(merge.merge_sentences(df.limit(0), "t", "p", "x", "s", "e", "d")) == []


def test_offsets_carry_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(merge, "BLOCK", 3)
    data = [("a", p, None if p in (4, 7) else float(p), None if p == 5 else p + 0.5, None, f"text {p}" if p != 6 else "") for p in range(10)]
    df = spark.createDataFrame(data, "t string, p long, s double, e double, d double, x string")
    got = {r.pos: (r.offset, r.start_s) for r in merge.segment_offsets(df, "t", "p", "x", "s", "e", "d").collect()}
    assert got[3] == (21, 3.0) and got[4] == (28, 3.5) and got[7] == (42, 6.5) and 6 not in got
    ids = {r.p: r.id for r in merge.segment_ids(df, "t", "p").collect()}
    assert ids[0] == "seg_0000" and ids[9] == "seg_0009"


def fold(sizes, limit):
    held, n, out = None, 1, []
    for s in sizes:
        if held is not None and held + s > limit:
            n, held = n + 1, None
        held = (held or 0) + s
        out.append(n)
    return out


def test_greedy_batches(spark):
    rnd = random.Random(1)
    groups = {g: [rnd.choice([0, 1, 2, 5, 9, 30]) for _ in range(rnd.randrange(1, 120))] for g in "abc"} | {"d": [5, 4, 3, 9, 1, 1], "e": [20, 1, 20], "f": [5, 5, 5]}
    df = spark.createDataFrame([(g, i, s) for g, xs in groups.items() for i, s in enumerate(xs)], "g string, p long, s long")
    for limit, block in ((10, 7), (31, 3), (10, 1000)):
        got = {(r.grp, r.pos): r.batch_no for r in batching.greedy_batches(df, "g", "p", "s", limit, block).collect()}
        for g, xs in groups.items():
            assert [got[g, i] for i in range(len(xs))] == fold(xs, limit)
    assert fold([5, 4, 3, 9, 1, 1], 10) == [1, 1, 2, 3, 3, 4]


def test_json_tasks(spark):
    df = spark.createDataFrame([("t", 0, "seg_0", 'say "hi"\n'), ("t", 1, "seg_1", None), ("t", None, "seg_2", "x"), (None, 1, "seg_3", "x"), ("t", 1, "seg_1", None)], "t string, p long, i string, x string")
    got = batching.json_tasks(df, "t", "p", "i", "x").collect()
    assert len(got) == 1 and got[0].payload == '[{"id": "seg_0", "text": "say \\"hi\\"\\n"}, {"id": "seg_1", "text": ""}]'
    assert got[0].task_id == "json_subtitle_batch_t_part_1" and batching.LIMIT == 19_200


def test_chapter_tasks(spark):
    data = [
        (1, 0, "c0", "T0", 0, "paragraph", "x" * 30), (1, 1, "c1", None, 0, "heading", "y" * 30), (1, 1, "c1", None, 1, "paragraph", "y" * 30),
        (1, 2, "c2", "Big", 0, "heading", "h" * 60), (1, 2, "c2", "Big", 1, "paragraph", "z" * 900), (1, 2, "c2", "Big", 2, "paragraph", "w" * 60), (1, 3, "c3", "", 0, "paragraph", "v" * 30),
    ]
    df = spark.createDataFrame(data, "b long, cp long, cid string, title string, bp long, kind string, html string")
    got = {r.task_id: r for r in batching.chapter_tasks(df, "b", "cp", "cid", "title", "bp", "kind", "html", 100).collect()}
    assert set(got) == {"batch::c0::to::c1", "split::c2::part_0", "split::c2::part_1", "split::c2::part_2", "batch::c3::to::c3"}
    assert got["split::c2::part_1"].payload == "z" * 900
    assert got["batch::c0::to::c1"].payload == '[{"id": "c0", "html_content": "<h1>T0</h1>' + "x" * 30 + '", "injected_heading": true}, {"id": "c1", "html_content": "' + "y" * 60 + '"}]'


def model_wrap(text, width=35):
    out = []
    while len(text) > width:
        k = next((p + 1 for b in display.BREAKS if (p := text.rfind(b, 0, width)) >= 0), width)
        out.append(text[:k].strip())
        text = text[k:].strip()
    return out + ([text] if text else [])


def test_display_golden(spark):
    texts = ["- Hi - well-known fact", "你好。世界！ok. tail", "Really? Yes!", "a" * 40, "x" * 80, "One. two, three four five six seven eight nine ten", "", "line。" * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1:] for r in df.select("t", display.dialogue_parts(F.col("t"), True), display.dialogue_parts(F.col("t")), display.marked_parts(F.col("t"), display.STRONG), display.chunks(F.col("t")), display.wrap_lines(F.col("t"))).collect()}
    assert got[texts[0]][0] == ["Hi", "- well", "- known fact"] and got[texts[0]][1] == ["Hi", "- well-known fact"]
    assert got[texts[1]][2] == ["你好。", "世界！", "ok.", "tail"] and got[texts[2]][2] == ["Really? Yes!"]
    assert got[texts[3]][3] == ["a" * 35 + "\n" + "a" * 5] and got[texts[4]][3] == ["x" * 35 + "\n" + "x" * 35, "x" * 10]
    assert got[texts[5]][3] == ["One.\ntwo,", "three four five six seven eight nin\ne ten"] and got[""][3] == []
    for t in texts:
        assert got[t][4] == model_wrap(t)


def test_screen_parts_tile_their_segment(spark):
    data = [("a", 0, 0.0, 9.0, "One. Two three! - Four, " + "five six seven, " * 9 + "end."), ("a", 1, 5.0, 5.0, "No time. At all."), ("a", 2, 1.0, 2.0, None), ("a", 3, None, 2.0, "x. y."), ("a", 4, 3.0, 8.0, "3.14 is pi。好")]
    df = spark.createDataFrame(data, "t string, p long, s double, e double, x string")
    got = {}
    for r in display.on_screen(df, "t", "p", "s", "e", "x").orderBy("pos", "part_no").collect():
        got.setdefault(r.pos, []).append(r)
    assert got[0][0].start_s == 0.0 and got[0][-1].end_s == 9.0 and len(got[0]) > 4
    assert all(abs(a.end_s - b.start_s) < 2e-3 for a, b in zip(got[0], got[0][1:], strict=False))
    assert [r.text for r in got[1]] == ["No time. At all."] and [r.text for r in got[2]] == [""] and len(got[3]) == 1
    assert [r.text for r in got[4]] == ["3.14 is pi。", "好"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 60))
def test_walk_is_the_fold(sizes, limit):
    closed, _, _ = batching._walk(sizes, limit, 0, True)
    assert [c + 1 for c in closed] == fold(sizes, limit)


def test_a_long_run_without_marks_is_linear():
    import time

    began = time.time()
    out = merge.merge_run([("word " * 20 + "end", float(i), i + 0.9) for i in range(6000)])
    assert len(out) > 2000 and time.time() - began < 20
    assert sum(len(t.replace(" ", "")) for t, _, _ in out) == 6000 * 83
