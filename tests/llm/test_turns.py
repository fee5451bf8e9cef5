from __future__ import annotations

import random

import pytest

from tests.conftest import rows
from textloom.llm import turns
from textloom.llm.turns import speaker_turns

CAST = [("t", 1, "Galmar Thraras", "host"), ("t", 2, "Fendo Kine", None), ("u", 1, "Ann Bee", "host"), ("u", 2, "Cal Dee", "guest"), ("u", 3, "Eve Foo", "guest"), ("t", 2, "Fendo Kine", None), ("t", None, "X Y", None)]


def frames(spark, texts, track="t"):
    data = [(track, i, i, t, float(i), 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "track_id string, pos long, row_id long, text string, start_s double, duration_s double"), spark.createDataFrame(CAST, "track_id string, speaker_no long, full_name string, speaker_role string")


def found(spark, texts, track="t"):
    return [(r.speaker_no, r.first_pos, r.last_pos, r.text) for r in speaker_turns(*frames(spark, texts, track)).orderBy("turn_no").collect()]


def test_labels_of_all_kinds(spark):
    texts = ["GALMAR: One", "two. (Fendo Kine) Three", "[00:10:32] [Galmar] Four: five", "<v Fendo Kine> six", ">> THRARAS: seven", "- Fendo: eight", "G.T.: nine", "SPK_2: ten", "Speaker 1: a", "speaker2: b", "HOST: c", "Feendo: d", "Galmar T.: e", "kine: f", "Galmar : g"]
    got = found(spark, texts)
    assert [g[0] for g in got] == [1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1]
    assert got[0] == (1, 0, 1, "One two.") and got[1] == (2, 1, 1, "Three") and got[2] == (1, 2, 2, "Four: five")


def test_noise_and_dropped_turns(spark):
    texts = ["GALMAR: At uh, noon", "(Galmar laughs)", "[MUSIC: slow piano]", "FENDO: Mm-hm.", "♪ ♪", "[inaudible] he you know, left. *coughs*", "KINE: Uh-huh.", "HOST: Chapter 3: Well... {12:25.0}", "<i>[sighs]</i>", None, "00:12:13", "Remember: x 【音楽】"]
    assert found(spark, texts) == [(1, 0, 0, "At noon"), (2, 5, 5, "he left."), (1, 7, 11, "Chapter 3: Well... Remember: x")]


def test_long_noise(spark):
    """Sound notes and sung lines of any length hold no spoken words."""
    sung, note = "la la and the river flows " * 8, "the door falls shut behind the two of them with a long echo " * 3
    assert found(spark, ["GALMAR: One", f"♪ {sung}♪", "FENDO: two", f"*{note.strip()}*", f"KINE: ♫♪ {sung}♪", f"HOST: three *{note.strip()}* four"]) == [(1, 0, 0, "One"), (2, 2, 2, "two"), (1, 5, 5, "three four")]


def test_bare_changes(spark):
    assert found(spark, ["lost", "FENDO: a >> b", ">> c", ">> d", "GALMAR: e"]) == [(None, 0, 0, "lost"), (2, 1, 1, "a"), (1, 1, 1, "b"), (2, 2, 2, "c"), (1, 3, 4, "d e")]
    assert [g[0] for g in found(spark, ["CAL: a", ">> b", "Eve Foo: c", "GUEST: d"], "u")] == [2, None, 3]


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_blocks_make_no_difference(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rnd = random.Random(1)
    texts = [rnd.choice(["GALMAR: a", "FENDO: b", "c", "c", ">> d", "(applause)", "uh", "KINE: e >> f", None]) for _ in range(60)]
    speaker, spoken = None, []
    for i, t in enumerate(texts):
        for part in (t or "").replace(">>", "\n>>").split("\n"):
            p = part.strip()
            if p.startswith(("GALMAR:", "FENDO:", "KINE:")):
                speaker, p = (1 if p[0] == "G" else 2), p.partition(":")[2].strip()
            elif p.startswith(">>"):
                speaker, p = None if speaker is None else 3 - speaker, p[2:].strip()
            if p and p not in ("(applause)", "uh"):
                spoken.append((speaker, i))
    want = []
    for s, i in spoken:
        if want and want[-1][0] == s:
            want[-1] = (s, want[-1][1], i)
        else:
            want.append((s, i, i))
    # A change mark before any label is unknown, like what came before.
    assert [g[:3] for g in found(spark, texts)] == want


def test_copies_nulls_and_empty(spark):
    df, cast = frames(spark, ["GALMAR: a", "b", None])
    twice = df.unionByName(df.selectExpr("track_id", "pos", "row_id + 100 AS row_id", "text", "start_s", "duration_s")).unionByName(df.selectExpr("CAST(NULL AS STRING) AS track_id", "pos", "row_id", "text", "start_s", "duration_s"))
    clash = twice.selectExpr("*", "1 AS block", "'x' AS speaker", "'y' AS track")
    assert rows(speaker_turns(clash, cast), "track", "speaker_no", "first_pos", "last_pos", "start_s", "duration_s") == [("t", 1, 0, 1, 0.0, 1.5)]
    assert rows(speaker_turns(df.limit(0), cast)) == [] and rows(speaker_turns(df, cast.limit(0))) == []
