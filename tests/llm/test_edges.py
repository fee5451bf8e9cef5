"""Nulls in any column, repeated rows and very long texts, for every operator of the package."""

from __future__ import annotations

from tests.conftest import rows
from textloom.llm.languages import fit_and_segment
from textloom.llm.leaks import find_leaks
from textloom.llm.mixing import counted, mix_documents
from textloom.llm.packing import cut_to_capacity, pack
from textloom.llm.pairs import broken_pairs
from textloom.llm.pieces import split_items
from textloom.llm.sentences import run_on_ends, run_on_units, whole_text_units
from textloom.llm.turns import speaker_turns

LONG = "The captain opened the box near the harbour. " * 4_000
BIG = 2**60 + 1


def frame(spark):
    data = [(BIG, LONG, "en", "t", 1), (BIG, LONG, "en", "t", 1), (2, None, None, None, None), (None, "Text of no key.", "en", "t", 2), (3, "", "", "", 0), (4, "Short one. Two.", None, None, 3)]
    return spark.createDataFrame(data, "k long, x string, l string, g string, p long")


def test_every_operator(spark):
    df = frame(spark)
    assert {r[0] for r in rows(whole_text_units(df, "k", "x"), "row_key")} == {BIG, 4} and whole_text_units(df, "k", "x").count() == 8_002
    assert {r[0] for r in rows(run_on_ends(df, "g", "p", "k", "x"), "row_key")} == {BIG, 4}
    assert run_on_units(df, "g", "p", "k", "x").count() == 4_000
    assert {r[0] for r in rows(split_items(df, "k", "x"), "item_key")} == {BIG}
    bins = pack(cut_to_capacity(df, "k", "g", "x", "p")).collect()
    assert {i.item_key for b in bins for i in b["items"]} == {BIG, 2, 3, 4} and all(b["size"] <= 2000 for b in bins)
    assert rows(broken_pairs(df, "k", "x", "x", "l")) == [(4, "copy")]
    items = spark.createDataFrame([(7, LONG[:2000]), (None, LONG[:2000]), (8, None)], "i long, t string")
    assert rows(find_leaks(df, "k", "x", items, "i", "t"), "doc_key", "item_key") == [(BIG, 7), (BIG, 7)]
    targets = spark.createDataFrame([("en", 1.0, 2), (None, 0.5, 1), ("x", None, None)], "source string, target_share double, max_repeats long")
    assert {r[0] for r in rows(mix_documents(counted(df, "k", "x", "l"), targets), "doc_key")} == {BIG}
    got = rows(fit_and_segment(df, "k", "x", "l"), "doc_id", "segment_no", "lang")
    assert {g[0] for g in got} == {BIG, 4} and all(g[2] == "en" for g in got)
    cast = spark.createDataFrame([("t", 1, "Ann Bee", None)], "track_id string, speaker_no long, full_name string, speaker_role string")
    talk = spark.createDataFrame([("t", 0, None, "ANN: " + LONG, None, None), ("t", None, 1, "x", 0.0, 1.0), ("t", 1, 2, None, None, 1.0)], "track_id string, pos long, row_id long, text string, start_s double, duration_s double")
    assert rows(speaker_turns(talk, cast, with_text=False), "speaker_no", "first_pos", "last_pos", "start_s", "duration_s") == [(1, 0, 0, None, 0.0)]
