from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from textloom.llm import mixing
from textloom.llm.mixing import counted, encoding, mix_documents, mix_shares, source_name, token_counts, water_fill


def test_water_fill():
    t, held, caps = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100, "b": 10, "c": 1000}, {"a": 1, "b": 2, "c": 1}
    got = water_fill(t, held, caps)
    assert got["b"] == pytest.approx(20) and got["a"] == pytest.approx(100 / 3) and got["c"] == pytest.approx(40 / 3)
    got = water_fill(t, held, caps, 200)
    assert got["b"] == 20 and got["a"] == 100 and got["c"] == pytest.approx(80)
    assert water_fill(t, {"a": 0}, caps) == {"a": 0.0, "b": 0.0, "c": 0.0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 1000), st.integers(0, 4)), min_size=1, max_size=6), st.one_of(st.none(), st.floats(1, 10_000)))
def test_water_fill_is_feasible(sources, total):
    t = {str(i): x[0] for i, x in enumerate(sources)}
    held = {str(i): x[1] for i, x in enumerate(sources)}
    caps = {str(i): x[2] for i, x in enumerate(sources)}
    got = water_fill(t, held, caps, total)
    assert all(0 <= got[s] <= held[s] * caps[s] * (1 + 1e-9) for s in t)
    if total:
        assert sum(got.values()) == pytest.approx(min(total, sum(held[s] * caps[s] for s in t)), rel=1e-6)


def data(spark):
    docs = [(i, "some words " * (1 + i % 7), [" Big", "BIG", "big"][i % 3]) for i in range(600)]
    docs += [(1000 + i, "few words here", "small-one") for i in range(20)] + [(2000, None, "big"), (2001, "", "small_one"), (2002, "lost", None), (2003, "other", "unlisted")]
    return spark.createDataFrame(docs, "k long, t string, s string").selectExpr("*", "'x' AS source", "1 AS tokens"), spark.createDataFrame([("big", 0.8, 1), ("small_one", 0.2, 3)], "source string, target_share double, max_repeats long")


def test_token_counts(spark):
    df, _ = data(spark)
    enc = encoding()
    for k, s, n in rows(token_counts(df, "k", "t", "s")):
        text = {2000: "", 2001: "", 2002: "lost", 2003: "other"}.get(k, "few words here" if k >= 1000 else "some words " * (1 + k % 7))
        assert n == len(enc.encode_ordinary(text)) and s in ("big", "small_one", None, "unlisted")


@pytest.mark.parametrize("buckets", [1, 16, 1 << 14])
def test_mix(spark, buckets):
    df, targets = data(spark)
    counts = counted(df, "k", "t", "s")
    got = mix_documents(counts, targets, buckets=buckets)
    used = rows(got)
    size = {s: sum(n * r for _, x, n, r in used if x == s) for s in ("big", "small_one")}
    assert size["big"] / sum(size.values()) == pytest.approx(0.8, abs=0.02)
    assert all(r <= {"big": 1, "small_one": 3}[s] and r > 0 for _, s, _, r in used)
    assert len({u[0] for u in used}) == len(used) and used == rows(mix_documents(counts, targets, buckets=buckets))
    over = rows(mix_documents(counts, targets, total=10_000_000, buckets=buckets))
    assert {r for _, s, _, r in over if s == "big"} == {1} and {r for _, s, _, r in over if s == "small_one"} == {3}


def test_shares(spark):
    df, targets = data(spark)
    got = {r.source: r for r in mix_shares(counted(df, "k", "t", "s"), targets.unionByName(spark.createDataFrame([("absent", 0.1, 2)], targets.schema))).collect()}
    assert got["absent"].mix_tokens == 0 and got["small_one"].most_repeats == 3
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    empty = counted(df.limit(0), "k", "t", "s")
    assert rows(mix_documents(empty, targets)) == [] and rows(mix_documents(empty, targets.limit(0))) == []


def test_names(spark):
    df = spark.createDataFrame([(" Local-SRT ",), ("local srt",), ("",), (None,), ("-",)], "s string")
    assert [r[0] for r in df.select(source_name(df.s)).collect()] == ["local_srt", "local_srt", None, None, None]
    assert mixing.TOKENIZER_DIR
