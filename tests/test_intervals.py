from __future__ import annotations

import random

import pytest
from tests.conftest import rows

from textloom.operators.intervals import interval_bounds, interval_gaps, interval_periods

SCHEMA = "k string, s double, e double, d double"


def brute(data, least=500):
    by, gaps = {}, set()
    for k, s, e, d in data:
        end = e if e is not None else (None if s is None or d is None else s + d)
        if k is None or s is None or end is None or s != s or end != end:
            continue
        a, b = round(s * 1000), round(end * 1000)
        if b > a:
            by.setdefault(k, []).append((a, b))
    for k, xs in by.items():
        reach = None
        for a, b in sorted(xs):
            if reach is not None and a - reach > least:
                gaps.add((k, reach, a))
            reach = b if reach is None else max(reach, b)
    return by, gaps


@pytest.mark.parametrize("shard", [1000, 7000, 600_000])
def test_gaps_equal_brute_force(spark, shard):
    rnd = random.Random(shard)
    data = []
    for k in ("a", "b", "c"):
        for _ in range(150):
            s = rnd.choice([None, rnd.randrange(-20, 300), rnd.randrange(0, 300), rnd.random() * 300])
            data.append((k, s, rnd.choice([None, (s or 0) + rnd.choice([-1.0, 0.0, 0.2, 1, 40])]), rnd.choice([None, 0.0, 0.3, 2.5])))
    data = [(k, None if s is None else float(s), None if e is None else float(e), d) for k, s, e, d in data]
    bounds = interval_bounds(spark.createDataFrame(data, SCHEMA), "k", "s", "e", "d")
    by, gaps = brute(data)
    assert set(rows(interval_gaps(bounds, 500, shard))) == gaps
    periods = rows(interval_periods(bounds, 500, shard))
    assert len(periods) == len(gaps) + len(by)
    for k, xs in by.items():
        own = sorted(p[2:] for p in periods if p[0] == k)
        assert own[0][0] == min(a for a, _ in xs) and own[-1][1] == max(b for _, b in xs)


def test_nulls_nan_ties_and_empty(spark):
    data = [("a", 0.0, 1.0, None), ("a", 0.0, 1.0, None), ("a", float("nan"), 2.0, None), ("a", 1.0, float("inf"), None), (None, 0.0, 9.0, None), ("a", 1.5, None, 1.0), ("a", 3.0005, 4.0, None), ("b", 5.0, 5.0, None)]
    bounds = interval_bounds(spark.createDataFrame(data, SCHEMA), "k", "s", "e", "d")
    assert rows(interval_gaps(bounds)) == []
    assert rows(interval_gaps(bounds, 400)) == [("a", 1000, 1500), ("a", 2500, 3000)]
    empty = interval_bounds(spark.createDataFrame([], SCHEMA), "k", "s", "e", "d")
    assert rows(interval_gaps(empty)) == [] and rows(interval_periods(empty)) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([("x", 0.0, 1.0, "p", 7), ("x", 9.0, 10.0, "q", 8)], "k string, s double, e double, entity string, shard int")
    assert rows(interval_gaps(interval_bounds(df, "k", "s", "e"))) == [("x", 1000, 9000)]
