from __future__ import annotations

import random

from tests.conftest import rows
from textloom.operators.grouped import map_groups


def test_groups_span_batches(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("abcde") if rnd.random() < 0.6 else "hot", rnd.randrange(3), rnd.randrange(1000), None if rnd.random() < 0.1 else f"x{i}", b"b" * (i % 3)) for i in range(700)]
    df = spark.createDataFrame(data, "g string, h long, n long, x string, b binary")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = rows(map_groups(df, ["g", "h"], ["n"], lambda k, c: [(*k, len(c["n"]), sum(c["n"]), c["n"] == sorted(c["n"]), sum(x is None for x in c["x"]), sum(map(len, c["b"])))], "g string, h long, k int, total long, ordered boolean, nulls int, bytes int"))
        assert rows(map_groups(df.limit(0), ["g"], ["n"], lambda k, c: [(k[0],)], "g string")) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for g, h, n, x, b in data:
        w = want.setdefault((g, h), [0, 0, True, 0, 0])
        w[0] += 1
        w[1] += n
        w[3] += x is None
        w[4] += len(b)
    assert got == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_groups_stay_whole_above_a_join(spark):
    """A join by the same keys, made a broadcast join at run time, must not part a group."""
    big = spark.range(20_000).repartition(5).selectExpr("id % 37 AS g", "id AS n")
    small = spark.range(37).selectExpr("id AS g", "id * 2 AS m")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = rows(map_groups(big.join(small, "g"), ["g"], ["n"], lambda k, c: [(k[0], len(c["n"]))], "g long, k long"))
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(got) == 37 and sum(k for _, k in got) == 20_000
