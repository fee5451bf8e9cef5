"""Running a function over small groups without paying for each group.

``applyInPandas`` starts anew for every group, which costs milliseconds; with many small groups that is all it does. Here a
partition's rows come sorted by group and are cut into groups as they stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 20_000

Columns = dict[str, list[Any]]


def map_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable[[tuple, Columns], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``function`` makes of each group, in ``schema``.

    It gets the values of ``keys`` (which mustn't be null) and the group's columns as lists, sorted by ``order``. A group is
    held by one task, so groups must be bounded.
    """
    names, columns = [x.split()[0] for x in schema.split(", ")], df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        held: Columns = {c: [] for c in columns}
        out: list[tuple] = []
        for batch in batches:
            lists = {c: batch[c].tolist() for c in columns}
            found = list(zip(*[lists[k] for k in keys], strict=True))
            start = 0
            for i, k in enumerate(found):
                if k == key:
                    continue
                if key is not None:
                    for c in columns:
                        held[c] += lists[c][start:i]
                    out += function(key, held)
                    held = {c: [] for c in columns}
                key, start = k, i
            for c in columns:
                held[c] += lists[c][start:]
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=names)
                out = []
        if key is not None:
            out += function(key, held)
        yield pd.DataFrame(out, columns=names)

    # By a hash of the keys rather than the keys: a repartition by what a join below is partitioned by is planned away, and
    # adaptive execution may then give that join another partitioning, since nothing above it says what it needs.
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
