from __future__ import annotations

import importlib
import sys

import pytest

from textloom.tables import cut_lineage


class Cluster:
    """A DataFrame of a session on a cluster, as far as cutting its lineage looks at one."""

    def __init__(self, master, folder=None):
        self.sparkSession = self.sparkContext = self.conf = self._jsc = self
        self.master, self.folder, self.used = master, folder, None

    def sc(self):
        return self

    getCheckpointDir = sc

    def isEmpty(self):
        return self.used is None

    def get(self, name, default=None):
        return self.folder if name == "spark.checkpoint.dir" else default

    def setCheckpointDir(self, folder):
        self.used = folder

    def checkpoint(self, eager):
        return self


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            cut_lineage(Cluster(master))
        assert cut_lineage(Cluster(master, "hdfs:///x")).used == "hdfs:///x"
    for master in ("local", "local[4]", "local[*]"):
        assert cut_lineage(Cluster(master)).used.startswith("/")
        assert cut_lineage(Cluster(master, "file:///y")).used == "file:///y"


def test_the_entry_runs_without_the_subpackage_but_not_without_what_it_needs(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    assert len(entry.queries()) >= len(entry.QUERIES) > 50
    names = [m for m in sys.modules if m.startswith("textloom.llm")]
    for m in names:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "textloom.llm", None)  # as if the folder were gone
    assert set(importlib.reload(entry).queries()) == set(entry.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
