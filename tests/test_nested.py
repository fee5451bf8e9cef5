from __future__ import annotations

import json

import pandas as pd
from tests.conftest import rows

from textloom.operators.nested import Objects, canonical, distinct_objects, flatten_nested, nested_paths, object_bridge, read_document, rebuild

DOC = [
    {"type": "paragraph", "content_rich_source": ["bare", {"type": "bold", "content": {"type": "text", "content": "x"}}], "content_source": "plain"},
    {"type": "list", "items_source": [{"content": [{"type": "text", "content": "a"}], "nested_list": {"type": "list", "items_source": [{"content": "b", "nested_list": [{"type": "list", "items_source": []}]}]}}]},
    {"type": "note_content", "content_source": [{"type": "heading", "content_source": "h"}]},
    {"type": "table", "content_source": {"headers": ["H", [{"type": "text", "content": "I"}]], "rows": [[["r"], [{"type": "line_break"}]]]}},
    {"type": "code_block", "content_structured_source": [{"type": "code", "value": "v"}, {"type": "comment", "value": "c"}]},
    {"type": "heading", "content_source": None, "content": [{"type": "text", "content": "no node"}]},
]
PATHS = {
    "0": ("", "paragraph"),
    "0/content_rich_source/0": ("0", "text"),
    "0/content_rich_source/1": ("0", "bold"),
    "0/content_rich_source/1/content/0": ("0/content_rich_source/1", "text"),
    "1": ("", "list"),
    "1/items_source/0": ("1", "list_item"),
    "1/items_source/0/content/0": ("1/items_source/0", "text"),
    "1/items_source/0/nested_list": ("1/items_source/0", "list"),
    "1/items_source/0/nested_list/items_source/0": ("1/items_source/0/nested_list", "list_item"),
    "1/items_source/0/nested_list/items_source/0/content/0": ("1/items_source/0/nested_list/items_source/0", "text"),
    "1/items_source/0/nested_list/items_source/0/nested_list/0": ("1/items_source/0/nested_list/items_source/0", "list"),
    "2": ("", "note_content"),
    "2/content_source/0": ("2", "heading"),
    "3": ("", "table"),
    "3/content_source/headers/0/0": ("3", "text"),
    "3/content_source/headers/1/0": ("3", "text"),
    "3/content_source/rows/0/0/0": ("3", "text"),
    "3/content_source/rows/0/1/0": ("3", "line_break"),
    "4": ("", "code_block"),
    "4/content_structured_source/0": ("4", "code"),
    "4/content_structured_source/1": ("4", "comment"),
    "5": ("", "heading"),
}


def places(document):
    """Path, parent path and type of every node below the root."""
    store = Objects()
    return [n[:3] for n in store.occurrences(store.add(document))][1:]


def identity(value):
    return Objects().add(value)


def test_paths():
    assert {n[0]: (n[1], n[2]) for n in places(DOC)} == PATHS


def test_identities_tell_every_difference_and_no_more():
    table = {"type": "table", "content_source": {"headers": ["H"], "rows": [["a", ""], [[], None]]}}
    apart = [
        [{"type": "note", "content_source": "A"}],
        [{"type": "note", "content_source": "B"}],
        [{"type": "note", "content_source": ["A"]}],
        [{"type": "code_block", "content_structured_source": ["x"]}],
        [{"type": "code_block", "content_structured_source": [{"value": "x"}]}],
        [{"type": "code_block", "content_structured_source": []}],
        [{"type": "code_block", "content_structured_source": None}],
        [{"type": "code_block"}],
        [table],
        [{**table, "content_source": {**table["content_source"], "caption": "c"}}],
        [{**table, "content_source": {"headers": ["H"], "rows": [["a", ""], [[], []]]}}],
        [{**table, "content_source": {"headers": ["H"], "rows": [["a"], [[], None]]}}],
        [{"type": "list", "items_source": [{"content": "x"}]}],
        [{"type": "list", "items_source": {"content": "x"}}],
        [{"type": "list", "items_source": [{"content": ["x"]}]}],
        [{"type": "list", "items_source": [{"content": ["#0"]}]}],
        [{"type": "list", "items_source": [{"content": [{"type": "text", "content": "x"}]}]}],
        {"type": "list", "items_source": [{"content": "x"}]},
        ["A"],
        [],
    ]
    assert len({identity(x) for x in apart}) == len(apart)
    item = {"content": ["a", {"type": "bold", "content": ["b"]}], "nested_list": {"type": "list", "items_source": ["c"]}, "x": {"p": 1, "q": [2]}}
    turned = {"x": {"q": [2], "p": 1}, "nested_list": {"items_source": ["c"], "type": "list"}, "content": ["a", {"content": ["b"], "type": "bold"}]}
    assert identity([{"type": "list", "items_source": [item]}]) == identity([{"items_source": [turned], "type": "list"}])
    rows, headers = table["content_source"]["rows"], table["content_source"]["headers"]
    assert identity([table]) == identity([{"content_source": {"rows": rows, "headers": headers}, "type": "table"}])


def test_every_chapter_is_rebuilt():
    store = Objects()
    documents = [d for t in pd.read_parquet("/root/testdata/sf0.1/chapters.parquet", columns=["content"])["content"] if (d := read_document(t)) is not None]
    roots = [store.add(d) for d in documents]
    payloads = {i: n[1] for i, n in store.nodes.items()}
    links = {(i, k): x for i, n in store.nodes.items() for k, (_, x) in enumerate(n[2])}
    assert len(documents) > 1000 and all(rebuild(payloads, links, r) == canonical(d) for r, d in zip(roots, documents, strict=True))


def test_documents_are_rebuilt_from_objects_and_bridge(spark):
    """From the tables alone."""
    chapters = spark.read.parquet("/root/testdata/sf0.01/chapters.parquet").select("chapter_key", "content")
    nodes = flatten_nested(chapters, "chapter_key", "content").persist()
    payloads = {r.node_id: r.payload for r in distinct_objects(nodes).collect()}
    links = {(r.parent_id, r.ordinal): r.child_id for r in object_bridge(nodes).collect()}
    roots = {r.doc_key: r.node_id for r in nodes.where("node_path = ''").collect()}
    want = {k: d for k, t in chapters.collect() if (d := read_document(t)) is not None}
    assert len(want) > 100 and roots.keys() == want.keys()
    assert all(rebuild(payloads, links, roots[k]) == canonical(d) for k, d in want.items())
    assert {i for i, in nodes.select("node_id").distinct().collect()} == payloads.keys()
    by_payload = {r.node_id: (r.node_type, rebuild(payloads, links, r.node_id)) for r in nodes.select("node_id", "node_type").distinct().collect()}
    assert len(set(by_payload.values())) == len(by_payload), "equal objects have one identity"
    nodes.unpersist()


def test_wrappings():
    text = json.dumps(DOC)
    for wrapped in (text, "﻿" + text, f"```json\n{text}\n```", f"Here it is [1]:\n```\n{text}\n```", json.dumps(text), json.dumps(json.dumps(text)), text + "\n", json.dumps(DOC[0])):
        assert read_document(wrapped) in (DOC, DOC[0]), wrapped[:30]
    for broken in (None, "", "  ", text[:-5], json.dumps(text)[:-9], "hello", '"hello"', "12", "null", "```json\n[{"):
        assert read_document(broken) is None, broken
    often = "[1]"
    for _ in range(12):
        often = json.dumps(often)
    assert read_document(often) == [1]
    deep = '[{"type": "bold", "content": ' * 20_000 + "null" + "}]" * 20_000
    assert len(places(read_document(deep.replace('[{"type": "bold"', '[{"type": "paragraph", "content_rich_source": 1, "x": 1}, {"type": "bold"', 1)))) >= 1


def test_depth_is_no_limit():
    value = "leaf"
    for _ in range(5000):
        value = {"type": "bold", "content": [value]}
    assert len(places([{"type": "paragraph", "content_rich_source": [value]}])) == 5002


def test_identities_and_bridge(spark):
    data = [(1, json.dumps(DOC)), (2, json.dumps(DOC)), (3, json.dumps(DOC[:1])), (4, None), (5, "broken ["), (None, json.dumps(DOC))]
    df = spark.createDataFrame(data, "k long, c string").selectExpr("k", "c", "'x' AS node_id", "1 AS batch")
    nodes = flatten_nested(df, "k", "c")
    found = rows(nodes, "doc_key", "node_path", "node_id")
    assert found == rows(nested_paths(df, "k", "c"), "doc_key", "node_path", "node_id")
    by = {(k, p): i for k, p, i in found}
    assert by[1, ""] == by[2, ""] != by[3, ""]
    assert len(found) == 2 * len(PATHS) + 4 + 3
    assert all(by[1, p] == by[2, p] for p in PATHS)
    assert by[1, "0"] == by[3, "0"] and by[1, "0"] != by[1, "1"]
    objects = rows(distinct_objects(nodes))
    assert len({o[0] for o in objects}) == len(objects) and sum(o[3] for o in objects) == len(found)
    bridge = rows(object_bridge(nodes))
    assert len(bridge) == len(set(bridge)) and (by[1, "0"], "content_rich_source/0", 0, by[1, "0/content_rich_source/0"]) in bridge


def test_empty(spark):
    assert rows(flatten_nested(spark.createDataFrame([], "k long, c string"), "k", "c")) == []


def test_canonical_without_recursion():
    import json as j

    from textloom.operators import nested

    value = {"b": [1, {"z": None, "a": "é\n"}], "a": {}, "c": []}
    assert nested.canonical(value) == j.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    deep = [1, "x"]
    for _ in range(30_000):
        deep = {"k": [deep, 2]}
    text = nested.canonical(deep)
    assert text.startswith('{"k":[{"k":[') and text.endswith(",2]},2]}") and len(text) == 30_000 * 10 + 7
