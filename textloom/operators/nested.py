"""Deeply nested records as flat tables that keep parent and child apart but linked (Merkle subtree identities).

Every node gets an identity from the bottom up: the digest of its type, of its *payload* and of the identities of the nodes
it holds. The payload is the node's whole value as canonical JSON in which each child node is replaced by a hole, ``#0``,
``#1`` and so on; a ``#`` outside a string is no JSON, so holes can't be mistaken for content. Nothing of the value is left
out, so objects share an identity if and only if they are equal JSON values (keys in any order) of one type, and a document
can be rebuilt from its root. The document as a whole is a node too, of type :data:`ROOT`. Then

* ``objects`` stores each distinct node once,
* ``bridge`` stores each distinct parent-child link once, with the steps and the ordinal (the number of the hole),
* ``occurrences`` keeps every place in every document.

A document is read and walked by one task with explicit stacks, so depth isn't limited by a call stack. The task stores its
objects once and takes the occurrences from the stored links of the root; there is no shuffle until the objects of all tasks
are brought together, and that aggregation combines on the map side, so an object that makes up a third of all
occurrences is no hot key.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fields through which nodes are reached.
RICH, ITEMS, NESTED, STRUCTURED, SOURCE, INNER = "content_rich_source", "items_source", "nested_list", "content_structured_source", "content_source", "content"
NOTE_TYPES = frozenset({"note_content", "note"})

ROOT = "document"
_CHILD_FIELDS = frozenset({RICH, ITEMS, NESTED, STRUCTURED, SOURCE, INNER})

PATH_SCHEMA = "doc_key long, node_path string, parent_path string, node_type string, node_id string"
NODE_SCHEMA = PATH_SCHEMA + ", parent_id string, field string, ordinal int, payload string"
#: Distinct objects that a task keeps before it starts anew; what a document holds is kept while it is read.
KEPT = 200_000

_FENCE = re.compile(r"```[A-Za-z]*[ \t]*\r?\n")
_TOKEN = re.compile(r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+)')
_DECODER = json.JSONDecoder()
_MISSING = object()


def _decode_flat(text: str, at: int) -> Any:
    """The JSON document that begins at ``at``, read without recursion (for nesting beyond the decoder's depth)."""
    root: list[Any] = []
    stack: list[tuple[Any, Any]] = [(root, None)]
    while True:
        if not (m := _TOKEN.match(text, at)):
            raise ValueError("incomplete")
        at, token = m.end(), m[1]
        holder, key = stack[-1]
        if token in "]}":
            if (token == "]") != isinstance(holder, list) or holder is root:
                raise ValueError("unbalanced")
            stack.pop()
            if len(stack) == 1:
                return root[0]
            continue
        if token in ",:":
            continue
        if isinstance(holder, dict) and key is None:
            stack[-1] = (holder, json.loads(token))
            continue
        value: Any = [] if token == "[" else {} if token == "{" else json.loads(token)
        if isinstance(holder, dict):
            holder[key] = value
            stack[-1] = (holder, None)
        else:
            holder.append(value)
        if token in "[{":
            stack.append((value, None))
        elif holder is root:
            return value


def _decode_at(text: str, at: int) -> Any:
    try:
        return _DECODER.raw_decode(text, at)[0]
    except RecursionError:
        try:
            return _decode_flat(text, at)
        except ValueError:
            return _MISSING
    except ValueError:
        return _MISSING


def read_document(text: str | None) -> Any:
    """The complete JSON array or object in ``text``, or None.

    It may stand in a code fence, after a byte order mark or a line of introduction, or be encoded as a JSON string, any
    number of times. A document that breaks off isn't complete.
    """
    while text is not None:  # each decoding takes off two quotation marks at least
        body = text.lstrip("﻿ \t\r\n​")
        if body[:1] == '"':
            value = _decode_at(body, 0)
            if not isinstance(value, str):
                return None
            text = value
            continue
        starts = [m.end() for m in _FENCE.finditer(body)][:1] if body[:1] not in ("[", "{") else []
        for start in [*starts, 0]:
            m = re.compile(r"[\[{\"]" if start else r"[\[{]").search(body, start)
            if m:
                value = _decode_at(body, m.start())
                if isinstance(value, (list, dict)):
                    return value
                if isinstance(value, str):
                    text = value
                    break
        else:
            return None
    return None


def _rule(field: str, kind: Any, place: str) -> str | None:
    """Where the child nodes of a value stand that is at ``place`` and has a field ``field``; None: it has none there."""
    if field == INNER:
        return "inline" if place == "item" or place == "inline" and kind != "text" else None
    if field == SOURCE:
        return "block" if kind in NOTE_TYPES else "table" if kind == "table" else None
    return {RICH: "inline", ITEMS: "item", NESTED: "block", STRUCTURED: "block"}.get(field)


def _node_type(value: Any, place: str) -> str | None:
    """None: no node; what it holds then belongs to the nearest node around it."""
    if place == "item":
        return "list_item"
    if isinstance(value, str):
        return "text" if place == "inline" else None
    kind = value.get("type") if isinstance(value, dict) else None
    return kind if isinstance(kind, str) else None


def _spread(value: Any, depth: int, steps: str, place: str) -> list[Any]:
    """What to write for arrays ``depth`` deep; a lone value where one belongs counts as its position 0."""
    if not depth:
        return [(value, place, steps)]
    if value is None:
        return ["null"]
    if not isinstance(value, list):
        return _spread(value, depth - 1, f"{steps}/0", place)
    out: list[Any] = ["["]
    for i, v in enumerate(value):
        out += [*([","] if i else []), *_spread(v, depth - 1, f"{steps}/{i}", place)]
    return [*out, "]"]


def _fields(value: dict[str, Any], place: str, steps: str) -> list[Any]:
    """What to write for an object: text, and ``(value, place, steps)`` where nodes can stand."""
    kind, out, pre = value.get("type"), [], f"{steps}/" if steps else ""
    text = "{"
    for key in sorted(value):
        x = value[key]
        text += ("," if len(text) > 1 or out else "") + _quoted(key) + ":"
        where = _rule(key, kind, place) if key in _CHILD_FIELDS and x is not None else None
        if where == "table" and isinstance(x, dict):
            out += [text, *_table(x, pre + key)]
            text = ""
        elif where is None or where == "table":
            text += canonical(x)
        else:
            out += [text, *_spread(x, 0 if key == NESTED and not isinstance(x, list) else 1, pre + key, where)]
            text = ""
    return [*out, text + "}"]


def _table(value: dict[str, Any], steps: str) -> list[Any]:
    out: list[Any] = ["{"]
    for n, part in enumerate(sorted(value)):
        out.append(("," if n else "") + _quoted(part) + ":")
        depth = {"headers": 2, "rows": 3}.get(part)
        out += [canonical(value[part])] if depth is None else _spread(value[part], depth, f"{steps}/{part}", "inline")
    return [*out, "}"]


def describe(value: Any, place: str) -> tuple[str, list[tuple[Any, str, str]]]:
    """The payload of the node ``value``, and ``(value, place, steps)`` of the node in each of its holes.

    What isn't a node but stands where nodes do (objects without a type, bare strings among blocks) is written out, and the
    nodes it holds are this node's.
    """
    if place == ROOT:
        todo = _spread(value, 1, "", "block")[::-1]
        todo = [x if isinstance(x, str) else (x[0], x[1], x[2][1:]) for x in todo]
    elif isinstance(value, dict) and not _CHILD_FIELDS.isdisjoint(value):
        todo = _fields(value, place, "")[::-1]
    else:
        return canonical(value), []
    if len(todo) == 1 and isinstance(todo[0], str):
        return todo[0], []
    out: list[str] = []
    held: list[tuple[Any, str, str]] = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif _node_type(x[0], x[1]) is not None:
            out.append(f"#{len(held)}")
            held.append(x)
        elif isinstance(x[0], dict):
            todo += _fields(*x)[::-1]
        else:
            out.append(canonical(x[0]))
    return "".join(out), held


_ENCODE = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False).encode
_quoted = json.encoder.encode_basestring


def canonical(value: Any) -> str:
    """JSON with sorted keys and no blanks, of a value nested to any depth."""
    if isinstance(value, str):
        return _quoted(value)
    if value is None or value is True or value is False:
        return "null" if value is None else "true" if value else "false"
    try:
        return _ENCODE(value)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]
    while todo:
        done, x = todo.pop()
        if done:
            out.append(x)
        elif isinstance(x, dict):
            todo.append((True, "}"))
            for n, k in reversed(list(enumerate(sorted(x)))):
                todo += [(False, x[k]), (True, ("," if n else "") + json.dumps(k, ensure_ascii=False) + ":")]
            todo.append((True, "{"))
        elif isinstance(x, list):
            todo.append((True, "]"))
            for n, v in reversed(list(enumerate(x))):
                todo += [(False, v)] + ([(True, ",")] if n else [])
            todo.append((True, "["))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


class Objects:
    """Distinct nodes by identity: type, payload, and the steps and identity of the node in each hole."""

    def __init__(self) -> None:
        self.nodes: dict[str, tuple[str, str, tuple[tuple[str, str], ...]]] = {}

    def add(self, document: Any) -> str:
        """The identity of the document's root, with all nodes under it stored."""
        kinds, payloads, parents, steps = [ROOT], [""], [-1], [""]
        todo: list[tuple[int, Any, str]] = [(0, document, ROOT)]
        while todo:
            n, value, place = todo.pop()
            payloads[n], held = describe(value, place)
            for v, p, s in held:
                kinds.append(_node_type(v, p) or "")
                payloads.append("")
                parents.append(n)
                steps.append(s)
                todo.append((len(kinds) - 1, v, p))
        # Parents have lower numbers than their children, so the reverse order is bottom up.
        below: list[list[tuple[str, str]]] = [[] for _ in kinds]
        for n in range(len(kinds) - 1, -1, -1):
            links = tuple(reversed(below[n]))
            text = f"{len(kinds[n])}:{kinds[n]}{payloads[n]}" + "".join([f"#{i}" for _, i in links])
            me = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            if me not in self.nodes:
                self.nodes[me] = (kinds[n], payloads[n], links)
            if n:
                below[parents[n]].append((steps[n], me))
        return me

    def occurrences(self, root: str) -> Iterator[tuple[str, str | None, str, str, str | None, str | None, int | None, str]]:
        """``path, parent path, type, identity, parent's identity, steps, ordinal, payload`` of the root and all places below."""
        todo: list[tuple[str, str | None, str, str | None, str | None, int | None]] = [("", None, root, None, None, None)]
        while todo:
            path, up, me, over, step, ordinal = todo.pop()
            kind, payload, links = self.nodes[me]
            yield path, up, kind, me, over, step, ordinal, payload
            if links:
                pre = f"{path}/" if path else ""
                todo += [(pre + s, path, i, me, s, n) for n, (s, i) in enumerate(links)][::-1]


_HOLE = re.compile(r'"(?:[^"\\]|\\.)*"|#([0-9]+)')


def rebuild(payloads: dict[str, str], links: dict[tuple[str, int], str], root: str) -> str:
    """The canonical JSON of the document with this root, from objects and bridge alone."""
    out: list[str] = []
    todo: list[tuple[str, int]] = [(root, 0)]
    while todo:
        me, at = todo.pop()
        text = payloads[me]
        for m in _HOLE.finditer(text, at):
            if m[1] is not None:
                out.append(text[at : m.start()])
                todo += [(me, m.end()), (links[me, int(m[1])], 0)]
                break
        else:
            out.append(text[at:])
    return "".join(out)


def _plain(text: str | None) -> str | None:
    """Lone surrogates can't be written as UTF-8; they become replacement characters."""
    return text.encode("utf-8", "replace").decode() if text and not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text) else text


def _flatten(df: DataFrame, key: str, content: str, schema: str) -> DataFrame:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        arrays = []
        for (_, kind), values in zip(fields, columns, strict=False):
            try:
                arrays.append(pa.array(values, kind))
            except UnicodeEncodeError:
                arrays.append(pa.array([_plain(v) for v in values], kind))
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, short = Objects(), len(fields) == len(PATH_SCHEMA.split(", "))
        for batch in batches:
            rows: list[tuple] = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if (document := read_document(text)) is None:
                    continue
                if len(store.nodes) > KEPT:
                    store = Objects()
                found = store.occurrences(store.add(document))
                rows += [(k, *x[:4]) for x in found] if short else [(k, *x) for x in found]
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    return df.where(F.col(content).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(content).alias("c")).mapInArrow(run, schema)


def flatten_nested(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each occurrence of a node in ``content``, as :data:`NODE_SCHEMA`; ``doc_key`` is the row's ``key``.

    The document itself is the row with the empty ``node_path`` and a null parent. Null, empty or incomplete content gives no
    row; a row stored twice gives its nodes twice, under its own key. Lone objects or strings where an array belongs count
    as position 0. Rows without a key are left out, columns other than the two named are ignored.
    """
    return _flatten(df, key, content, NODE_SCHEMA)


def nested_paths(df: DataFrame, key: str, content: str) -> DataFrame:
    """The occurrences of :func:`flatten_nested` as :data:`PATH_SCHEMA`, without what ``objects`` and ``bridge`` hold."""
    return _flatten(df, key, content, PATH_SCHEMA)


def distinct_objects(nodes: DataFrame) -> DataFrame:
    """``node_id, node_type, payload, occurrences``: each distinct object of :func:`flatten_nested` once."""
    return nodes.groupBy("node_id").agg(F.first("node_type").alias("node_type"), F.first("payload").alias("payload"), F.count(F.lit(1)).alias("occurrences"))


def object_bridge(nodes: DataFrame) -> DataFrame:
    """``parent_id, field, ordinal, child_id``: each distinct link between distinct objects once."""
    return nodes.where(F.col("parent_id").isNotNull()).select("parent_id", "field", "ordinal", F.col("node_id").alias("child_id")).distinct()
