"""HTML and typed blocks, both ways.

The parser is the standard library's; the tree is ours: void elements hold nothing, and a paragraph, list item, table row
or cell ends where the next one of its kind begins. Trees are read and written with explicit stacks, so elements may be
nested to any depth. Blocks are dictionaries shaped like the items of a chapter's content.
Ids come from the document's key and the block's place, so a run repeated gives the same ids.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import posixpath
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.nested import canonical, read_document

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An element of the key ends an open one of its values, if nothing of the third kind lies between.
_ENDS = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
_WALLS = frozenset("ul ol table div section body td th li blockquote".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element: its name, attributes and contents (nodes and strings); its first image, and whether it holds words."""

    __slots__ = ("attrs", "contents", "image", "name", "parent", "worded")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent, self.contents = name, attrs, parent, []
        self.image: Node | None = None
        self.worded = False

    def strings(self) -> Iterator[str]:
        todo: list[Any] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo += reversed(x.contents)

    def text(self) -> str:
        return "".join(self.strings())

    def plain(self) -> str:
        return " ".join(s.strip() for s in self.strings() if s.strip())

    def elements(self, *names: str, deep: bool = True) -> Iterator[Node]:
        todo = [c for c in reversed(self.contents) if isinstance(c, Node)]
        while todo:
            x = todo.pop()
            if not names or x.name in names:
                yield x
            if deep:
                todo += [c for c in reversed(x.contents) if isinstance(c, Node)]

    def classes(self) -> list[str] | None:
        return self.attrs["class"].split() if self.attrs.get("class") else None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        enders = _ENDS.get(tag, ()) + (("p",) if tag in _BLOCKS else ())
        x: Node | None = self.at if enders else None
        while x is not None and x.name:
            if x.name in enders:
                self.at = x.parent or self.root
                break
            if x.name in _WALLS and not (tag in ("tr",) and x.name in ("td", "th")):
                break
            x = x.parent
        node = self.add(tag, attrs)
        if tag not in VOID:
            self.at = node

    def add(self, tag: str, attrs: list[tuple[str, str | None]]) -> Node:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.contents.append(node)
        x: Node | None = self.at if tag == "img" else None
        while x is not None and x.image is None:
            x.image = node
            x = x.parent
        return node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.add(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        x: Node | None = self.at
        while x is not None and x.name != tag:
            x = x.parent
        if x is not None and x.name:
            self.at = x.parent or self.root

    def handle_data(self, data: str) -> None:
        self.at.contents.append(data)
        x: Node | None = self.at if data.strip() else None
        while x is not None and not x.worded:
            x.worded = True
            x = x.parent


def parse_tree(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


def rich_items(node: Node) -> list[dict[str, Any]]:
    """The inline items of an element; blank text is dropped, unknown elements become their text."""
    top: list[dict[str, Any]] = []
    todo = [(node, top)]
    while todo:
        at, out = todo.pop()
        for c in at.contents:
            if isinstance(c, str):
                if c.strip():
                    out.append({"type": "text", "content": c})
            elif c.name in ("b", "strong", "i", "em", "small"):
                out.append({"type": {"b": "bold", "strong": "bold", "i": "italic", "em": "italic"}.get(c.name, "small"), "content": []})
                todo.append((c, out[-1]["content"]))
            elif c.name == "a" and "noteref" in c.attrs.get("epub:type", ""):
                out.append({"type": "note_reference", "marker": c.text(), "note_id": c.attrs.get("href", "#")[1:]})
            elif c.name == "a":
                out.append({"type": "hyperlink", "href": c.attrs.get("href", ""), "title": c.attrs.get("title") or None, "content": []})
                todo.append((c, out[-1]["content"]))
            elif c.name == "br":
                out.append({"type": "line_break"})
            elif (text := c.text()).strip():
                out.append({"type": "text", "content": text})
    return top


def resolve_image(src: str, base: str, known: set[str] | None) -> str:
    """The resource an image means: its normalised path, else the only one with its file name, else what is written."""
    path = posixpath.normpath(posixpath.join(base, src)).lstrip("/")
    if not known:
        return src
    if path in known:
        return path
    name = posixpath.basename(src)
    same = [k for k in known if posixpath.basename(k) == name]
    return same[0] if len(same) == 1 else src


def _list(node: Node) -> dict[str, Any]:
    def empty(at: Node) -> dict[str, Any]:
        return {"type": "list", "ordered": at.name == "ol", "items_source": [], "mmg_id": at.attrs.get("data-mmg-id"), "css_classes": at.classes()}

    top = empty(node)
    todo = [(node, top)]
    while todo:
        at, block = todo.pop()
        for li in at.elements("li", deep=False):
            nested = next(li.elements("ul", "ol"), None)
            inner = None
            if nested is not None:
                inner = empty(nested)
                todo.append((nested, inner))
                nested.parent.contents.remove(nested)
            block["items_source"].append({"content": rich_items(li), "nested_list": inner})
    return top


def _table(node: Node) -> dict[str, Any]:
    def cells(tr: Node) -> list[list[dict[str, Any]]]:
        return [rich_items(c) for c in tr.elements("td", "th")]

    head = next(node.elements("thead"), None)
    in_head = list(head.elements("tr")) if head is not None else []
    body = [tr for tr in node.elements("tr") if tr not in in_head]
    headers = [c for tr in in_head for c in cells(tr)]
    if not in_head and body and (first := next(body[0].elements("td", "th"), None)) is not None and first.name == "th":
        headers = cells(body.pop(0))
    return {"type": "table", "content_source": {"headers": headers, "rows": [cells(tr) for tr in body]}, "mmg_id": node.attrs.get("data-mmg-id"), "css_classes": node.classes()}


def _code(node: Node) -> dict[str, Any]:
    code = next(node.elements("code"), None)
    language = next((c.removeprefix("language-") for c in (code.classes() or []) if c.startswith("language-")), None) if code is not None else None
    lines: list[dict[str, str]] = [{"type": "code", "value": ""}]
    for c in (code or node).contents:
        comment = isinstance(c, Node) and c.name == "span" and "comment" in (c.classes() or [])
        if isinstance(c, Node) and c.name == "br":
            lines.append({"type": "code", "value": ""})
            continue
        for n, part in enumerate((c if isinstance(c, str) else c.text()).split("\n")):
            if n:
                lines.append({"type": "code", "value": ""})
            lines[-1]["value"] += part
            if comment and part:
                lines[-1]["type"] = "comment"
    while len(lines) > 1 and not lines[-1]["value"]:
        lines.pop()
    return {"type": "code_block", "language": language, "content_structured_source": lines, "mmg_id": node.attrs.get("data-mmg-id"), "css_classes": node.classes()}


def parse_block(node: Node, base: str = "", known: set[str] | None = None, keep_unknown: bool = True) -> dict[str, Any] | None:
    """The block of one element; None for what is no block (with ``keep_unknown``, elements with text are paragraphs)."""
    top: list[dict[str, Any]] = []
    todo, notes = [(node, top, keep_unknown)], []
    while todo:
        at, out, keep = todo.pop()
        block = _one_block(at, base, known, keep)
        if block is None:
            continue
        out.append(block)
        if block["type"] == "note_content":
            notes.append(block)
            todo += [(c, block["content_source"], True) for c in at.elements(deep=False)][::-1]
    # Notes without anything are no blocks; those inside come later in the list.
    for note in reversed(notes):
        note["content_source"] = [b for b in note["content_source"] if b["type"] != "note_content" or b["content_source"]]
    return next((b for b in top if b["type"] != "note_content" or b["content_source"]), None)


def _one_block(node: Node, base: str, known: set[str] | None, keep_unknown: bool) -> dict[str, Any] | None:
    """The block of one element; a note still without what it holds."""
    mmg, classes = node.attrs.get("data-mmg-id"), node.classes()
    image = node if node.name == "img" else node.image
    if image is not None and (image is node or not node.worded):
        if "src" not in image.attrs:
            return None
        out = {"type": "image", "path": resolve_image(image.attrs["src"], base, known), "content_source": image.attrs.get("alt", ""), "mmg_id": mmg, "img_css_classes": image.classes()}
        return out | ({"container_tag": node.name, "css_classes": classes} if image is not node else {})
    if len(node.name) == 2 and node.name[0] == "h" and node.name[1] in "123456":
        return {"type": "heading", "level": int(node.name[1]), "content_source": node.plain(), "mmg_id": mmg, "css_classes": classes}
    if node.name in ("ul", "ol"):
        return _list(node)
    if node.name == "p":
        only = [c for c in node.contents if isinstance(c, Node)]
        if len(only) == 1 and only[0].name in ("span", "i") and "bullet" in (only[0].classes() or []) and not node.worded:
            return {"type": "list", "ordered": False, "items_source": [{"content": [{"type": "text", "content": only[0].text()}], "nested_list": None}], "mmg_id": mmg, "css_classes": ["pseudo-list-generated", "bullet"]}
        return {"type": "paragraph", "content_rich_source": rich_items(node), "content_source": node.plain(), "mmg_id": mmg, "css_classes": classes}
    if node.name == "table":
        return _table(node)
    if node.name == "pre":
        return _code(node)
    if node.name == "hr":
        return {"type": "marker", "role": "doc-pagebreak", "title": node.attrs.get("title") or None, "mmg_id": mmg, "css_classes": classes} if "doc-pagebreak" in (classes or []) else None
    if node.name == "div" and node.attrs.get("id") and keep_unknown:
        return {"type": "note_content", "id": node.attrs["id"], "marker_source": "", "content_source": [], "mmg_id": mmg, "css_classes": classes}
    if keep_unknown and node.name not in ("script", "style", "head", "title", "meta", "link") and node.worded:
        return {"type": "paragraph", "content_rich_source": rich_items(node), "content_source": node.plain(), "mmg_id": mmg, "css_classes": classes}
    return None


def pseudo_list(nodes: list[Node]) -> dict[str, Any]:
    """One list of consecutive paragraphs that imitate its items."""
    return {"type": "list", "ordered": False, "items_source": [{"content": rich_items(n), "nested_list": None} for n in nodes], "mmg_id": None, "css_classes": [*((nodes[0].classes() if nodes else None) or []), "pseudo-list-marker"]}


def parse_blocks(text: str | None, key: str = "", base: str = "", known: set[str] | None = None, unwrap: bool = False, keep_unknown: bool = True) -> list[dict[str, Any]]:
    """The blocks of a document's body, with deterministic ids. ``unwrap``: sections and divisions are entered."""
    if not text:
        return []
    root = parse_tree(text)
    top = next(root.elements("body"), root)
    out: list[dict[str, Any]] = []
    todo = list(reversed([c for c in top.contents if isinstance(c, Node)]))
    while todo:
        node = todo.pop()
        if node.name == "html" or unwrap and node.name in ("section", "div") and not (node.attrs.get("id") and "note" in node.attrs.get("epub:type", "")):
            todo += reversed([c for c in node.contents if isinstance(c, Node)])
            continue
        block = parse_block(node, base, known, keep_unknown)
        if block:
            identity = hashlib.sha256(f"{key}|{len(out)}".encode()).hexdigest()[:32]
            out.append({"id": identity, **{k: v for k, v in block.items() if v is not None or k == "nested_list"}})
    return out


def _attributes(pairs: dict[str, Any]) -> str:
    return "".join(f' {k}="{html_lib.escape(str(v))}"' for k, v in pairs.items() if v)


def _common(block: dict[str, Any]) -> dict[str, Any]:
    return {"class": " ".join(block.get("css_classes") or []), "data-mmg-id": block.get("mmg_id")}


def _many(x: Any) -> list[Any]:
    return x if isinstance(x, list) else [] if x is None else [x]


def _written(todo: list[Any]) -> str:
    """Text put together from strings and ``(function, value)``, whose functions give more of both."""
    out: list[str] = []
    todo = todo[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += x[0](x[1])[::-1]
    return "".join(out)


def render_rich(items: Any) -> str:
    """The HTML of inline items; a bare string is text."""
    return _written([(_rich_parts, items)])


def _rich_parts(items: Any) -> list[Any]:
    out: list[Any] = []
    for x in _many(items):
        kind = x.get("type") if isinstance(x, dict) else "text"
        inner = x.get("content") if isinstance(x, dict) else x
        if kind == "text":
            out.append(html_lib.escape(inner or "", quote=False))
        elif kind in ("bold", "italic", "small"):
            tag = {"bold": "b", "italic": "i", "small": "small"}[kind]
            out += [f"<{tag}>", (_rich_parts, inner), f"</{tag}>"]
        elif kind == "hyperlink":
            out += [f'<a href="{html_lib.escape(x.get("href") or "")}"{_attributes({"title": x.get("title")})}>', (_rich_parts, inner), "</a>"]
        elif kind == "line_break":
            out.append("<br/>")
        elif kind == "note_reference":
            out.append(f'<a href="#{html_lib.escape(x.get("note_id") or "")}" epub:type="noteref">{html_lib.escape(x.get("marker") or "", quote=False)}</a>')
        elif inner is not None:
            out.append((_rich_parts, inner))
    return out


def render_block(block: dict[str, Any]) -> str:
    """The HTML of a block, target before source; empty for what isn't shown."""
    return _written([(_block_parts, block)])


def _block_parts(block: dict[str, Any]) -> list[Any]:
    kind, own = block.get("type"), _common(block)
    text = block.get("content_target") or block.get("content_source") or ""
    if kind == "heading":
        tag = f"h{block.get('level') or 1}"
        return [f"<{tag}{_attributes(own)}>{html_lib.escape(text, quote=False)}</{tag}>"]
    if kind == "paragraph":
        return [f"<p{_attributes(own)}>", (_rich_parts, block.get("content_rich_target") or block.get("content_rich_source") or text), "</p>"]
    if kind == "image":
        img = {"src": f"../images/{posixpath.basename(block.get('path') or '')}", "alt": text, "class": " ".join(block.get("img_css_classes") or [])}
        if tag := block.get("container_tag"):
            return [f"<{tag}{_attributes(own)}><img{_attributes(img)}/></{tag}>"]
        return [f"<img{_attributes({**img, **{k: v for k, v in own.items() if v}})}/>"]
    if kind == "list":
        tag, classes = ("ol" if block.get("ordered") else "ul"), list(block.get("css_classes") or [])
        pseudo = ' class="pseudo-list-item"' if "pseudo-list-marker" in classes else ""
        own["class"] = " ".join(c for c in classes if c != "pseudo-list-marker")
        items: list[Any] = []
        for it in _many(block.get("items_target") or block.get("items_source")):
            it = it if isinstance(it, dict) else {"content": it}
            items += [f"<li{pseudo}>", (_rich_parts, it.get("content")), *[(_block_parts, n) for n in _many(it.get("nested_list")) if isinstance(n, dict)], "</li>"]
        return [f"<{tag}{_attributes(own)}>", *items, f"</{tag}>"]
    if kind == "table":
        t = block.get("content_target") or {}
        t = t if t.get("headers") or t.get("rows") else block.get("content_source") or {}
        head = [p for c in _many(t.get("headers")) for p in ("<th>", (_rich_parts, c), "</th>")]
        rows = [p for r in _many(t.get("rows")) for p in ("<tr>", *[q for c in _many(r) for q in ("<td>", (_rich_parts, c), "</td>")], "</tr>")]
        head = ["<thead><tr>", *head, "</tr></thead>"] if head else []
        rows = ["<tbody>", *rows, "</tbody>"] if rows else []
        return [f"<table{_attributes(own)}>", *head, *rows, "</table>"]
    if kind == "code_block":
        lines = []
        for x in _many(block.get("content_structured_target") or block.get("content_structured_source")):
            x = x if isinstance(x, dict) else {"value": x}
            value = html_lib.escape(str(x.get("value") or ""), quote=False)
            lines.append(f'<span class="comment">{value}</span>' if x.get("type") == "comment" else value)
        return [f"<pre{_attributes(own)}><code{_attributes({'class': 'language-' + block['language'] if block.get('language') else ''})}>{'<br/>'.join(lines)}</code></pre>"]
    if kind == "marker":
        return [f"<hr{_attributes({'class': own['class'] or 'doc-pagebreak', 'title': block.get('title'), 'data-mmg-id': own['data-mmg-id']})}/>"] if block.get("role") == "doc-pagebreak" else []
    if kind in ("note_content", "note"):
        return [f"<div{_attributes({'id': block.get('id'), **own})}>", *[(_block_parts, b) for b in _many(block.get("content_target") or block.get("content_source")) if isinstance(b, dict)], "</div>"]
    return []


def source_text(block: dict[str, Any]) -> str:
    """A block's source text: its plain text, the texts of a list's items, else nothing."""
    if block.get("type") in ("heading", "paragraph", "image"):
        return block.get("content_source") or ""
    if block.get("type") == "list":
        return " ".join(filter(None, (parse_tree(render_rich(i.get("content") if isinstance(i, dict) else i)).plain() for i in _many(block.get("items_source")))))
    return ""


def _json(value: Any) -> str:
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return canonical(value)


_SCHEMA = "doc_key string, block_no int, block_type string, level int, block_text string, mmg_id string, block string"


def html_to_blocks(df: DataFrame, key: str, html: str, unwrap: bool = False, keep_unknown: bool = True) -> DataFrame:
    """One row for each block of each document, as :data:`_SCHEMA`; ``block`` is its JSON. Null and empty HTML has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (k, n, x["type"], x.get("level"), source_text(x), x.get("mmg_id"), _json(x))
                for k, t in zip(b["k"], b["t"], strict=True)
                for n, x in enumerate(parse_blocks(t, k or "", unwrap=unwrap, keep_unknown=keep_unknown))
            ]
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _SCHEMA.split(", ")])
            yield frame.astype({"level": "Int32"})

    return df.where(F.col(html).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(html).alias("t")).mapInPandas(run, _SCHEMA)


def blocks_to_html(df: DataFrame, key: str, content: str) -> DataFrame:
    """``doc_key, block_no, block_type, html``: each block of a chapter's content as HTML.

    Content is read as leniently as by :func:`textloom.operators.nested.read_document`; what holds no document has none.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, x.get("type") if isinstance(x.get("type"), str) else None, render_block(x)) for k, t in zip(b["k"], b["t"], strict=True) for n, x in enumerate(_many(read_document(t))) if isinstance(x, dict)]
            yield pd.DataFrame(rows, columns=["doc_key", "block_no", "block_type", "html"])

    return df.where(F.col(content).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(content).alias("t")).mapInPandas(run, "doc_key string, block_no int, block_type string, html string")
