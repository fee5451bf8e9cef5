"""EPUB files as tables of books, chapters and resources."""

from __future__ import annotations

import io
import json
import posixpath
import re
import urllib.parse
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.html_blocks import parse_blocks, parse_tree


@dataclass
class Epub:
    """What an EPUB holds. Chapters are in reading order; resources are by their place beside the package file."""

    metadata: dict[str, object] = field(default_factory=dict)
    chapters: list[dict[str, object]] = field(default_factory=list)
    resources: list[dict[str, object]] = field(default_factory=list)


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in root.iter() if _name(x.tag) == name]


def _text(root: ElementTree.Element, name: str) -> str:
    found = _all(root, name)
    return ("".join(found[0].itertext())).strip() if found else ""


def _xml(data: bytes) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return None


def _navigation(name: str, data: bytes, base: str) -> tuple[dict[str, str], dict[str, str], list[str]]:
    """Titles and types of chapters by href, and the hrefs a navigation file links to; the last entry of an href counts."""
    titles: dict[str, str] = {}
    types: dict[str, str] = {}

    def at(href: str) -> str:
        return posixpath.normpath(posixpath.join(base, urllib.parse.unquote(href.split("#")[0])))

    if name.endswith(".ncx"):
        root = _xml(data)
        for point in _all(root, "navPoint") if root is not None else []:
            label, content = _all(point, "text"), _all(point, "content")
            if label and content and (label[0].text or "").strip() and content[0].get("src"):
                titles[at(content[0].get("src"))] = label[0].text.strip()
        return titles, types, list(titles)
    tree = parse_tree(data.decode("utf-8", "replace"))
    navs = list(tree.elements("nav"))
    toc = next((n for n in navs if n.attrs.get("epub:type") == "toc"), navs[0] if navs else None)
    if toc is not None:
        for a in toc.elements("a"):
            if a.attrs.get("href") and a.text().strip():
                titles[at(a.attrs["href"])] = a.text().strip()
    for n in navs:
        for a in n.elements("a"):
            if n.attrs.get("epub:type") and a.attrs.get("href"):
                types[at(a.attrs["href"])] = n.attrs["epub:type"]
    return titles, types, list(titles)


def parse_epub(data: bytes, key: str = "") -> Epub:
    """The book in ``data``. A file that is no EPUB, or lacks its package file, gives an empty one."""
    book = Epub()
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = set(archive.namelist())
        container = _xml(archive.read("META-INF/container.xml")) if "META-INF/container.xml" in names else None
        roots = [x.get("full-path") for x in _all(container, "rootfile")] if container is not None else []
        package = next((p for p in roots if p in names), None)
        opf = _xml(archive.read(package)) if package else None
    except (zipfile.BadZipFile, KeyError, OSError):
        return book
    if opf is None:
        return book
    folder = posixpath.dirname(package)
    ids = _all(opf, "identifier")
    isbn = next(("".join(x.itertext()).strip() for x in ids if x.get("id") == "pub-identifier"), None)
    isbn = isbn or next(("".join(x.itertext()).strip().rsplit(":", 1)[-1] for x in ids if "urn:isbn:" in "".join(x.itertext())), None)
    cover_id = next((m.get("content") for m in _all(opf, "meta") if m.get("name") == "cover"), None)
    book.metadata = {
        "title": _text(opf, "title"),
        "authors": [a for x in _all(opf, "creator") if (a := "".join(x.itertext()).strip())],
        "language": _text(opf, "language"),
        "publisher": _text(opf, "publisher"),
        "isbn": isbn,
        "cover": None,
    }
    manifest: dict[str, tuple[str, str, str]] = {}
    navs: list[tuple[int, str]] = []
    for item in _all(opf, "item"):
        i, href, kind = item.get("id"), item.get("href"), item.get("media-type")
        full = posixpath.normpath(posixpath.join(folder, urllib.parse.unquote(href))) if href else ""
        if not (i and href and kind) or full not in names:
            continue
        manifest[i] = (href, kind, full)
        if i == cover_id:
            book.metadata["cover"] = href
        if "nav" in (item.get("properties") or "").split():
            navs.append((0, href))
        elif kind == "application/x-dtbncx+xml":
            navs.append((1, href))
        if kind == "text/css" or kind.startswith("image/"):
            book.resources.append({"href": href, "media_type": kind, "content": archive.read(full)})
    titles: dict[str, str] = {}
    types: dict[str, str] = {}
    if navs:
        href = min(navs)[1]
        titles, types, _ = _navigation(href, archive.read(posixpath.normpath(posixpath.join(folder, href))), posixpath.dirname(href))
    images = {r["href"] for r in book.resources if str(r["media_type"]).startswith("image/")}
    for ref in _all(opf, "itemref"):
        if ref.get("idref") not in manifest:
            continue
        href, _, full = manifest[ref.get("idref")]
        source = archive.read(full).decode("utf-8", "replace")
        style = next((n.text() for n in parse_tree(source).elements("style") if n.text()), None)
        clean = posixpath.normpath(href)
        blocks = parse_blocks(source, f"{key}|{href}", posixpath.dirname(href), images, unwrap=True)
        book.chapters.append({"chapter_id": href, "title": titles.get(clean), "nav_type": types.get(clean), "css": style, "content": json.dumps(blocks, ensure_ascii=False)})
    return book


_TABLES = {
    "books": "path string, title string, authors array<string>, language string, publisher string, isbn string, cover string",
    "chapters": "path string, chapter_pos int, chapter_id string, title string, nav_type string, css string, content string",
    "resources": "path string, href string, media_type string, content binary",
}


def read_epubs(spark: SparkSession, path: str, what: str) -> DataFrame:
    """The ``books``, ``chapters`` or ``resources`` of all EPUB files under ``path``; a file is one row of one task.

    ``content`` of a chapter is a JSON array of blocks. Broken files give a book without a title and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _TABLES[what].split(", ")]
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                book = parse_epub(bytes(data), p)
                if what == "books":
                    m = book.metadata
                    rows = [(p, m.get("title"), m.get("authors") or [], m.get("language"), m.get("publisher"), m.get("isbn"), m.get("cover"))]
                elif what == "chapters":
                    rows = [(p, n, c["chapter_id"], c["title"], c["nav_type"], c["css"], c["content"]) for n, c in enumerate(book.chapters)]
                else:
                    rows = [(p, r["href"], r["media_type"], r["content"]) for r in book.resources]
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInPandas(run, _TABLES[what])


def is_contents(chapter: Column, nav_type: Column, title: Column) -> Column:
    """Whether a chapter is a table of contents, by its type or its title."""
    # How types, file names and titles of contents are told.
    typed = nav_type.rlike(r"\btoc\b") & chapter.rlike("toc|nav|contents")
    return F.coalesce(typed, F.lit(False)) | F.coalesce(F.lower(title).contains("contents") | title.contains("目录"), F.lit(False))


def spine_chapters(spine: DataFrame, manifest: DataFrame, titles: DataFrame, book: str) -> DataFrame:
    """``book, pos, href, title``: the reading order (``idref, pos``) joined with the manifest (``id, href``) and the titles
    (``href, title, pos``; the last one of an href counts). Entries the manifest lacks are left out."""
    last = titles.groupBy(book, F.substring_index("href", "#", 1).alias("href")).agg(F.max_by("title", "pos").alias("title"))
    return spine.join(manifest, (spine[book] == manifest[book]) & (spine["idref"] == manifest["id"])).select(spine[book], spine["pos"], manifest["href"]).join(last, [book, "href"], "left").select(book, "pos", "href", "title")
