"""Books as EPUB files."""

from __future__ import annotations

import hashlib
import html
import io
import posixpath
import zipfile
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.names import sanitize_filename
from textloom.operators.html_blocks import render_block
from textloom.operators.nested import read_document

_E = html.escape
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
_STAMP = (1980, 1, 1, 0, 0, 0)


def container_xml(package: str) -> str:
    root = f'<rootfile full-path="{_E(package)}" media-type="application/oebps-package+xml"/>'
    return f'{_HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>{root}</rootfiles></container>'


def page(title: str | None, body: str, styles: list[str] | None = None, css: str | None = None) -> str:
    """A page: its title if it has one, links to the style sheets, its own style, its body."""
    head = f"<title>{_E(title)}</title>" if title else ""
    head += "".join(f'<link rel="stylesheet" type="text/css" href="../styles/{_E(posixpath.basename(s))}"/>' for s in styles or [])
    head += f'<style type="text/css">{_E(css, quote=False)}</style>' if css else ""
    return f'{_HEAD}<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head>{head}</head><body>{body}</body></html>'


def _shown(chapter: dict[str, Any]) -> str | None:
    return (chapter.get("title_target") or chapter.get("title")) if chapter.get("title") else None


def package_xml(book: dict[str, Any], chapters: list[dict[str, Any]], resources: list[dict[str, Any]]) -> str:
    """The package file: target title and language before the source's, an ISBN or an id made from the book's key."""
    identity = f"urn:isbn:{book['isbn']}" if book.get("isbn") else "urn:uuid:" + _uuid(str(book.get("key") or book.get("title") or ""))
    meta = [f"<dc:title>{_E(book.get('title_target') or book.get('title') or '')}</dc:title>", f"<dc:language>{_E(book.get('language_target') or book.get('language') or '')}</dc:language>"]
    meta += [f"<dc:creator>{_E(a)}</dc:creator>" for a in book.get("authors") or [] if a]
    meta += [f"<dc:publisher>{_E(book['publisher'])}</dc:publisher>"] if book.get("publisher") else []
    meta += [f'<dc:identifier id="pub-id">{_E(identity)}</dc:identifier>']
    meta += ['<meta name="cover" content="img-cover"/>'] if book.get("cover") else []
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>']
    names = [posixpath.basename(c["chapter_id"]) for c in chapters]
    items += [f'<item id="chap-{_E(n)}" href="text/{_E(n)}" media-type="application/xhtml+xml"/>' for n in names]
    for r in resources:
        n = posixpath.basename(r["href"])
        if r["media_type"] == "text/css":
            items.append(f'<item id="css-{_E(n)}" href="styles/{_E(n)}" media-type="text/css"/>')
        else:
            cover = r["href"] == book.get("cover")
            items.append(f'<item id="{"img-cover" if cover else f"img-{_E(n)}"}" href="images/{_E(n)}" media-type="{_E(r["media_type"])}"{" properties=" + chr(34) + "cover-image" + chr(34) if cover else ""}/>')
    spine = "".join(f'<itemref idref="chap-{_E(n)}"/>' for n in names)
    return f'{_HEAD}<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="pub-id" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{"".join(meta)}</metadata><manifest>{"".join(items)}</manifest><spine>{spine}</spine></package>'


def _uuid(key: str) -> str:
    d = hashlib.sha256(key.encode()).hexdigest()
    return f"{d[:8]}-{d[8:12]}-4{d[13:16]}-a{d[17:20]}-{d[20:32]}"


def navigation_page(chapters: list[dict[str, Any]]) -> str:
    """The navigation: the chapters that have a title."""
    links = "".join(f'<li><a href="text/{_E(posixpath.basename(c["chapter_id"]))}">{_E(t)}</a></li>' for c in chapters if (t := _shown(c)))
    return page("Table of Contents", f'<nav epub:type="toc"><h1>Table of Contents</h1><ol>{links}</ol></nav>')


def build_epub(book: dict[str, Any], chapters: list[dict[str, Any]], resources: list[dict[str, Any]]) -> bytes:
    """The bytes of a book's file; the same book gives the same bytes. Of resources with one file name the last is kept."""
    styles = [r["href"] for r in resources if r["media_type"] == "text/css"]
    files: dict[str, bytes] = {"META-INF/container.xml": container_xml("OEBPS/content.opf").encode()}
    for c in chapters:
        content = read_document(c.get("content")) or []
        body = "".join(render_block(b) for b in (content if isinstance(content, list) else [content]) if isinstance(b, dict))
        files[f"OEBPS/text/{posixpath.basename(c['chapter_id'])}"] = page(_shown(c), body, styles, c.get("css")).encode("utf-8", "replace")
    for r in resources:
        files[f"OEBPS/{'styles' if r['media_type'] == 'text/css' else 'images'}/{posixpath.basename(r['href'])}"] = bytes(r["content"])
    files["OEBPS/content.opf"] = package_xml(book, chapters, resources).encode("utf-8", "replace")
    files["OEBPS/nav.xhtml"] = navigation_page(chapters).encode("utf-8", "replace")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", _STAMP), "application/epub+zip", zipfile.ZIP_STORED)
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, _STAMP), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epub_path(title: Column, language: Column) -> Column:
    return F.concat(F.lit("epub_translated/"), sanitize_filename(title), F.lit("_"), F.regexp_replace(language, "-", "_"), F.lit(".epub"))


def build_epubs(books: DataFrame, chapters: DataFrame, resources: DataFrame | None, key: str) -> DataFrame:
    """``key, epub``: the file of each book. A book, with its chapters and resources, is one row and one file.

    ``books`` has ``title, title_target, authors, language, language_target, publisher, isbn, cover``; ``chapters``
    ``chapter_pos, chapter_id, title, title_target, css, content``; ``resources`` ``href, media_type, content``. Columns
    that are missing count as null.
    """

    def packed(df: DataFrame, fields: list[str]) -> Column:
        return F.struct(*[(F.col(f) if f in df.columns else F.lit(None).cast("string")).alias(f) for f in fields])

    ch = chapters.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("chapter_pos").alias("pos"), packed(chapters, ["chapter_id", "title", "title_target", "css", "content"]).alias("c")))).alias("chapters"))
    own = books.select(F.col(key).alias("k"), packed(books, ["title", "title_target", "language", "language_target", "publisher", "isbn", "cover"]).alias("book"), (F.col("authors") if "authors" in books.columns else F.array().cast("array<string>")).alias("authors"))
    joined = own.join(ch, "k", "left")
    if resources is not None:
        rs = resources.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_list(F.struct("href", "media_type", "content"))).alias("resources"))
        joined = joined.join(rs, "k", "left")
    else:
        joined = joined.withColumn("resources", F.array().cast("array<struct<href:string,media_type:string,content:binary>>"))

    def run(batches: Any) -> Any:
        for b in batches:
            rows = []
            for k, book, authors, chs, res in zip(b["k"], b["book"], b["authors"], b["chapters"], b["resources"], strict=True):
                own_chapters = [dict(x["c"]) for x in (chs if chs is not None else [])]
                own_resources = [dict(x) for x in (res if res is not None else [])]
                rows.append((k, build_epub({**dict(book), "authors": list(authors) if authors is not None else [], "key": str(k)}, [c for c in own_chapters if c["chapter_id"]], own_resources)))
            yield pd.DataFrame(rows, columns=["k", "epub"])

    kind = books.schema[key].dataType.simpleString()
    return joined.select("k", "book", "authors", "chapters", "resources").mapInPandas(run, f"k {kind}, epub binary").withColumnRenamed("k", key)
