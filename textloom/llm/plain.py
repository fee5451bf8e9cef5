"""The words of a text that is delivered as plain text, SRT, Markdown, HTML or JSON.

:func:`blocks` drops markup, field names, ids, subtitle numbers and times, and keeps everything else in order. Paragraphs,
HTML blocks, JSON strings and Markdown entries are blocks of their own; subtitle entries run on.
"""

from __future__ import annotations

import html
import json
import re

_TIME = r"[ \t]*(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?[ \t]*-->[ \t]*(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?[^\n]*"
_SUBTITLE = re.compile(rf"\s*(?:^|(?<=\n))[ \t]*(?:\d+[ \t]*\r?\n)?{_TIME}(?:\r?\n|\Z)")
_HEADED = re.compile(rf"(?:\A|\n)[ \t]*#+{_TIME}(?:\n|\Z)")
_BLOCK_TAG = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|br|hr|tr|td|th|table|section|article|blockquote|pre|body|html|title|head|nav|header|footer)\b[^<>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.DOTALL)
_MARK = re.compile(r"(?m)\*\*|__|~~|^[ \t]*(?:#{1,6}|>|[*+](?=\s)|```.*|\|)[ \t]*|`")
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_JOINT = re.compile(f"(?<=[{_CJK}，、。！？」』”])\\x1f(?=[{_CJK}，、。！？「『“])")
_BREAK = re.compile(r"\n[ \t]*\n|\x1e")
_KEY = re.compile(r'"[\w\-. ]{1,64}"[ \t]*:')
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"?')
_ID = re.compile(r"[\w.:/#\-]*\Z", re.ASCII)


def _strings(value: object) -> list[str]:
    """The strings of a JSON value that hold words rather than ids, in order."""
    out: list[str] = []
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if not _ID.match(x):
                out.append(x)
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            todo += reversed(x.values())
    return out


def _unescape(s: str) -> str:
    try:
        return json.loads(f'"{s}"')
    except ValueError:
        return s.replace('\\"', '"').replace("\\n", "\n")


def _json_blocks(text: str) -> list[str] | None:
    try:
        return _strings(json.loads(text))
    except (ValueError, RecursionError):
        if not _KEY.search(text):
            return None
    return [s for s in (_unescape(x) for x in _STRING.findall(_KEY.sub("\x1e", text))) if not _ID.match(s)]


def blocks(text: str | None) -> list[str]:
    """The blocks of words in ``text``; none for null, blank and wordless texts."""
    if not text:
        return []
    head = text.lstrip()[:1]
    parts = _json_blocks(text) if head in ("[", "{") else None
    out: list[str] = []
    for part in [text] if parts is None else parts:
        if "-->" in part:
            part = _HEADED.sub("\x1e", part)
            part = _SUBTITLE.sub("\x1f", part)
            part = _JOINT.sub("", part).replace("\x1f", " ")
        if "<" in part:
            part = _TAG.sub("", _BLOCK_TAG.sub("\x1e", part))
        if "&" in part:
            part = html.unescape(part)
        if "#" in part or "*" in part or "`" in part or ">" in part or "|" in part or "__" in part:
            part = _MARK.sub("", part)
        out += [b for b in _BREAK.split(part) if b and not b.isspace()]
    return out
