"""Splitting oversized items at natural boundaries: content-defined chunking.

A rolling hash over the last characters of each place sets landmarks. From where a piece begins, the first landmark
between the minimum and the maximum size is taken and snapped to the nearest natural boundary of the highest rank around
it, so where a text is cut depends on what stands there and not on where it stands: an edit alters the pieces around it,
and the cuts after it fall on the same landmarks again. Each piece after the first repeats the end of the one before,
from a boundary if there is one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a unit, the units an item or piece may have, and the characters repeated.
CHARS_PER_UNIT, MAX_UNITS, OVERLAP = 3, 2000, 150
#: Landmarks stand once in so many characters on average; no piece is cut before the minimum share of its maximum.
LANDMARK_EVERY, MIN_SHARE = 1024, 0.4
#: How far a landmark looks for a boundary.
SNAP = 400
_WINDOW = 16

# Natural boundaries from the strongest: paragraphs and blocks, sentences, lines, clauses, words.
_BLOCK_END = r"\n[ \t]*\n+|</(?:p|div|h[1-6]|li|ul|ol|table|tr|section|blockquote|pre)>|(?<=[}\]])[ \n]*,[ \n]*(?=\{\"(?:type|id|content)\")"
_RANKS = [
    re.compile(_BLOCK_END, re.IGNORECASE),
    re.compile(r"[.!?…]+[)\]’'”»\"]*(?=\s)|[。！？｡]+[」』”’）]*"),
    re.compile(r"\n+"),
    re.compile(r"[,;:](?=\s)|[，；：、]"),
    re.compile(r"\s+"),
]
_GEAR = np.random.default_rng(20240229).integers(1, 2**32, 4096, dtype=np.uint64).astype(np.uint32)


def units(text: Column, chars_per_unit: int = CHARS_PER_UNIT) -> Column:
    """The size of a text in units, rounded down; null for null."""
    return F.floor(F.length(text) / F.lit(chars_per_unit)).cast("long")


def landmarks(text: str, every: int = LANDMARK_EVERY) -> np.ndarray:
    """The places of ``text`` whose preceding characters hash to a landmark."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    g = _GEAR[cps & np.uint32(4095)]
    h = np.zeros(len(cps), dtype=np.uint32)
    for j in range(min(_WINDOW, len(cps))):
        h[j:] += g[: len(g) - j] << np.uint32(j)
    return np.flatnonzero((h >> np.uint32(_WINDOW)) % np.uint32(every) == 0) + 1


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a character from its marks."""
    c = text[at]
    return unicodedata.combining(c) != 0 or c in "‍️" or text[at - 1] == "‍" or 0xDC00 <= ord(c) <= 0xDFFF or 0x1F3FB <= ord(c) <= 0x1F3FF


def boundary_near(text: str, at: int, low: int, high: int, snap: int = SNAP) -> int | None:
    """The boundary nearest to ``at``, of the highest rank that has one within ``snap``, in ``(low, high]``."""
    lo, hi = max(low, at - snap), min(high, at + snap)
    for rank in _RANKS:
        best = None
        for m in rank.finditer(text, max(0, lo - 8), min(len(text), hi + 8)):
            e = m.end()
            if lo < e <= hi and (best is None or abs(e - at) < abs(best - at)):
                best = e
        if best is not None:
            return best
    return None


def cut_places(text: str, first: int, later: int, every: int = LANDMARK_EVERY) -> list[int]:
    """The ends of the pieces of ``text``: the first of at most ``first`` characters, others of ``later``."""
    marks = landmarks(text, every)
    out: list[int] = []
    begin, n, size = 0, len(text), first
    while n - begin > size:
        low, high = begin + int(size * MIN_SHARE), begin + size
        i = int(np.searchsorted(marks, low, side="right"))
        at = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        cut = boundary_near(text, at, low, high)
        if cut is None:
            # No landmark has a boundary: the last boundary before the maximum, else the maximum itself.
            for rank in _RANKS:
                ends = [m.end() for m in rank.finditer(text, low, high) if m.end() <= high]
                if ends:
                    cut = ends[-1]
                    break
        if cut is None or cut <= begin:
            cut = high
            while cut > begin + 1 and _joined(text, cut):
                cut -= 1
            if cut == begin + 1:
                cut = high
        out.append(cut)
        begin, size = cut, later
    out.append(n)
    return out


def repeat_from(text: str, cut: int, begin: int, overlap: int = OVERLAP) -> int:
    """Where the piece after ``cut`` begins: up to ``overlap`` characters before, at a boundary if one is there."""
    low = max(begin, cut - overlap)
    if low == 0 or overlap == 0:
        return low if overlap else cut
    for rank in (_RANKS[0], _RANKS[1], _RANKS[4]):
        for m in rank.finditer(text, max(0, low - 8), cut):
            if low <= m.end() < cut - overlap // 3:
                return m.end()
    while low < cut and _joined(text, low):
        low += 1
    return low


def split_text(text: str, max_chars: int, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(begin, new, end)`` of each piece of at most ``max_chars``: it repeats ``begin`` to ``new`` of the piece before."""
    ends = cut_places(text, max_chars, max(1, max_chars - overlap))
    out, begin, new = [], 0, 0
    for e in ends:
        out.append((begin, new, e))
        begin, new = repeat_from(text, e, new, overlap), e
    return out


def split_items(df: DataFrame, key: str, text: str, max_units: int = MAX_UNITS, overlap: int = OVERLAP, chars_per_unit: int = CHARS_PER_UNIT) -> DataFrame:
    """``item_key, piece_no, pieces, begin_char, new_char, end_char, piece``: the pieces of each item of more than ``max_units``.

    Pieces are numbered from 1 and have at most ``max_units`` each; ``piece`` is the text from ``begin_char`` to
    ``end_char``, of which what lies before ``new_char`` is repeated. Items within the limit, null texts and rows without a key give no row.
    A text without any boundary is cut at the limit, never between a character and its marks. Items stored twice are each
    cut. Sizes are taken before any text reaches Python.
    """
    max_chars = (max_units + 1) * chars_per_unit - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch["k"], batch["t"], strict=True):
                found = split_text(t, max_chars, overlap)
                for lo in range(0, len(found), 1000):
                    yield pd.DataFrame(
                        [(k, n, len(found), b, new, e, t[b:e]) for n, (b, new, e) in enumerate(found[lo : lo + 1000], lo + 1)],
                        columns=["item_key", "piece_no", "pieces", "begin_char", "new_char", "end_char", "piece"],
                    )

    big = df.where((units(F.col(text), chars_per_unit) > max_units) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return big.mapInPandas(run, "item_key long, piece_no int, pieces int, begin_char long, new_char long, end_char long, piece string")
