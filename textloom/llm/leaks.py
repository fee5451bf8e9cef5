"""Evaluation texts that occur, whole or in part and not always letter by letter, in a training corpus.

Wu-Manber multi-pattern search. The patterns are short runs of words of the test items ("seeds"): where a document holds
15 words of an item of which at most one in ten is changed, added or left out, it holds one such run unchanged, since n
words with n/10 changes leave a run of at least 6 (for scripts without spaces: 30 characters, a run of 7). A table says
for each block of characters how far the search can move on; almost every block of an ordinary text moves it by nearly
a whole pattern. A block of zero shift selects a bucket of patterns, whose texts are compared directly, and the place is
then extended both ways word by word with as many changes as its length allows.

The items are the stated query set. Their characters are counted first and the items cut into blocks of a bounded size; all
documents are searched for one block after the other, so no executor (and not the driver) holds more than one block's
tables. Each document is one row of one task; nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.plain import blocks
from textloom.tables import cut_lineage

MIN_WORDS, SEED_WORDS = 15, 6
MIN_CHARS, SEED_CHARS = 30, 7
#: Characters of items of a block, whose tables are sent to the executors at once (some hundred bytes for each).
BLOCK_CHARS = 2_000_000

_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_WORDLESS = re.compile(r"[\W_]+")
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def fold(text: str) -> str:
    """Without case and diacritics."""
    text = text.casefold()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def word_string(text: str) -> str:
    """The words of ``text``, folded, each followed by one blank, after a first blank."""
    text = fold(text)
    words = (text.encode("ascii").translate(_ASCII).decode("ascii") if text.isascii() else _WORDLESS.sub(" ", text)).split()
    return f" {' '.join(words)} " if words else " "


def char_string(text: str) -> str:
    """The letters and digits of ``text``, folded."""
    return _WORDLESS.sub("", fold(text))


@dataclass
class Searcher:
    """The shift table, the buckets and the items of one unit (words or characters)."""

    block: int
    length: int = 0
    shift: dict[str, int] = field(default_factory=dict)
    buckets: dict[str, list[tuple[str, int, int]]] = field(default_factory=dict)

    @staticmethod
    def build(patterns: list[tuple[str, int, int]], block: int) -> Searcher | None:
        """``patterns``: text, item number, place in the item."""
        if not patterns:
            return None
        s = Searcher(block=block, length=min(len(p) for p, _, _ in patterns))
        s.block = min(block, s.length)
        for p, item, at in patterns:
            for end in range(s.block, s.length + 1):
                b, d = p[end - s.block : end], s.length - end
                if d < s.shift.get(b, s.length):
                    s.shift[b] = d
            s.buckets.setdefault(p[s.length - s.block : s.length], []).append((p, item, at))
        return s

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(place in the text, item number, place in the item)`` of each occurrence of a pattern."""
        block, far, shift, buckets = self.block, self.length - self.block + 1, self.shift, self.buckets
        i, n = self.length, len(text)
        while i <= n:
            b = text[i - block : i]
            d = shift.get(b, far)
            if d:
                i += d
                continue
            for p, item, at in buckets[b]:
                if text.startswith(p, i - self.length):
                    yield i - self.length, item, at
            i += 1


def reach(doc: list[str] | str, item: list[str] | str, d: int, i: int, step: int, most: int) -> list[int]:
    """For each number of changes up to ``most`` the item's units that match on from ``(d, i)`` in direction ``step``.

    A run ends with a unit that is the same in both.
    """
    n, m = (len(doc), len(item)) if step > 0 else (d + 1, i + 1)
    room_d, room_i = (n - d, m - i) if step > 0 else (n, m)

    def slide(x: int, diagonal: int) -> int:
        y = x + diagonal
        while x < room_i and y < room_d and item[i + step * x] == doc[d + step * y]:
            x += 1
            y += 1
        return x

    front = {0: slide(0, 0)}
    best = front[0]
    out = [best]
    for _ in range(most):
        new: dict[int, int] = {}
        for diagonal, x in front.items():
            for to, nx in ((diagonal, x + 1), (diagonal - 1, x + 1), (diagonal + 1, x)):
                if nx <= room_i and 0 <= nx + to <= room_d and nx > new.get(to, -1):
                    new[to] = nx
        front = {}
        for diagonal, x in new.items():
            y = slide(x, diagonal)
            front[diagonal] = y
            if y > x and y > best:
                best = y
        out.append(best)
    return out


def covered(doc: list[str] | str, item: list[str] | str, d: int, i: int, seed: int, least: int) -> int:
    """The most units of ``item`` around a seed at ``(d, i)`` that ``doc`` holds with at most one in ten changed; 0 if under ``least``."""
    most = len(item) // 10
    right = reach(doc, item, d + seed, i + seed, 1, most)
    left = reach(doc, item, d - 1, i - 1, -1, most)
    best = 0
    for a, x in enumerate(left):
        for b, y in enumerate(right):
            total = seed + x + y
            if total >= least and a + b <= total // 10:
                best = max(best, total)
    return best


class LeakFinder:
    """The tables of a block of items. ``items``: key and text of each; null and wordless texts have no pattern."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.keys: list[int] = []
        self.units: list[list[str] | str] = []
        words: list[tuple[str, int, int]] = []
        chars: list[tuple[str, int, int]] = []
        texts = [(k, " ".join(blocks(t))) for k, t in items if t]
        for key, text in texts:
            n = len(self.keys)
            self.keys.append(key)
            if _is_cjk(text):
                s = char_string(text)
                self.units.append(s)
                chars += [(s[a : a + SEED_CHARS], n, a) for a in range(len(s) - SEED_CHARS + 1)] if len(s) >= MIN_CHARS else []
            else:
                w = word_string(text).split()
                self.units.append(w)
                words += [(f" {' '.join(w[a : a + SEED_WORDS])} ", n, a) for a in range(len(w) - SEED_WORDS + 1)] if len(w) >= MIN_WORDS else []
        self.words, self.chars = Searcher.build(words, 8), Searcher.build(chars, 3)

    def search(self, text: str, largest: bool = True) -> dict[int, int]:
        """The keys of the items that ``text`` leaks, with the size of the largest passage of each.

        Without ``largest`` an item is passed over once it is found, and the size is that of its first passage.
        """
        parts = blocks(text)
        found: dict[int, int] = {}
        # By item and diagonal the place after the last seed: a seed that goes on there reaches no further than the first of its
        # run. So a text that repeats itself costs one extension for each diagonal, not for each pair of places.
        last: dict[tuple[int, int], int] = {}

        def wanted(item: int, d: int, p: int) -> bool:
            known = found.get(item, 0)
            goes_on = last.get((item, d - p)) == d
            last[item, d - p] = d + 1
            return not goes_on and (known < len(self.units[item]) if largest else not known)

        if self.words and parts:
            s = word_string(" ".join(parts))
            doc: list[str] | None = None
            d = counted = 0
            for at, item, p in self.words.find(s):
                doc = doc or s.split()
                d, counted = d + s.count(" ", counted, at), at
                if wanted(item, d, p):
                    found[item] = max(found.get(item, 0), covered(doc, self.units[item], d, p, SEED_WORDS, MIN_WORDS))
        # The parts are decoded; the text itself may hold these scripts only as escapes or entities.
        if self.chars and any(map(_CJK.search, parts)):
            s = char_string("".join(parts))
            for at, item, p in self.chars.find(s):
                if wanted(item, at, p):
                    found[item] = max(found.get(item, 0), covered(s, self.units[item], at, p, SEED_CHARS, MIN_CHARS))
        return {self.keys[n]: size for n, size in found.items() if size}


def _is_cjk(text: str) -> bool:
    n = len(_CJK.findall(text))
    return n * 2 > sum(c.isalpha() for c in text)


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, largest: bool = True) -> DataFrame:
    """``doc_key, item_key, units``: each document with each item of which it holds a passage, and the size of
    the largest (without ``largest``, of the first, which takes less time).

    Sizes are words of the item, or characters in scripts without spaces. Null, empty and wordless texts on either side
    match nothing, nor do rows without a key; an item shorter than a passage has no passage; items stored twice are each
    reported. ``items`` is the query set: a hash of their keys deals them to blocks of about :data:`BLOCK_CHARS` characters, and
    all documents are searched for one block after the other. What is found doesn't depend on the blocks.
    """
    own = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t"))
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    asked = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_key"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    done: DataFrame | None = None
    for n in range(n_blocks):
        rows = [(r[0], r[1]) for r in own.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == n).collect()]  # one block
        shared = context.broadcast(rows)
        found = asked.mapInPandas(_search(shared, largest), "doc_key long, item_key long, units int")
        if n_blocks > 1:
            found = cut_lineage(found)
            shared.unpersist()
        done = found if done is None else done.unionByName(found)
    return done


def _search(shared: Any, largest: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = LeakFinder(shared.value)
        for batch in batches:
            out = [(k, item, size) for k, t in zip(batch["doc_key"], batch["text"], strict=True) for item, size in finder.search(t, largest).items()]
            yield pd.DataFrame(out, columns=["doc_key", "item_key", "units"])

    return run
