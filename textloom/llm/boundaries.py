"""The boundary rules as a finite transducer over a small alphabet.

A text is a row of *chunks*, cut at blanks (or between letters of a script without spaces). A chunk is first read by one
regular expression into *events*: marks that can end a sentence, and quotation marks. Each event carries where it ends, its
symbol, what lies between it and the event before, and the class of what follows it. All rules are then tables over a state:

* which style of quotation is open, if any,
* what stands right before: an end or a quotation mark (touching, or with blanks or other marks since), a word after which a
  number with a point is an ordinal, the first half of an abbreviation in two parts, or anything else.

So what a chunk does is a function on :data:`STATES` states, whatever came before it. What a chunk lets the chunks before it see
is a second automaton, run from the right: the class of its first word, whether a verb of saying comes first, whether it begins
with a closing mark, and for each style of quotation whether a closing or another opening mark comes next. Both compose
associatively, so a prefix scan over chunks gives each its entry state and its right context, and the ends are the same however
a text is cut.

What is said in quotation marks ends no sentence, however long it is; the ends in a quotation count where no closing mark
comes before another opening one of its style or the end of the text, unless the text itself breaks off there.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

# Abbreviations that never end a sentence (a name, a number or a list follows them) and those that may.
NEVER = frozenset(
    "dr dra mr mrs ms prof проф st sr sra srta hr p pp pág págs pag fig figs abb nr núm vol bd kap cap см стр рис vs e.g i.e z.b ej ex p.ej p.ex bzw ca approx напр т.е d.h cf vgl gen col lt sgt rev hon им ул chap sec ch eq".split()
)
MAYBE = frozenset("etc usw env ч a.m p.m u.s.w т.д т.п др пр inc ltd co corp jr al ff u.a usf u.s u.k".split())

U, L, D, C, K, SMALL_K, J, E, PASS, KP = range(10)

# Symbols. Ends: plain mark, mark after a word that may be an abbreviation, mark after a number, mark that always ends, ellipsis amid
# a script without spaces, an unmarked end, the end of a text; then marks of a chunk's first word that depend on the word before
# it: after a number, after the second half of an abbreviation. Then quotation marks.
S_PLAIN, S_MAYBE, S_NUMBER, S_ALWAYS, S_ELLIPSIS, S_BLANK, S_TEXT_END, S_FIRST_NUMBER, S_FIRST_D, S_FIRST_M = range(10)
Q_OPEN_E, Q_CLOSE_E, Q_LOW, Q_OPEN_F, Q_CLOSE_F, Q_OPEN_J, Q_CLOSE_J, Q_OPEN_S, Q_CLOSE_S = range(10, 19)
SYMBOLS = 19
_QUOTES = {"“": Q_OPEN_E, "”": Q_CLOSE_E, "„": Q_LOW, "«": Q_OPEN_F, "»": Q_CLOSE_F, "「": Q_OPEN_J, "『": Q_OPEN_J, "」": Q_CLOSE_J, "』": Q_CLOSE_J, '"': Q_OPEN_S}
_OPENS = {Q_OPEN_E: 1, Q_LOW: 2, Q_OPEN_F: 3, Q_OPEN_J: 4, Q_OPEN_S: 5}
_CLOSED_BY = {1: (Q_CLOSE_E,), 2: (Q_OPEN_E, Q_CLOSE_E), 3: (Q_CLOSE_F,), 4: (Q_CLOSE_J,), 5: (Q_CLOSE_S,)}
_CLOSING = frozenset((Q_CLOSE_E, Q_CLOSE_F, Q_CLOSE_J, Q_CLOSE_S))

# What stands right before. Anything else, a word before an ordinal, "a." or "p.", "т."; an end: touching, blanks since, marks
# since; a quotation mark: touching, blanks since.
N, N_ORD, N_AP, N_TE, E0, E1, E2, Q0, Q1 = range(9)
# What lies between two events, or an event and an edge of the chunk.
TOUCH, BLANKS, MARKS, WORDS = range(4)
STATES = 6 * 9  # state = 9 * style of the open quotation (0: none) + what stands right before
START = N
# What an event does: nothing, it may end a sentence, it closes a quotation that ends one, it closes what was never opened.
NOTHING, ENDING, CLOSING, STRAY = range(4)


def _after(before: int, between: int) -> int:
    if between == TOUCH:
        return before
    if between == BLANKS:
        return {E0: E1, Q0: Q1}.get(before, before)
    return E2 if between == MARKS and before in (E0, E1, E2) else N


def _step(state: int, between: int, symbol: int) -> tuple[int, int]:
    """The state after an event, and what the event does."""
    style, before = divmod(state, 9)
    if symbol == S_FIRST_NUMBER and before == N_ORD or symbol == S_FIRST_D and before != N_TE or symbol == S_FIRST_M and before != N_AP:
        return 9 * style + N, NOTHING  # no end: an ordinal, an initial
    at = _after(before, between)
    ended = at in (E0, E1, E2)
    if symbol == S_TEXT_END:
        return N, ENDING
    if symbol <= S_FIRST_M:
        return (9 * style + E2, NOTHING) if ended else (9 * style + E0, ENDING)
    touches = at == E0 or at == E1 and symbol == Q_CLOSE_F
    if style and symbol in _CLOSED_BY[style]:
        return (E0, CLOSING) if touches else (Q0, NOTHING)
    if symbol in _CLOSING:
        return 9 * style + (E0 if touches else Q0), STRAY if touches and not style else NOTHING
    return 9 * (style or _OPENS[symbol]) + Q0, NOTHING


def _tables() -> tuple[list[bytes], list[bytes], list[bytes]]:
    steps = [[[_step(x, b, y) for x in range(STATES)] for b in range(4)] for y in range(SYMBOLS)]
    pad = bytes(256 - STATES)
    to, does = ([bytes(r[i] for r in row) + pad for own in steps for row in own] for i in (0, 1))
    edges = []
    for tail in range(4):
        for b in range(4):
            edges.append(bytes(x // 9 * 9 + (tail if b == WORDS else _after(x % 9, b)) for x in range(STATES)) + pad)
    return to, does, edges


#: By 4 * symbol + what lies between: the state each state leads to, and what the event does. By 4 * tail + what lies between the
#: last event and the chunk's end: the same for the edge.
TO, DOES, EDGE = _tables()
EDGE_AT_END = BLANKS
IDENTITY = bytes(range(STATES))

_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ々〆"
_EVENT = re.compile(r"[.!?…。！？｡]+|[“”„«»「」『』\"]")
# A word after which a number with a point is a day or another ordinal, and first halves of abbreviations.
_ORDINAL = re.compile(r"\b(?:[Aa]m|[Dd]e[rnms]|[Vv]om|[Zz]um|[Bb]is|[Ii]m|[Ss]eit|[Aa]b|[Uu]nd)\Z")
_HALVES = {"т.": N_TE, "a.": N_AP, "p.": N_AP}
_CLOSERS = re.compile(r"[)\]）】》〉’']*")
_WORD = re.compile(r"[\w.]+$")
_SKIP = re.compile(r"[\s​‎‏﻿\-–—―♪]*")
_SAID = re.compile(r"[说喊问答叫嚷喝]|[。！？｡“「]")
_CJK_CHAR = re.compile(f"[{_CJK}]")
_BLANK_END = re.compile(f"(?<=[{_CJK}0-9A-Za-z”」』）)])[\\s　]+(?=[{_CJK}“「『0-9])")
_DASH_LINE = re.compile(r"(?<=[^\W_])[ \t]*\n\s*[-–—]\s*(?=[^\W\d_])")
_ALNUM = re.compile(r"[^\W_]")
_TRAIL = " \t\r\n\x0b\x0c\u3000\xa0)]）】》〉’'“”„«»「」『』\""
_MARKS = frozenset(".!?…。！？｡")
_OPENING = frozenset("“„«「『‘([（【¿¡\"<")
_PACK = struct.Struct("<iBBB")
# Where a complete text may be cut: between words, or within a run of letters of a script without spaces.
_LETTER = f"(?![{_CJK}])[^\\W\\d_]"
_CUT = re.compile(f"(?<={_LETTER}) (?={_LETTER})|(?<=[{_CJK}][{_CJK}][{_CJK}])(?=[{_CJK}]{{3}})")
#: Characters of a chunk of a complete text, at least.
CHUNK = 4096


def follow_class(text: str, at: int) -> int:
    """The class of what stands at ``at`` and after."""
    c = text[at : at + 1]
    if c.isspace():
        at += 1
        c = text[at : at + 1]
    if not c.isalnum():
        at = _SKIP.match(text, at).end()
        if at >= len(text):
            return PASS
        c = text[at]
    if c.isascii() and c.isalpha():
        return L if c.islower() else U
    if c in _OPENING:
        return U
    if c.isdigit():
        return D
    if c.isalpha():
        if _CJK_CHAR.match(c):
            if text.startswith(("と", "って"), at):
                return J
            m = _SAID.search(text, at)
            return KP if not m else K if m[0] in "说喊问答叫嚷喝" else SMALL_K
        return L if c.islower() else U
    if c in ",;:、，；：":
        return C
    return U


def chunk_said(text: str) -> int:
    """Whether a verb of saying (1) or an end (0) comes first in the chunk; 2: neither."""
    m = _SAID.search(text)
    return 2 if not m else int(m[0] in "说喊问答叫嚷喝")


def _between(text: str, begin: int, end: int) -> int:
    if begin >= end:
        return TOUCH
    part = text[begin:end]
    return BLANKS if part.isspace() else WORDS if _ALNUM.search(part) else MARKS


def _word_before(text: str, at: int) -> int:
    """What the last word before ``at`` makes of a number or letter that stands there; -1: it isn't in this chunk."""
    while at and text[at - 1].isspace():
        at -= 1
    if not at:
        return -1
    if text[at - 2 : at] in _HALVES and not text[max(0, at - 3) : at - 2].isalnum():
        return _HALVES[text[at - 2 : at]]
    return N_ORD if _ORDINAL.search(text, max(0, at - 5), at) else N


Event = tuple[int, int, int, int]


def scan_events(text: str, whole: bool, last: bool = False) -> list[Event]:
    """``(end, symbol, class of what follows, what lies between)`` of each event in a chunk.

    ``whole``: the chunk belongs to a text that is complete. Then blanks can mark an end in scripts without spaces, and a new
    dialogue line ends the one before. ``last``: it is the last chunk of such a text, whose end ends the last sentence.
    """
    out: list[Event] = []
    extra: list[int] = []
    if whole and not text.isascii() and _CJK_CHAR.search(text):
        extra += [m.start() for m in _BLANK_END.finditer(text) if _CJK_CHAR.match(text[m.end()]) or _CJK_CHAR.match(text[m.start() - 1]) or text[m.end()] in "“「『" and _CJK_CHAR.match(text, m.end() + 1)]
    if whole and "\n" in text:
        extra = sorted({*extra, *(m.start() for m in _DASH_LINE.finditer(text))})
    at = k = 0  # the end of the event before
    for m in _EVENT.finditer(text):
        s, e = m.span()
        while k < len(extra) and extra[k] <= s:
            out.append((extra[k], S_BLANK, U, _between(text, at, extra[k])))
            at, k = extra[k], k + 1
        c = text[s]
        symbol = _QUOTES.get(c)
        if symbol is not None:
            if symbol == Q_OPEN_S and (text[e : e + 1].strip() == "" or s and not text[s - 1].isspace() and text[s - 1] not in _OPENING and text[s - 1] not in "-–—"):
                symbol = Q_CLOSE_S
            end = _CLOSERS.match(text, e).end() if symbol in _CLOSING else e
            out.append((end, symbol, follow_class(text, end), _between(text, at, s)))
            at = end
            continue
        run = m[0]
        end = _CLOSERS.match(text, e).end()
        after = text[end : end + 1]
        if any(x in "。！？｡" for x in run):
            symbol = S_ALWAYS
        elif after and not after.isspace() and after not in _QUOTES and after not in "-–—" and not _CJK_CHAR.match(after):
            continue  # inside a number, an address or an abbreviation
        elif run == ".":
            w = _WORD.search(text, max(0, s - 24), s)
            word = w[0].lower().strip(".") if w else ""
            if word in MAYBE:
                symbol = S_MAYBE
            elif word in ("д", "п", "m"):
                half = _word_before(text, s - 1)
                if half < 0:
                    symbol = S_FIRST_M if word == "m" else S_FIRST_D
                elif half == (N_AP if word == "m" else N_TE):
                    symbol = S_MAYBE
                else:
                    continue
            elif word in NEVER or len(word) == 1 and not word.isdigit() and word.isalpha() and not _CJK_CHAR.match(word):
                continue
            elif word.isdigit():
                symbol = S_NUMBER
                if after and _CJK_CHAR.match(after):
                    continue
                if w.start() == s - len(word) and (len(word) == 1 or len(word) == 2 and word <= "31" and word > "0"):
                    before = _word_before(text, w.start())
                    if before == N_ORD:
                        continue
                    symbol = S_FIRST_NUMBER if before < 0 else S_NUMBER
            else:
                symbol = S_PLAIN
        elif run[0] == "…" and (_CJK_CHAR.match(text[s - 1 : s] or " ") or run == "……"):
            symbol = S_ELLIPSIS
        else:
            symbol = S_PLAIN
        out.append((end, symbol, follow_class(text, end), _between(text, at, s)))
        at = end
    for p in extra[k:]:
        out.append((p, S_BLANK, U, _between(text, at, p)))
        at = p
    if last:
        body = text.rstrip("​﻿ \t\r\n　\xa0\x0b\x0c  ")
        out.append((len(body), S_TEXT_END, E, _between(text, at, len(body))))
    return out


def pack_events(events: list[Event]) -> bytes:
    return b"".join([_PACK.pack(*e) for e in events])


def unpack_events(packed: bytes) -> list[Event]:
    return list(_PACK.iter_unpack(packed))


class Right(NamedTuple):
    """What a chunk, or the text from a place on, lets what stands before it see: the class of its beginning, its
    :func:`chunk_said`, and bits: for each style two (1 a closing mark comes next, 2 another opening one), two for how it ends
    (1 complete, 2 broken off) and two for its first mark (1 a closing mark that may stand off, 2 anything else)."""

    cls: int
    said: int
    marks: int

    def then(self, after: Right) -> Right:
        """Of this chunk followed by ``after``."""
        said = self.said if self.said != 2 else after.said
        cls = after.cls if self.cls == PASS else self.cls
        if cls == KP and said != 2:
            cls = K if said == 1 else SMALL_K
        marks = 0
        for shift in range(0, 14, 2):
            mine, theirs = self.marks >> shift & 3, after.marks >> shift & 3
            marks |= ((theirs or mine) if shift == _TAIL else (mine or theirs)) << shift
        return Right(cls, said, marks)


_TAIL, _HEAD = 10, 12
#: What follows the last chunk of a text, and a chunk that is empty.
END, EMPTY = Right(E, 0, 0), Right(PASS, 2, 0)


def _tail_of(text: str) -> int:
    """How a chunk ends: what doesn't end in a mark, or ends in dots, breaks off (2)."""
    body = text.rstrip(_TRAIL)
    return 0 if not body else 1 if body[-1] in _MARKS and not body.endswith(("…", "..")) else 2


def right_of(text: str, events: list[Event]) -> Right:
    marks = _tail_of(text) << _TAIL
    for _, symbol, _, _ in reversed(events):
        for style in range(1, 6) if symbol >= Q_OPEN_E else ():
            shift = 2 * style - 2
            if symbol in _CLOSED_BY[style]:
                marks = marks & ~(3 << shift) | 1 << shift
            elif _OPENS.get(symbol) == style:
                marks = marks & ~(3 << shift) | 2 << shift
    if text and not text.isspace():
        marks |= (1 if text.lstrip()[0] == "»" else 2) << _HEAD
    return Right(follow_class(text, 0), chunk_said(text) if not text.isascii() else 2, marks)


def edge_of(text: str, events: list[Event]) -> int:
    """Which of :data:`EDGE` holds from the last event to the end of the chunk and the blank after it."""
    begin = events[-1][0] if events else 0
    between = max(BLANKS, _between(text, begin, len(text)))
    return 4 * max(0, _word_before(text, len(text)) if between == WORDS else 0) + between


def function_of(events: list[Event], edge: int) -> bytes:
    """The state transition function of a chunk, as the state that each state leads to."""
    f = IDENTITY
    for _, symbol, _, between in events:
        f = f.translate(TO[4 * symbol + between])
    return f.translate(EDGE[edge])[:STATES]


def compose(first: bytes, then: bytes) -> bytes:
    """The function of two chunks in order."""
    return first.translate(then.ljust(256, b"\0"))


def _ends_here(symbol: int, ctx: int) -> bool:
    if symbol in (S_ALWAYS, S_BLANK):
        return True
    if symbol == S_PLAIN:
        return ctx not in (L, C)
    return ctx in (U, E) if symbol == S_ELLIPSIS else ctx in (U, K, SMALL_K, J, E)


def replay(events: list[Event], edge: int, state: int, own: Right, after: Right) -> list[int]:
    """The ends of sentences among a chunk's ``events``, entered in ``state``; ``own`` is :func:`right_of` the chunk, ``after`` what
    follows it."""
    ends: list[int] = []
    # For each style, whether a quotation that is open at the chunk's end is closed: by a mark, or where the text breaks off.
    broken = (after.marks >> _TAIL & 3 or own.marks >> _TAIL & 3) == 2
    closed = [False] + [after.marks >> 2 * i & 3 in ((0, 1) if broken else (1,)) for i in range(5)]
    ahead = [closed] * len(events)
    for i in range(len(events) - 1, -1, -1) if state >= 9 or any(e[1] >= Q_OPEN_E for e in events) else ():
        symbol = events[i][1]
        ahead[i] = closed
        if symbol >= Q_OPEN_E:
            closed = closed[:]
            for style in range(1, 6):
                if symbol in _CLOSED_BY[style]:
                    closed[style] = True
                elif _OPENS.get(symbol) == style:
                    closed[style] = False
    words = False  # there are some since the last end
    moved = False  # the last event ended a sentence, and its end may still move to a closing mark
    for (end, symbol, ctx, between), closed in zip(events, ahead, strict=True):
        code = 4 * symbol + between
        does = DOES[code][state]
        words = words or between == WORDS
        if does:
            ctx = after.cls if ctx == PASS else ctx
            if ctx == KP:
                ctx = K if after.said == 1 else SMALL_K
            ctx = E if ctx == PASS else ctx
        if does == ENDING:
            moved = words if symbol == S_TEXT_END else not (state >= 9 and closed[state // 9]) and _ends_here(symbol, ctx)
        elif does == CLOSING:
            moved = ctx in (U, D, E, SMALL_K)
        elif does == STRAY:
            if moved:
                ends.pop()
            moved = True
        elif symbol >= Q_OPEN_E:
            moved = False
        if does and moved:
            ends.append(end)
            words = False
        state = TO[code][state]
    if moved and state < 9 and events[-1][1] != S_TEXT_END and after.marks >> _HEAD & 3 == 1 and EDGE[edge][state] == E1:
        ends.pop()  # it moves to the closing mark at the head of what follows
    return ends


def cut_text(text: str, chunk: int = 0) -> Iterator[tuple[int, int]]:
    """Where the chunks of a complete text begin and end, each of ``chunk`` characters (:data:`CHUNK` if 0) or more; the last
    has a letter."""
    chunk = chunk or CHUNK
    begin = 0
    while begin < len(text):
        m = _CUT.search(text, begin + chunk)
        end = m.end() if m else len(text)
        yield begin, end
        begin = end


def whole_text_ends(text: str | None) -> list[int]:
    """The ends of the sentences of a complete text, as numbers of characters; none without a letter or digit."""
    if not text or not _ALNUM.search(text):
        return []
    if len(text) <= CHUNK:
        events = scan_events(text, True, True)
        return replay(events, EDGE_AT_END, START, Right(E, 0, _tail_of(text) << _TAIL), END)
    parts = [text[a:b] for a, b in cut_text(text)]
    return chunk_ends(parts, True)


def chunk_ends(parts: list[str], whole: bool) -> list[int]:
    """The ends of the sentences of a text in chunks, as characters of the chunks together; one after the other."""
    scanned = [scan_events(t, whole, whole and i + 1 == len(parts)) for i, t in enumerate(parts)]
    own = [right_of(t, e) for t, e in zip(parts, scanned, strict=True)]
    after = [END] * len(parts)
    for i in range(len(parts) - 2, -1, -1):
        after[i] = own[i + 1].then(after[i + 1])
    out, state, begin = [], START, 0
    for t, e, o, x in zip(parts, scanned, own, after, strict=True):
        edge = edge_of(t, e)
        out += [begin + end for end in replay(e, edge, state, o, x)]
        state = function_of(e, edge)[state]
        begin += len(t)
    return out
