from __future__ import annotations

import json
import random

from tests.conftest import rows
from textloom.llm import leaks
from textloom.llm.leaks import LeakFinder, find_leaks

RND = random.Random(9)
VOCAB = ["".join(RND.choice("bdfgklmnprstvz") + RND.choice("aeiou") for _ in range(RND.randrange(1, 5))) for _ in range(400)]
ITEMS = [(i, " ".join(RND.choice(VOCAB) for _ in range(40)) + ".") for i in range(12)]
HAN = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
ITEMS += [(100 + i, "".join(RND.choice(HAN) for _ in range(80)) + "。") for i in range(4)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(doc, item, least):
    """Whether a run of ``least`` or more units of the item is in the document with one change in ten."""
    for n in range(least, len(item) + 1):
        k = n // 10
        for i in range(len(item) - n + 1):
            part = item[i : i + n]
            for d in range(len(doc)):
                for m in range(max(1, n - k), n + k + 1):
                    got = doc[d : d + m]
                    if len(got) == m and got[0] == part[0] and got[-1] == part[-1] and edits(part, got) <= k:
                        return True
    return False


def changed(words, times):
    words = list(words)
    for _ in range(times):
        i = RND.randrange(1, len(words) - 1)
        kind = RND.randrange(3)
        if kind == 0:
            words[i] = "changed" + str(RND.randrange(99))
        elif kind == 1:
            del words[i]
        else:
            words.insert(i, "added" + str(RND.randrange(99)))
    return words


def test_finder_equals_brute_force():
    finder = LeakFinder(ITEMS[:3])
    for _ in range(40):
        key, text = RND.choice(ITEMS[:3])
        words = text.rstrip(".").split()
        n = RND.randrange(12, 24)
        at = RND.randrange(len(words) - n)
        doc = [RND.choice(VOCAB) for _ in range(5)] + changed(words[at : at + n], RND.randrange(4)) + [RND.choice(VOCAB) for _ in range(5)]
        assert (key in finder.search(" ".join(doc))) == brute(doc, words, 15)


def test_forms(spark):
    w = ITEMS[0][1].split()[5:25]
    html = "<p>Intro text here.</p><p>" + "\n".join(x.upper() if i % 3 else f"<b>{x}</b>," for i, x in enumerate(w)) + "</p>"
    srt = "".join(f"{i + 1}\n00:00:0{i},100 --> 00:00:0{i},900\n{' '.join(w[4 * i : 4 * i + 4])}\n\n" for i in range(5))
    js = '[{"id": "seg_0000", "text": "' + " ".join(w[:9]) + '"}, {"id": "seg_0001", "text": "' + " ".join(w[9:]) + '"}]'
    han = ITEMS[12][1]
    cjk = "x\n\n1\n00:00:01,000 --> 00:00:02,000\n" + han[10:25] + "，\n\n2\n00:00:03,000 --> 00:00:04,000\n" + han[25:45]
    docs = [(1, html), (2, srt), (3, js), (4, cjk), (5, " ".join(w[:14])), (6, han[:29]), (7, None), (8, ""), (9, ITEMS[1][1] + " " + ITEMS[2][1]), (1, html), (10, "filler words only. " * 3000 + " ".join(w))]
    df = spark.createDataFrame(docs, "k long, t string").selectExpr("*", "'x' AS doc_key", "3 AS text")
    items = spark.createDataFrame([*ITEMS, (900, None), (901, "short"), (902, "")], "i long, x string")
    want = [(1, 0), (1, 0), (2, 0), (3, 0), (4, 100), (9, 1), (9, 2), (10, 0)]
    assert rows(find_leaks(df, "k", "t", items, "i", "x"), "doc_key", "item_key") == sorted(want, key=repr)
    assert rows(find_leaks(df.limit(0), "k", "t", items, "i", "x")) == [] and rows(find_leaks(df, "k", "t", items.limit(0), "i", "x")) == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    docs = spark.createDataFrame([(i, t) for i, t in ITEMS], "k long, t string")
    items = spark.createDataFrame(ITEMS, "i long, x string")
    assert rows(find_leaks(docs, "k", "t", items, "i", "x"), "doc_key", "item_key") == sorted(((i, i) for i, _ in ITEMS), key=repr)


def test_other_scripts():
    text = "Слова этого длинного отрывка стоят здесь друг за другом и ничего не значат для того кто их читает вслух сегодня"
    finder = LeakFinder([(1, text)])
    assert finder.search("До. " + text.upper() + " После.") == {1: 20}


def test_units_are_of_the_largest_passage():
    """A part of 15 words (30 characters) first and the whole item later: the whole counts."""
    finder = LeakFinder(ITEMS)
    words, han = ITEMS[0][1].rstrip(".").split(), ITEMS[12][1].rstrip("。")
    doc = " ".join(words[20:35]) + ". Other words of another text here. " + " ".join(words) + "."
    assert finder.search(doc) == {0: 40} and finder.search(doc, largest=False) == {0: 15}
    doc = han[40:70] + "。别的文字写在这里" + han + "。"
    assert finder.search(doc) == {100: 80} and finder.search(doc, largest=False) == {100: 30}


def test_escaped_scripts():
    """Chinese only as JSON escapes or HTML entities is found too."""
    finder = LeakFinder(ITEMS)
    han = ITEMS[12][1]
    for doc in (json.dumps([{"id": "seg_0000", "text": han}]), "<p>" + "".join(f"&#{ord(c)};" for c in han) + "</p>", "<p>" + "".join(f"&#x{ord(c):x};" for c in han) + "</p>"):
        assert doc.isascii() and finder.search(doc) == {100: 80}


def test_items_of_other_scripts_change_nothing():
    """Words in other scripts count as added words, whatever the other items are."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    doc = item.replace(" ", " слово слово ")
    russian = "раз два три четыре пять шесть семь восемь девять десять " * 2
    assert LeakFinder([(1, item)]).search(doc) == LeakFinder([(1, item), (2, russian)]).search(doc) == {}
    near = item.replace("ten ", "ten слово ")
    assert LeakFinder([(1, item)]).search(near) == LeakFinder([(1, item), (2, russian)]).search(near) == {1: 19}
