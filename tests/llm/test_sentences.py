from __future__ import annotations

import random

import pytest

from tests.conftest import rows
from textloom.llm import boundaries as B
from textloom.llm import sentences
from textloom.llm.sentences import run_on_ends, run_on_units, whole_text_ends, whole_text_units

GOLDEN = {
    "See p. 100 and fig. 6: the painter forgot the key. At 3 a.m. the postman left.": 2,
    "Some things, e.g. the bread, etc. After noon, he left. According to Dr. Kalbrin, it is 7.6 long.": 3,
    "“Wait! Do not go!” called the miller. “Stop!” The miller left.": 3,
    "„Warte! Geh nicht!“, rief die Sängerin. Am 3. März kam z. B. die Uhr usw. Der Weg ist 1,6 Kilometer lang.": 3,
    "« Attends ! Ne pars pas ! » cria l'horloger. Voir p. 147 et fig. 10 : la tante !": 2,
    "«Подожди! Не уходи!» — крикнул сосед. По словам проф. Велма, в 5 ч. утра и т. д. Ну... садовник ушёл.": 3,
    "“等等！别走！”医生在磨坊后面喊道。嗯……昨天年轻的厨师来了！": 2,
    "「待って！行かないで！」と船長は叫びました。その道は5.9キロです？！": 2,
    "邮差在学校旁边 老师买下了信": 2,
    "Well... the doctor left! What?! Yes": 3,
    "- Hola.\n- ¿Qué tal": 2,
    "…": 0,
    "": 0,
    "Cut off in the": 1,
    "Yes. ... No.": 2,
}


@pytest.mark.parametrize("text", GOLDEN)
def test_whole_texts(text):
    ends = B.whole_text_ends(text)
    assert len(ends) == GOLDEN[text], [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert ends == sorted(set(ends)) and (not ends or ends[-1] == len(text.rstrip()))


WORDS = ["“Wait!", "go!”", "called", "the", "man.", "Dr.", "Who", "etc.", "At", "3", "3.", "am", "Am", "31.", "a.", "a.m.", "m.", "z.", "B.", "等等！", "”", "说", "了。", "...", "…", "and", "«Ну", "да.»", "да!", "»", "— он", '"Yes."', '"', "„Geh", "nicht!“", "Next?", "т.", "д.", "и", "(No.)", "「待って！", "行かないで！」と", "!”", "?!", ") ", "- Hi", "と", "\n", "12", "5", "E.", "Kap."]


def random_text(rnd, n):
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(n))


def sequential(texts):
    """The ends in each of the texts joined by blanks, read as one."""
    joined = B.chunk_ends(["\n".join(x or "" for x in texts)], False)
    out, begin = [], 0
    for t in texts:
        n = len(t or "")
        out.append([e - begin for e in joined if begin < e <= begin + n])
        begin += n + 1
    assert sum(map(len, out)) == len(joined)
    return out


def test_every_cut_at_blanks_gives_the_ends_of_the_whole():
    rnd = random.Random(11)
    for _ in range(3000):
        text = random_text(rnd, rnd.randrange(1, 14))
        places = [i + 1 for i, c in enumerate(text) if c.isspace() and i + 1 < len(text)]
        cuts = sorted(rnd.sample(places, rnd.randrange(len(places) + 1)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert B.chunk_ends(parts, False) == B.chunk_ends([text], False), (text, cuts)


def test_complete_texts_in_chunks_have_the_same_ends():
    rnd = random.Random(12)
    fill = ["the man", "老师买下了信在学校旁边", "он ушёл", "der Hafen"]
    for _ in range(2000):
        text = "".join(rnd.choice(WORDS + 6 * fill) + rnd.choice([" ", " ", " ", "", "\n"]) for _ in range(rnd.randrange(1, 30)))
        if not any(c.isalnum() for c in text):
            continue
        cuts = list(B.cut_text(text, 3))
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
        assert B.chunk_ends([text[a:b] for a, b in cuts], True) == B.whole_text_ends(text), (text, cuts)


def test_rows_are_read_as_one_text():
    assert sequential(["He waited.", "... Then he left."]) == [[10], [17]]
    assert sequential(["Am", "7. Mai kam er. Er ging."]) == [[], [14, 23]] and sequential(["At", "7. Then"]) == [[], [2]]
    assert sequential(["« Attends !", "» cria l'homme. Voir"]) == [[], [15]] and sequential(["Attends !", "» Il part."]) == [[], [1, 10]]


def test_quotations_of_any_length():
    inside = "This is sentence number {}! "
    said = "“" + "".join(inside.format(i) for i in range(30)).strip() + "” said the man. He left."
    assert B.whole_text_ends(said) == [len(said) - 9, len(said)]
    never = "“" + "".join(inside.format(i) for i in range(8)).strip()
    assert len(B.whole_text_ends(never)) == 8
    assert len(B.whole_text_ends("“Wait! Do not go! Come")) == 1  # breaks off in a quotation
    assert len(B.whole_text_ends("“One. Two. “Three. Four.” said he.")) == 3


def test_composition_is_associative_and_exact():
    rnd = random.Random(5)
    chunks = [random_text(rnd, rnd.randrange(6)) + " " for _ in range(40)]
    functions = [B.function_of(e, B.edge_of(t, e)) for t in chunks for e in [B.scan_events(t, False)]]
    rights = [B.right_of(t, B.scan_events(t, False)) for t in chunks]

    def fold(fs):
        out = B.IDENTITY
        for f in fs:
            out = B.compose(out, f)
        return out

    def join(rs):
        out = B.EMPTY
        for r in reversed(rs):
            out = r.then(out)
        return out

    for cut in (0, 7, 23, 40):
        assert B.compose(fold(functions[:cut]), fold(functions[cut:])) == fold(functions)
        assert join(rights[:cut]).then(join(rights[cut:])) == join(rights)
    whole = "".join(chunks)
    e = B.scan_events(whole, False)
    assert B.function_of(e, B.edge_of(whole, e))[B.START] == fold(functions)[B.START]


@pytest.mark.parametrize("block", [2, 5, 512])
def test_scan_equals_reading_in_order(spark, monkeypatch, block):
    monkeypatch.setattr(sentences, "BLOCK", block)
    monkeypatch.setattr(sentences, "SUPER", 3)
    rnd = random.Random(block)
    data, want = [], {}
    for track in ("a", "b"):
        texts = [random_text(rnd, rnd.randrange(0, 5)) or None for _ in range(60)]
        keys = [len(data) + i for i in range(len(texts))]
        data += [(track, i, k, t) for i, (k, t) in enumerate(zip(keys, texts, strict=True))]
        for k, e in zip(keys, sequential(texts), strict=True):
            want[k] = e
    # Rows fetched twice count each; a row of no track stands for itself.
    data += [("a", 4, 1000, data[4][3]), (None, 1, 1001, "One. Two"), ("a", None, 1002, "Alone.")]
    want[1000] = want[4]
    want[1001], want[1002] = [4], [6]
    df = spark.createDataFrame(data, "t string, p long, k long, x string").selectExpr("*", "'z' AS track", "1 AS row_key")
    got = {k: [] for k in want}
    for _, _, k, e in rows(run_on_ends(df, "t", "p", "k", "x")):
        got[k].append(e)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_units(spark):
    data = [("a", 0, 1, "See Dr."), ("a", 1, 2, "Kalbrin. He said"), ("a", 1, 3, "He said twice"), ("a", 2, 4, None), ("a", 3, 5, "no! 船长"), ("a", 4, 6, "走了。 End")]
    df = spark.createDataFrame(data, "t string, p long, k long, x string")
    got = rows(run_on_units(df, "t", "p", "k", "x"), "sentence_no", "first_pos", "last_pos", "sentence")
    assert got == [(1, 0, 1, "See Dr. Kalbrin."), (2, 1, 3, "He said no!"), (3, 3, 4, "船长走了。"), (4, 4, 4, "End")]
    assert rows(run_on_units(df.limit(0), "t", "p", "k", "x")) == []
    assert rows(run_on_ends(df.limit(0), "t", "p", "k", "x")) == []


def test_whole_units(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, " "), (4, "…"), (1, "One. Two."), (5, "long text. " * 5000)], "k long, x string").selectExpr("k", "x", "0 AS sentence")
    got = rows(whole_text_units(df, "k", "x"))
    assert [g for g in got if g[0] == 1] == [(1, 1, 4, "One."), (1, 1, 4, "One."), (1, 2, 9, "Two."), (1, 2, 9, "Two.")]
    assert {g[0] for g in got} == {1, 5}


def test_long_texts_are_scanned_in_chunks(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["the man left.", "Dr. Who", "“Wait! Go!”", "he said", "Am 3. Mai", "等等！别走"]) for _ in range(n)) for n in (900, 5, 2000)]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[0])], "k long, x string")
    want = sorted([(i, e) for i in (0, 0, 1, 2) for e in B.replay(*(lambda ev, t: (ev, B.edge_of(t, ev), B.START, B.right_of(t, ev), B.END))(B.scan_events(texts[i], True, True), texts[i]))], key=repr)
    assert rows(whole_text_ends(df, "k", "x")) == want
    assert len(rows(whole_text_units(df.where("k = 2"), "k", "x"))) == len([w for w in want if w[0] == 2])
